"""Fixed vocabularies, and lookups in them as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes by what they stand for. Quantity letters come with the readouts that occur with them.
_BY_TYPE = {
    "valve": "V MV",
    "safety_valve": "PSV",
    "relief_valve": "PRV",
    "pressure_control_valve": "PCV",
    "emergency_shutdown_valve": "ESD",
    "pump": "P",
    "tank": "T",
    "compressor": "C",
    "filter": "F",
    "heat_exchanger": "AC E",
    "thermowell": "TW",
    "hand_off_auto_switch": "HOA",
    "flow_element": "FE",
    "flow_recorder": "FR",
    "level_gauge": "LG",
    "level_switch_high": "LSH",
    "level_switch_low": "LSL",
    "level_alarm_high": "LAH",
    "level_alarm_low": "LAL",
    "pressure_differential_indicator": "DPI PDI",
    "pressure_differential_transmitter": "DPT PDT",
    "pressure_differential_indicator_transmitter": "DPIT",
}
_QUANTITIES = {"F": "flow", "L": "level", "P": "pressure", "T": "temperature"}
_READOUTS = {"C": "controller", "I": "indicator", "IC": "indicator_controller", "IT": "indicator_transmitter", "T": "transmitter"}
_UNUSED = {"LIT"}

PREFIX_TYPES: dict[str, str] = {p: t for t, ps in _BY_TYPE.items() for p in ps.split()} | {q + r: f"{quantity}_{readout}" for q, quantity in _QUANTITIES.items() for r, readout in _READOUTS.items() if q + r not in _UNUSED}

KIND_TYPES = dict(zip(("bowtie", "circle", "circle_triangle", "rectangle"), ("valve", "instrument", "pump", "tank")))

#: Words of a procedure that declare a type; listed in the order that the pattern tries them.
KEYWORD_TYPES = {w: w for w in ("valve", "pump", "tank")} | {"vessel": "tank"} | {w: "instrument" for w in ("transmitter", "sensor")} | {"compressor": "compressor", "exchanger": "heat_exchanger"}

#: Parts of a detector's class names, the first that occurs decides.
CLASS_WORDS: list[tuple[str, str]] = (
    [("valve", "valve"), ("psv", "safety_valve"), ("prv", "relief_valve"), ("pump", "pump")]
    + [(w, "compressor") for w in ("compressor", "blower")]
    + [("turbine", "turbine"), ("exchanger", "heat_exchanger")]
    + [(w, "tank") for w in "tank vessel tower drum reactor".split()]
    + [(w, "instrument") for w in "indicator transmitter controller recorder gauge alarm meter rotameter".split()]
)

COARSE3 = ("valve", "instrument", "equipment")
EQUIPMENT_TYPES = ("compressor", "filter", "heat_exchanger", "pump", "tank")
EQUIPMENT_PREFIXES = sorted(p for p, t in PREFIX_TYPES.items() if t in EQUIPMENT_TYPES)
VALVE_BODIES = tuple(f"{b}_valve" for b in "ball butterfly check gate globe needle".split())
SUBTYPES = sorted({*PREFIX_TYPES.values(), *VALVE_BODIES, "heat_exchanger", "instrument", "pump", "tank", "valve"})

#: Classes of the first detection data set by number: 0 valve, 1 instrument, 2 equipment; others are left out.
CLASS_NUMBERS: dict[int, int] = {c: k for k, cs in enumerate(([*range(3), *range(4, 7), 8, *range(10, 14)], [*range(14, 19), *range(24, 32)], [19, 21, 22])) for c in cs}
#: Coarse class of a component type in merged data sets.
TYPE_CLASSES = {"instrument": 1} | {t: 0 for t in ("valve", "safety_valve", "relief_valve")} | {t: 2 for t in ("compressor", "heat_exchanger", "pump", "tank", "turbine")}


def lookup(key: Column, table: Mapping) -> Column:
    """The table's value for ``key``; null if it has none."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(key.isNotNull(), F.try_element_at(literal, key))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
