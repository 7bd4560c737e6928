import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.functions import scalars as S
from tagweave.functions.vocabulary import EQUIPMENT_PREFIXES, PREFIX_TYPES


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_types_of_tags(spark):
    cases = {"": None, "   ": None, "-123": None, "  ft-101  ": "flow_transmitter", "PI 715A": "pressure_indicator", "PSV-501-A": "safety_valve", "FT101": "flow_transmitter", "PT-100": "pressure_transmitter", "P-100": "pump", "LIT-5": None, "MV-715-04B": "valve", "QQ-1": None, None: None}
    assert apply(spark, cases, S.type_of_tag) == list(cases.values())
    assert len(PREFIX_TYPES) == 45 and EQUIPMENT_PREFIXES == ["AC", "C", "E", "F", "P", "T"]


_PREFIX = re.compile(r"[\s-]")


@given(st.lists(st.text(alphabet="ABPTVFIC019 -\t\né", max_size=8), min_size=1, max_size=40))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_types_of_any_text(spark, values):
    def plain(v):
        first = _PREFIX.split(v.strip())[0]
        letters = re.sub("[0-9]+$", "", first.upper())
        return PREFIX_TYPES.get(letters if letters else first.upper())

    assert apply(spark, values, S.type_of_tag) == [plain(v) for v in values]


def test_categories(spark):
    kinds = [None, "unknown", "safety_valve", "pump", "filter", "equipment", "turbine", "pressure_indicator"]
    assert apply(spark, kinds, S.coarse6) == [None, "unknown", "valve", "pump", "instrument", "instrument", "instrument", "instrument"]
    assert apply(spark, kinds, S.coarse3) == [None, None, "valve", "equipment", "equipment", "equipment", "instrument", "instrument"]
    assert apply(spark, kinds, S.coarse3_or_unknown)[:2] == ["unknown", "unknown"]
    assert apply(spark, ["circle", "x", None], S.type_of_kind) == ["instrument", "unknown", "unknown"]
    names = ["Gate Valve", "equipment", "Blower", "Drum pump", "Rotameter", "Arrow", None]
    assert apply(spark, names, S.type_of_class) == ["valve", "equipment", "compressor", "pump", "instrument", "unknown", None]


def test_a_tag_s_type_must_not_contradict_the_outline(spark):
    rows = [("FT-101", "rectangle", None, "tank"), ("PI 715A", "circle", None, "pressure_indicator"), ("FT-101", "odd", None, "flow_transmitter"), (None, "bowtie", None, "valve"), ("V-1", "circle", "valve", "valve"), ("QQ-1", "x", None, "unknown"), ("P-1", "gate_valve", "", "pump"), ("", "circle", None, "instrument")]
    df = spark.createDataFrame(rows, "tag string, kind string, o string, want string")
    assert all(r.got == r.want for r in df.select("want", S.component_type(F.col("tag"), F.col("kind"), F.col("o")).alias("got")).collect())


def number(text):
    plain = (text or "").replace(",", "").strip()
    try:
        return float(plain) if text is not None else None
    except ValueError:
        return None


def test_numbers(spark):
    values = ["275", " 1,275 ", "1e3", ".5", "5.", "1_000", "1__0", "n/a", "", "1d", "5f", "-inf", "NaN", "+7", "0x10", None]

    got, want = apply(spark, values, S.to_float), [number(v) for v in values]
    assert [str(g) for g in got] == [str(w) for w in want]


@given(st.lists(st.text(alphabet="0123456789.,eE+-_ xnaif", max_size=7), min_size=1, max_size=60))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_numbers_of_any_text(spark, values):
    assert [str(g) for g in apply(spark, values, S.to_float)] == [str(number(v)) for v in values]


def test_digits_ranges_tags(spark):
    assert apply(spark, ["3/75", "x", "", None], S.digits) == ["375", None, None, None]
    assert apply(spark, ["1-25", "-20", " -20-5", "125", "3/75", "-"], S.is_range) == [True, False, True, False, False, False]
    assert apply(spark, [" pi\t 715a "], S.normal_tag) == ["PI 715A"]
    assert apply(spark, ["P=745", "AC—746", "a/b–c"], S.plain_separators) == ["P-745", "AC-746", "a-b-c"]
    assert apply(spark, ["unknown", "the tag is pi  715A.", "none here", "FT-101", None], S.loose_tag) == [None, "PI 715A", None, "FT-101", None]
    found = apply(spark, ["x mv-715-04b V-12, V-١٢ ABCDE-12 V-1 äV-101 (F-715A)"], lambda v: F.regexp_extract_all(F.upper(v), F.lit(S.BOUND_TAG), F.lit(1)))
    assert found == [["MV-715-04B", "V-12", "V-١٢", "F-715A"]]


def test_classification(spark):
    replies = ["valve, gate valve", "Instrument", "equipment, PUMP!", "unknown", "", "valve, spaceship", "pump", None]
    got = [(r.coarse, r.subtype) for r in apply(spark, replies, S.classification)]
    assert got == [("valve", "gate_valve"), ("instrument", None), ("equipment", "pump"), (None, None), (None, None), ("valve", None), (None, None), (None, None)]


@pytest.mark.parametrize("text", ["", "plain", "a\nb\tc", "it's", 'say "x"', "it's \"x\"", "back\\slash", "\x00\x1f\x7f", None])
def test_quoted(spark, text):
    assert apply(spark, [text], S.quoted) == [repr(text)]


def test_shown(spark):
    values = [275.0, 0.5, 12345678.0, -1e7, None]
    assert apply(spark, values, lambda v: S.shown(v, True), "double") == [str(v) for v in values]
