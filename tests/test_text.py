import pytest

from tagweave.operators import text as T
from tagweave.plans.queries import HEADERS, KNOWN, TABLES

STEPS = """Start-up
1. Open V-101 valve and check tank T-101 level.
2. Pump P-101 connects to
 V-101 before start.
3. Transmitter FT-101 discharges into T-101. pump T-101 is shut.
4. P-101 feeds into P-101. A-10 flows from the header to B-20 connected to C-30.
5. Check PSV-201."""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, full_text string")


def test_facts(spark):
    d = docs(spark, STEPS, None, "")
    assert {r.tag for r in T.referenced_tags(d).collect()} == {"V-101", "T-101", "P-101", "FT-101", "A-10", "B-20", "C-30", "PSV-201"}
    assert {r.tag: r.declared_type for r in T.declared_types(d).collect()} == {"V-101": "valve", "T-101": "pump", "P-101": "pump", "FT-101": "instrument"}
    assert {(r.a, r.b) for r in T.stated_connections(d).collect()} == {("P-101", "V-101"), ("FT-101", "T-101"), ("A-10", "B-20")}


def test_the_last_declaration_wins_across_documents(spark):
    d = docs(spark, "tank T-1 x pump T-12", "vessel T-12 (T-12 (pump)) sensor T-12")
    assert {r.tag: r.declared_type for r in T.declared_types(d).collect()} == {"T-12": "instrument"}


def test_limits(spark):
    rows = T.equipment_limits(spark.createDataFrame([*TABLES, ("e", []), ("n", None), ("o", [[], [["only header", "pressure"]]])], "doc_id string, tables array<array<array<string>>>")).collect()
    got = [(r.tag, r.pressure_psig, r.temperature_f) for r in sorted(rows, key=lambda r: (r.doc_id, r.table_no, r.row_no))]
    assert got == [("F-310", 265.0, "95"), ("E-350", 310.0, "385"), ("E-350", 310.0, "245"), ("P-1000", None, None), ("V-320", 1265.0, None), ("ZZ-12", None, "-20/400")]


@pytest.mark.parametrize("known", [True, False])
def test_title_blocks(spark, known):
    heads = spark.createDataFrame([*HEADERS, (9, "f-/153 a design: 10.5 psig"), (10, "WORKING: 210 PSIG DESIGN: 255 PSIG @ -20 TO 100F E—350")], "page int, text string")
    vocabulary = spark.createDataFrame([(t,) for t in KNOWN], "tag string") if known else None
    got = {r.tag: (r.design_pressure_psig, r.design_temperature_f) for r in T.title_limits(heads, vocabulary).collect()}
    if known:
        assert got == {"F-310": (10.5, None), "V-320": (None, None), "MV-330": (240.0, "85"), "MV-331": (240.0, "85"), "AC-340": (265.0, "95"), "E-350": (255.0, "-20 TO 100")}
    else:
        assert got["MV"] == (240.0, "85") and got["E"] == (255.0, "-20 TO 100") and set(got) == {"F", "V", "MV", "AC", "E"}


def test_first_success(spark):
    rows = [(0, 1, 0, " x "), (0, 1, 1, "see mv-701 now"), (0, 1, 2, "MV-702"), (0, 2, 0, "abc"), (0, 2, 1, ""), (0, 3, 0, None), (0, 3, 1, " ")]
    got = {r.ord: (r.tag, r.raw_text) for r in T.first_success(spark.createDataFrame(rows, "page int, ord bigint, attempt int, raw_text string")).collect()}
    assert got == {1: ("MV-701", "see mv-701 now"), 2: (None, "abc"), 3: (None, "")}
