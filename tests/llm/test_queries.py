import pytest

import __spark_entry__ as entry

from .helpers import oracle_rows, rows_of

NAMES = sorted(n for n in entry.oracle_sql() if n.startswith("op"))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, name):
    assert rows_of(entry.queries()[name](spark, sf)) == oracle_rows(entry.oracle_sql()[name], sf)


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()
