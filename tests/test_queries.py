import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tagweave.plans import queries as core

from .helpers import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    got = rows_of(core.QUERIES[name](spark, sf))
    assert got == oracle_rows(core.ORACLE_SQL[name], sf) and got


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["severity", "category", "message"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.QUERIES) <= set(entry.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['tagweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op1_')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
