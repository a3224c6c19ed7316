"""Every query over the whole smallest tables, against its SQL in DuckDB where it has one."""

import importlib.util
import math
from pathlib import Path

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.7g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    lists = [sorted([plain(int(v) if isinstance(v, float) and v.is_integer() else v) for v in r] for r in df[columns].itertuples(index=False)) for df in (got, want)]
    assert lists[0] == lists[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_nothing_outside_llm_imports_it():
    root = Path(__spark_entry__.__file__).parent
    for f in [*root.glob("plinth/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in f.relative_to(root).parts and f.name != "test_queries.py":
            assert "plinth.llm" not in f.read_text(), f
    assert importlib.util.find_spec("plinth.plans.registry")
