"""Every core query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from factloom.plans import queries as core


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_rows(spark, duck, sf_dir, name):
    found = core.QUERIES[name](spark, sf_dir)
    want = duck.execute(core.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["unpaywall_order"])
def test_locations_take_all_pages(spark, duck, sf_dir, name):
    sql = core.ORACLE_SQL[name].replace(" WHERE page_id % 5 < 2", "")
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    found = core.QUERIES[name](spark, sf_dir)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, want.fetchall())
    if name == "unpaywall_order":
        assert found.count() == duck.execute("SELECT count(*) FROM pages").fetchone()[0]
