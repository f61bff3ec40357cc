"""Every query with an oracle against DuckDB on the smallest tables: names, types and rows."""

import math

import duckdb
import pytest

from terrace import queries as registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_against_duckdb(spark, sf_dir, duck, name):
    df = registered.queries()[name](spark, sf_dir)
    found = duck.execute(registered.oracle_sql()[name])
    names = [x[0] for x in found.description]
    kinds = {x[0]: str(x[1]) for x in found.description}
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    theirs = in_order([tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()])
    ours = in_order([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(registered.queries().keys() - registered.oracle_sql().keys()))
def test_without_oracle_gives_rows(spark, sf_dir, name):
    assert registered.queries()[name](spark, sf_dir).count() > 0


def test_whole_joins_read_all_rows(spark, sf_dir):
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k).distinct().count() for t, k in keys.items()}
    made = registered.queries()
    full = made["join_full_whole"](spark, sf_dir)
    assert full.select("o_orderkey").dropna().distinct().count() == n["orders"]
    assert made["join_range_whole"](spark, sf_dir).select("l_orderkey", "l_linenumber").distinct().count() == n["lineitem"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
