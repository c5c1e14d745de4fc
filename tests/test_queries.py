"""Every key-value query against its SQL at the smallest scale."""

import os
from decimal import Decimal

import duckdb
import pytest

from keyloom.plans import kv_queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return str(v.normalize())
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(kv_queries.queries()))
def test_query(spark, con, sf_dir, name):
    df = kv_queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = con.execute(kv_queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_contract_without_optional_parts(spark, sf_dir):
    import __spark_entry__ as e

    assert os.path.exists(sf_dir)
    assert set(kv_queries.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10


def test_scan_is_pushed_down(spark, sf_dir, capsys):
    from keyloom.operators import reads

    kv = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand as key", "p_name as value")
    reads.prefix_scan(kv, "Brand#1").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(p_brand,Brand#1)" in plan and "LessThan(p_brand,Brand#2)" in plan
    reads.scan_from(kv, "Brand#1", 5).explain("formatted")
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_scans_of_a_compacted_database_are_pushed_down(spark, sf_dir, capsys):
    for name, pushed in (("stored_get_one", "EqualTo(key,"), ("stored_range_scan", "GreaterThanOrEqual(key,"), ("stored_prefix_scan", "LessThan(key,"), ("stored_scan_from_100", "GreaterThanOrEqual(key,")):
        kv_queries.queries()[name](spark, sf_dir).explain("formatted")
        plan = capsys.readouterr().out
        filters = [line for line in plan.split("\n") if "PushedFilters" in line]
        assert filters and all(pushed in f for f in filters) and "Exchange" not in plan, plan


def test_long_values_come_back_whole(spark, tmp_path):
    values = ["v" * 5000, "é" * 1500, ""]
    spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r["value"] for r in kv_queries.queries()["transform_roundtrip"](spark, str(tmp_path)).collect()} == set(values)


def test_fold_writers_share_keys(con):
    shared = con.execute(f"SELECT count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT source) AS n FROM {kv_queries.WRITERS_LOG} GROUP BY key)").fetchone()[0]
    last_change = con.execute(kv_queries.LATEST.format(kv_queries.WRITERS_LOG, "")).fetchall()
    assert shared > 1 and sorted(con.execute(kv_queries.oracle_sql()["confluence_fold_writers"]).fetchall()) != sorted(last_change)
