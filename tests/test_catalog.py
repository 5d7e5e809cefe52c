"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from factspark.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, bool) or x is None:
        return x
    return round(float(x), 6) if isinstance(x, int | float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["name", "price"]


def test_rules_on_all_parts(spark, tmp_path):
    """The closure of a table beyond 200 parts, against brute force."""
    spark.range(1, 701).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    reach = {(k >> i, k) for k in range(1, 701) for i in range(1, k.bit_length() + 1)}
    assert {tuple(r) for r in QUERIES["rule_recursive"](spark, str(tmp_path)).collect()} == reach
    assert {r[0] for r in QUERIES["rule_const_arg"](spark, str(tmp_path)).collect()} == {b for a, b in reach if a == 3}


def test_whole_tables_take_part(spark):
    """Not only the first suppliers are joined, nor the first customers compared."""
    below = {r["a"] for r in QUERIES["theta_join"](spark, "/root/testdata/sf0.01").select("a").distinct().collect()}
    assert len(below) > 50
    sides = QUERIES["db_diff"](spark, SF).groupBy("side").count().collect()
    facts = 2 * spark.read.parquet(f"{SF}/customer.parquet").count()
    assert {r["side"] for r in sides} == {"a", "b", "both"} and sum(r["count"] for r in sides if r["side"] != "b") == facts


def test_theta_join_of_one_nation(spark, tmp_path):
    """All rows share one value: pairs are dealt out over tasks, and those with both keys are not made distinct again."""
    spark.range(60).selectExpr("id AS s_suppkey", "'s' AS s_name", "3 AS s_nationkey", "double(id * 37 % 60) AS s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(400).selectExpr("id AS c_custkey", "'c' AS c_name", "3 AS c_nationkey", "double(id * 53 % 400) / 7 AS c_acctbal", "'m' AS c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for t in set(TABLES) - {"supplier", "customer"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = QUERIES["theta_join"](spark, str(tmp_path))
        tasks = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
        expected = sorted((a, b) for a in range(60) for b in range(400) if a * 37 % 60 > b * 53 % 400 / 7)
        assert sorted(tuple(r) for r in df.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_closure_rounds(spark, monkeypatch):
    """Rounds over graphs with cycles and several paths: nothing is broadcast, and more rows go to more tasks."""
    from factspark.operators import rules
    from factspark.query import q_df
    from factspark.sources import base

    seen = []

    def spy(df):
        seen.append((int(spark.conf.get("spark.sql.shuffle.partitions")), "Broadcast" in df._jdf.queryExecution().executedPlan().toString()))
        return base.materialise(df)

    monkeypatch.setattr(rules, "materialise", spy)
    monkeypatch.setattr(base, "ROWS_A_TASK", 20)
    ring = [(i, (i + 1) % 11) for i in range(11)] + [(i, i + 2) for i in range(20, 40)] + [(3, 21), (5, 5), (30, 29), (29, 30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for rule in ("[[(reach ?a ?b) [?a ?b]] [(reach ?a ?b) [?a ?t] (reach ?t ?b)]]", "[[(reach ?a ?b) [?a ?b]] [(reach ?a ?b) (reach ?a ?t) (reach ?t ?b)]]"):
        seen.clear()
        got = [tuple(r) for r in q_df("[:find ?x ?y :in $ % :where (reach ?x ?y)]", spark.createDataFrame(ring, "a long, b long"), rule, spark=spark).collect()]
        reach = set(ring)
        while more := {(a, d) for a, b in reach for c, d in ring if b == c} - reach:
            reach |= more
        assert sorted(got) == sorted(reach)
        assert not any(b for _, b in seen) and max(n for n, _ in seen) >= len(reach) // 40 > int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
