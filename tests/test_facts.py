"""Set-based databases against the same changes stated fact by fact."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factspark.conn import create_conn
from factspark.db import DatomSource
from factspark.edn import Keyword as K
from factspark.facts import from_lines, init_facts
from factspark.operators.pull import pull
from factspark.query import q
from factspark.tx import TransactionError
from factspark.values import ANY, tagged, to_any, untagged

from .test_tx import SCHEMA


def frame(spark, rows, names="e a v"):
    kinds = {"e": "long", "t": "long", "id": "long", "a": "string", "v": ANY, "old": ANY, "new": ANY}
    plain = [tuple((tagged(x) if x is not None else None) if kinds[n] == ANY else x for n, x in zip(names.split(), r, strict=True)) for r in rows]
    return spark.createDataFrame(plain, ", ".join(f"{n} {kinds[n]}" for n in names.split()))


def held(facts):
    return {(r["e"], r["a"], untagged(r["v"])) for r in facts.df.collect()}


def same(facts, conn):
    assert held(facts) == {(d.e, d.a, d.v) for d in conn.db} and facts.df.count() == len(conn.db)


ROWS = [(31, ":code", "R"), (41, ":code", "V"), (41, ":year", 1710), (41, ":label", "blue"), (41, ":label", "rare"), (41, ":room", 31), (42, ":code", "C"), (42, ":serial", 77), (42, ":piece", 51), (51, ":piece", 52), (52, ":screw", 1), (31, ":near", 41), (31, ":near", 42)]


@pytest.fixture
def both(spark):
    """The same database twice: as a DataFrame, given with a repeated fact, and on the driver."""
    conn = create_conn(SCHEMA)
    conn.transact([[":db/add", e, K(a), v] for e, a, v in ROWS])
    return init_facts(frame(spark, [*ROWS, ROWS[0]]), SCHEMA), conn


def test_add_and_retract(spark, both):
    facts, conn = both
    new = [(41, ":year", 1711), (41, ":label", "old"), (41, ":label", "rare"), (43, ":shelf", 2), (43, ":slot", 4)]
    facts = facts.add(frame(spark, new))
    conn.transact([[":db/add", e, K(a), v] for e, a, v in new])
    same(facts, conn)
    assert facts.max_eid == conn.db.max_eid == 52
    facts = facts.retract(frame(spark, [(43, ":slot", 4)])).retract(frame(spark, [(41, ":label")], "e a"))
    conn.transact([[":db/retract", 43, K(":slot"), 4], [":db.fn/retractAttribute", 41, K(":label")]])
    same(facts, conn)
    assert conn.db.value(43, ":shelf+slot") == (2, None)


def test_retracted_entities_take_components_and_references(spark, both):
    facts, conn = both
    facts = facts.retract(frame(spark, [(42,), (99,)], "e"))
    conn.transact([[":db/retractEntity", 42]])
    same(facts, conn)
    assert {e for e, _, _ in held(facts)} == {31, 41}
    other = both[0].retract(frame(spark, [(42, ":piece")], "e a"))
    assert {e for e, _, _ in held(other)} == {31, 41, 42}


def test_upserts(spark, both):
    """Known by identity; two maps that share a new one; new numbers in order; references between maps."""
    facts, conn = both
    maps = [(-1, ":code", "V"), (-1, ":year", 5), (-2, ":code", "N"), (-2, ":room", -1), (-3, ":code", "N"), (-3, ":year", 6), (-4, ":year", 7), (42, ":year", 8)]
    after, ids = facts.upsert(frame(spark, maps, "t a v"))
    conn.transact([[":db/add", t, K(a), v] for t, a, v in maps])
    same(after, conn)
    assert {r["t"]: r["e"] for r in ids.collect()} == {-1: 41, -2: 53, -3: 53, -4: 54, 42: 42} and after.max_eid == 54
    with pytest.raises(TransactionError, match="one map"):
        facts.upsert(frame(spark, [(-1, ":code", "V"), (-1, ":code", "C")], "t a v"))


@pytest.mark.parametrize(("rows", "message"), [([(43, ":serial", 77)], "unique"), ([(41, ":year", 1), (41, ":year", 2)], "two values"), ([(41, ":shelf+slot", 1)], "composites")])
def test_refused(spark, both, rows, message):
    with pytest.raises(TransactionError, match=message):
        both[0].add(frame(spark, rows))


def test_cas(spark, both):
    facts, conn = both
    after = facts.cas(frame(spark, [(41, ":year", 1710, 1712), (42, ":height", None, 3)], "e a old new"))
    conn.transact([[":db.fn/cas", 41, K(":year"), 1710, 1712], [":db.fn/cas", 42, K(":height"), None, 3]])
    same(after, conn)
    for wrong in ((41, ":year", 1, 2), (41, ":year", None, 2), (42, ":year", 1, 2)):
        with pytest.raises(TransactionError, match="swap"):
            facts.cas(frame(spark, [wrong], "e a old new"))


def test_pull_rows(spark, both):
    facts, conn = both
    met = facts.pull_rows(frame(spark, [(42,), (31,)], "id")).collect()
    assert {(r["root"], r["e"], r["a"]) for r in met} == {(42, 42, ":code"), (42, 42, ":serial"), (42, 42, ":piece"), (42, 51, ":piece"), (42, 52, ":screw"), (31, 31, ":code"), (31, 31, ":near")}
    ring = init_facts(frame(spark, [(i, ":next", i % 6 + 1) for i in range(1, 7)] + [(i, ":n", i) for i in range(1, 7)]), {":next": {":db/valueType": ":db.type/ref"}})
    paths = {tuple(r["path"]) for r in ring.pull_rows(frame(spark, [(4,)], "id"), [":n"], [":next"]).collect()}
    assert paths == {(4, 5, 6, 1, 2, 3)[:k] for k in range(1, 7)}
    assert {r["e"] for r in ring.pull_rows(frame(spark, [(4,)], "id"), [":n"], [":next"], 2).collect()} == {4, 5, 6}
    assert pull(conn.db, "[*]", 42)[":piece"][0][":piece"][0][":screw"] == 1


def test_lines_and_lookups(spark, both):
    facts, conn = both
    assert held(from_lines(facts.to_lines(), SCHEMA)) == held(facts) and {r["a"]: r["n"] for r in facts.stats().collect()}[":label"] == 2
    source = DatomSource.of_frame(spark, facts.df, SCHEMA)
    text = '[:find ?c :where [?v :room [:code "R"]] [?v :code ?c]]'
    assert q(text, source, spark=spark) == q(text, conn.db, spark=spark) == {("V",)}
    empty = init_facts(frame(spark, []), SCHEMA)
    assert empty.max_eid == 0 and empty.add(frame(spark, ROWS[:2])).df.count() == 2 and empty.retract(frame(spark, [(1,)], "e")).df.count() == 0
    assert facts.add(frame(spark, [])).df.agg(F.count("*")).first()[0] == len(ROWS)


def test_pull_rows_broadcasts_nothing(spark, monkeypatch):
    """Levels, links and values are as large as the facts, however well their files compress; chains and a cycle of 30 entities."""
    from factspark import facts
    from factspark.sources import base

    seen = []

    def spy(df):
        seen.append((int(spark.conf.get("spark.sql.shuffle.partitions")), df._jdf.queryExecution().executedPlan().toString()))
        return base.materialise(df)

    monkeypatch.setattr(facts, "materialise", spy)
    monkeypatch.setattr(base, "ROWS_A_TASK", 10)
    boss = {k: k // 2 for k in range(2, 31)} | {1: 3}
    text, ref = (lambda c: to_any(c, "string").cast(ANY)), (lambda c: to_any(c, "long").cast(ANY))
    people = spark.range(1, 31).select(F.col("id").alias("e"), F.lit(":name").alias("a"), text(F.concat(F.lit("n"), "id")).alias("v"))
    over = spark.createDataFrame(sorted(boss.items()), "e long, t long").select("e", F.lit(":boss").alias("a"), ref(F.col("t")).alias("v"))
    f = init_facts(people.unionByName(over), {":boss": {":db/valueType": ":db.type/ref"}})
    met = f.pull_rows(f.df.filter("a = ':name'").select(F.col("e").alias("id")), [":name"], [":boss"])
    got = {(r["root"], tuple(r["path"])): r["name"] for r in met.select("root", "path", F.col("v.str").alias("name")).collect()}
    expected = {}
    for k in range(1, 31):
        path = [k]
        while True:
            expected[k, tuple(path)] = f"n{path[-1]}"
            if boss[path[-1]] in path:
                break
            path.append(boss[path[-1]])
    assert got == expected
    assert not any("Broadcast" in plan for _, plan in [*seen, (0, met._jdf.queryExecution().executedPlan().toString())])
    assert max(n for n, _ in seen) >= len(expected) // 10
