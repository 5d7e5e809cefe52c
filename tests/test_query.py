"""Queries over a small fleet, as facts, as a database and as tables; expectations are worked out in plain Python."""

from __future__ import annotations

import statistics

import pytest

from factspark.conn import conn_from_datoms, create_conn
from factspark.edn import Keyword as K
from factspark.edn import read
from factspark.plans.syntax import QueryError
from factspark.query import q, q_df

#: number -> hull, crew, harbour; crew or harbour may lack.
FLEET = {11: ("brig", 24, 71), 12: ("sloop", 9, 71), 13: ("brig", 40, 72), 14: ("yawl", 4, None), 15: ("sloop", None, 72), 16: ("brig", 24, 73)}
HARBOURS = {71: "Aber", 72: "Brest", 73: "Cork"}
HULL = {n: h for n, (h, _, _) in FLEET.items()}
CREW = {n: c for n, (_, c, _) in FLEET.items() if c is not None}
HOME = {n: p for n, (_, _, p) in FLEET.items() if p is not None}
FACTS = [(n, K(f":{a}"), v) for a, d in (("hull", HULL), ("crew", CREW), ("home", HOME), ("port", HARBOURS)) for n, v in d.items()]


@pytest.fixture(scope="module")
def ask(spark):
    return lambda text, *more: q(text, FACTS, *more, spark=spark)


def test_patterns_and_joins(ask):
    assert ask("[:find ?s :where [?s :crew]]") == {(n,) for n in CREW}
    assert ask('[:find ?s ?c :where [?s :hull "brig"] [?s :crew ?c]]') == {(n, CREW[n]) for n in CREW if HULL[n] == "brig"}
    assert ask("[:find ?s ?p :where [?s :home ?h] [?h :port ?p]]") == {(n, HARBOURS[h]) for n, h in HOME.items()}
    assert ask("[:find ?s ?t :where [?s :home ?h] [?t :home ?h] [(< ?s ?t)]]") == {(s, t) for s in HOME for t in HOME if HOME[s] == HOME[t] and s < t}
    assert ask("[:find ?s ?t :where [?s :crew ?c] [?t :crew ?d] [(< ?c ?d)]]") == {(s, t) for s in CREW for t in CREW if CREW[s] < CREW[t]}
    assert ask("[:find ?a ?v :where [14 ?a ?v]]") == {(K(":hull"), "yawl"), (K(":crew"), 4)}


def test_inputs(ask, spark):
    assert ask("[:find ?s :in $ ?h ?c :where [?s :hull ?h] [?s :crew ?c]]", "brig", 24) == {(11,), (16,)}
    assert ask("[:find ?s :in $ [?h ...] :where [?s :hull ?h]]", ["yawl", "raft"]) == {(14,)}
    assert ask("[:find ?s :in $ [?h ...] :where [?s :hull ?h]]", []) == set()
    assert ask("[:find ?s ?fee :in $ [[?h ?fee]] :where [?s :hull ?h]]", [["sloop", 5], ["yawl", 2]]) == {(12, 5), (15, 5), (14, 2)}
    limits = {K(":small"): [1, 10], K(":large"): [30, 99]}
    assert ask("[:find ?k ?s :in $ [[?k [?lo ?hi]] ...] :where [?s :crew ?c] [(<= ?lo ?c ?hi)]]", limits) == {(K(":small"), 12), (K(":small"), 14), (K(":large"), 13)}
    assert q("[:find ?x ?y :in [?x ...] [?y ...] :where [(< ?x ?y)]]", [4, 6], [5, 7], spark=spark) == {(4, 5), (4, 7), (6, 7)}
    assert q("[:find ?z :in ?x :where [(* ?x 3 2) ?z]]", 7, spark=spark) == {(42,)}
    assert q("[:find ?n :where [(ground [8 9]) [?n ...]] [(odd? ?n)]]", spark=spark) == {(9,)}
    assert q("[:find ?x :in [[_ ?x]]]", [[1, "a"], [2, "a"]], spark=spark) == {("a",)}


def test_negation_and_choice(ask):
    assert ask("[:find ?s :where [?s :hull] (not [?s :home _])]") == {(14,)}
    assert ask("[:find ?s :where [?s :hull] (not [?s :crew ?c] [(> ?c 20)])]") == {(12,), (14,), (15,)}
    assert ask('[:find ?h :where [?h :port] (not-join [?h] [?s :home ?h] [?s :hull "brig"] [?s :crew 24])]') == {(72,)}
    assert ask('[:find ?s :where (or [?s :hull "yawl"] [?s :crew 9])]') == {(12,), (14,)}
    assert ask('[:find ?s :where (or (and [?s :hull "brig"] [?s :crew 40]) (and [?s :hull "sloop"] [?s :home 72]))]') == {(13,), (15,)}
    assert ask('[:find ?s :where [?s :crew ?c] (or-join [?s] (and [?s :home ?h] [?h :port "Aber"]))]') == {(11,), (12,)}
    assert ask("[:find ?s :where [?s :hull] [(missing? $ ?s :crew)]]") == {(15,)}
    assert ask("[:find ?s ?c :where [?s :hull] [(get-else $ ?s :crew 0) ?c]]") == {(n, CREW.get(n, 0)) for n in HULL}


def test_types_differ(spark):
    rows = [(i, K(":load"), v) for i, v in enumerate((7, 7.0, "7", True, K(":seven")))]
    for i, value in enumerate((7, 7.0, "7", True, K(":seven"))):
        assert q("[:find ?e :in $ ?v :where [?e :load ?v]]", rows, value, spark=spark) == {(i,)}
    assert q("[:find ?a ?b :in [?a ...] [?b ...] :where [(= ?a ?b)]]", [7], [7.0], spark=spark) == set()
    assert q("[:find ?a :in [[?a]] :where [(< 5 ?a)]]", [[6], ["six"], [-6]], spark=spark) == {(6,), ("six",)}


@pytest.mark.parametrize(
    ("query", "inputs", "message"),
    [
        ("[:find ?s :where [?s :crew] [(> ?c 1)] [?s :crew ?c]]", (), "unbound"),
        ("[:find ?s :where (not [?s :crew 4]) [?s :hull]]", (), "unbound"),
        ("[:find ?s :where [?s :crew ?c] [(sinks ?c)]]", (), "no predicate"),
        ("[:find ?s ?d :where [?s :crew ?c] [(sink ?c) ?d]]", (), "no function"),
        ("[:find ?s :where (or [?s :crew ?c] [?s :hull ?h])]", (), "different variables"),
        ("[:find ?s :in $ ?z :where [?s :crew]]", (), "not enough"),
        ("[:find ?s :where [?s :crew]]", (1,), "too many"),
        ("[:find ?s :in $ % :where (sinks ?s)]", ("[[(sails ?s) [?s :crew]]]",), "no rule"),
        ("[:find ?lost :where [?s :crew]]", (), "nothing binds"),
        ("[:find ?s :keys a b :where [?s :crew]]", (), "differ in number"),
        ("[:find ?s :where (not)]", (), "no clauses"),
    ],
)
def test_refused(ask, query, inputs, message):
    with pytest.raises(QueryError, match=message):
        ask(query, *inputs)


def test_aggregates(ask, spark):
    crews = sorted(set(CREW.values()))
    assert ask("[:find (sum ?c) . :where [?s :crew ?c]]") == sum(crews)  # as sets: 24 counts once
    assert ask("[:find (sum ?c) . :with ?s :where [?s :crew ?c]]") == sum(CREW.values())
    assert ask("[:find (min ?c) (max ?c) (count ?c) :where [?s :crew ?c]]") == [(4, 40, 4)]
    (median, mean, var, dev), = ask("[:find (median ?c) (avg ?c) (variance ?c) (stddev ?c) :with ?s :where [?s :crew ?c]]")
    assert (median, mean) == (statistics.median(CREW.values()), statistics.mean(CREW.values()))
    assert (var, dev) == pytest.approx((statistics.pvariance(CREW.values()), statistics.pstdev(CREW.values())))
    assert sorted(ask("[:find ?h (max 2 ?s) (min 1 ?s) (count ?s) :where [?s :home ?h]]")) == [(71, (11, 12), (11,), 2), (72, (13, 15), (13,), 2), (73, (16,), (16,), 1)]
    assert ask("[:find (sum ?c) :where [?s :crew ?c] [(> ?c 99)]]") == [] and ask("[:find (sum ?c) . :where [?s :crew ?c] [(> ?c 99)]]") is None
    import pyspark.sql.functions as F

    assert ask("[:find (aggregate ?f ?c) . :in $ ?f :where [?s :crew ?c]]", lambda c: F.sum(c * c)) == sum(c * c for c in crews)


def test_shapes(ask, spark):
    assert sorted(ask("[:find [?p ...] :where [_ :port ?p]]")) == sorted(HARBOURS.values())
    assert ask('[:find [?s ?c] :where [?s :hull "yawl"] [?s :crew ?c]]') == [14, 4]
    assert ask("[:find ?h . :where [14 :hull ?h]]") == "yawl" and ask("[:find ?h . :where [99 :hull ?h]]") is None
    assert ask("[:find ?s ?h :keys ship at :where [?s :home ?h] [?s :crew 40]]") == [{"ship": 13, "at": 72}]
    assert q_df('[:find ?s ?h :strs "s" "h" :where [?s :home ?h]]', FACTS, spark=spark).columns == ["s", "h"]


#: Channels from lock to lock, with a loop at the end.
CHANNELS = [("a", "b"), ("b", "c"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "y")]


def closure(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("rule", ["[[(way ?a ?b) [?a ?b]] [(way ?a ?b) [?a ?t] (way ?t ?b)]]", "[[(way ?a ?b) [?a ?b]] [(way ?a ?b) (way ?a ?t) [?t ?b]]]", "[[(way ?a ?b) [?a ?b]] [(way ?a ?b) (way ?a ?t) (way ?t ?b)]]"])
def test_recursion(spark, rule):
    """Right, left and doubly recursive; free, and bound at either end by a constant, an input, a collection or another clause."""
    run = lambda text, *more: q(text, CHANNELS, rule, *more, spark=spark)
    every = closure(CHANNELS)
    assert run("[:find ?a ?b :in $ % :where (way ?a ?b)]") == every
    assert run('[:find ?b :in $ % :where (way "d" ?b)]') == {(b,) for a, b in every if a == "d"}
    assert run("[:find ?a :in $ % ?to :where (way ?a ?to)]", "e") == {(a,) for a, b in every if b == "e"}
    assert run("[:find ?a ?b :in $ % [?a ...] :where (way ?a ?b)]", ["a", "x", "no"]) == {(a, b) for a, b in every if a in "ax"}
    assert run('[:find ?a ?b :in $ % :where [?a "y"] (way ?a ?b)]') == {("x", "y")}


def test_rules_in_turn(spark):
    """Two rules that call each other: an even and an odd number of steps."""
    rules = "[[(odd ?a ?b) [?a ?b]] [(odd ?a ?b) [?a ?t] (even ?t ?b)] [(even ?a ?b) [?a ?t] (odd ?t ?b)]]"
    line = [(i, i + 1) for i in range(12)]
    assert q("[:find ?a ?b :in $ % :where (odd ?a ?b)]", line, rules, spark=spark) == {(a, b) for a in range(13) for b in range(a + 1, 13) if (b - a) % 2}
    assert q("[:find ?b :in $ % :where (even 3 ?b)]", line, rules, spark=spark) == {(b,) for b in range(5, 13, 2)}


def test_rules_over_sources(spark):
    crew = [(n, c) for n, c in CREW.items()]
    got = q("[:find ?s :in $ $c % :where [?s :hull _] ($c full ?s)]", FACTS, crew, "[[(full ?s) [?s ?c] [(>= ?c 24)]]]", spark=spark)
    assert got == {(n,) for n, c in CREW.items() if c >= 24}
    assert q("[:find ?a ?b :in $ % :where (linked ?a ?b)]", CHANNELS[:1], "[[(linked ?a ?b) [?a ?b]] [(linked ?a ?b) [?b ?a]]]", spark=spark) == {("a", "b"), ("b", "a")}


def test_long_chain(spark):
    rule = "[[(way ?a ?b) [?a ?b]] [(way ?a ?b) (way ?a ?t) [?t ?b]]]"
    line = [(i, i + 1) for i in range(45)]
    assert len(q("[:find ?a ?b :in $ % :where (way ?a ?b)]", line, rule, spark=spark)) == 46 * 45 // 2


def test_database(spark):
    conn = create_conn(read("{:callsign {:db/unique :db.unique/identity} :tows {:db/valueType :db.type/ref} :cargo {:db/cardinality :db.cardinality/many}}"))
    conn.transact(read('[{:db/id 21 :callsign "T1" :draught 3 :tows 22 :cargo ["salt" "tar"]} {:db/id 22 :callsign "T2" :draught 5 :tows 23} {:db/id 23 :callsign "T3" :draught 2.5}]'))
    run = lambda text, *more: q(text, conn.db, *more, spark=spark)
    assert run('[:find ?c :where [[:callsign "T1"] :tows ?b] [?b :callsign ?c]]') == {("T2",)}
    assert run('[:find ?c :where [?t :tows [:callsign "T3"]] [?t :callsign ?c]]') == {("T2",)}
    assert run("[:find ?d :in $ ?t :where [?t :draught ?d]]", [K(":callsign"), "T2"]) == {(5,)}
    assert run("[:find ?v ?tx :where [21 :cargo ?v ?tx]]") == {("salt", conn.db.max_tx), ("tar", conn.db.max_tx)}
    refs = [[K(":callsign"), "T1"], [K(":callsign"), "T3"]]
    assert run("[:find ?t ?d :in $ [?t ...] :where [?t :draught ?d]]", refs) == {((K(":callsign"), "T1"), 3), ((K(":callsign"), "T3"), 2.5)}
    light = conn.db.filter(lambda _, d: d.a != ":draught" or d.v < 4).filter(lambda _, d: d.e != 23)
    assert q("[:find ?t :where [?t :draught _]]", light, spark=spark) == {(21,)}
    with pytest.raises(QueryError, match="no entity"):
        run('[:find ?d :where [[:callsign "T9"] :draught ?d]]')
    assert run("[:find (pull ?t [:callsign]) . :where [?t :draught 5]]") == {":callsign": "T2"}
    assert run("[:find [(pull ?t ?p) ...] :in $ ?p :where [?t :cargo _]]", "[*]") == [{":db/id": 21, ":callsign": "T1", ":draught": 3, ":tows": {":db/id": 22}, ":cargo": ["salt", "tar"]}]
    df = q_df("[:find (pull ?t [:callsign (limit :cargo 1)]) :where [?t :draught _]]", conn.db, spark=spark)
    assert sorted((r[0]["callsign"], r[0]["cargo"]) for r in df.collect()) == [("T1", ["salt"]), ("T2", None), ("T3", None)]


def test_scans_are_pruned(spark):
    from factspark.sources import tpch_tables

    plan = q_df('[:find ?n :where [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_name ?n]]', tpch_tables(spark, "/root/testdata/sf0.001"), spark=spark)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan and plan.count("FileScan") == 1 and "c_acctbal" not in plan.split("FileScan")[1]


def test_functions_as_inputs(ask):
    from factspark.plans.compile import column_function

    halved = column_function("double")(lambda c: c / 2)
    assert ask("[:find ?s ?d :in $ ?f :where [?s :crew ?c] [(?f ?c) ?d]]", halved) == {(n, c / 2) for n, c in CREW.items()}
    assert ask("[:find ?s :in $ ?f :where [?s :crew ?c] [(?f ?c)]]", lambda c: c > 20) == {(n,) for n, c in CREW.items() if c > 20}


def test_order_of_tuples():
    db = conn_from_datoms([(1, ":at", (5, 6)), (2, ":at", (5, 6, 1)), (3, ":at", (2, 8))], {":at": {":db/index": True}}).db
    assert [d.v for d in db.index("avet")] == [(2, 8), (5, 6), (5, 6, 1)]
