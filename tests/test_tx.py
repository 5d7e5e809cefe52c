"""Transactions, index access, pull, entities and stores, over a museum's rooms and exhibits."""

from __future__ import annotations

import math

import pytest

from factspark.conn import conn_from_db, create_conn
from factspark.db import Datom, diff, empty_db, init_db, is_filtered
from factspark.edn import Keyword as K
from factspark.edn import read
from factspark.entity import datafy, entity, nav, squuid, squuid_time_millis
from factspark.operators.pull import pull, pull_many
from factspark.plans.syntax import QueryError
from factspark.serialize import from_edn, from_json, to_edn, to_json
from factspark.tx import TransactionError, db_with, resolve_tempid, tempid, with_tx

REF, MANY = {":db/valueType": ":db.type/ref"}, {":db/cardinality": ":db.cardinality/many"}
SCHEMA = {
    ":code": {":db/unique": ":db.unique/identity"}, ":serial": {":db/unique": ":db.unique/value"}, ":year": {":db/index": True}, ":label": MANY, ":room": REF, ":near": REF | MANY,
    ":piece": REF | MANY | {":db/isComponent": True}, ":shelf+slot": {":db/tupleAttrs": [":shelf", ":slot"], ":db/unique": ":db.unique/value"},
}


@pytest.fixture
def conn():
    """Room 31, vase 41 in it with two labels, clock 42."""
    c = create_conn(SCHEMA)
    c.transact([{":db/id": 31, ":code": "R"}, {":db/id": 41, ":code": "V", ":year": 1710, ":label": ["blue", "rare"], ":room": 31}, {":db/id": 42, ":code": "C", ":year": 1820, ":serial": 77}])
    return c


def changes(report):
    return [(d.e, d.a, d.v, d.added) for d in report.tx_data]


def labels(db, e=41):
    return sorted(db.values(e, ":label"))


def test_adding_and_retracting(conn):
    before = conn.db
    r = conn.transact(read('[[:db/add 41 :year 1711] [:db/add 42 :year 1820] [:db/add 41 :label "chipped"] nil [:db/retract 41 :label "blue"] [:db/retract 41 :label "absent"]]'))
    assert changes(r) == [(41, ":year", 1710, False), (41, ":year", 1711, True), (41, ":label", "chipped", True), (41, ":label", "blue", False)]
    assert labels(conn.db) == ["chipped", "rare"] and before.value(41, ":year") == r.db_before.value(41, ":year") == 1710
    conn.transact(read("[[:db.fn/retractAttribute 41 :label] [:db/retract 41 :year]]"))
    assert labels(conn.db) == [] and conn.db.value(41, ":year") is None


def test_retracting_an_entity_takes_its_pieces_and_references(conn):
    conn.transact([{":db/id": 42, ":piece": [{":hand": "long"}, {":hand": "short", ":piece": {":screw": 1}}], ":near": 41}])
    pieces = {d.e for d in conn.db} - {31, 41, 42}
    assert len(pieces) == 3
    conn.transact(read("[[:db/retractEntity 41]]"))
    assert not conn.db.values(42, ":near") and {d.e for d in conn.db} == {31, 42} | pieces
    conn.transact(read("[[:db.fn/retractEntity [:code \"C\"]]]"))
    assert {d.e for d in conn.db} == {31}


def test_temporary_ids_and_upserts(conn):
    r = conn.transact(read('[{:db/id -7 :code "M" :room "hall"} {:db/id "hall" :code "H"} [:db/add :db/current-tx :by "ann"]]'))
    mask, hall = r.tempids[-7], r.tempids["hall"]
    assert mask != hall and conn.db.value(mask, ":room") == hall and conn.db.value(conn.db.max_tx, ":by") == "ann"
    r = conn.transact(read('[{:db/id -1 :code "V" :year 1500} {:code "C" :year 1} [:db/add -1 :label "copy"]]'))
    assert r.tempids[-1] == 41 and conn.db.value(42, ":year") == 1 and labels(conn.db) == ["blue", "copy", "rare"]
    r = conn.transact(read('[[:db/add -2 :year 9] [:db/add -2 :code "C"]]'))
    assert r.tempids[-2] == 42 and conn.db.value(42, ":year") == 9
    t = tempid()
    r = conn.transact([{":db/id": t, ":code": "N", ":_near": 31, ":room": {":code": "R"}}])
    assert resolve_tempid(r.tempids, t) == conn.db.entid([K(":code"), "N"]) == conn.db.value(31, ":near") and conn.db.value(resolve_tempid(r.tempids, t), ":room") == 31 and tempid(None, -3) == -3


@pytest.mark.parametrize(
    ("ops", "message"),
    [
        ("[[:db/add -1 :room -2]]", "as values only"), ("[[:db/add 41 :year nil]]", "nil is no value"), ("[[:db/polish 41]]", "no operation"), ("[{:db/id 50 :serial 77}]", "unique"),
        ('[[:db/add 41 :code "C"]]', "unique"), ("[[:db.fn/cas 41 :year 1 2]]", "found"), ("[[:db.fn/cas -1 :year nil 2]]", "temporary"), ('[{:db/id -1 :code "V"} {:db/id -1 :code "C"}]', "would be|unique"),
        ("[{:db/id 41 :_year 42}]", "in reverse"), ("[[:db/add 2147483648 :year 1]]", "numbers end"), ("[41]", "neither a map"), ('[[:db/add [:code "Z"] :year 1]]', "no entity"),
        ("[{:db/id 41 :shelf 1} [:db/add 41 :shelf+slot [9 9]]]", "not set directly"), ('[{:db/id 60 :shelf 1 :slot 1} {:db/id 61 :shelf 1 :slot 1}]', "unique"),
    ],
)
def test_refused_and_unchanged(conn, ops, message):
    before = conn.db
    with pytest.raises(QueryError, match=message):
        conn.transact(read(ops))
    assert conn.db is before


def test_swaps_and_functions(conn):
    conn.transact(read("[[:db.fn/cas 41 :year 1710 1712] [:db.fn/cas 41 :height nil 30]]"))
    assert (conn.db.value(41, ":year"), conn.db.value(41, ":height")) == (1712, 30)
    later = lambda db, e, n: [[":db/add", e, K(":year"), db.value(e, ":year") + n]]
    conn.transact([[":db.fn/call", later, 41, 8]])
    conn.transact([{":db/ident": K(":age-by-one"), ":db/fn": lambda db, e: later(db, e, 1)}])
    conn.transact([[K(":age-by-one"), 41]])
    assert conn.db.value(41, ":year") == 1721


def test_composites_follow_their_parts(conn):
    for op, value in (("[{:db/id 42 :shelf 3}]", (3, None)), ("[[:db/add 42 :slot 9]]", (3, 9)), ("[[:db/add 42 :shelf 4]]", (4, 9)), ("[[:db/retract 42 :slot 9]]", (4, None)), ("[[:db/retract 42 :shelf 4]]", None)):
        conn.transact(read(op))
        assert conn.db.value(42, ":shelf+slot") == value
    conn.transact(read("[{:db/id 41 :shelf 5 :slot 6}]"))
    assert conn.db.entid([K(":shelf+slot"), (5, 6)]) == 41


def test_listeners_views_and_resets(conn):
    seen = []
    key = conn.listen(lambda r: seen.append(len(r.tx_data)))
    conn.transact(read("[[:db/add 41 :year 3]]"))
    size = len(conn.db)
    conn.reset(empty_db(SCHEMA))
    conn.unlisten(key)
    conn.transact_async(read("[[:db/add 41 :year 3]]")).result()
    assert seen == [2, size] and len(conn.db) == 1
    view = conn.db.filter(lambda *_: True)
    assert is_filtered(view) and not is_filtered(conn.db)
    with pytest.raises(TransactionError, match="view"):
        with_tx(view, [])
    assert db_with(conn.db, read("[[:db/add 41 :year 4]]")).value(41, ":year") == 4 and conn.db.value(41, ":year") == 3
    assert conn_from_db(conn.db).db == conn.db and hash(conn.db) == hash(from_json(to_json(conn.db)))


def test_indexes(conn):
    db = conn.db
    assert [d.v for d in db.datoms("aevt", ":code")] == ["R", "V", "C"] and db.find_datom("eavt", 42, ":year").v == 1820 and db.find_datom("eavt", 99) is None
    assert [d.e for d in db.seek_datoms("aevt", ":year", 42)] == [42] and [(d.a, d.e) for d in db.rseek_datoms("aevt", ":label", 41)][:2] == [(":label", 41)] * 2
    assert [d.e for d in db.index_range(":year", 1700, 1800)] == [41] and [d.e for d in db.index_range(":year")] == [41, 42]
    for call in (lambda: db.index_range(":label", "a"), lambda: db.datoms("avet", ":label")):
        with pytest.raises(QueryError, match="no index"):
            call()
    only_a, only_b, both = diff(init_db([(1, ":w", 2), (1, ":h", 3)]), init_db([(1, ":w", 2), (1, ":h", 3.0)]))
    assert ([d.v for d in only_a], [d.v for d in only_b], [d.v for d in both]) == ([3], [3.0], [2])


def test_pulls(conn):
    conn.transact(read('[{:db/id 31 :near [41 42]} {:db/id 42 :piece [{:hand "long"} {:hand "short"}] :room 31}]'))
    db = conn.db
    assert pull(db, "[:code :label :nothing]", 41) == {":code": "V", ":label": ["blue", "rare"]} and pull(db, "[:nothing]", 41) is None
    assert pull_many(db, "[:year]", [41, 99, [K(":code"), "C"]]) == [{":year": 1710}, None, {":year": 1820}]
    assert pull(db, "[{:near [:code]}]", 31) == {":near": [{":code": "V"}, {":code": "C"}]} and pull(db, "[:_near {:_room [:code]}]", 31) == {":_room": [{":code": "V"}, {":code": "C"}]}
    assert pull(db, '[[:label :limit 1] (default :height 0) [:code :as "id"] [:year :xform dec]]', 41) == {":label": ["blue"], ":height": 0, "id": "V", ":year": 1709}
    assert [p[":hand"] for p in pull(db, "[*]", 42)[":piece"]] == ["long", "short"]
    chain = create_conn({":next": REF})
    chain.transact([{":db/id": i, ":n": i, ":next": i % 5 + 1} for i in range(1, 6)])
    step = pull(chain.db, "[:n {:next ...}]", 1)
    for i in range(1, 6):
        assert step[":n"] == i
        step = step[":next"]
    assert step == {":db/id": 1} and pull(chain.db, "[:n {:next 1}]", 4) == {":n": 4, ":next": {":n": 5}}
    many = create_conn(SCHEMA)
    many.transact([{":db/id": 1, ":label": [f"{i:04d}" for i in range(1234)]}])
    assert len(pull(many.db, "[:label]", 1)[":label"]) == 1000 and len(pull(many.db, "[(limit :label nil)]", 1)[":label"]) == 1234
    for bad in ("[(limit :label 0)]", "[[:label :year]]", ":label", "[{:near -1}]", "[[:label :shine 1]]"):
        with pytest.raises((QueryError, ValueError)):
            pull(db, bad, 41)
    seen = []
    pull(db, "[:code :_near]", 41, lambda *x: seen.append(x[:3]))
    assert (K(":db.pull/attr"), 41, ":code") in seen and (K(":db.pull/reverse"), 41, ":near") in seen


def test_entities(conn):
    vase = entity(conn.db, [K(":code"), "V"])
    assert vase[":year"] == 1710 and vase[":room"][":code"] == "R" and vase[":nothing"] is None and vase[":label"] == ["blue", "rare"] and entity(conn.db, 99) is None
    assert entity(conn.db, 31)[":_room"] == [vase] and ":year" in vase and "rare" in repr(vase.touch()) and nav(vase, ":room", vase[":room"])[":code"] == "R"
    assert datafy(vase)[":room"] == {":db/id": 31} and squuid_time_millis(squuid(1_600_000_000_456)) == 1_600_000_000_000


def test_text_and_json():
    values = [K(":seen"), math.inf, (3, "x"), 'quote"', False, -0.5]
    db = init_db([Datom(i, ":v", v) for i, v in enumerate(values, 1)], {":v": {":db/index": True}})
    assert from_json(to_json(db)) == db == from_edn(to_edn(db)) and from_json(to_json(db)).max_eid == len(values)


def test_parquet_store_and_log(spark, tmp_path):
    from factspark.store import ParquetStore
    from factspark.streaming import LOG, changes as log_changes, each_batch, log_to, per_window

    store = ParquetStore(spark, str(tmp_path / "db"), branching=6)
    assert store.restore() is None
    conn = create_conn(SCHEMA, store)
    log_to(conn, spark, str(tmp_path / "log"))
    conn.transact([{":db/id": 41, ":code": "V", ":year": 1}])
    conn.transact(read("[[:db/add 41 :year 2]]"))
    conn.transact(read("[[:db/add 41 :year 2]]"))  # changes nothing, so nothing is written
    assert store.restore() == conn.db and len(store.addresses()) == 2
    assert {(r["a"], r["v"]["lng"]) for r in store.facts().collect()} == {(":code", None), (":year", 2)}
    conn.transact([{":db/id": 42, ":label": list("abcdefghi")}])
    assert store.restore_conn().db == conn.db and store.garbage() and store.restore() == conn.db
    lazy = store.open()
    assert lazy.max_eid == conn.db.max_eid and lazy.df.count() == len(conn.db) and lazy.schema == conn.db.schema
    counts = []
    each_batch(log_changes(spark, str(tmp_path / "log")), lambda df, _: counts.append(df.count()), str(tmp_path / "cp"))
    assert sum(counts) == 2 + 2 + 9 and per_window(spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))).isStreaming


def test_edn_store(conn, tmp_path):
    from factspark.store import EdnStore

    store = EdnStore(str(tmp_path / "deep" / "museum.edn"))
    assert store.restore() is None
    store.store(conn.db)
    assert store.restore() == conn.db
