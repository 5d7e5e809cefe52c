"""EDN text, query parsing and validation."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from factspark.edn import Form, Keyword, Symbol, read, write
from factspark.plans.parse import parse_query, parse_rules
from factspark.plans.syntax import QueryError
from factspark.schema import Schema, is_reverse, reverse


@pytest.mark.parametrize(
    ("text", "value"),
    [("1", 1), ("-2.5", -2.5), ('"a\\n\\"b"', 'a\n"b'), (":a/b", Keyword(":a/b")), ("[1 [2] #{3}]", [1, [2], frozenset([3])]), ("{:a 1, :b nil}", {Keyword(":a"): 1, Keyword(":b"): None}), ("; c\n true", True), ("#_ 1 2", 2), ('#inst "2024-01-02"', dt.datetime(2024, 1, 2)), ("##Inf", math.inf), ("1e3", 1000.0)],
)
def test_read(text, value):
    assert read(text) == value


def test_kinds_of_forms():
    x = read("(f ?x :k)")
    assert isinstance(x, Form) and isinstance(x[0], Symbol) and isinstance(x[2], Keyword)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(alphabet=st.characters(codec="utf-8")), lambda x: st.lists(x, max_size=4), max_leaves=12)


@given(values)
def test_round_trip(x):
    assert read(write(x)) == x


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("[:find ?x :where [?e :a ?y]]", "nothing binds"),
        ("[:find ?x :with ?x :where [?x]]", "both :find and :with"),
        ("[:find ?x :keys a b :where [?x]]", "differ in number"),
        ("[:find ?x . :keys a :where [?x]]", "there are none in a"),
        ("[:find ?x :keys a :syms b :where [?x]]", "exclude each other"),
        ("[:find ?x :where [$b ?x]]", "no inputs for the sources"),
        ("[:find ?x :in $ :where (r ?x)]", "has no %"),
        ("[:find ?x :in ?x ?x]", "twice"),
        ("[:find :where [?x]]", "find names no rows|not something to find"),
        ("[:find ?x :where []]", "neither|without terms|not a clause"),
    ],
)
def test_invalid(query, message):
    with pytest.raises(QueryError, match=message):
        parse_query(query)


def test_rules():
    rules = parse_rules("[[(r [?a] ?b) [?a :x ?b]] [(r [?a] ?b) [?b :x ?a]]]")
    assert len(rules["r"]) == 2 and len(rules["r"][0].required) == 1
    with pytest.raises(QueryError, match="differ in their number"):
        parse_rules("[[(r ?a) [?a :x]] [(r ?a ?b) [?a :x ?b]]]")
    with pytest.raises(QueryError, match="twice"):
        parse_rules("[[(r ?a ?a) [?a :x]]]")


def test_schema():
    s = Schema(read("{:a {:db/unique :db.unique/identity} :b {:db/valueType :db.type/ref} :t {:db/tupleAttrs [:a :c]}}"))
    assert s.of(":a").index and s.of(":b").ref and s.of(":t").tuple_attrs == (":a", ":c") and not s.of(":z").many
    for bad in ("{:a {:db/isComponent true}}", "{:a {:db/valueType :db.type/string}}", "{:a {:db/tupleAttrs []}}", "{:m {:db/cardinality :db.cardinality/many} :t {:db/tupleAttrs [:m :x]}}"):
        with pytest.raises(QueryError):
            Schema(read(bad))


def test_reverse():
    assert reverse(":a/b") == ":a/_b" and reverse(":a/_b") == ":a/b" and reverse(":x") == ":_x" and is_reverse(":_x") and not is_reverse(":x/y")
