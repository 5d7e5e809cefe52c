"""Databases of facts: immutable values with a schema, read by queries, pull, entities and index access.

A ``Db`` keeps its facts on the driver, where transactions change them one
after the other; as a source it is a DataFrame with one tagged value column,
which becomes a native column for every attribute whose values have one type.
``DatomSource.of_frame`` is a source over facts that stay a DataFrame of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .edn import Keyword
from .plans.syntax import Blank, Const, Pattern, QueryError
from .schema import Schema, is_reverse, reverse
from .sources.base import Rel, Source
from .values import ANY, RANKS, from_any, kind_of, literal, tagged, to_any

#: The first transaction, and the largest entity id.
TX0, EMAX = 0x20000000, 0x7FFFFFFF
INDEXES = {"eavt": ("e", "a", "v", "tx"), "aevt": ("a", "e", "v", "tx"), "avet": ("a", "v", "e", "tx")}


class Datom(NamedTuple):
    e: int
    a: str
    v: Any
    tx: int = TX0
    added: bool = True


def same(x: Any, y: Any) -> bool:
    """Equality that tells types apart."""
    return kind_of(x) == kind_of(y) and x == y


def freeze(v: Any) -> Any:
    return tuple(map(freeze, v)) if isinstance(v, list | tuple) else v


def sort_key(v: Any) -> tuple:
    """Order over all types; a missing value sorts first."""
    if v is None:
        return (-1,)
    k = kind_of(v)
    if k == "array":
        return (RANKS[k], len(v), tuple(map(sort_key, v)))
    if k in ("long", "double"):
        return (RANKS[k], float(v) if v == v else float("-inf"), str(v) if abs(v) > 2**53 else "")
    return (RANKS[k], v if k in ("bool", "ts") else str(v))


class _Key:
    """A fact's value as a dictionary key that tells 1, 1.0 and true apart."""

    __slots__ = ("kind", "value")

    def __init__(self, v: Any) -> None:
        self.kind, self.value = kind_of(v), freeze(v)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Key) and self.kind == other.kind and self.value == other.value

    def __hash__(self) -> int:
        try:
            return hash((self.kind, self.value))
        except TypeError:
            return hash((self.kind, repr(self.value)))


class Db:
    """Facts by entity and attribute, with the transaction of each."""

    def __init__(self, schema: dict | Schema | None = None, facts: dict | None = None, max_eid: int = 0, max_tx: int = TX0) -> None:
        self.schema = schema if isinstance(schema, Schema) else Schema(schema)
        self.facts: dict[int, dict[str, dict[_Key, tuple[Any, int]]]] = facts if facts is not None else {}
        self.max_eid, self.max_tx = max_eid, max_tx
        self._source: DatomSource | None = None

    # -- reading

    def datoms_of(self, e: int, a: str | None = None) -> Iterator[Datom]:
        for attr, values in self.facts.get(e, {}).items():
            if a is None or attr == a:
                for v, tx in values.values():
                    yield Datom(e, attr, v, tx)

    def __iter__(self) -> Iterator[Datom]:
        for e in self.facts:
            yield from self.datoms_of(e)

    def __len__(self) -> int:
        return sum(len(v) for attrs in self.facts.values() for v in attrs.values())

    def __eq__(self, other: object) -> bool:
        mine = lambda db: {(d.e, d.a, _Key(d.v)) for d in db}
        return isinstance(other, Db) and self.schema == other.schema and mine(self) == mine(other)

    def __hash__(self) -> int:
        return hash(frozenset((d.e, d.a, _Key(d.v)) for d in self))

    def __repr__(self) -> str:
        return f"#factspark/DB {{:datoms {len(self)}}}"

    def has(self, e: int, a: str, v: Any) -> bool:
        return _Key(v) in self.facts.get(e, {}).get(a, {})

    def values(self, e: int, a: str) -> list:
        return [v for v, _ in self.facts.get(e, {}).get(a, {}).values()]

    def value(self, e: int, a: str) -> Any:
        return next(iter(self.values(e, a)), None)

    def holders(self, a: str, v: Any) -> list[int]:
        """Entities with a fact."""
        key = _Key(v)
        return [e for e, attrs in self.facts.items() if key in attrs.get(a, {})]

    def entid(self, ref: Any, strict: bool = False) -> int | None:  # noqa: PLR0911
        """The id that a number, a lookup ref [attr value] or an ident names."""
        if isinstance(ref, bool) or ref is None:
            found = None
        elif isinstance(ref, int):
            if ref > EMAX:
                raise QueryError(f"entity numbers end at {EMAX}: {ref}")
            return ref
        elif isinstance(ref, list | tuple):
            if len(ref) != 2:
                raise QueryError(f"a lookup ref is an attribute and a value: {list(ref)}")
            a = str(ref[0])
            if not self.schema.of(a).unique:
                raise QueryError(f"no unique attribute, so no lookup ref: {list(ref)}")
            if ref[1] is None:
                return None
            v = self.entid(ref[1]) if self.schema.of(a).ref and not isinstance(ref[1], int) else ref[1]
            found = next(iter(self.holders(a, v)), None)
        elif isinstance(ref, Keyword) or (isinstance(ref, str) and ref.startswith(":")):
            found = next((e for e in self.holders(":db/ident", Keyword(ref))), None)
        else:
            raise QueryError(f"names no entity: {ref!r}")
        if found is None and strict:
            raise QueryError(f"no entity is {ref!r}")
        return found

    # -- index access

    def index(self, name: str) -> list[Datom]:
        parts = INDEXES[name.lstrip(":")]
        rows = [d for d in self if name.lstrip(":") != "avet" or self.schema.of(d.a).index]
        key = {"e": lambda d: d.e, "a": lambda d: d.a, "v": lambda d: sort_key(d.v), "tx": lambda d: d.tx}
        return sorted(rows, key=lambda d: tuple(key[p](d) for p in parts))

    def _components(self, name: str, comps: tuple) -> tuple:
        parts, out = INDEXES[name.lstrip(":")], []
        a = None
        for p, c in zip(parts, comps, strict=False):
            if p == "a":
                a = str(c) if c is not None else None
                if name.lstrip(":") == "avet" and a is not None and not self.schema.of(a).index:
                    raise QueryError(f"{a} has no index")
                out.append(a)
            elif p == "e":
                out.append(self.entid(c) if c is not None else None)
            elif p == "v" and c is not None and a and self.schema.of(a).ref:
                out.append(self.entid(c))
            else:
                out.append(c)
        return tuple(out)

    def datoms(self, index: str, *comps: Any) -> list[Datom]:
        """A sorted slice by leading components."""
        parts, comps = INDEXES[index.lstrip(":")], self._components(index, comps)
        fits = lambda d: all(c is None or (same(getattr(d, p), c) if p == "v" else getattr(d, p) == c) for p, c in zip(parts, comps, strict=False))
        return [d for d in self.index(index) if fits(d)]

    def find_datom(self, index: str, *comps: Any) -> Datom | None:
        return next(iter(self.datoms(index, *comps)), None)

    def _at(self, index: str, d: Datom, n: int) -> tuple:
        return tuple(sort_key(d.v) if p == "v" else getattr(d, p) for p in INDEXES[index.lstrip(":")][:n])

    def seek_datoms(self, index: str, *comps: Any) -> list[Datom]:
        """From the components to the index's end."""
        comps = self._components(index, comps)
        least = tuple(sort_key(c) if p == "v" else c for p, c in zip(INDEXES[index.lstrip(":")], comps, strict=False))
        return [d for d in self.index(index) if self._at(index, d, len(least)) >= least]

    def rseek_datoms(self, index: str, *comps: Any) -> list[Datom]:
        """From the components back to the index's start."""
        comps = self._components(index, comps)
        most = tuple(sort_key(c) if p == "v" else c for p, c in zip(INDEXES[index.lstrip(":")], comps, strict=False))
        return [d for d in reversed(self.index(index)) if self._at(index, d, len(most)) <= most]

    def index_range(self, attr: str, start: Any = None, end: Any = None) -> list[Datom]:
        """Facts of an indexed attribute by value, from start to end, both included; None is open."""
        if not self.schema.of(str(attr)).index:
            raise QueryError(f"{attr} has no index")
        if self.schema.of(str(attr)).ref:
            start, end = (self.entid(x) if x is not None else None for x in (start, end))
        lo, hi = sort_key(start), sort_key(end)
        return [d for d in self.index("avet") if d.a == str(attr) and (start is None or sort_key(d.v) >= lo) and (end is None or sort_key(d.v) <= hi)]

    # -- views and changes

    def filter(self, pred: Callable[[Db, Datom], bool]) -> FilteredDb:
        return FilteredDb(self, (pred,))

    def empty(self) -> Db:
        return Db(self.schema)

    def with_schema(self, schema: dict) -> Db:
        return Db(schema, self.facts, self.max_eid, self.max_tx)

    def as_source(self, spark: SparkSession) -> DatomSource:
        if self._source is None or self._source.spark is not spark:
            self._source = DatomSource.of(spark, self)
        return self._source

    def frame(self, spark: SparkSession) -> DataFrame:
        """The facts as rows (e, a, v, tx, added), v tagged."""
        rows = [(d.e, d.a, tagged(d.v), d.tx, True) for d in self.index("eavt")]
        return spark.createDataFrame(rows, f"e long, a string, v {ANY}, tx long, added boolean")


class FilteredDb(Db):
    """A view of the facts that all predicates keep; they get the unfiltered database and the fact."""

    def __init__(self, base: Db, preds: tuple) -> None:
        kept: dict = {}
        for d in base:
            if all(p(base, d) for p in preds):
                kept.setdefault(d.e, {}).setdefault(d.a, {})[_Key(d.v)] = (d.v, d.tx)
        super().__init__(base.schema, kept, base.max_eid, base.max_tx)
        self.base, self.preds = base, preds

    def filter(self, pred: Callable[[Db, Datom], bool]) -> FilteredDb:
        return FilteredDb(self.base, (*self.preds, pred))


def is_filtered(db: Db) -> bool:
    return isinstance(db, FilteredDb)


def init_db(datoms: Iterable[Any], schema: dict | None = None) -> Db:
    """A database of given facts, which are trusted."""
    s = Schema(schema)
    facts: dict = {}
    max_eid, max_tx = 0, TX0
    for d in datoms:
        if not isinstance(d, tuple | list) or len(d) < 3:
            raise QueryError(f"not a fact but a {type(d).__name__}")
        d = Datom(*d)  # noqa: PLW2901
        facts.setdefault(d.e, {}).setdefault(str(d.a), {})[_Key(d.v)] = (freeze(d.v), d.tx)
        max_tx = max(max_tx, d.tx)
        for e in (d.e, d.v) if s.of(str(d.a)).ref else (d.e,):
            if isinstance(e, int) and max_eid < e < TX0:
                max_eid = e
    return Db(s, facts, max_eid, max_tx)


def empty_db(schema: dict | None = None) -> Db:
    return Db(schema)


def diff(a: Db, b: Db) -> tuple[list[Datom], list[Datom], list[Datom]]:
    """Facts only in a, only in b, and in both."""
    of = lambda db: {(d.e, d.a, _Key(d.v)): d for d in db}
    x, y = of(a), of(b)
    return [d for k, d in x.items() if k not in y], [d for k, d in y.items() if k not in x], [d for k, d in x.items() if k in y]


def _lookup(df: DataFrame, schema: Schema) -> Callable[[Any], int]:
    """Entity of an ident or a lookup ref in facts of any size: one filtered read for each."""

    def resolve(ref: Any) -> int:
        a, v = (":db/ident", Keyword(str(ref))) if isinstance(ref, str) else (str(ref[0]), ref[1])
        if not schema.of(a).unique:
            raise QueryError(f"{a} is not unique, so {ref!r} names no entity")
        found = df.filter((F.col("a") == a) & (F.col("v") == to_any(literal(v), kind_of(v)).cast(ANY))).select("e").first()
        if found is None:
            raise QueryError(f"no entity is {ref!r}")
        return found["e"]

    return resolve


class DatomSource(Source):
    """Facts as a DataFrame (e, a, v tagged, tx[, added]) with the kind of each attribute that has one.

    Filters on the attribute come first, so that a store partitioned by it
    reads the partitions it needs only.
    """

    def __init__(self, spark: SparkSession, df: DataFrame, schema: Schema, kinds: dict[str, str], resolve: Callable[[Any], Any] | None = None) -> None:
        self.spark, self.df, self.schema, self.kinds, self.resolve = spark, df, schema, kinds, resolve or (lambda x: x)
        self.db: Db | None = None  # where the facts are on the driver too

    @staticmethod
    def of(spark: SparkSession, db: Db) -> DatomSource:
        kinds: dict[str, set[str]] = {}
        for d in db:
            kinds.setdefault(d.a, set()).add(kind_of(d.v))
        out = DatomSource(spark, db.frame(spark), db.schema, {a: k.pop() for a, k in kinds.items() if len(k) == 1}, lambda x: db.entid(x, strict=True))
        out.db = db
        return out

    @staticmethod
    def of_frame(spark: SparkSession, df: DataFrame, schema: dict | None = None) -> DatomSource:
        """Facts of any size; attributes are few, and their kinds are found by one aggregation."""
        ranks = {v: k for k, v in RANKS.items() if k not in ("other", "double")}
        found = df.groupBy("a").agg(F.min("v.rank").alias("lo"), F.max("v.rank").alias("hi"), F.count("v.lng").alias("ints"), F.count("*").alias("n")).toLocalIterator()
        kinds = {}
        for r in found:
            if r["lo"] == r["hi"]:
                k = ranks[r["lo"]]
                if k != "long" or r["ints"] in (0, r["n"]):
                    kinds[r["a"]] = "double" if k == "long" and r["ints"] == 0 else k
        return DatomSource(spark, df, Schema(schema), kinds, _lookup(df, Schema(schema)))

    def filtered(self, cond: Column) -> DatomSource:
        return DatomSource(self.spark, self.df.filter(cond), self.schema, self.kinds, self.resolve)

    def _entity(self, x: Any) -> Any:
        return self.resolve(x) if isinstance(x, list | tuple | Keyword) else x

    def scan(self, patterns: list[Pattern], hints: dict[str, str]) -> Rel:
        from .sources.collection import match

        (pattern,) = patterns
        terms = list(pattern.terms) + [Blank()] * (5 - len(pattern.terms))
        attr = str(terms[1].value) if isinstance(terms[1], Const) else None
        if attr and is_reverse(attr):
            attr = reverse(attr)
            terms[0], terms[2] = terms[2], terms[0]
        ref = attr is not None and self.schema.of(attr).ref
        if isinstance(terms[0], Const):
            terms[0] = Const(self._entity(terms[0].value))
        if ref and isinstance(terms[2], Const):
            terms[2] = Const(self._entity(terms[2].value))
        df, kind = self.df, "any"
        if attr is not None:
            df, kind = df.filter(F.col("a") == attr), self.kinds.get(attr, "any")
            if kind in ("array", "other"):
                kind = "any"
        added = F.col("added") if "added" in df.columns else F.lit(True)
        df = df.select(F.col("e").alias("c0"), F.col("a").alias("c1"), from_any(F.col("v"), kind).alias("c2"), F.col("tx").alias("c3"), added.alias("c4"))
        kinds = ["long", "keyword", kind, "long", "bool"]
        terms[1] = Blank() if attr is not None else terms[1]
        return match(df, kinds, tuple(terms))


