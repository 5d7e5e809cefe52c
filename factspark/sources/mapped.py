"""Ordinary tables read as facts: a column is an attribute, a row an entity.

Patterns about one entity become a single scan with the columns they need, so
that projection and filters reach the files and values keep native types.  A
null is a missing fact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..edn import Keyword
from ..plans.syntax import Blank, Const, Pattern, QueryError, Var
from ..values import kind_of, kind_of_type, literal, to_any
from .base import Rel, Source, gid


@dataclass(frozen=True)
class Table:
    """name, its rows, the key column (None: the whole row is the entity), and columns that refer to other tables' keys."""

    name: str
    df: DataFrame
    key: str | None = None
    refs: dict[str, str] = field(default_factory=dict)

    def entity(self) -> Column:
        return F.col(self.key) if self.key else F.struct(*self.df.columns)

    def kind(self, column: str) -> str:
        if column in self.refs:
            return f"eid:{self.refs[column]}"
        return kind_of_type(self.df.schema[column].dataType)


class MappedSource(Source):
    def __init__(self, spark: SparkSession, tables: list[Table], filters: dict[str, list[Callable[[DataFrame], DataFrame]]] | None = None) -> None:
        self.spark, self.tables, self.filters = spark, {t.name: t for t in tables}, filters or {}

    def filtered(self, table: str, f: Callable[[DataFrame], DataFrame]) -> MappedSource:
        """A view whose entities of one table are those that f keeps; views of views keep what all keep."""
        return MappedSource(self.spark, list(self.tables.values()), self.filters | {table: [*self.filters.get(table, []), f]})

    def rows(self, table: str) -> DataFrame:
        df = self.table(table).df
        for f in self.filters.get(table, []):
            df = f(df)
        return df

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise QueryError(f"no table {name}")
        return self.tables[name]

    def column(self, attr: Any) -> tuple[str, str]:
        """(table, column) of an attribute :table/column."""
        table, slash, column = str(attr).lstrip(":").partition("/")
        if not slash or table not in self.tables or column not in self.tables[table].df.columns:
            raise QueryError(f"no attribute {attr}")
        return table, column

    def group_key(self, pattern: Pattern) -> Any:
        t = pattern.terms
        if len(t) > 1 and isinstance(t[1], Const) and isinstance(t[0], Var) and len(t) <= 3:
            return t[0].name, self.column(t[1].value)[0]
        return None

    def key_of(self, ref: Any, table: str) -> Any:
        """The key of the entity that a lookup ref [attr value], or a plain key, names in a table."""
        if not isinstance(ref, list | tuple):
            return ref
        t, c = self.column(ref[0])
        if t != table:
            return None
        if c == self.table(table).key:
            return ref[1]
        found = self.rows(table).filter(F.col(c) == literal(ref[1])).select(self.table(table).key).limit(2).collect()
        if not found:
            raise QueryError(f"no entity is [{ref[0]} {ref[1]!r}]")
        return found[0][0]

    def _fixed(self, table: str, column: str, value: Any) -> Column:
        t, c = self.table(table), F.col(column)
        if column in t.refs:
            key = self.key_of(value, t.refs[column])
            return c == literal(key) if key is not None else F.lit(False)
        kind = kind_of(value)
        fits = kind == t.kind(column) or (kind == "keyword" and t.kind(column) == "string")
        return c == literal(value) if fits else F.lit(False)

    def scan(self, patterns: list[Pattern], hints: dict[str, str]) -> Rel:
        first = patterns[0].terms
        if len(first) < 2 or not isinstance(first[1], Const):
            return self._any_attribute(first, hints)
        name = self.column(first[1].value)[0]
        t = self.table(name)
        df = self.rows(name)
        out: dict[str, tuple[Column, str]] = {}
        if isinstance(first[0], Var):
            out[first[0].name] = (t.entity(), f"eid:{name}")
        elif isinstance(first[0], Const):
            key = self.key_of(first[0].value, name)
            df = df.filter(F.col(t.key) == literal(key) if key is not None else F.lit(False))
        unique = frozenset([first[0].name]) if isinstance(first[0], Var) else None
        keys: dict[str, str] = {}
        for p in patterns:
            if len(p.terms) > 3:
                raise QueryError("mapped tables have no transactions")
            table, column = self.column(p.terms[1].value)
            if table != name:
                raise QueryError(f"{p.terms[1].value} is no attribute of {name}")
            c, kind = F.col(column), t.kind(column)
            df = df.filter(c.isNotNull())
            v = p.terms[2] if len(p.terms) == 3 else Blank()
            if isinstance(v, Const):
                df = df.filter(self._fixed(name, column, v.value))
            elif isinstance(v, Var):
                if v.name in out:
                    other, k = out[v.name]
                    df = df.filter(other == c if k == kind else F.lit(False))
                else:
                    out[v.name] = (c, kind)
                    if column == t.key and unique is not None:
                        keys[v.name] = first[0].name
        return Rel(df.select(*[c.alias(v) for v, (c, _) in out.items()]), {v: k for v, (_, k) in out.items()}, unique, keys)

    def _any_attribute(self, terms: tuple, hints: dict[str, str]) -> Rel:
        """Every attribute of every table that may match, as attribute and tagged value: one scan a table."""
        e, a, v = (*terms, Blank(), Blank())[:3]
        hint = hints.get(e.name, "") if isinstance(e, Var) else ""
        names = [hint[4:]] if hint.startswith("eid:") else [self.column(e.value[0])[0]] if isinstance(e, Const) and isinstance(e.value, list) else list(self.tables)
        single = len(names) == 1
        parts: list[DataFrame] = []
        for name in names:
            t = self.table(name)
            if t.key is None and not single:
                continue
            facts = []
            for c in t.df.columns:
                col = gid(F.col(c), t.refs[c]) if c in t.refs else F.col(c)
                facts.append(F.struct(F.lit(f":{name}/{c}").alias("a"), F.when(F.col(c).isNotNull(), to_any(col, "gid" if c in t.refs else t.kind(c))).alias("v")))
            df = self.rows(name)
            if isinstance(e, Const):
                key = self.key_of(e.value, name)
                df = df.filter(F.col(t.key) == literal(key) if key is not None else F.lit(False))
            entity = t.entity() if single else gid(t.entity(), name)
            parts.append(df.select(entity.alias("e"), F.explode(F.array(*facts)).alias("f")).select("e", "f.a", "f.v").filter("v is not null"))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionAll(p)
        if isinstance(v, Const):
            df = df.filter(F.col("v") == to_any(literal(v.value), kind_of(v.value)))
        out: dict[str, tuple[Column, str]] = {}
        for x, c, kind in ((e, "e", f"eid:{names[0]}" if single else "gid"), (a, "a", "keyword"), (v, "v", "any")):
            if isinstance(x, Var):
                if x.name in out:
                    df = df.filter(F.lit(False))
                out.setdefault(x.name, (F.col(c), kind))
        return Rel(df.select(*[c.alias(n) for n, (c, _) in out.items()]), {n: k for n, (_, k) in out.items()})


def tpch_tables(spark: SparkSession, sf_dir: str) -> MappedSource:
    """The test tables with their keys and references."""
    spec: dict[str, tuple[str | None, dict[str, str]]] = {
        "region": ("r_regionkey", {}), "nation": ("n_nationkey", {"n_regionkey": "region"}), "customer": ("c_custkey", {"c_nationkey": "nation"}),
        "supplier": ("s_suppkey", {"s_nationkey": "nation"}), "part": ("p_partkey", {}), "orders": ("o_orderkey", {"o_custkey": "customer"}),
        "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}), "events": ("event_id", {}), "documents": ("doc_id", {}), "labels": (None, {"doc_id": "documents"}),
    }
    return MappedSource(spark, [Table(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), key, refs) for n, (key, refs) in spec.items()])


def attribute(table: str, column: str) -> Keyword:
    return Keyword(f":{table}/{column}")
