"""Collections of tuples, matched by position."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.syntax import Blank, Const, Pattern, QueryError, Var
from ..values import ANY, kind_of, kind_of_type, literal, tagged, to_any
from .base import Rel, Source


def frame(spark: SparkSession, rows: list[tuple], width: int) -> tuple[DataFrame, list[str]]:
    """Python rows as columns c0.. with their kinds; a column of several types is tagged.  Tuples shorter than width do not match."""
    rows = [tuple(r) for r in rows if len(r) >= width]
    kinds = []
    for i in range(width):
        found = {kind_of(r[i]) for r in rows}
        kinds.append(found.pop() if len(found) == 1 else "any" if found else "string")
    native = {"long": "bigint", "double": "double", "bool": "boolean", "ts": "timestamp_ntz"}
    tagged_at = [k in ("any", "array", "other") for k in kinds]
    schema = ", ".join(f"c{i} {ANY if t else native.get(k, 'string')}" for i, (k, t) in enumerate(zip(kinds, tagged_at, strict=True)))
    value = lambda x, k, t: tagged(x) if t else float(x) if k == "double" else x if k in native else str(x)
    data = [tuple(value(r[i], kinds[i], tagged_at[i]) for i in range(width)) for r in rows]
    df = spark.createDataFrame(data, schema or "c0 string")
    return df, ["any" if t else k for k, t in zip(kinds, tagged_at, strict=True)]


class CollectionSource(Source):
    """A list of tuples, or a DataFrame addressed by column position."""

    def __init__(self, spark: SparkSession, data: Any) -> None:
        self.spark, self.data = spark, data

    def scan(self, patterns: list[Pattern], hints: dict[str, str]) -> Rel:
        (pattern,) = patterns
        terms = pattern.terms
        if isinstance(self.data, DataFrame):
            if len(terms) > len(self.data.columns):
                raise QueryError(f"pattern of {len(terms)} terms over {len(self.data.columns)} columns")
            df = self.data.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.data.columns)])
            kinds = [kind_of_type(f.dataType) for f in df.schema.fields]
        else:
            fits = lambda r: len(r) >= len(terms) and all(not isinstance(t, Const) or (kind_of(x) == kind_of(t.value) and x == t.value) for x, t in zip(r, terms, strict=False))
            df, kinds = frame(self.spark, [r for r in self.data if fits(r)], len(terms))
        return match(df, kinds, terms)


def match(df: DataFrame, kinds: list[str], terms: tuple) -> Rel:
    """Rows of columns c0.. that fit the terms, as a relation of their variables."""
    out: dict[str, tuple] = {}
    for i, t in enumerate(terms):
        c = F.col(f"c{i}")
        if isinstance(t, Blank):
            continue
        df = df.filter(c.isNotNull())
        if isinstance(t, Const):
            k = kind_of(t.value)
            if kinds[i] == "any":
                df = df.filter(c == to_any(literal(t.value), k) if k not in ("array", "other") else c["str"] == F.lit(tagged(t.value)[3]))
            else:
                df = df.filter(c == literal(t.value)) if k == kinds[i] else df.filter(F.lit(False))
        elif isinstance(t, Var):
            if t.name in out:
                other, k = out[t.name]
                df = df.filter(other == c) if k == kinds[i] else df.filter(to_any(other, k) == to_any(c, kinds[i]))
            else:
                out[t.name] = (c, kinds[i])
        else:
            raise QueryError(f"no place for {t} in a pattern")
    return Rel(df.select(*[c.alias(v) for v, (c, _) in out.items()]), {v: k for v, (_, k) in out.items()})

