"""Index access to facts in a DataFrame (e, a, v tagged, tx): slices, seeks, ranges, differences, composites.

Slices and ranges are filters, which a store partitioned by attribute prunes;
order is that of the index.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..db import INDEXES
from ..values import ANY, kind_of, literal, to_any


def _value(part: str, x: Any) -> Column:
    return to_any(literal(x), kind_of(x)).cast(ANY) if part == "v" else F.lit(str(x) if part == "a" else x)


def _parts(index: str) -> tuple[str, ...]:
    return INDEXES[index.lstrip(":")]


def datoms(facts: DataFrame, index: str, *comps: Any) -> DataFrame:
    for p, c in zip(_parts(index), comps, strict=False):
        if c is not None:
            facts = facts.filter(F.col(p) == _value(p, c))
    return facts.orderBy(*_parts(index))


def find_datom(facts: DataFrame, index: str, *comps: Any) -> DataFrame:
    return datoms(facts, index, *comps).limit(1)


def _beyond(index: str, comps: tuple, down: bool) -> Column:
    """Lexicographic comparison of the leading columns with the components, equal ones included."""
    cond = F.lit(True)
    for p, c in reversed(list(zip(_parts(index), comps, strict=False))):
        col, x = F.col(p), _value(p, c)
        cond = ((col < x) if down else (col > x)) | ((col == x) & cond)
    return cond


def seek_datoms(facts: DataFrame, index: str, *comps: Any) -> DataFrame:
    return facts.filter(_beyond(index, comps, False)).orderBy(*_parts(index))


def rseek_datoms(facts: DataFrame, index: str, *comps: Any) -> DataFrame:
    return facts.filter(_beyond(index, comps, True)).orderBy(*[F.col(p).desc() for p in _parts(index)])


def index_range(facts: DataFrame, attr: str, start: Any = None, end: Any = None) -> DataFrame:
    out = facts.filter(F.col("a") == str(attr))
    if start is not None:
        out = out.filter(F.col("v") >= _value("v", start))
    if end is not None:
        out = out.filter(F.col("v") <= _value("v", end))
    return out.orderBy("v", "e")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a, b or both), e, a, v of the facts of two databases."""
    x = a.select("e", "a", "v").withColumn("in_a", F.lit(True))
    y = b.select("e", "a", "v").withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "a").when(F.col("in_a").isNull(), "b").otherwise("both")
    return x.join(y, ["e", "a", "v"], "full_outer").select(side.alias("side"), "e", "a", "v")


def composite(facts: DataFrame, attrs: list[str]) -> DataFrame:
    """e and parts: the composite value of attributes with one value, null where an entity lacks one; one aggregation."""
    return facts.filter(F.col("a").isin(attrs)).groupBy("e").agg(F.array(*[F.max(F.when(F.col("a") == a, F.col("v"))) for a in attrs]).alias("parts"))
