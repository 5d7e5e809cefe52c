"""Aggregates of find clauses.

They work on the distinct rows of the find and with variables, grouped by the
find elements that are no aggregates; without rows there are no groups.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.syntax import Aggregate, Const, Plain, QueryError, Var
from ..sources.base import Rel


def _smallest(c: Column, n: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(c)), 1, n)


def _largest(c: Column, n: int) -> Column:
    return F.sort_array(F.slice(F.sort_array(F.collect_list(c), asc=False), 1, n))


def _with_replacement(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.get(F.shuffle(F.collect_list(c)), F.lit(0)))


#: name -> (of one argument, of a number and one argument, kind of the result)
AGGREGATES: dict[str, tuple[Callable[[Column], Column] | None, Callable[[Column, int], Column] | None, str | None]] = {
    "sum": (F.sum, None, None), "avg": (lambda c: F.avg(c), None, "double"), "median": (lambda c: F.median(c), None, "double"),
    "variance": (F.var_pop, None, "double"), "stddev": (F.stddev_pop, None, "double"), "count": (lambda c: F.count(c), None, "long"),
    "count-distinct": (lambda c: F.count_distinct(c), None, "long"), "distinct": (lambda c: F.sort_array(F.collect_set(c)), None, "array"),
    "min": (F.min, _smallest, None), "max": (F.max, _largest, None), "rand": (lambda c: F.get(F.shuffle(F.collect_list(c)), F.lit(0)), _with_replacement, None),
    "sample": (None, lambda c, n: F.slice(F.shuffle(F.collect_list(c)), 1, n), "array"),
}


def top_n(rel: Rel, keys: list[str], f: Aggregate, n: int) -> Rel:
    """Rows among the n smallest or largest of their group, so that a group's list is short before it is collected."""
    from pyspark.sql import Window

    v = f.args[-1].name
    order = F.col(f"`{v}`").asc() if f.fn.name == "min" else F.col(f"`{v}`").desc()
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys] or [F.lit(1)]).orderBy(order)
    return Rel(rel.df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn"), rel.kinds)


def aggregate(rel: Rel, keys: list[str], aggregates: list[Aggregate], ctx: Any) -> tuple[DataFrame, list[str]]:
    """Columns of keys and __a0.., and the kinds of the latter."""
    cols, kinds = [], []
    if len(aggregates) == 1 and isinstance(aggregates[0].fn, Plain) and aggregates[0].fn.name in ("min", "max") and len(aggregates[0].args) == 2:
        rel = top_n(rel, keys, aggregates[0], int(_value(aggregates[0].args[0], ctx)))
    for i, f in enumerate(aggregates):
        arg = f.args[-1]
        if not isinstance(arg, Var):
            raise QueryError("Aggregates need a variable as their last argument")
        c, kind = rel.col(arg.name), rel.kinds[arg.name]
        fn = ctx.fixed.get(f.fn.name) if f.custom or f.fn.name not in AGGREGATES else None
        if fn is not None or f.fn.name not in AGGREGATES:
            if fn is None and "/" in f.fn.name:
                import importlib

                module, _, attr = f.fn.name.rpartition("/")
                fn = getattr(importlib.import_module(module), attr)
            if fn is None:
                raise QueryError(f"no aggregate {f.fn.name}")
            more = [F.lit(_value(a, ctx)) for a in f.args[:-1]]
            cols.append(fn(*more, c).alias(f"__a{i}"))
            kinds.append(getattr(fn, "kind", kind))
            continue
        one, several, out = AGGREGATES[f.fn.name]
        if len(f.args) == 2:
            if several is None:
                raise QueryError(f"'{f.fn.name}' takes one argument")
            cols.append(several(c, int(_value(f.args[0], ctx))).alias(f"__a{i}"))
            kinds.append("array")
        else:
            if one is None:
                raise QueryError(f"'{f.fn.name}' takes a number and an argument")
            cols.append(one(c).alias(f"__a{i}"))
            kinds.append(out or kind)
    if keys:
        return rel.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*cols), kinds
    return rel.df.agg(F.count("*").alias("__n"), *cols).filter("__n > 0").drop("__n"), kinds


def _value(a: Any, ctx: Any) -> Any:
    if isinstance(a, Const):
        return a.value
    if a.name not in ctx.fixed:
        raise QueryError(f"'{a.name}' must be an input")
    return ctx.fixed[a.name]
