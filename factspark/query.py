"""q: a query over sources, as a DataFrame or as Python values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .edn import Keyword
from .functions.aggregates import aggregate
from .operators.rules import rename
from .plans.compile import Context, bind_inputs, check_order, flatten, product, resolve
from .plans.parse import parse_query
from .plans.syntax import Aggregate, BindColl, BindTuple, Plain, Pull, Query, QueryError, Var, vars_of
from .sources.base import Rel
from .sources.collection import frame
from .sources.mapped import MappedSource
from .values import untagged


def _name(q: Query, i: int, f: Any) -> str:
    if q.keys:
        return q.keys[i].lstrip(":")
    if isinstance(f, Var):
        return f.column
    if isinstance(f, Pull):
        return f"pull_{f.var.column}"
    return f"{f.fn.name.lstrip('?').replace('/', '_')}_{f.args[-1].column}"


def q_df(query: Any, *inputs: Any, spark: SparkSession | None = None) -> DataFrame:
    """The rows that a query finds, with a column for each find element: named by :keys, :syms or :strs, else after its variable."""
    return _run(parse_query(query), inputs, spark, {})[0]


def _session(spark: SparkSession | None) -> SparkSession:
    found = spark or SparkSession.getActiveSession()
    if found is None:
        raise QueryError("no Spark session")
    return found


def _run(q: Query, inputs: tuple, spark: SparkSession | None, pulls_here: dict[Any, Any]) -> tuple[DataFrame, list[str], Context]:
    """The result, the kinds of its columns, and the context after the clauses.

    With "driver" in pulls_here, pulls from a database that is on the driver
    are left to the caller: they are put there by column, which stays an id.
    """
    spark = _session(spark)
    ctx = bind_inputs(q, inputs, spark)
    check_order(q.where, ctx.bound(), ctx.rules)
    where, ctx = _lookup_refs(q, inputs, ctx)
    after = resolve(where, ctx)
    names = vars_of(q.find) + [v.name for v in q.with_]
    wanted = [n for n in dict.fromkeys(names) if not callable(after.fixed.get(n))]
    rel = product(after, wanted)
    for n in wanted:  # fixed variables come back as constant columns
        if n not in rel.kinds and n in after.fixed:
            from .functions.builtins import constant

            c = constant(after.fixed[n])
            rel = Rel(rel.df.withColumn(n, c.col), rel.kinds | {n: c.kind}, rel.unique)
    rel = rel.project(wanted).distinct()
    aggregates = [f for f in q.find if isinstance(f, Aggregate)]
    columns = [_name(q, i, f) for i, f in enumerate(q.find)]
    if len(set(columns)) < len(columns):
        columns = [f"{c}_{i}" if columns.count(c) > 1 else c for i, c in enumerate(columns)]
    for v, k in list(rel.kinds.items()):
        if k.startswith("eid:") and any(isinstance(f, Var) and f.name == v for f in q.find) and not any(isinstance(f, Pull) and f.var.name == v for f in q.find):
            rel = rel.cast(v, "gid") if dict(rel.df.dtypes)[v] in ("int", "bigint", "smallint", "tinyint") else Rel(rel.df.withColumn(v, F.to_json(rel.col(v))), rel.kinds | {v: "string"}, rel.unique)
    if aggregates:
        keys = [f for f in q.find if not isinstance(f, Aggregate)]
        key_vars = [f.var.name if isinstance(f, Pull) else f.name for f in keys]
        df, kinds = aggregate(rel, key_vars, aggregates, after)
        out = []
        n = 0
        for f in q.find:
            if isinstance(f, Aggregate):
                out.append((F.col(f"__a{n}"), kinds[n]))
                n += 1
            else:
                v = f.var.name if isinstance(f, Pull) else f.name
                out.append((F.col(f"`{v}`"), rel.kinds[v]))
        result = df.select(*[c.alias(name) for (c, _), name in zip(out, columns, strict=True)])
        final_kinds = [k for _, k in out]
    else:
        out_cols = [F.col(f"`{f.var.name if isinstance(f, Pull) else f.name}`").alias(c) for f, c in zip(q.find, columns, strict=True)]
        result = rel.df.select(*out_cols)
        final_kinds = [rel.kinds[f.var.name if isinstance(f, Pull) else f.name] for f in q.find]
    pulls = [(i, f) for i, f in enumerate(q.find) if isinstance(f, Pull)]
    if pulls:
        from .operators.pull import pull_df

        for i, f in pulls:
            pattern = f.pattern.value if not isinstance(f.pattern, Plain | Var) else ctx.fixed.get(f.pattern.name)
            if pattern is None and isinstance(f.pattern, Plain) and f.pattern.name == "*":
                pattern = ["*"]
            source = after.source(f.src)
            if getattr(source, "db", None) is not None and "driver" in pulls_here:
                pulls_here[i] = (source.db, pattern)
                continue
            ids = result.select(F.col(columns[i]).alias("id")).distinct()
            pulled = pull_df(source, ids, pattern, final_kinds[i])
            packed = pulled.select(F.col("id").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in pulled.columns if c != "id"]).alias("__p"))
            result = result.join(packed, F.col(f"`{columns[i]}`") == F.col("__id"), "left").withColumn(columns[i], F.col("__p")).drop("__id", "__p")
    return result, final_kinds, after


def _is_ref(x: Any) -> bool:
    return isinstance(x, list | tuple) and len(x) == 2 and isinstance(x[0], Keyword)


def _lookup_refs(q: Query, inputs: tuple, ctx: Context) -> tuple[tuple, Context]:
    """Clauses and context in which variables of collection inputs that hold lookup refs are joined by the entities they name; the find clause still gives the refs."""
    where, source = q.where, ctx.sources.get("$")
    for b, x in zip(q.inputs, inputs, strict=True):
        if not isinstance(b, BindColl | BindTuple) or isinstance(x, DataFrame) or source is None:
            continue
        rows = flatten(b, x)
        for v in vars_of(b):
            refs = {tuple(r[v]) for r in rows if _is_ref(r.get(v))}
            if not refs or len(refs) < len({str(r[v]) for r in rows}):
                continue
            if isinstance(source, MappedSource):
                table = source.column(next(iter(refs))[0])[0]
                found, kind = [(r, source.key_of(list(r), table)) for r in refs], f"eid:{table}"
            else:
                found, kind = [(r, source.resolve(list(r))) for r in refs], "long"
            hidden = f"{v}__entity"
            df, kinds = frame(ctx.spark, [(list(r), e) for r, e in found if e is not None], 2)
            pairs = Rel(df.select(F.col("c0").alias(v), F.col("c1").alias(hidden)), {v: kinds[0], hidden: kind})
            where, ctx = rename(where, {v: Var(hidden)}), ctx.add(pairs)
    return where, ctx


def q(query: Any, *inputs: Any, spark: SparkSession | None = None) -> Any:
    """What a query finds, as Python values in the shape of its find clause.

    A set of tuples (a list where :with or aggregates keep repeated rows), a list
    for [?x ...], a tuple for [?x ?y], a value for ?x . , dicts with :keys and
    the like.
    """
    parsed = parse_query(query)
    pulls: dict[Any, Any] = {"driver": True}
    df, kinds, _ = _run(parsed, inputs, spark, pulls)
    if parsed.shape in ("tuple", "scalar"):
        df = df.limit(1)
    from .operators.pull import pull

    value = lambda i, v, k: pull(*pulls[i], v) if i in pulls else _python(v, k)
    rows = [tuple(value(i, v, k) for i, (v, k) in enumerate(zip(r, kinds, strict=True))) for r in df.collect()]
    if parsed.keys:
        dicts = [dict(zip(parsed.keys, r, strict=True)) for r in rows]
        return dicts if parsed.shape == "rel" else dicts[0] if dicts else None
    if parsed.shape == "coll":
        return [r[0] for r in rows]
    if parsed.shape == "tuple":
        return list(rows[0]) if rows else None
    if parsed.shape == "scalar":
        return rows[0][0] if rows else None
    if parsed.with_ or any(isinstance(f, Aggregate | Pull) for f in parsed.find):
        return rows
    return set(rows)


def _python(v: Any, kind: str) -> Any:
    from .edn import Symbol

    if v is None:
        return None
    if kind == "any":
        return untagged(v)
    if kind == "keyword":
        return Keyword(v)
    if kind == "symbol":
        return Symbol(v)
    if isinstance(v, list):
        return tuple(untagged(x) if isinstance(x, tuple) and len(x) == 6 and hasattr(x, "rank") else x for x in v)
    return v.asDict(True) if hasattr(v, "asDict") else v

