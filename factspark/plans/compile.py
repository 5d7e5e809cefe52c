"""From a parsed query and its inputs to a DataFrame.

Clauses are checked in the order they are written; the plan itself is free of
order.  The context is a list of relations that share no variables; a clause
joins those it touches.  Patterns about one entity of mapped tables become one
scan.  Relations that nothing connects are crossed only where a predicate, a
function or the find clause needs both.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builtins import BUILTINS, WITH_SOURCE, Arg, constant, equal, truth
from ..sources.base import Rel, Source, convert, join, theta, union
from ..sources.collection import CollectionSource, frame
from ..values import kind_of_type, to_any
from .syntax import (
    And, BindIgnore, BindRules, BindScalar, BindSource, BindTuple, Blank, Branch, Const, Function, Not, Or, Pattern, Plain, Predicate, Query, QueryError, RuleCall, Src, Var, vars_of,
)


@dataclass(frozen=True)
class Known:
    """A clause that is a relation already: rows of columns h0.. for args."""

    rel: Rel
    args: tuple


@dataclass
class Context:
    spark: SparkSession
    sources: dict[str, Source]
    rules: dict[str, list[Branch]] = field(default_factory=dict)
    rels: list[Rel] = field(default_factory=list)
    fixed: dict[str, Any] = field(default_factory=dict)  # scalar inputs: constants and callables by variable
    compared: list[set[str]] = field(default_factory=list)  # variables of each comparison among the clauses

    def kinds(self) -> dict[str, str]:
        return {v: k for r in self.rels for v, k in r.kinds.items()}

    def bound(self) -> set[str]:
        return set(self.kinds()) | set(self.fixed)

    def with_(self, **changes: Any) -> Context:
        return replace(self, **changes)

    def source(self, src: Src) -> Source:
        if src.name not in self.sources:
            raise QueryError(f"no input for the source {src.name}")
        return self.sources[src.name]

    def add(self, rel: Rel) -> Context:
        """Joins rel with the relations that share variables with it."""
        rel = self._fix(rel)
        touching, apart = [], []
        for r in self.rels:
            (touching if set(r.kinds) & set(rel.kinds) else apart).append(r)
        for r in touching:
            rel = theta(r, rel) if self._is_theta(r, rel) else join(r, rel)
        return self.with_(rels=[*apart, rel])

    def _is_theta(self, a: Rel, b: Rel) -> bool:
        """Whether a comparison picks pairs of two relations, neither of which has one row for the variables they share."""
        shared = set(a.kinds) & set(b.kinds)
        across = any(c & set(a.kinds) - shared and c & set(b.kinds) - shared for c in self.compared)
        return across and not a.single(shared) and not b.single(shared)

    def _fix(self, rel: Rel) -> Rel:
        """Columns of fixed variables become filters."""
        for v in [v for v in rel.kinds if v in self.fixed and not callable(self.fixed[v])]:
            rel = rel.filter(equal(Arg(rel.col(v), rel.kinds[v]), constant(self.fixed[v])))
            rest = [x for x in rel.kinds if x != v]
            keys = {x: e for x, e in rel.keys.items() if v not in (x, e)}
            rel = Rel(rel.df.drop(v), {x: rel.kinds[x] for x in rest}, rel.unique - {v} if rel.unique is not None else None, keys)
        return rel

    def together(self, names: set[str]) -> tuple[Context, Rel | None]:
        """The context with the relations of names made one, and that one."""
        touched = [r for r in self.rels if set(r.kinds) & names]
        if not touched:
            return self, None
        one = reduce(join, touched)
        return self.with_(rels=[*[r for r in self.rels if not set(r.kinds) & names], one]), one

    def swap(self, old: Rel | None, new: Rel) -> Context:
        return self.with_(rels=[new if r is old else r for r in self.rels]) if old is not None else self.with_(rels=[*self.rels, new])


def one_row(spark: SparkSession) -> Rel:
    return Rel(spark.range(1).select(), {}, frozenset())


# ---- inputs


def bind_inputs(q: Query, inputs: tuple, spark: SparkSession) -> Context:
    if len(inputs) > len(q.inputs):
        raise QueryError(f"the query takes {len(q.inputs)} inputs, {len(inputs)} were given: too many")
    if len(inputs) < len(q.inputs):
        raise QueryError(f"the query takes {len(q.inputs)} inputs, {len(inputs)} were given: not enough")
    from .parse import parse_rules

    ctx = Context(spark, {})
    for b, x in zip(q.inputs, inputs, strict=True):
        if isinstance(b, BindSource):
            ctx.sources[b.src.name] = as_source(spark, x)
        elif isinstance(b, BindRules):
            ctx.rules.update(parse_rules(x))
        elif isinstance(b, BindScalar):
            ctx.fixed[b.var.name] = x
        elif not isinstance(b, BindIgnore):
            ctx = ctx.add(bind_value(spark, b, x))
    return ctx


def as_source(spark: SparkSession, x: Any) -> Source:
    if isinstance(x, Source):
        return x
    if hasattr(x, "as_source"):
        return x.as_source(spark)
    return CollectionSource(spark, x)


def flatten(b: Any, x: Any) -> list[dict[str, Any]]:
    """Rows of variables that a binding takes from a Python value."""
    if isinstance(b, BindIgnore):
        return [{}]
    if isinstance(b, BindScalar):
        return [{b.var.name: x}]
    if isinstance(b, BindTuple):
        if not isinstance(x, list | tuple):
            raise QueryError(f"no tuple to bind: {x!r}")
        if len(x) < len(b.parts):
            raise QueryError(f"too short for the tuple that it is bound to: {x!r}")
        rows: list[dict[str, Any]] = [{}]
        for p, y in zip(b.parts, x, strict=False):
            rows = [r | s for r in rows for s in flatten(p, y)]
        return rows
    if isinstance(x, str | int | float) or x is None:
        raise QueryError(f"no collection to bind: {x!r}")
    items = x.items() if isinstance(x, dict) else x
    return [r for y in items for r in flatten(b.inner, y)]


def bind_value(spark: SparkSession, b: Any, x: Any) -> Rel:
    names = vars_of(b)
    if isinstance(x, DataFrame):
        df = x.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(x.columns, names, strict=False)])
        return Rel(df, {n: kind_of_type(df.schema[n].dataType) for n in names})
    rows = flatten(b, x)
    if not names:
        return one_row(spark) if rows else Rel(spark.range(0).select(), {}, frozenset())
    df, kinds = frame(spark, [tuple(r[n] for n in names) for r in rows], len(names))
    return Rel(df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]), dict(zip(names, kinds, strict=True)))


# ---- clauses


def check_order(clauses: tuple, bound: set[str], rules: dict) -> set[str]:
    """Variables bound after the clauses; raises where one needs a variable that is not bound before it."""
    bound = set(bound)
    for c in clauses:
        if isinstance(c, Predicate | Function):
            needs = set(vars_of(c.args)) | set(vars_of(c.fn))
            if needs - bound:
                raise QueryError(f"unbound: {' '.join(sorted(needs - bound))} in {c}")
            bound |= set(vars_of(c.binding)) if isinstance(c, Function) else set()
        elif isinstance(c, Not):
            names = set(vars_of(c))
            if c.vars is not None:
                if missing := {v.name for v in c.vars} - bound:
                    raise QueryError(f"unbound: {' '.join(sorted(missing))} in {c}")
                check_order(c.clauses, {v.name for v in c.vars}, rules)
            else:
                if not names & bound:
                    raise QueryError(f"unbound: each of {' '.join(sorted(names))} in {c}")
                check_order(c.clauses, bound, rules)
        elif isinstance(c, Or):
            if c.free is None:
                free = [set(vars_of(b)) - bound for b in c.branches]
                if any(f != free[0] for f in free):
                    raise QueryError(f"branches of or bind different variables, {[sorted(f) for f in free]}, in {c}")
                for b in c.branches:
                    check_order((b,), bound, rules)
                bound |= free[0]
            else:
                if missing := {v.name for v in c.required} - bound:
                    raise QueryError(f"unbound: {' '.join(sorted(missing))} in {c}")
                given = {v.name for v in c.required} | ({v.name for v in c.free} & bound)
                for b in c.branches:
                    after = check_order((b,), given, rules)
                    if lost := {v.name for v in c.free} - after:
                        raise QueryError(f"branches of or bind different variables: {sorted(lost)} not in {b}")
                bound |= {v.name for v in c.free}
        elif isinstance(c, And):
            bound = check_order(c.clauses, bound, rules)
        else:
            bound |= set(vars_of(c.args if isinstance(c, Known) else c))
    return bound


def stands_alone(clauses: tuple, given: set[str], rules: dict) -> bool:
    """Whether the clauses can be evaluated with only the given variables bound."""
    try:
        check_order(clauses, given, rules)
    except QueryError:
        return False
    return True


def resolve(clauses: tuple, ctx: Context) -> Context:
    """The context after the clauses."""
    outer = ctx.compared
    ctx = ctx.with_(compared=[*outer, *(set(vars_of(c.args)) for c in clauses if isinstance(c, Predicate) and c.fn not in (Plain("="), Plain("==")))])
    stars: dict[Any, list[Pattern]] = {}
    for c in clauses:
        if isinstance(c, Pattern) and (key := _star(c, ctx)) is not None:
            stars.setdefault(key, []).append(c)
    done = set()
    for c in clauses:
        if isinstance(c, Pattern):
            key = _star(c, ctx)
            if key is None:
                ctx = scan(ctx, [c])
            elif key not in done:
                done.add(key)
                ctx = scan(ctx, stars[key])
        else:
            ctx = STEPS[type(c)](c, ctx)
    return ctx.with_(compared=outer)


def _star(c: Pattern, ctx: Context) -> Any:
    source = ctx.source(c.src)
    key = source.group_key(_substituted(c, ctx))
    return (c.src.name, key) if key is not None else None


def _substituted(c: Pattern, ctx: Context) -> Pattern:
    """Fixed variables become constants, so that they reach the scan as filters."""
    return Pattern(c.src, tuple(Const(ctx.fixed[t.name]) if isinstance(t, Var) and t.name in ctx.fixed and not callable(ctx.fixed[t.name]) else t for t in c.terms))


def scan(ctx: Context, patterns: list[Pattern]) -> Context:
    rel = ctx.source(patterns[0].src).scan([_substituted(p, ctx) for p in patterns], ctx.kinds())
    return ctx.add(rel) if rel.kinds else _exists(ctx, rel)


def _exists(ctx: Context, rel: Rel) -> Context:
    """A relation without variables: rows stay if it has any."""
    some = Rel(rel.df.limit(1), {}, frozenset())
    return ctx.with_(rels=[*ctx.rels, some])


def argument(ctx: Context, rel: Rel | None, a: Any) -> Arg:
    if isinstance(a, Const):
        return constant(a.value)
    if isinstance(a, Var):
        if a.name in ctx.fixed:
            return constant(ctx.fixed[a.name])
        return Arg(rel.col(a.name), rel.kinds[a.name])
    if isinstance(a, Plain):
        return constant(a.name)
    raise QueryError(f"no value for {a}")


def function_of(ctx: Context, fn: Any, what: str) -> Callable[[list[Arg]], Arg]:
    name = fn.name
    if isinstance(fn, Plain) and name in BUILTINS:
        return BUILTINS[name]
    f = ctx.fixed.get(name)
    if f is None and "/" in name:
        module, _, attr = name.rpartition("/")
        try:
            f = getattr(importlib.import_module(module), attr)
        except (ImportError, AttributeError):
            f = None
    if f is None:
        raise QueryError(f"no {what} {name}")
    return lambda args: _call(f, args)


def _call(f: Callable, args: list[Arg]) -> Arg:
    """A Python function of columns.  It may be marked with a kind; one that is not a column function runs as a UDF."""
    out = f(*[a.col for a in args])
    return out if isinstance(out, Arg) else Arg(out, getattr(f, "kind", "bool"))


def column_function(kind: str) -> Callable[[Callable], Callable]:
    """Marks a function of columns with the kind of its result."""

    def mark(f: Callable) -> Callable:
        f.kind = kind
        return f

    return mark


def predicate(c: Predicate, ctx: Context) -> Context:
    if isinstance(c.fn, Plain) and c.fn.name == "missing?":
        return _missing(c, ctx)
    ctx, rel = ctx.together(set(vars_of(c.args)))
    if any(isinstance(a, Src) for a in c.args):
        f = ctx.fixed.get(c.fn.name)
        if f is None:
            raise QueryError(f"no predicate {c.fn.name}")
        args = [ctx.source(a) if isinstance(a, Src) else argument(ctx, rel, a).col for a in c.args]
        cond = f(*args)
    else:
        fn = function_of(ctx, c.fn, "predicate")
        cond = truth(fn([argument(ctx, rel, a) for a in c.args]))
    if rel is None:
        return ctx.with_(rels=[*ctx.rels, one_row(ctx.spark).filter(cond)])
    return ctx.swap(rel, rel.filter(cond))


def function(c: Function, ctx: Context) -> Context:
    if isinstance(c.fn, Plain) and c.fn.name in WITH_SOURCE:
        return {"get-else": _get_else, "get-some": _get_some}[c.fn.name](c, ctx)
    ctx, rel = ctx.together(set(vars_of(c.args)))
    fn = function_of(ctx, c.fn, "function")
    args = [argument(ctx, rel, a) for a in c.args]
    if all(a.fixed for a in args) and isinstance(c.fn, Plain) and c.fn.name in ("ground", "identity", "untuple", "re-pattern"):
        value = args[0].value
        if isinstance(c.binding, BindScalar) and c.binding.var.name not in ctx.bound():
            return ctx.with_(fixed=ctx.fixed | {c.binding.var.name: value})
        return ctx.add(bind_value(ctx.spark, c.binding, value))
    base = rel if rel is not None else one_row(ctx.spark)
    out = fn(args)
    if out.kind == "nil":
        out = Arg(F.lit(None).cast("string"), "string")
    new, names = destructure(base, c.binding, out, ctx)
    if rel is not None:
        ctx = ctx.with_(rels=[r for r in ctx.rels if r is not rel])
    return ctx.add(new)


def destructure(rel: Rel, b: Any, value: Arg, ctx: Context) -> tuple[Rel, list[str]]:
    """rel with the variables of a binding of value; a null drops the row, and a bound variable must be equal."""
    if isinstance(b, BindIgnore):
        return rel.filter(value.col.isNotNull()), []
    if isinstance(b, BindScalar):
        name = b.var.name
        rel = rel.filter(value.col.isNotNull())
        if name in rel.kinds:
            return rel.filter(equal(Arg(rel.col(name), rel.kinds[name]), value)), [name]
        df = rel.df.withColumn(name, value.col)
        kind = value.kind if value.kind != "item" else kind_of_type(df.schema[name].dataType)
        return Rel(df, rel.kinds | {name: kind}, rel.unique), [name]
    if isinstance(b, BindTuple):
        names = []
        parts = value.value if value.fixed and isinstance(value.value, list | tuple) else None
        for i, p in enumerate(b.parts):
            item = constant(parts[i]) if parts is not None else Arg(F.get(value.col, F.lit(i)), "item")
            rel, more = destructure(rel, p, item, ctx)
            names += more
        return rel, names
    tmp = "__item"
    df = rel.df.withColumn(tmp, F.explode(value.col))
    inner, names = destructure(Rel(df, rel.kinds, None), b.inner, Arg(F.col(tmp), kind_of_type(df.schema[tmp].dataType)), ctx)
    return Rel(inner.df.drop(tmp), inner.kinds, None), names


def _facts(ctx: Context, src: Src, rel: Rel, e: Any, attr: Any, value: str) -> Rel:
    """The values of an attribute for the entities of e, as variable value."""
    a = str(attr.value)
    from ..schema import is_reverse, reverse

    terms = (Var(value), Const(type(attr.value)(reverse(a))), e) if is_reverse(a) else (e, Const(attr.value), Var(value))
    return ctx.source(src).scan([Pattern(src, terms)], rel.kinds if rel else {})


def _missing(c: Predicate, ctx: Context) -> Context:
    src, e, attr = c.args
    ctx, rel = ctx.together(set(vars_of(e)))
    return ctx.swap(rel, join(rel, _facts(ctx, src, rel, e, attr, "__v").project([e.name]), "left_anti"))


def _get_else(c: Function, ctx: Context) -> Context:
    src, e, attr, default = c.args
    ctx, rel = ctx.together(set(vars_of((e, default))))
    d = argument(ctx, rel, default)
    if d.kind == "nil":
        raise QueryError("get-else needs a default that is a value")
    facts = _facts(ctx, src, rel, e, attr, "__v")
    kind = facts.kinds["__v"]
    if kind != d.kind:
        value = (lambda col: F.when(col.isNull(), to_any(d.col, d.kind)).otherwise(to_any(col, kind)))
        out_kind = "any"
    else:
        value, out_kind = (lambda col: F.coalesce(col, d.col)), kind
    name = e.name
    right = facts.cast(name, rel.kinds[name]) if facts.kinds[name] != rel.kinds[name] else facts
    df = rel.df.join(right.df.withColumnRenamed(name, "__e"), F.col(f"`{name}`") == F.col("__e"), "left")
    df = df.withColumn("__out", value(F.col("__v"))).drop("__e", "__v")
    new, _ = destructure(Rel(df, rel.kinds, rel.unique if right.unique is not None else None), c.binding, Arg(F.col("__out"), out_kind), ctx)
    return ctx.with_(rels=[r for r in ctx.rels if r is not rel]).add(Rel(new.df.drop("__out"), new.kinds, new.unique))


def _get_some(c: Function, ctx: Context) -> Context:
    src, e, *attrs = c.args
    ctx, rel = ctx.together(set(vars_of(e)))
    df, name, pairs = rel.df, e.name, []
    for i, attr in enumerate(attrs):
        facts = _facts(ctx, src, rel, e, attr, f"__v{i}")
        right = facts.df.select(F.col(f"`{name}`").alias(f"__e{i}"), F.col(f"__v{i}"))
        df = df.join(right, F.col(f"`{name}`") == F.col(f"__e{i}"), "left").drop(f"__e{i}")
        pairs.append((attr.value, F.col(f"__v{i}"), facts.kinds[f"__v{i}"]))
    kinds = {k for _, _, k in pairs}
    kind = kinds.pop() if len(kinds) == 1 else "any"
    attr_col = F.coalesce(*[F.when(v.isNotNull(), F.lit(str(a))) for a, v, _ in pairs])
    value = F.coalesce(*[F.when(v.isNotNull(), convert(v, k, kind)) for _, v, k in pairs])
    df = df.withColumn("__a", attr_col).withColumn("__x", value).drop(*[f"__v{i}" for i in range(len(attrs))]).filter("__a is not null")
    parts = c.binding.parts if isinstance(c.binding, BindTuple) else None
    if parts is None:
        raise QueryError("get-some gives a tuple [attr value]")
    new, _ = destructure(Rel(df, rel.kinds), parts[0], Arg(F.col("__a"), "keyword"), ctx)
    if len(parts) > 1:
        new, _ = destructure(new, parts[1], Arg(F.col("__x"), kind), ctx)
    return ctx.with_(rels=[r for r in ctx.rels if r is not rel]).add(Rel(new.df.drop("__a", "__x"), new.kinds))


def within(clauses: tuple, ctx: Context, names: list[str], src: Src) -> Rel:
    """The relation of the named variables that the clauses give: from the clauses alone where they stand alone, else within the context."""
    inner = ctx.with_(sources=ctx.sources | {"$": ctx.source(src)} if src.name != "$" else ctx.sources)
    fixed = set(ctx.fixed)
    if stands_alone(clauses, fixed, ctx.rules):
        inner = inner.with_(rels=[])
    else:
        # Only what the clauses use of the context goes in.
        used = set(vars_of(clauses))
        inner = inner.with_(rels=[r.project([v for v in r.kinds if v in used]).distinct() for r in ctx.rels if set(r.kinds) & used])
    after = resolve(clauses, inner)
    rel = product(after, [n for n in names if n not in fixed])
    for n in names:  # what the clauses ground is a constant column outside
        if n not in fixed and n not in rel.kinds and n in after.fixed:
            c = constant(after.fixed[n])
            rel = Rel(rel.df.withColumn(n, c.col), rel.kinds | {n: c.kind}, rel.unique)
    return rel


def product(ctx: Context, names: list[str]) -> Rel:
    """One relation of the named variables; relations without any of them only say whether there are rows."""
    out = None
    for r in ctx.rels:
        keep = [v for v in r.kinds if v in names]
        part = r.project(keep) if keep else Rel(r.df.select().limit(1), {}, frozenset())
        out = part if out is None else join(out, part)
    return out if out is not None else one_row(ctx.spark)


def negation(c: Not, ctx: Context) -> Context:
    names = set(v.name for v in c.vars) if c.vars is not None else set(vars_of(c.clauses))
    inner_ctx = ctx
    if c.vars is not None:  # other names are local
        inner_ctx = ctx.with_(rels=[r.project([v for v in r.kinds if v in names]) for r in ctx.rels if set(r.kinds) & names], fixed={k: v for k, v in ctx.fixed.items() if k in names or callable(v)})
    shared = [v for v in names if v in ctx.kinds()]
    if not c.clauses:
        return ctx
    body = within(c.clauses, inner_ctx, shared, c.src)
    ctx, rel = ctx.together(set(shared))
    if rel is None:  # only fixed variables are shared: all rows go if the body has any
        some = body.df.limit(1).select(F.lit(1).alias("__x"))
        gone = one_row(ctx.spark).df.withColumn("__x", F.lit(1)).join(some, "__x", "left_anti").select()
        return ctx.with_(rels=[*ctx.rels, Rel(gone, {}, frozenset())])
    return ctx.swap(rel, join(rel, body, "left_anti"))


def disjunction(c: Or, ctx: Context) -> Context:
    if c.free is None:
        names = vars_of(c.branches)
        inner = ctx
    else:
        names = [v.name for v in (*c.required, *c.free)]
        inner = ctx.with_(rels=[r.project([v for v in r.kinds if v in names]).distinct() for r in ctx.rels if set(r.kinds) & set(names)], fixed={k: v for k, v in ctx.fixed.items() if k in names or callable(v)})
    names = [n for n in names if n not in ctx.fixed]
    parts = [within(b.clauses if isinstance(b, And) else (b,), inner, names, c.src) for b in c.branches]
    for v in {v for p in parts for v in p.kinds}:  # a branch that takes the variable from outside has it there
        parts = [p if v in p.kinds else join(p, product(inner, [v]).distinct()) for p in parts]
    rel = reduce(union, parts).distinct() if len(parts) > 1 else parts[0].distinct()
    return _join_or_semi(ctx, rel)


def _join_or_semi(ctx: Context, rel: Rel) -> Context:
    if not rel.kinds:
        return _exists(ctx, rel)
    touched = [r for r in ctx.rels if set(r.kinds) & set(rel.kinds)]
    if len(touched) == 1 and set(rel.kinds) <= set(touched[0].kinds):
        return ctx.swap(touched[0], join(touched[0], rel, "left_semi"))
    return ctx.add(rel)


def conjunction(c: And, ctx: Context) -> Context:
    return resolve(c.clauses, ctx)


def known(c: Known, ctx: Context) -> Context:
    """A relation with columns h0.. under the call's arguments."""
    rel, keep = c.rel, {}
    unique = rel.unique
    for i, a in enumerate(c.args):
        h = f"h{i}"
        if isinstance(a, Blank):
            unique = None if unique is not None and h in unique else unique
            continue
        if isinstance(a, Const) or (isinstance(a, Var) and a.name in ctx.fixed):
            value = a.value if isinstance(a, Const) else ctx.fixed[a.name]
            rel = rel.filter(equal(Arg(rel.col(h), rel.kinds[h]), constant(value)))
            unique = unique - {h} if unique is not None and rel.kinds[h] == constant(value).kind else None
        elif a.name in keep:
            same = rel.kinds[h] == rel.kinds[keep[a.name]]
            rel = rel.filter(equal(Arg(rel.col(h), rel.kinds[h]), Arg(rel.col(keep[a.name]), rel.kinds[keep[a.name]])))
            unique = frozenset(keep[a.name] if x == h else x for x in unique) if unique is not None and same else None
        else:
            keep[a.name] = h
    name_of = {h: n for n, h in keep.items()}
    unique = frozenset(name_of[h] for h in unique) if unique is not None and unique <= set(name_of) else None
    out = Rel(rel.df.select(*[F.col(h).alias(n) for n, h in keep.items()]), {n: rel.kinds[h] for n, h in keep.items()}, unique).distinct()
    return _join_or_semi(ctx, out)


def rule_call(c: RuleCall, ctx: Context) -> Context:
    from ..operators.rules import call

    return call(c, ctx)


STEPS: dict[type, Callable[[Any, Context], Context]] = {Predicate: predicate, Function: function, Not: negation, Or: disjunction, And: conjunction, Known: known, RuleCall: rule_call}
