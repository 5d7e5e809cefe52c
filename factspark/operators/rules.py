"""Rule calls.

A rule that does not reach itself is put in place, as a disjunction over its
head variables.  A recursive one is evaluated with all rules that it reaches
and that reach it, semi-naively: each round joins what the last round added,
and stops when nothing is new.  Rounds are written to the shared folder.

What a call binds reaches the first round: a transitive closure starts from
the edges at the bound end only, and other rules start from the bound values
of arguments that they hand on unchanged.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from ..functions.builtins import Arg, constant, equal
from ..plans.compile import Context, Known, check_order, disjunction, product, resolve
from ..plans.syntax import And, Blank, Branch, Const, Function, Not, Or, Pattern, Plain, Predicate, QueryError, RuleCall, Src, Var, vars_of
from ..sources.base import Rel, dealt, join, materialise, union

_fresh = 0


def rename(x: Any, names: dict[str, Any]) -> Any:
    """A tree with variables replaced."""
    if isinstance(x, Var):
        return names.get(x.name, x)
    if isinstance(x, tuple):
        return tuple(rename(y, names) for y in x)
    if isinstance(x, Pattern):
        return Pattern(x.src, rename(x.terms, names))
    if isinstance(x, Predicate):
        return Predicate(rename(x.fn, names), rename(x.args, names))
    if isinstance(x, Function):
        return Function(rename(x.fn, names), rename(x.args, names), rename(x.binding, names))
    if isinstance(x, RuleCall):
        return RuleCall(x.src, x.name, rename(x.args, names))
    if isinstance(x, Not):
        return Not(x.src, rename(x.clauses, names), rename(x.vars, names) if x.vars is not None else None)
    if isinstance(x, Or):
        return Or(x.src, rename(x.branches, names), rename(x.required, names), rename(x.free, names) if x.free is not None else None)
    if isinstance(x, And):
        return And(rename(x.clauses, names))
    if hasattr(x, "__dataclass_fields__") and not isinstance(x, Const | Plain | Src | Blank):
        return replace(x, **{f: rename(getattr(x, f), names) for f in x.__dataclass_fields__})
    return x


def calls_in(clauses: tuple) -> list[RuleCall]:
    out: list[RuleCall] = []
    for c in clauses:
        if isinstance(c, RuleCall):
            out.append(c)
        elif isinstance(c, Not | And):
            out += calls_in(c.clauses)
        elif isinstance(c, Or):
            out += calls_in(c.branches)
    return out


def reach(rules: dict[str, list[Branch]], name: str) -> set[str]:
    seen, todo = set(), [name]
    while todo:
        for b in rules.get(todo.pop(), []):
            for c in calls_in(b.clauses):
                if c.name not in seen:
                    seen.add(c.name)
                    todo.append(c.name)
    return seen


def fresh(branch: Branch, heads: list[Any], target: list[Var]) -> Branch:
    """The branch with its head variables named as target and its others renamed apart."""
    global _fresh  # noqa: PLW0603
    _fresh += 1
    names: dict[str, Any] = {v: Var(f"{v}__{_fresh}") for v in vars_of(branch.clauses)}
    for v, t in zip(heads, target, strict=True):
        names[v.name] = t
    return Branch((), (), rename(branch.clauses, names))


def call(c: RuleCall, ctx: Context) -> Context:
    branches = ctx.rules.get(c.name)
    if branches is None:
        raise QueryError(f"no rule {c.name} for {c}")
    head = [*branches[0].required, *branches[0].free]
    if len(c.args) != len(head):
        raise QueryError(f"the rule {c.name} does not take {len(c.args)} arguments")
    args = tuple(Var(a.name) if isinstance(a, Plain) else a for a in c.args)
    for a in args[: len(branches[0].required)]:
        if isinstance(a, Var) and a.name not in ctx.bound():
            raise QueryError(f"unbound: {a.name} in {c}")
    scoped = ctx.with_(sources=ctx.sources | {"$": ctx.source(c.src)}) if c.src.name != "$" else ctx
    if c.name in reach(ctx.rules, c.name):
        return _back(ctx, _fixpoint(c.name, scoped, args), args)
    return _inline(c, args, branches, ctx, scoped)


def _back(ctx: Context, rel: Rel, args: tuple) -> Context:
    from ..plans.compile import known

    return known(Known(rel, args), ctx)


def _inline(c: RuleCall, args: tuple, branches: list[Branch], ctx: Context, scoped: Context) -> Context:
    """A disjunction over fresh head variables, which constants fix from the start."""
    global _fresh  # noqa: PLW0603
    _fresh += 1
    target, fixed, seen = [], dict(scoped.fixed), {}
    for i, a in enumerate(args):
        if isinstance(a, Var) and a.name not in seen and a.name not in scoped.fixed:
            seen[a.name] = a
            target.append(a)
        else:
            v = Var(f"?arg{i}__{_fresh}")
            if isinstance(a, Const):
                fixed[v.name] = a.value
            elif isinstance(a, Var) and a.name in scoped.fixed:
                fixed[v.name] = scoped.fixed[a.name]
            target.append(v)
    free, bodies = tuple(target), []
    for b in branches:
        bodies.append(And(fresh(b, [*b.required, *b.free], target).clauses))
    again = [(v, a) for v, a in zip(target, args, strict=True) if isinstance(a, Var) and v is not a and a.name in seen]
    given = scoped.with_(fixed=fixed)
    required = tuple(v for v in free if v.name in given.bound())
    out = disjunction(Or(Src(), tuple(bodies), required, tuple(v for v in free if v not in required)), given)
    for v, a in again:
        from ..plans.compile import predicate

        out = predicate(Predicate(Plain("="), (v, a)), out)
    used = {v for x in args if isinstance(x, Var) for v in [x.name]}
    rels = [r.project([v for v in r.kinds if v in used or v in ctx.kinds() or not v.startswith("?arg")]) for r in out.rels]
    return out.with_(rels=rels, fixed=ctx.fixed, sources=ctx.sources)


def _fixpoint(name: str, ctx: Context, args: tuple) -> Rel:
    """All tuples of a recursive rule, as columns h0.., from rules that reach each other."""
    rules = ctx.rules
    group = {n for n in {name} | reach(rules, name) if name in reach(rules, n) or n == name}
    fixed = {k: v for k, v in ctx.fixed.items() if callable(v)}
    head = {n: [*rules[n][0].required, *rules[n][0].free] for n in group}
    # A function passed down unchanged is named as in the call.
    handed = {head[name][i].name: a for i, a in enumerate(args) if isinstance(a, Var) and callable(ctx.fixed.get(a.name))}
    base = ctx.with_(rels=[], fixed=fixed | {v: ctx.fixed[a.name] for v, a in handed.items()})

    def evaluate(n: str, b: Branch, swap: dict[int, Rel]) -> Rel:
        """A branch with its calls into the group, by number, replaced by relations."""
        heads = [*b.required, *b.free]
        count = [-1]

        def put(c: Any) -> Any:
            if isinstance(c, RuleCall) and c.name in group:
                count[0] += 1
                return Known(swap[count[0]], c.args)
            if isinstance(c, Not):
                if any(x.name in group for x in calls_in(c.clauses)):
                    raise QueryError("a recursive rule cannot call itself under not")
                return c
            if isinstance(c, And):
                return And(tuple(map(put, c.clauses)))
            return Or(c.src, tuple(map(put, c.branches)), c.required, c.free) if isinstance(c, Or) else c

        clauses = tuple(map(put, b.clauses))
        check_order(clauses, set(base.fixed), rules)
        rel = product(resolve(clauses, base), [v.name for v in heads])
        out = {}
        for i, v in enumerate(heads):
            if v.name in rel.kinds:
                out[f"h{i}"] = (rel.col(v.name), rel.kinds[v.name])
        return Rel(rel.df.select(*[c.alias(h) for h, (c, _) in out.items()]), {h: k for h, (_, k) in out.items()}).distinct()

    total: dict[str, Rel] = {}
    for n in group:
        seeds = [evaluate(n, b, {}) for b in rules[n] if not any(c.name in group for c in calls_in(b.clauses))]
        if seeds:
            rel = seeds[0]
            for s in seeds[1:]:
                rel = union(rel, s).distinct()
            total[n] = Rel(materialise(rel.df), rel.kinds, frozenset(rel.kinds))
    if not total:
        raise QueryError(f"rule '{name}' has no branch to start from")
    if _is_closure(name, rules, group):
        for i in (0, 1):
            seeds = _bound(total[name], f"h{i}", args[i], ctx)
            if seeds is not None:
                return _paths_from(seeds, total[name], i)
        return _closure(total[name])
    for i, a in enumerate(args):
        if group == {name} and _handed_on(rules[name], name, i) and f"h{i}" in total[name].kinds:
            seeds = _bound(total[name], f"h{i}", a, ctx)
            if seeds is not None:
                total[name] = Rel(materialise(seeds.df), seeds.kinds, seeds.unique)
    delta = dict(total)
    rows = {n: rel.df.count() for n, rel in total.items()}
    while delta:
        found: dict[str, Rel] = {}
        for n in group:
            for b in rules[n]:
                inner = [c.name for c in calls_in(b.clauses) if c.name in group]
                for i, m in enumerate(inner):
                    if m not in delta or any(x not in total for x in inner):
                        continue
                    rel = evaluate(n, b, {j: delta[x] if j == i else total[x] for j, x in enumerate(inner)})
                    found[n] = union(found[n], rel) if n in found else rel
        delta = {}
        for n, rel in found.items():
            new = rel.distinct()
            if n in total:
                new = join(new, total[n], "left_anti")
            new, more = _round(new, sum(rows.values()))
            if more:
                delta[n] = new
                total[n] = _grown(total[n], new) if n in total else new
                rows[n] = rows.get(n, 0) + more
    if name not in total:
        raise QueryError(f"rule '{name}' has no branch to start from")
    return total[name]


def _is_closure(name: str, rules: dict[str, list[Branch]], group: set[str]) -> bool:
    """Whether a rule is the transitive closure of its first branch: r(a, b) from e(a, b), or from e(a, t) and r(t, b), or from r(a, t) and e(t, b)."""
    if len(group) > 1 or len(rules[name]) != 2:
        return False
    base, step = sorted(rules[name], key=lambda b: any(c.name in group for c in calls_in(b.clauses)))
    calls = [c for c in step.clauses if isinstance(c, RuleCall) and c.name in group]
    if calls_in(base.clauses) or len(calls_in(step.clauses)) != 1 or len(calls) != 1 or len(calls[0].args) != 2:
        return False
    rest = tuple(c for c in step.clauses if c is not calls[0])
    (a, b), (x, y) = [*step.required, *step.free], calls[0].args
    h0, h1 = Var("?h0"), Var("?h1")
    p, r = [*base.required, *base.free]
    target = rename(base.clauses, {p.name: h0, r.name: h1})
    if isinstance(x, Var) and y == b and x not in (a, b):
        return rename(rest, {a.name: h0, x.name: h1}) == target
    if isinstance(y, Var) and x == a and y not in (a, b):
        return rename(rest, {y.name: h0, b.name: h1}) == target
    return False


def _bound(rel: Rel, h: str, a: Any, ctx: Context) -> Rel | None:
    """The rows of rel whose column h has the value, or one of the values, that the call gives it; None if it gives none."""
    if isinstance(a, Const) or (isinstance(a, Var) and a.name in ctx.fixed and not callable(ctx.fixed[a.name])):
        value = a.value if isinstance(a, Const) else ctx.fixed[a.name]
        return rel.filter(equal(Arg(rel.col(h), rel.kinds[h]), constant(value)))
    for held in ctx.rels:
        if isinstance(a, Var) and a.name in held.kinds:
            values = Rel(held.df.select(held.col(a.name).alias(h)), {h: held.kinds[a.name]}).distinct()
            kept = join(rel, values, "left_semi")
            return Rel(kept.df, kept.kinds, rel.unique)
    return None


def _handed_on(branches: list[Branch], name: str, i: int) -> bool:
    """Whether every call of the rule to itself has the rule's own i-th argument in the i-th place."""
    return all(c.args[i] == [*b.required, *b.free][i] for b in branches for c in calls_in(b.clauses) if c.name == name)


def _paths_from(seeds: Rel, edges: Rel, end: int) -> Rel:
    """Paths of any length that begin (end 0) or stop (end 1) with an edge of seeds: each round is one edge longer."""
    from ..sources.base import common_kind

    if common_kind(edges.kinds["h0"], edges.kinds["h1"]) is None:
        return seeds
    total = new = Rel(materialise(seeds.df), seeds.kinds, frozenset(seeds.kinds))
    rows = total.df.count() + edges.df.count()
    grows, stays = ("h1", "h0") if end == 0 else ("h0", "h1")
    step = Rel(edges.df.select(edges.col("h0").alias("t" if end == 0 else "h0"), edges.col("h1").alias("h1" if end == 0 else "t")), {"t": edges.kinds[stays], grows: edges.kinds[grows]})
    while True:
        at = Rel(new.df.select(new.col(stays), new.col(grows).alias("t")), {stays: new.kinds[stays], "t": new.kinds[grows]})
        new, more = _round(join(join(at, step).project(["h0", "h1"]).distinct(), total, "left_anti"), rows)
        if not more:
            return total
        total, rows = _grown(total, new), rows + more


def _round(found: Rel, rows: int) -> tuple[Rel, int]:
    """What a round found over so many rows, written, and its number of rows."""
    with dealt(found.df.sparkSession, rows):
        new = Rel(materialise(found.df), found.kinds, frozenset(found.kinds))
    return new, new.df.count()


def _grown(total: Rel, new: Rel) -> Rel:
    """Both, which share no row."""
    both = union(total, new)
    return Rel(both.df.hint("merge"), both.kinds, frozenset(both.kinds))


def _closure(edges: Rel) -> Rel:
    """Paths of any length, doubling the length that is covered each round.

    far: pairs whose shortest path has a length of 2 ** k, near: those with a shorter one.  A pair at less than twice that
    length is one of far behind one of near, so that paths are not put together at each of their inner nodes.
    """
    from ..sources.base import common_kind

    if common_kind(edges.kinds["h0"], edges.kinds["h1"]) is None:
        return edges

    def behind(a: Rel, b: Rel) -> Rel:
        left = Rel(a.df.select(a.col("h0"), a.col("h1").alias("t")), {"h0": a.kinds["h0"], "t": a.kinds["h1"]})
        right = Rel(b.df.select(b.col("h0").alias("t"), b.col("h1")), {"t": b.kinds["h0"], "h1": b.kinds["h1"]})
        return join(join(left, right).project(["h0", "h1"]).distinct(), total, "left_anti")

    near, far, total = None, edges, edges
    rows = edges.df.count()
    while True:
        if near is not None:
            new, more = _round(behind(near, far), rows)
            total, rows = _grown(total, new) if more else total, rows + more
        near = total
        far, more = _round(behind(far, far), rows)
        if not more:
            return total
        total, rows = _grown(total, far), rows + more
