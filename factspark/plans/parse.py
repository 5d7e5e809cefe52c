"""From EDN data to syntax trees, with validation."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

from ..edn import Form, Keyword, Symbol, read, write
from .syntax import (
    Aggregate, And, BindColl, BindIgnore, BindRules, BindScalar, BindSource, BindTuple, Blank, Branch, Const, Function, Not, Or, Pattern, Plain, Predicate, Pull, Query, QueryError, RuleCall, Src, Var, vars_of,
)

CLAUSE_WORDS = {"not", "not-join", "or", "or-join", "and"}


def term(x: Any) -> Any:
    if isinstance(x, Symbol):
        if x == "_":
            return Blank()
        if x.startswith("?"):
            return Var(str(x))
        if x.startswith("$"):
            return Src(str(x))
        return Const(x)
    return Const(x)


def fn_arg(x: Any) -> Any:
    if isinstance(x, Symbol) and not x.startswith(("?", "$")) and x != "_":
        return Plain(str(x))
    return term(x)


def binding(x: Any) -> Any:
    if isinstance(x, Symbol):
        if x == "_":
            return BindIgnore()
        if x == "%":
            return BindRules()
        if x.startswith("$"):
            return BindSource(Src(str(x)))
        return BindScalar(Var(str(x)) if x.startswith("?") else Plain(str(x)))
    if isinstance(x, list):
        if len(x) == 2 and x[1] == "..." and isinstance(x[1], Symbol):
            return BindColl(binding(x[0]))
        if len(x) == 1 and isinstance(x[0], list):
            return BindColl(binding(x[0]))
        if x:
            return BindTuple(tuple(binding(y) for y in x))
        raise QueryError("a tuple binding names nothing")
    raise QueryError(f"not a binding of a value, a tuple, a collection or rows: {write(x)}")


def find_elem(x: Any) -> Any:
    if isinstance(x, Symbol) and x.startswith("?"):
        return Var(str(x))
    if isinstance(x, Form) and x:
        head, args = x[0], list(x[1:])
        if head == "pull":
            src = Src()
            if args and isinstance(args[0], Symbol) and args[0].startswith("$"):
                src = Src(str(args.pop(0)))
            if len(args) == 2 and isinstance(args[0], Symbol) and args[0].startswith("?"):
                return Pull(src, Var(str(args[0])), fn_arg(args[1]))
        elif head == "aggregate" and len(args) >= 2:
            return Aggregate(fn_arg(args[0]), tuple(fn_arg(a) for a in args[1:]), True)
        elif isinstance(head, Symbol) and not head.startswith("?"):
            return Aggregate(Plain(str(head)), tuple(fn_arg(a) for a in args))
    raise QueryError(f"not something to find: {write(x)}")


def find_spec(xs: list) -> tuple[str, tuple]:
    if len(xs) == 1 and isinstance(xs[0], list):
        inner = xs[0]
        if len(inner) == 2 and isinstance(inner[1], Symbol) and inner[1] == "...":
            return "coll", (find_elem(inner[0]),)
        return "tuple", tuple(map(find_elem, inner))
    if len(xs) == 2 and isinstance(xs[1], Symbol) and xs[1] == ".":
        return "scalar", (find_elem(xs[0]),)
    if not xs:
        raise QueryError("find names no rows, collection, tuple or single value")
    return "rel", tuple(map(find_elem, xs))


def clause(x: Any) -> Any:
    if isinstance(x, Form):
        return _list_clause(x)
    if isinstance(x, list) and x:
        if isinstance(x[0], Form):
            call = x[0]
            if not call:
                raise QueryError("a clause calls nothing")
            fn = call[0]
            target = Var(str(fn)) if str(fn).startswith("?") else Plain(str(fn))
            args = tuple(fn_arg(a) for a in call[1:])
            if len(x) == 1:
                return Predicate(target, args)
            if len(x) == 2:
                return Function(target, args, binding(x[1]))
            raise QueryError(f"not a clause: {write(x)}")
        src, rest = Src(), x
        if isinstance(x[0], Symbol) and x[0].startswith("$"):
            src, rest = Src(str(x[0])), x[1:]
        if not rest:
            raise QueryError("a pattern without terms")
        return Pattern(src, tuple(map(term, rest)))
    raise QueryError(f"neither a pattern, a call nor a combination of clauses: {write(x)}")


def _list_clause(x: Form) -> Any:
    src, rest = Src(), list(x)
    if rest and isinstance(rest[0], Symbol) and rest[0].startswith("$"):
        src = Src(str(rest.pop(0)))
    if not rest or not isinstance(rest[0], Symbol):
        raise QueryError(f"not a clause: {write(x)}")
    head, args = str(rest[0]), rest[1:]
    if head == "not":
        if not args:
            raise QueryError("not has no clauses")
        return Not(src, tuple(map(clause, args)))
    if head == "not-join":
        if not args or not isinstance(args[0], list) or not args[0]:
            raise QueryError("not-join takes variables, then clauses")
        return Not(src, tuple(map(clause, args[1:])), tuple(Var(str(v)) for v in args[0]))
    if head == "and":
        return And(tuple(map(clause, args)))
    if head == "or":
        if not args:
            raise QueryError("or has no branches")
        out = Or(src, tuple(map(clause, args)))
        return out
    if head == "or-join":
        if len(args) < 2 or not isinstance(args[0], list):
            raise QueryError("or-join takes variables, then branches")
        req, free = rule_vars(args[0])
        return Or(src, tuple(map(clause, args[1:])), req, free)
    if not args:
        raise QueryError("a rule is called with an argument at least")
    return RuleCall(src, head, tuple(fn_arg(a) for a in args))


def rule_vars(xs: list) -> tuple[tuple, tuple]:
    req: tuple = ()
    if xs and isinstance(xs[0], list):
        req, xs = tuple(Var(str(v)) for v in xs[0]), xs[1:]
    free = tuple(Var(str(v)) for v in xs)
    if not req and not free:
        raise QueryError("a rule head lists variables, those that must be bound in brackets before the others")
    names = [v.name for v in (*req, *free)]
    if len(names) != len(set(names)):
        raise QueryError("a rule head names a variable twice")
    return req, free


def parse_rules(data: Any) -> dict[str, list[Branch]]:
    data = read(data) if isinstance(data, str) else data
    out: dict[str, list[Branch]] = {}
    for r in data:
        head, body = r[0], r[1:]
        if not body:
            raise QueryError("a branch of a rule has no clauses")
        if not isinstance(head, tuple | list) or not head:
            raise QueryError(f"not a rule, which is its head and then clauses: {r!r}")
        req, free = rule_vars(list(head[1:]))
        branches = out.setdefault(str(head[0]), [])
        if branches and (len(branches[0].required), len(branches[0].free)) != (len(req), len(free)):
            raise QueryError(f"branches of the rule {head[0]} differ in their number of variables")
        branches.append(Branch(req, free, tuple(map(clause, body))))
    return out


def as_map(q: Any) -> dict[str, list]:
    if isinstance(q, dict):
        return {str(k).lstrip(":"): v for k, v in q.items()}
    out: dict[str, list] = {}
    key = None
    for x in q:
        if isinstance(x, Keyword):
            key = str(x)[1:]
            out[key] = []
        elif key is None:
            raise QueryError("a query begins with a keyword")
        else:
            out[key].append(x)
    return out


@lru_cache(100)
def _parse_text(text: str) -> Query:
    return _parse(read(text))


def parse_query(q: Any) -> Query:
    """A query as EDN text, list or dict."""
    return _parse_text(q) if isinstance(q, str) else _parse(q)


def _parse(data: Any) -> Query:
    m = as_map(data)
    unknown = set(m) - {"find", "with", "in", "where", "keys", "syms", "strs"}
    if unknown:
        raise QueryError(f"no such parts of a query: {sorted(unknown)}")
    shape, find = find_spec(m.get("find", []))
    where = tuple(map(clause, m.get("where", [])))
    kinds = [k for k in ("keys", "syms", "strs") if k in m]
    keys = None
    if len(kinds) > 1:
        raise QueryError(":keys, :syms and :strs exclude each other")
    if kinds:
        keys = tuple(str(k) for k in m[kinds[0]])
        if shape not in ("rel", "tuple"):
            raise QueryError(f":{kinds[0]} names the columns of rows, and there are none in a {'collection' if shape == 'coll' else 'single value'}")
        if len(keys) != len(find):
            raise QueryError(f":{kinds[0]} and :find differ in number")
    with_ = tuple(Var(str(v)) for v in m.get("with", []))
    if "in" in m:
        inputs = tuple(map(binding, m["in"]))
    else:
        inputs = (BindSource(Src()),) if _uses_source(where) or any(isinstance(f, Pull) for f in find) else ()
    q = Query(shape, find, with_, inputs, where, keys, kinds[0] if kinds else "")
    _validate(q)
    return q


def _uses_source(clauses: tuple) -> bool:
    for c in clauses:
        if isinstance(c, Pattern | RuleCall) or (isinstance(c, Predicate | Function) and any(isinstance(a, Src) for a in c.args)):
            return True
        if isinstance(c, Not | And) and _uses_source(c.clauses):
            return True
        if isinstance(c, Or) and _uses_source(c.branches):
            return True
    return False


def _sources(x: Any) -> set[str]:
    if isinstance(x, Pattern):
        return {x.src.name}
    if isinstance(x, RuleCall):
        return {x.src.name} | _sources(x.args)
    if isinstance(x, Not):
        return {x.src.name} | _sources(x.clauses)
    if isinstance(x, Or):
        return {x.src.name} | _sources(x.branches)
    if isinstance(x, And):
        return _sources(x.clauses)
    if isinstance(x, Predicate | Function):
        return _sources(x.args)
    if isinstance(x, Src):
        return {x.name}
    if isinstance(x, tuple):
        return set().union(*map(_sources, x)) if x else set()
    return set()


def _validate(q: Query) -> None:
    find, with_ = set(vars_of(q.find)), {v.name for v in q.with_}
    known = set(vars_of(q.where)) | set(vars_of(q.inputs))
    if unknown := sorted((find | with_) - known):
        raise QueryError(f"nothing binds {' '.join(unknown)}, which find asks for")
    if shared := sorted(find & with_):
        raise QueryError(f"both :find and :with name {' '.join(shared)}")
    names = [n for b in q.inputs for n in vars_of(b)] + [b.src.name for b in q.inputs if isinstance(b, BindSource)] + ["%" for b in q.inputs if isinstance(b, BindRules)]
    if len(names) != len(set(names)):
        raise QueryError(":in names a variable twice")
    if len(with_) != len(q.with_):
        raise QueryError(":with names a variable twice")
    given = {b.src.name for b in q.inputs if isinstance(b, BindSource)}
    used = _sources(q.where) | {f.src.name for f in q.find if isinstance(f, Pull)}
    if (used - {"$"}) - given:
        raise QueryError(f"no inputs for the sources {' '.join(sorted(used - {'$'} - given))}")
    calls = _calls(q.where)
    if calls and not any(isinstance(b, BindRules) for b in q.inputs):
        raise QueryError("rules are called, but :in has no %")


def _calls(clauses: tuple) -> list[RuleCall]:
    out = []
    for c in clauses:
        if isinstance(c, RuleCall):
            out.append(c)
        elif isinstance(c, Not | And):
            out += _calls(c.clauses)
        elif isinstance(c, Or):
            out += _calls(c.branches)
    return out
