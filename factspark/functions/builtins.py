"""The functions that predicates and function clauses call, as column expressions.

Each takes Args (column, kind, and the value if it is a constant) and returns
an Arg.  A null result drops the tuple in a function clause and is false in a
predicate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..edn import write
from ..plans.syntax import QueryError
from ..values import RANKS, kind_of, literal, to_any

_MISSING = object()


@dataclass(frozen=True)
class Arg:
    col: Column
    kind: str
    value: Any = _MISSING

    @property
    def fixed(self) -> bool:
        return self.value is not _MISSING


def constant(x: Any) -> Arg:
    return Arg(F.lit(None).cast("string"), "nil", None) if x is None else Arg(literal(x), kind_of(x), x)


def _number(a: Arg) -> bool:
    return a.kind in ("long", "double") or a.kind.startswith("eid:") or a.kind == "gid"


def equal(a: Arg, b: Arg) -> Column:
    """Equality that tells types apart: 1 is not 1.0, and a keyword is not a string."""
    if a.kind == b.kind:
        return a.col == b.col
    if "any" in (a.kind, b.kind) and "nil" not in (a.kind, b.kind):
        return to_any(a.col, a.kind) == to_any(b.col, b.kind)
    if _number(a) and _number(b) and "double" not in (a.kind, b.kind):
        return a.col == b.col
    if {a.kind, b.kind} == {"keyword", "string"} and (a.fixed or b.fixed):
        return F.lit(False)
    return F.lit(False)


def ordering(a: Arg, b: Arg, op: str) -> Column:
    """A comparison over all types: by value within a type, else by the order of types."""
    f: dict[str, Callable[[Any, Any], Any]] = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    if a.kind == b.kind and a.kind not in ("any", "array"):
        return f[op](a.col, b.col)
    if _number(a) and _number(b):
        return f[op](a.col.cast("double"), b.col.cast("double")) if "double" in (a.kind, b.kind) else f[op](a.col, b.col)
    if a.kind == b.kind == "array":
        return f[op](F.struct(F.size(a.col), a.col), F.struct(F.size(b.col), b.col))
    if "any" in (a.kind, b.kind):
        strip = lambda c: F.struct(c["rank"], c["num"], F.when(c["num"].isNull(), c["str"]).alias("str"), c["bool"], c["ts"])
        return f[op](strip(to_any(a.col, a.kind)), strip(to_any(b.col, b.kind)))
    return F.lit(f[op](RANKS[a.kind], RANKS[b.kind]))


def _chain(op: str) -> Callable[[list[Arg]], Arg]:
    def call(args: list[Arg]) -> Arg:
        return Arg(reduce(lambda x, y: x & y, [ordering(a, b, op) for a, b in zip(args, args[1:], strict=False)], F.lit(True)), "bool")

    return call


def _all_equal(args: list[Arg]) -> Arg:
    return Arg(reduce(lambda x, y: x & y, [equal(a, b) for a, b in zip(args, args[1:], strict=False)], F.lit(True)), "bool")


def _numeric_equal(args: list[Arg]) -> Arg:
    return Arg(reduce(lambda x, y: x & y, [a.col == b.col for a, b in zip(args, args[1:], strict=False)], F.lit(True)), "bool")


def _not(f: Callable[[list[Arg]], Arg]) -> Callable[[list[Arg]], Arg]:
    return lambda args: Arg(~f(args).col, "bool")


def _plain(a: Arg) -> Arg:
    """A tagged value as a number."""
    return Arg(a.col["num"], "double") if a.kind == "any" else a


def _fold(op: Callable[[Column, Column], Column], unary: Callable[[Column], Column], start: int | None = None) -> Callable[[list[Arg]], Arg]:
    def call(args: list[Arg]) -> Arg:
        if not args:
            return constant(start)
        args = list(map(_plain, args))
        kind = "double" if any(a.kind == "double" for a in args) else "long"
        return Arg(unary(args[0].col) if len(args) == 1 else reduce(op, [a.col for a in args]), kind)

    return call


def _divide(args: list[Arg]) -> Arg:
    cs = [a.col.cast("double") for a in args]
    return Arg(F.lit(1.0) / cs[0] if len(cs) == 1 else reduce(lambda x, y: x / y, cs), "double")


def _num(f: Callable[[Column, Column], Column]) -> Callable[[list[Arg]], Arg]:
    return lambda a: Arg(f(a[0].col, a[1].col), "double" if "double" in (a[0].kind, a[1].kind) else "long")


def _quotient(a: list[Arg]) -> Arg:
    """Division towards zero."""
    x, y = a[0].col, a[1].col
    if "double" in (a[0].kind, a[1].kind):
        return Arg(F.when(x / y >= 0, F.floor(x / y)).otherwise(F.ceil(x / y)).cast("double"), "double")
    return Arg(F.call_function("div", x, y), "long")


def _same(f: Callable[[Column], Column]) -> Callable[[list[Arg]], Arg]:
    return lambda a: Arg(f(a[0].col), a[0].kind)


def _bool(f: Callable[..., Column]) -> Callable[[list[Arg]], Arg]:
    return lambda a: Arg(f(*[x.col for x in a]), "bool")


def truth(a: Arg) -> Column:
    """Everything but nil and false is true."""
    if a.kind == "nil":
        return F.lit(False)
    return F.coalesce(a.col, F.lit(False)) if a.kind == "bool" else a.col.isNotNull()


def _and(args: list[Arg]) -> Arg:
    """The first value that is false or nil, else the last."""
    if not args:
        return constant(True)
    out = args[-1].col
    for a in reversed(args[:-1]):
        out = F.when(truth(a), out).otherwise(a.col if a.kind == args[-1].kind else F.lit(None))
    return Arg(out, args[-1].kind)


def _or(args: list[Arg]) -> Arg:
    out = args[-1].col
    for a in reversed(args[:-1]):
        out = F.when(truth(a), a.col).otherwise(out)
    return Arg(out, args[-1].kind)


def _compare(args: list[Arg]) -> Arg:
    a, b = args
    if "nil" in (a.kind, b.kind):
        return constant((a.kind != "nil") - (b.kind != "nil"))
    return Arg(F.when(ordering(a, b, "<"), -1).when(ordering(a, b, ">"), 1).otherwise(0).cast("bigint"), "long")


def shown(a: Arg) -> Column:
    """A value as str prints it; nil is empty."""
    if a.kind == "nil":
        return F.lit("")
    if a.kind == "any":
        return F.coalesce(a.col["str"], a.col["lng"].cast("string"), a.col["num"].cast("string"), a.col["bool"].cast("string"))
    if a.kind == "array":
        return F.concat(F.lit("["), F.array_join(a.col.cast("array<string>"), " "), F.lit("]"))
    return F.coalesce(a.col.cast("string"), F.lit(""))


def printed(a: Arg) -> Column:
    """A value as EDN text."""
    if a.fixed:
        return F.lit(write(a.value))
    if a.kind == "string":
        return F.concat(F.lit('"'), F.replace(F.replace(a.col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return shown(a)


def _print(f: Callable[[Arg], Column], end: str) -> Callable[[list[Arg]], Arg]:
    return lambda args: Arg(F.concat(F.concat_ws(" ", *map(f, args)), F.lit(end)), "string")


def _pattern(a: Arg) -> str:
    if not a.fixed:
        raise QueryError("a pattern must be a constant")
    return str(a.value)


def _re_find(args: list[Arg]) -> Arg:
    p = _pattern(args[0])
    groups = _groups(p)
    hit = args[1].col.rlike(p)
    if groups:
        return Arg(F.when(hit, F.array(*[F.regexp_extract(args[1].col, p, i) for i in range(groups + 1)])), "array")
    return Arg(F.when(hit, F.regexp_extract(args[1].col, p, 0)), "string")


def _re_matches(args: list[Arg]) -> Arg:
    p = _pattern(args[0])
    groups, whole = _groups(p), f"^(?:{p})$"
    hit = args[1].col.rlike(whole)
    if groups:
        return Arg(F.when(hit, F.array(*[F.regexp_extract(args[1].col, whole, i) for i in range(groups + 1)])), "array")
    return Arg(F.when(hit, args[1].col), "string")


def _groups(p: str) -> int:
    import re

    return re.compile(p).groups


def _range(args: list[Arg]) -> Arg:
    lo, hi, step = [F.lit(0), args[0].col, F.lit(1)] if len(args) == 1 else [*[a.col for a in args], F.lit(1)][:3]
    lo, hi = lo.cast("bigint"), hi.cast("bigint")
    return Arg(F.when(((step > 0) & (lo < hi)) | ((step < 0) & (lo > hi)), F.sequence(lo, hi - F.sign(step).cast("bigint"), step.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), "array")


def _vector(args: list[Arg]) -> Arg:
    if len({a.kind for a in args}) <= 1:
        return Arg(F.array(*[a.col for a in args]), "array")
    return Arg(F.array(*[to_any(a.col, a.kind) for a in args]), "array")


def _get(args: list[Arg]) -> Arg:
    c, k = args[0], args[1]
    default = args[2].col if len(args) > 2 else F.lit(None)
    if c.fixed and isinstance(c.value, dict):
        out = default
        for key, v in c.value.items():
            out = F.when(equal(k, constant(key)), literal(v)).otherwise(out)
        kinds = {kind_of(v) for v in c.value.values()}
        return Arg(out, kinds.pop() if len(kinds) == 1 else "other")
    found = F.get(c.col, k.col.cast("int")) if c.kind == "array" else F.try_element_at(c.col, k.col)
    return Arg(F.coalesce(found, default), _item_kind(c))


def _item_kind(a: Arg) -> str:
    if a.fixed and isinstance(a.value, list | tuple) and a.value:
        return kind_of(a.value[0])
    return "item"


def _contains(args: list[Arg]) -> Arg:
    c, k = args
    if c.fixed and isinstance(c.value, dict | frozenset | set):
        return Arg(reduce(lambda x, y: x | y, [equal(k, constant(x)) for x in c.value], F.lit(False)), "bool")
    return Arg((k.col >= 0) & (k.col < F.size(c.col)) if c.kind == "array" else F.map_contains_key(c.col, k.col), "bool")


def _count(a: list[Arg]) -> Arg:
    if a[0].fixed and isinstance(a[0].value, dict | frozenset | set):
        return constant(len(a[0].value))
    return Arg((F.length(a[0].col) if a[0].kind == "string" else F.size(a[0].col)).cast("bigint"), "long")


def _subs(a: list[Arg]) -> Arg:
    s, start, end = a[0].col, a[1].col.cast("int"), a[2].col.cast("int") if len(a) > 2 else F.length(a[0].col)
    bad = (start < 0) | (end > F.length(s)) | (start > end)
    return Arg(F.when(bad, F.raise_error(F.lit("String index out of range")).cast("string")).otherwise(s.substr(start + 1, end - start)), "string")


def _keyword_part(first: bool) -> Callable[[list[Arg]], Arg]:
    def call(a: list[Arg]) -> Arg:
        bare = F.regexp_replace(a[0].col, "^:", "")
        return Arg(F.nullif(F.regexp_extract(bare, "^(.+)/", 1), F.lit("")) if first else F.regexp_extract(bare, "([^/]*)$", 1), "string")

    return call


def _keyword(a: list[Arg]) -> Arg:
    parts = [F.regexp_replace(x.col, "^:", "") for x in a]
    return Arg(F.concat(F.lit(":"), F.concat_ws("/", *parts)), "keyword")


def _is_nil(args: list[Arg]) -> Column:
    return F.lit(True) if args[0].kind == "nil" else args[0].col.isNull()


def _identity(a: list[Arg]) -> Arg:
    return a[0]


def _differ(a: list[Arg]) -> Arg:
    half = len(a) // 2
    return Arg(~reduce(lambda x, y: x & y, [equal(x, y) for x, y in zip(a[:half], a[half:], strict=True)], F.lit(True)), "bool")


def _type(a: list[Arg]) -> Arg:
    return Arg(F.lit(":" + a[0].kind.partition(":")[0]), "keyword")


def _map(a: list[Arg]) -> Arg:
    return Arg(F.create_map(*[x.col for x in a]), "other")


def _rand(a: list[Arg]) -> Arg:
    return Arg(F.rand() * a[0].col if a else F.rand(), "double")


def _empty(a: list[Arg]) -> Arg:
    return Arg(_count(a).col == 0, "bool")


BUILTINS: dict[str, Callable[[list[Arg]], Arg]] = {
    "=": _all_equal, "==": _numeric_equal, "not=": _not(_all_equal), "!=": _not(_all_equal),
    "<": _chain("<"), ">": _chain(">"), "<=": _chain("<="), ">=": _chain(">="),
    "+": _fold(lambda x, y: x + y, lambda x: x, 0), "-": _fold(lambda x, y: x - y, lambda x: -x), "*": _fold(lambda x, y: x * y, lambda x: x, 1), "/": _divide,
    "quot": _quotient,
    "rem": _num(lambda x, y: x % y), "mod": _num(lambda x, y: (x % y + y) % y),
    "inc": _same(lambda x: x + 1), "dec": _same(lambda x: x - 1), "max": _fold(F.greatest, lambda x: x), "min": _fold(F.least, lambda x: x),
    "zero?": _bool(lambda x: x == 0), "pos?": _bool(lambda x: x > 0), "neg?": _bool(lambda x: x < 0), "even?": _bool(lambda x: x % 2 == 0), "odd?": _bool(lambda x: x % 2 != 0),
    "compare": _compare, "rand": _rand, "rand-int": lambda a: Arg(F.floor(F.rand() * a[0].col).cast("bigint"), "long"),
    "true?": lambda a: Arg(a[0].col == F.lit(True) if a[0].kind == "bool" else F.lit(False), "bool"), "false?": lambda a: Arg(a[0].col == F.lit(False) if a[0].kind == "bool" else F.lit(False), "bool"),
    "nil?": lambda a: Arg(_is_nil(a), "bool"), "some?": lambda a: Arg(~_is_nil(a), "bool"), "not": lambda a: Arg(~truth(a[0]), "bool"), "and": _and, "or": _or,
    "identical?": lambda a: Arg(equal(a[0], a[1]), "bool"), "identity": _identity, "ground": _identity, "untuple": _identity,
    "keyword": _keyword, "name": _keyword_part(False), "namespace": _keyword_part(True), "meta": lambda a: constant(None), "type": _type,
    "vector": _vector, "list": _vector, "tuple": _vector, "set": lambda a: Arg(F.sort_array(F.array_distinct(a[0].col)), "array"), "hash-map": _map, "array-map": _map,
    "count": _count, "range": _range, "not-empty": lambda a: Arg(F.when(_count(a).col > 0, a[0].col), a[0].kind), "empty?": _empty, "contains?": _contains,
    "str": lambda a: Arg(F.concat(*map(shown, a)) if a else F.lit(""), "string"), "subs": _subs, "get": _get,
    "pr-str": _print(printed, ""), "print-str": _print(shown, ""), "println-str": _print(shown, "\n"), "prn-str": _print(printed, "\n"),
    "re-find": _re_find, "re-matches": _re_matches, "re-seq": lambda a: Arg(F.regexp_extract_all(a[1].col, F.lit(_pattern(a[0])), F.lit(0)), "array"), "re-pattern": _identity,
    "-differ?": _differ, "clojure.string/blank?": _bool(lambda s: s.isNull() | s.rlike(r"^\s*$")), "clojure.string/includes?": _bool(lambda s, x: F.contains(s, x)),
    "clojure.string/starts-with?": _bool(lambda s, x: F.startswith(s, x)), "clojure.string/ends-with?": _bool(lambda s, x: F.endswith(s, x)),
}
#: Functions that take a source: the planner handles them.
WITH_SOURCE = {"get-else", "get-some", "missing?"}
