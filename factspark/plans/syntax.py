"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query, rule, pattern or input that is not valid."""


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def column(self) -> str:
        return self.name.lstrip("?")


@dataclass(frozen=True)
class Blank:
    pass


@dataclass(frozen=True)
class Src:
    name: str = "$"


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Plain:
    """A plain symbol: an input's name, or a function's."""

    name: str


# Bindings of inputs and function results.
@dataclass(frozen=True)
class BindIgnore:
    pass


@dataclass(frozen=True)
class BindScalar:
    var: Any


@dataclass(frozen=True)
class BindColl:
    inner: Any


@dataclass(frozen=True)
class BindTuple:
    parts: tuple


@dataclass(frozen=True)
class BindSource:
    src: Src


@dataclass(frozen=True)
class BindRules:
    pass


# Find elements.
@dataclass(frozen=True)
class Aggregate:
    fn: Any  # Plain or Var
    args: tuple
    custom: bool = False


@dataclass(frozen=True)
class Pull:
    src: Src
    var: Var
    pattern: Any


# Clauses.
@dataclass(frozen=True)
class Pattern:
    src: Src
    terms: tuple


@dataclass(frozen=True)
class Predicate:
    fn: Any
    args: tuple


@dataclass(frozen=True)
class Function:
    fn: Any
    args: tuple
    binding: Any


@dataclass(frozen=True)
class RuleCall:
    src: Src
    name: str
    args: tuple


@dataclass(frozen=True)
class Not:
    src: Src
    clauses: tuple
    vars: tuple | None = None


@dataclass(frozen=True)
class Or:
    src: Src
    branches: tuple
    required: tuple = ()
    free: tuple | None = None


@dataclass(frozen=True)
class And:
    clauses: tuple


@dataclass(frozen=True)
class Branch:
    required: tuple
    free: tuple
    clauses: tuple


@dataclass
class Query:
    shape: str  # rel, coll, tuple, scalar
    find: tuple
    with_: tuple
    inputs: tuple
    where: tuple
    keys: tuple | None = None
    key_kind: str = ""
    extra: dict = field(default_factory=dict)


def vars_of(x: Any) -> list[str]:
    """Names of the variables in a tree, in order, each once."""
    out: dict[str, None] = {}

    def walk(y: Any) -> None:
        if isinstance(y, Var):
            out[y.name] = None
        elif isinstance(y, tuple | list):
            for z in y:
                walk(z)
        elif isinstance(y, Not) and y.vars is not None:
            walk(y.vars)
        elif isinstance(y, Or) and y.free is not None:
            walk(y.required)
            walk(y.free)
        elif isinstance(y, Not):
            walk(y.clauses)
        elif isinstance(y, Or):
            walk(y.branches)
        elif isinstance(y, And | Branch):
            walk(y.clauses)
        elif isinstance(y, Pattern):
            walk(y.terms)
        elif isinstance(y, Predicate | RuleCall):
            walk(getattr(y, "fn", None))
            walk(y.args)
        elif isinstance(y, Function):
            walk(y.fn)
            walk(y.args)
            walk(y.binding)
        elif isinstance(y, BindScalar):
            walk(y.var)
        elif isinstance(y, BindColl):
            walk(y.inner)
        elif isinstance(y, BindTuple):
            walk(y.parts)
        elif isinstance(y, Aggregate):
            walk(y.args)
        elif isinstance(y, Pull):
            walk(y.var)

    walk(x)
    return list(out)
