"""Attribute schemas and their validation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .plans.syntax import QueryError


@dataclass(frozen=True)
class Attr:
    many: bool = False
    unique: str | None = None  # "value" or "identity"
    ref: bool = False
    component: bool = False
    index: bool = False
    tuple_attrs: tuple[str, ...] = ()


PLAIN = Attr()
IDENT = Attr(unique="identity")


class SchemaError(QueryError):
    """A schema that is not valid."""


class Schema:
    """attribute -> Attr; attributes that are not declared are plain."""

    def __init__(self, spec: dict[str, dict] | None = None) -> None:
        self.spec = {str(a): {str(k): v for k, v in (p or {}).items()} for a, p in (spec or {}).items()}
        self.attrs = {a: self._attr(a, p) for a, p in self.spec.items()}
        self.tuples_of: dict[str, list[str]] = {}
        for a, x in self.attrs.items():
            for part in x.tuple_attrs:
                if part in self.attrs and (self.attrs[part].many or self.attrs[part].tuple_attrs):
                    what = "tuple" if self.attrs[part].tuple_attrs else "multi-cardinality"
                    raise SchemaError(f"{a} is composed of {part}, a {what} attribute")
                self.tuples_of.setdefault(part, []).append(a)

    @staticmethod
    def _attr(a: str, p: dict[str, Any]) -> Attr:
        allowed = {":db/valueType": {":db.type/ref", ":db.type/tuple"}, ":db/cardinality": {":db.cardinality/one", ":db.cardinality/many"}, ":db/unique": {":db.unique/value", ":db.unique/identity"}}
        for key, values in allowed.items():
            if p.get(key) is not None and str(p[key]) not in values:
                raise SchemaError(f"{key} of {a} is {p[key]}, not one of {' '.join(sorted(values))}")
        ref, many = str(p.get(":db/valueType")) == ":db.type/ref", str(p.get(":db/cardinality")) == ":db.cardinality/many"
        component = bool(p.get(":db/isComponent"))
        if component and not ref:
            raise SchemaError(f"{a} is a component but no reference")
        tuple_attrs = p.get(":db/tupleAttrs")
        if str(p.get(":db/valueType")) == ":db.type/tuple" and tuple_attrs is None:
            raise SchemaError(f"{a} is a tuple of nothing: it has no :db/tupleAttrs")
        if tuple_attrs is not None:
            if not isinstance(tuple_attrs, list | tuple) or not tuple_attrs:
                raise SchemaError(f":db/tupleAttrs of {a} is no list of attributes")
            if many:
                raise SchemaError(f"{a} is composed of others and has one value only")
        unique = {":db.unique/value": "value", ":db.unique/identity": "identity"}.get(str(p.get(":db/unique")))
        return Attr(many, unique, ref, component, bool(p.get(":db/index")) or unique is not None or ref or tuple_attrs is not None, tuple(map(str, tuple_attrs or ())))

    def of(self, a: str) -> Attr:
        return self.attrs.get(a, IDENT if a == ":db/ident" else PLAIN)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.attrs == other.attrs

    def __hash__(self) -> int:
        return hash(frozenset(self.attrs.items()))


def is_reverse(a: str) -> bool:
    return a.rpartition("/")[2].lstrip(":").startswith("_")


def reverse(a: str) -> str:
    """:x/_y for :x/y and back."""
    space, slash, name = a.rpartition("/")
    if not slash:
        return ":" + (name[2:] if name.startswith(":_") else "_" + name.lstrip(":"))
    return f"{space}/{name[1:] if name.startswith('_') else '_' + name}"
