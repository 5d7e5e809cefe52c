"""Databases as plain data, and as EDN text."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

from .db import TX0, Datom, Db, init_db
from .edn import Keyword, Tagged, read, write

#: How a dumped value is marked when it is no plain JSON value.
KEYWORD, OTHER, INF, MINUS_INF, NAN = range(5)


def to_serializable(db: Db, freeze: Callable[[Any], str] = write) -> dict[str, Any]:
    """A dict that JSON can write."""
    keywords: list[str] = []
    at: dict[str, int] = {}

    def value(v: Any) -> Any:
        if isinstance(v, Keyword):
            if v not in at:
                at[v] = len(keywords)
                keywords.append(str(v))
            return [KEYWORD, at[v]]
        if isinstance(v, float) and not math.isfinite(v):
            return [NAN] if v != v else [INF] if v > 0 else [MINUS_INF]
        if isinstance(v, bool | int | float) or (isinstance(v, str) and type(v) is str):
            return v
        return [OTHER, freeze(v)]

    eavt = db.index("eavt")
    attrs = sorted({d.a for d in eavt})
    number = {a: i for i, a in enumerate(attrs)}
    place = {(d.e, d.a, repr(d.v)): i for i, d in enumerate(eavt)}
    order = lambda name: [place[d.e, d.a, repr(d.v)] for d in db.index(name)]
    return {
        "count": len(eavt), "tx0": TX0, "max-eid": db.max_eid, "max-tx": db.max_tx, "schema": write({Keyword(a): {Keyword(k): _key(v) for k, v in p.items()} for a, p in db.schema.spec.items()}),
        "attrs": attrs, "eavt": [[d.e, number[d.a], value(d.v), d.tx - TX0] for d in eavt], "aevt": order("aevt"), "avet": order("avet"), "keywords": keywords, "branching-factor": 512, "ref-type": "strong",
    }


def _key(v: Any) -> Any:
    return Keyword(v) if isinstance(v, str) and v.startswith(":") else [_key(x) for x in v] if isinstance(v, list | tuple) else v


def from_serializable(data: dict[str, Any], thaw: Callable[[str], Any] = read) -> Db:
    def value(v: Any) -> Any:
        if not isinstance(v, list):
            return v
        return {KEYWORD: lambda: Keyword(data["keywords"][v[1]]), OTHER: lambda: thaw(v[1]), INF: lambda: math.inf, MINUS_INF: lambda: -math.inf, NAN: lambda: math.nan}[v[0]]()

    db = init_db([Datom(e, data["attrs"][a], value(v), tx + data["tx0"]) for e, a, v, tx in data["eavt"]], read(data["schema"]))
    db.max_eid, db.max_tx = data["max-eid"], data["max-tx"]
    return db


def to_json(db: Db) -> str:
    return json.dumps(to_serializable(db))


def from_json(text: str) -> Db:
    return from_serializable(json.loads(text))


def to_edn(db: Db) -> str:
    """#factspark/DB {:schema .. :datoms [[e a v tx] ..]}"""
    schema = {Keyword(a): {Keyword(k): _key(v) for k, v in p.items()} for a, p in db.schema.spec.items()}
    return write(Tagged("factspark/DB", {Keyword(":schema"): schema, Keyword(":datoms"): [[d.e, Keyword(d.a), d.v, d.tx] for d in db.index("eavt")]}))


def from_edn(text: str) -> Db:
    def db(m: dict) -> Db:
        return init_db([Datom(e, str(a), v, tx) for e, a, v, tx in m[":datoms"]], m[":schema"])

    def datom(v: list) -> Datom:
        return Datom(v[0], str(v[1]), *v[2:])

    return read(text, {"factspark/DB": db, "factspark/Datom": datom})
