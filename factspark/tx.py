"""Transactions: operations applied one after the other to a copy of the facts they touch.

For changes that a program states fact by fact; ``facts.Facts`` changes facts
that are a DataFrame, set by set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .db import EMAX, TX0, Datom, Db, FilteredDb, _Key, freeze
from .edn import Keyword
from .plans.syntax import QueryError
from .schema import Schema, is_reverse, reverse

#: Names of the running transaction.
CURRENT_TX = {":db/current-tx", "datomic.tx"}


class TransactionError(QueryError):
    """Transaction data that cannot be applied."""


class Auto:
    """The temporary id of an entity that was given none."""


@dataclass
class TxReport:
    db_before: Db
    db_after: Db
    tx_data: list[Datom] = field(default_factory=list)
    tempids: dict[Any, int] = field(default_factory=dict)
    tx_meta: Any = None


class _Retry(Exception):
    def __init__(self, tempid: Any, eid: int) -> None:
        super().__init__()
        self.tempid, self.eid = tempid, eid


def tempid(part: Any = None, x: int | None = None) -> int:
    """A new negative id, or x."""
    if x is not None:
        return x
    _counter[0] -= 1
    return _counter[0]


_counter = [-1_000_000]


def resolve_tempid(tempids: dict, x: Any) -> int | None:
    return tempids.get(x)


def is_tempid(x: Any) -> bool:
    return isinstance(x, Auto) or (isinstance(x, int) and not isinstance(x, bool) and x < 0) or (isinstance(x, str) and not x.startswith(":"))


def with_tx(db: Db, tx_data: Any, tx_meta: Any = None) -> TxReport:
    """The report of applying tx_data; db stays as it is."""
    if isinstance(db, FilteredDb):
        raise TransactionError("a filtered view takes no transactions")
    if tx_data is not None and not isinstance(tx_data, list | tuple):
        raise TransactionError(f"a transaction is a sequence, not {tx_data!r}")
    known: dict[Any, int] = {}
    while True:
        run = _Run(db, known)
        try:
            return run.apply(list(tx_data or []), tx_meta)
        except _Retry as r:
            if known.get(r.tempid) not in (None, r.eid):
                raise TransactionError(f"{r.tempid} would be both {known[r.tempid]} and {r.eid}") from None
            known = known | {r.tempid: r.eid}


def db_with(db: Db, tx_data: Any) -> Db:
    return with_tx(db, tx_data).db_after


class _Run:
    """One pass over a transaction's operations."""

    def __init__(self, db: Db, known: dict[Any, int]) -> None:
        self.before, self.tx = db, db.max_tx + 1
        self.db = Db(db.schema, dict(db.facts), db.max_eid, db.max_tx)
        self.own: set[int] = set()  # entities whose facts are copied
        self.known, self.tempids = known, dict(known)
        self.used: set = set()  # tempids that stand for an entity
        self.as_value: set = set()
        self.log: list[Datom] = []
        self.holders: dict[str, dict[_Key, set[int]]] = {}
        self.queue: set[tuple[int, str]] = set()

    @property
    def schema(self) -> Schema:
        return self.db.schema

    def apply(self, ops: list, meta: Any) -> TxReport:
        todo = list(reversed(ops))
        while todo:
            op = todo.pop()
            if op is None:
                continue
            more = self.one(op)
            todo.extend(reversed(more))
            if not more or not todo:
                self.flush()
        self.flush()
        if lost := self.as_value - self.used:
            raise TransactionError(f"named as values only: {sorted(map(str, lost))}")
        self.db.max_tx = self.tx
        ids = {k: v for k, v in self.tempids.items() if not isinstance(k, Auto)}
        return TxReport(self.before, self.db, self.log, ids | {Keyword(":db/current-tx"): self.tx}, meta)

    # -- ids

    def new_eid(self) -> int:
        self.db.max_eid += 1
        return self.db.max_eid

    def entity(self, e: Any) -> int:
        if isinstance(e, str) and str(e) in CURRENT_TX:
            return self.tx
        if is_tempid(e):
            self.used.add(e)
            if e not in self.tempids:
                self.tempids[e] = self.new_eid()
            return self.tempids[e]
        if e is None or isinstance(e, bool | float):
            raise TransactionError(f"names no entity: {e!r}")
        eid = self.db.entid(e, strict=True)
        if self.db.max_eid < eid < TX0:
            self.db.max_eid = eid
        return eid

    def ref_value(self, v: Any) -> int:
        if isinstance(v, str) and str(v) in CURRENT_TX:
            return self.tx
        if is_tempid(v):
            self.as_value.add(v)
            if v not in self.tempids:
                self.tempids[v] = self.new_eid()
            return self.tempids[v]
        eid = self.db.entid(v, strict=True)
        if self.db.max_eid < eid < TX0:
            self.db.max_eid = eid
        return eid

    # -- operations

    def one(self, op: Any) -> list:
        if isinstance(op, dict):
            return self.entity_map({str(k): v for k, v in op.items()})
        if isinstance(op, Datom):
            self.raw(op)
            return []
        if not isinstance(op, list | tuple) or not op:
            raise TransactionError(f"neither a map nor an operation: {op!r}")
        name, *args = op
        if callable(name):
            return list(name(self.db, *args))
        name = str(name)
        if name == ":db.fn/call":
            return list(args[0](self.db, *args[1:]) or [])
        if name in (":db.fn/cas", ":db/cas"):
            self.cas(*args)
            return []
        if name == ":db/add":
            self.check(op, 4)
            return self.add_op(*args[:3], tx=args[3] if len(args) > 3 else None)
        if name == ":db/retract":
            if len(args) == 3 and args[2] is not None:
                self.retract_value(*args)
            else:
                self.retract_attr(args[0], args[1])
            return []
        if name == ":db.fn/retractAttribute":
            self.retract_attr(args[0], args[1])
            return []
        if name in (":db.fn/retractEntity", ":db/retractEntity"):
            self.retract_entity(args[0])
            return []
        eid = self.db.entid(Keyword(name)) if name.startswith(":") else None
        fn = self.db.value(eid, ":db/fn") if eid is not None else None
        if callable(fn):
            return list(fn(self.db, *args) or [])
        if eid is not None:
            raise TransactionError(f"{name} has no function in :db/fn")
        raise TransactionError(f"no operation or transaction function: {op!r}")

    @staticmethod
    def check(op: Any, n: int) -> None:
        if len(op) < n or op[3] is None:
            raise TransactionError(f"nil is no value, in {op!r}")
        if not isinstance(op[2], str) or not str(op[2]):
            raise TransactionError(f"{op[2]!r} names no attribute, in {op!r}")

    def add_op(self, e: Any, a: Any, v: Any, tx: Any = None) -> list:
        a = str(a)
        if isinstance(v, dict):
            return [*self.nested(e, a, v)]
        if is_reverse(a):
            return [[":db/add", v, Keyword(reverse(a)), e]]
        attr = self.schema.of(a)
        if attr.ref:
            if attr.unique == "identity" and not isinstance(v, int):
                v = self.ref_value(v)
            value = self.ref_value(v)
        else:
            value = freeze(v)
        if attr.unique == "identity" and is_tempid(e):
            holder = self.find(a, value)
            if holder is not None:
                if e in self.tempids and self.tempids[e] != holder:
                    if e in self.known:
                        raise TransactionError(f"{e} would be both {self.tempids[e]} and {holder}")
                    raise _Retry(e, holder)
                self.tempids[e] = holder
        eid = self.entity(e)
        if attr.tuple_attrs:
            current = tuple(self.db.value(eid, x) for x in attr.tuple_attrs)
            if tuple(value) != current and any(c is not None for c in current):
                raise TransactionError(f"a composite follows its parts and is not set directly: [{a} {value!r}]")
        self.add(eid, a, value, tx)
        return []

    def find(self, a: str, v: Any) -> int | None:
        if a not in self.holders:
            idx: dict[_Key, set[int]] = {}
            for e, attrs in self.db.facts.items():
                for k in attrs.get(a, {}):
                    idx.setdefault(k, set()).add(e)
            self.holders[a] = idx
        found = self.holders[a].get(_Key(v))
        return min(found) if found else None

    def entity_map(self, m: dict[str, Any]) -> list:
        e = m.pop(":db/id", None)
        e = Auto() if e is None else e
        if not isinstance(e, Auto | int | str | list | tuple):
            raise TransactionError(f":db/id names no entity: {e!r}")
        if is_tempid(e):
            e = self.upsert(e, m)
        ops, tuples = [], []
        for a, v in m.items():
            if not isinstance(a, str):
                raise TransactionError(f"{a!r} names no attribute")
            if v is None:
                raise TransactionError(f"nil is no value, of {a}")
            name = reverse(a) if is_reverse(a) else a
            attr = self.schema.of(name)
            if is_reverse(a) and not attr.ref:
                raise TransactionError(f"{a} is written in reverse but is no reference")
            into = tuples if attr.tuple_attrs else ops
            for x in self.several(name, v, attr, is_reverse(a)):
                if isinstance(x, dict):
                    into.extend(self.nested(e, a, x))
                elif is_reverse(a):
                    into.append([":db/add", x, Keyword(name), e])
                else:
                    into.append([":db/add", e, Keyword(name), x])
        if not m and isinstance(e, Auto):
            self.entity(e)
        if not m:
            self.used.add(e) if is_tempid(e) else None
        return ops + tuples

    def several(self, a: str, v: Any, attr: Any, back: bool) -> list:
        """The values of a collection for an attribute with many; a lookup ref is one value."""
        if isinstance(v, set | frozenset):
            return list(v)
        if isinstance(v, list | tuple) and (attr.many or back):
            lookup = attr.ref and len(v) == 2 and isinstance(v[0], Keyword) and self.schema.of(str(v[0])).unique
            return [v] if lookup else list(v)
        return [v]

    def nested(self, e: Any, a: str, m: dict) -> list:
        """A map as a value: an entity of its own that the attribute refers to."""
        name = reverse(a) if is_reverse(a) else a
        if not self.schema.of(name).ref:
            if is_reverse(a):
                raise TransactionError(f"{a} is written in reverse but is no reference")
            return [[":db/add", e, Keyword(a), _Opaque(m)]] if not isinstance(m, _Opaque) else []
        m = {str(k): v for k, v in m.items()}
        child = m.get(":db/id") or Auto()
        link = [":db/add", child, Keyword(name), e] if is_reverse(a) else [":db/add", e, Keyword(name), child]
        return [m | {":db/id": child}, link]

    def upsert(self, e: Any, m: dict[str, Any]) -> Any:
        """The entity that unique attributes of a map name, or e."""
        found: dict[int, str] = {}
        for a, v in m.items():
            if is_reverse(a) or v is None or self.schema.of(a).unique != "identity":
                continue
            attr = self.schema.of(a)
            for x in self.several(a, v, attr, False):
                if isinstance(x, dict):
                    continue
                if attr.ref:
                    x = self.tempids.get(x) if is_tempid(x) else self.db.entid(x)  # noqa: PLW2901
                holder = self.find(a, freeze(x)) if x is not None else None
                if holder is not None:
                    found.setdefault(holder, f"[{a} {x!r}]")
        if len(found) > 1:
            raise TransactionError(f"one map would be several entities: {' and '.join(f'{i} by {w}' for i, w in found.items())}")
        if found:
            (holder,) = found
            if e in self.tempids and self.tempids[e] != holder and not isinstance(e, Auto):
                if e in self.known:
                    raise TransactionError(f"{found[holder]} would be {holder}, but it is {self.tempids[e]} already")
                raise _Retry(e, holder)
            self.tempids[e] = holder
            self.used.add(e)
        return e

    def cas(self, e: Any, a: Any, old: Any, new: Any) -> None:
        if is_tempid(e):
            raise TransactionError("compare and swap takes no temporary id")
        eid, a = self.entity(e), str(a)
        attr = self.schema.of(a)
        if attr.ref:
            old, new = (self.ref_value(x) if x is not None else None for x in (old, new))
        values = self.db.values(eid, a)
        fits = any(_Key(x) == _Key(old) for x in values) if attr.many else (_Key(values[0]) == _Key(old) if values else old is None)
        if not fits:
            raise TransactionError(f"compare and swap found [{eid} {a} {values if attr.many else (values[0] if values else None)}] instead of {old!r}")
        self.add(eid, a, freeze(new))

    # -- facts

    def _own(self, e: int) -> dict[str, dict]:
        if e not in self.own:
            self.db.facts[e] = {a: dict(v) for a, v in self.db.facts.get(e, {}).items()}
            self.own.add(e)
        return self.db.facts[e]

    def add(self, e: int, a: str, v: Any, tx: Any = None) -> None:
        if e > EMAX:
            raise TransactionError(f"entity numbers end at {EMAX}: {e}")
        v = v.value if isinstance(v, _Opaque) else v
        attr, key = self.schema.of(a), _Key(v)
        if self.db.has(e, a, v):
            return
        if attr.unique and (holder := self.find(a, v)) is not None and holder != e:
            raise TransactionError(f"[{e} {a} {v!r}] breaks a unique attribute, as {holder} has the value")
        tx = tx if tx is not None else self.tx
        if not attr.many:
            for old in self.db.values(e, a):
                self.remove(e, a, old)
        self._own(e).setdefault(a, {})[key] = (v, tx)
        if a in self.holders:
            self.holders[a].setdefault(key, set()).add(e)
        self.log.append(Datom(e, a, v, tx, True))
        if self.db.max_eid < e < TX0:
            self.db.max_eid = e
        for t in self.schema.tuples_of.get(a, []):
            self.queue.add((e, t))

    def remove(self, e: int, a: str, v: Any) -> None:
        if not self.db.has(e, a, v):
            return
        facts = self._own(e)
        del facts[a][_Key(v)]
        if not facts[a]:
            del facts[a]
        if not facts:
            del self.db.facts[e]
            self.own.discard(e)
        if a in self.holders:
            self.holders[a].get(_Key(v), set()).discard(e)
        self.log.append(Datom(e, a, v, self.tx, False))
        for t in self.schema.tuples_of.get(a, []):
            self.queue.add((e, t))

    def flush(self) -> None:
        """Brings composite attributes in line with their parts."""
        while self.queue:
            e, t = self.queue.pop()
            parts = tuple(self.db.value(e, x) for x in self.schema.of(t).tuple_attrs)
            if all(p is None for p in parts):
                for old in self.db.values(e, t):
                    self.remove(e, t, old)
            else:
                self.add(e, t, parts)

    def retract_value(self, e: Any, a: Any, v: Any) -> None:
        eid = self.db.entid(e)
        if eid is None:
            return
        v = self.db.entid(v) if self.schema.of(str(a)).ref else freeze(v)
        self.remove(eid, str(a), v)

    def retract_attr(self, e: Any, a: Any) -> None:
        eid = self.db.entid(e)
        if eid is None:
            return
        for v in self.db.values(eid, str(a)):
            self.remove(eid, str(a), v)
            if self.schema.of(str(a)).component:
                self.retract_entity(v)

    def retract_entity(self, e: Any) -> None:
        eid = self.db.entid(e)
        if eid is None:
            return
        for d in list(self.db.datoms_of(eid)):
            self.remove(eid, d.a, d.v)
            if self.schema.of(d.a).component:
                self.retract_entity(d.v)
        for a, attr in self.schema.attrs.items():
            if attr.ref:
                for holder in self.db.holders(a, eid):
                    self.remove(holder, a, eid)

    def raw(self, d: Datom) -> None:
        if d.added:
            self.add(d.e, str(d.a), freeze(d.v), d.tx)
        else:
            self.remove(d.e, str(d.a), freeze(d.v))


@dataclass(frozen=True)
class _Opaque:
    """A map that is a value."""

    value: Any
