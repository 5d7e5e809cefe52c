"""Pull: hierarchical projections of entities.

``pull`` and ``pull_many`` give nested Python values from a database on the
driver, recursion and cycles included.  ``pull_df`` is the same for whole sets
of entities as DataFrames, one join a level: its patterns must be of bounded
depth, as a schema is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..db import Db, sort_key
from ..edn import Form, Keyword, Symbol, read
from ..plans.syntax import Const, Pattern, QueryError, Src, Var
from ..schema import is_reverse, reverse
from ..sources.base import Source, gid
from ..sources.mapped import MappedSource

#: Values of an attribute with many that a pull returns, unless told otherwise.
LIMIT = 1000
ID = ":db/id"
_NONE = object()


@dataclass(frozen=True)
class Spec:
    attr: str
    name: Any
    limit: int | None = LIMIT
    default: Any = _NONE
    xform: Callable | None = None
    nested: tuple | None = None  # specs of the entities referred to
    depth: int | float | None = None  # of recursion

    @property
    def forward(self) -> str:
        return reverse(self.attr) if is_reverse(self.attr) else self.attr


@dataclass(frozen=True)
class Wildcard:
    pass


def parse_pattern(p: Any) -> tuple:
    p = read(p) if isinstance(p, str) else p
    if not isinstance(p, list | tuple) or isinstance(p, Form):
        raise QueryError(f"a pull pattern is a sequence, not {p!r}")
    out: dict[Any, Any] = {}
    for x in p:
        for s in _specs(x):
            out["*" if isinstance(s, Wildcard) else s.name] = s
    return tuple(out.values())


def _xform(f: Any) -> Callable:
    if callable(f):
        return f
    from ..functions import python_builtin

    return python_builtin(str(f))


def _attr(x: Any) -> Spec:
    if isinstance(x, str) and not isinstance(x, Symbol):
        return Spec(str(x), x)
    if isinstance(x, list | tuple) and x:
        head = str(x[0])
        if head in ("limit", "default") and isinstance(x[0], Symbol | str) and len(x) == 3 and not head.startswith(":"):
            base = _attr(x[1])
            if head == "limit":
                return _limited(base, x[2])
            return _with(base, default=x[2])
        spec = _attr(x[0])
        opts = list(x[1:])
        if len(opts) % 2:
            raise QueryError(f"an option of a pulled attribute has no value: {x!r}")
        for k, v in zip(map(str, opts[::2]), opts[1::2], strict=True):
            if k == ":limit":
                spec = _limited(spec, v)
            elif k == ":default":
                spec = _with(spec, default=v)
            elif k == ":as":
                spec = _with(spec, name=v)
            elif k == ":xform":
                spec = _with(spec, xform=_xform(v))
            else:
                raise QueryError(f"no option of pull is {k}")
        return spec
    raise QueryError(f"nothing to pull: {x!r}")


def _with(s: Spec, **changes: Any) -> Spec:
    from dataclasses import replace

    return replace(s, **changes)


def _limited(s: Spec, n: Any) -> Spec:
    if n is not None and (not isinstance(n, int) or n <= 0):
        raise QueryError(f"a limit is positive or nil, not {n!r}")
    return _with(s, limit=n)


def _specs(x: Any) -> list:
    if x == "*" or x == ":*":
        return [Wildcard()]
    if isinstance(x, dict):
        out = []
        for k, v in x.items():
            s = _attr(list(k) if isinstance(k, tuple) and not isinstance(k, Form) else k)
            if v == "..." or (isinstance(v, int) and not isinstance(v, bool)):
                if not v == "..." and v <= 0:
                    raise QueryError(f"a depth is positive, not {v}")
                out.append(_with(s, depth=float("inf") if v == "..." else v))
            else:
                out.append(_with(s, nested=parse_pattern(v)))
        return out
    return [_attr(x)]


# ---- on the driver


def pull(db: Db, pattern: Any, ref: Any, visitor: Callable | None = None) -> dict | None:
    """The pattern's attributes of one entity; None if there are none."""
    specs = parse_pattern(pattern)
    eid = db.entid(ref)
    return _Pull(db, visitor).entity(eid, specs, {}, frozenset()) if eid is not None else None


def pull_many(db: Db, pattern: Any, refs: list) -> list[dict | None]:
    return [pull(db, pattern, r) for r in refs]


class _Pull:
    def __init__(self, db: Db, visitor: Callable | None) -> None:
        self.db, self.visitor = db, visitor
        self.back: dict[str, dict[int, list[int]]] = {}

    def holders(self, a: str, e: int) -> list[int]:
        if a not in self.back:
            idx: dict[int, list[int]] = {}
            for x, attrs in self.db.facts.items():
                for v, _ in attrs.get(a, {}).values():
                    idx.setdefault(v, []).append(x)
            self.back[a] = {k: sorted(v) for k, v in idx.items()}
        return self.back[a].get(e, [])

    def tell(self, what: str, e: int, a: Any = None) -> None:
        if self.visitor:
            self.visitor(Keyword(what), e, a, None)

    def entity(self, e: int, specs: tuple, depths: dict, seen: frozenset) -> dict | None:
        """Depth-first with a stack of its own: each frame is a dict to fill and the place it goes to."""
        root: dict = {}
        todo: list[tuple] = [(e, specs, depths, seen, root, None)]
        frames = []
        while todo:
            e, specs, depths, seen, out, done = todo.pop()
            frames.append((out, done))
            for s in specs:
                if isinstance(s, Wildcard):
                    self.tell(":db.pull/wildcard", e)
                    named = {x.attr for x in specs if isinstance(x, Spec)}
                    out[Keyword(ID)] = e
                    for a in sorted(self.db.facts.get(e, {})):
                        if a not in named:
                            attr = self.db.schema.of(a)
                            nested = (Wildcard(),) if attr.component else None
                            self.one(Spec(a, Keyword(a), nested=nested), e, specs, depths, seen, out, todo)
                elif s.attr == ID:
                    out[s.name] = s.xform(e) if s.xform else e
                else:
                    self.one(s, e, specs, depths, seen, out, todo)
        for out, done in reversed(frames):
            if done:
                done(out)
        return root or None

    def one(self, s: Spec, e: int, specs: tuple, depths: dict, seen: frozenset, out: dict, todo: list) -> None:
        back, a = is_reverse(s.attr), s.forward
        attr = self.db.schema.of(a)
        if back:
            self.tell(":db.pull/reverse", e, a)
            values = self.holders(a, e)
        else:
            self.tell(":db.pull/attr", e, a)
            values = sorted(self.db.values(e, a), key=sort_key)
        single = attr.component if back else not attr.many
        if not single and s.limit is not None:
            values = values[: s.limit]
        if not values:
            if s.default is not _NONE:
                out[s.name] = s.default
            elif s.xform:
                out[s.name] = s.xform(None)
            return
        follows = s.nested is not None or s.depth is not None or back or attr.component
        if not (attr.ref or back):
            if s.nested is not None or s.depth is not None:
                return
            value: Any = values[0] if single else list(values)
            out[s.name] = s.xform(value) if s.xform else value
            return
        if not follows:
            refs: Any = [{Keyword(ID): v} for v in values]
            value = refs[0] if single else refs
            out[s.name] = s.xform(value) if s.xform else value
            return
        slots: list[Any] = [None] * len(values)
        out[s.name] = None
        left = [len(values)]

        def finish() -> None:
            got = [x for x in slots if x]
            if not got:
                out.pop(s.name, None)
                if s.default is not _NONE:
                    out[s.name] = s.default
                return
            value = got[0] if single else got
            out[s.name] = s.xform(value) if s.xform else value

        def put(i: int) -> Callable[[dict], None]:
            def done(x: dict) -> None:
                slots[i] = x
                left[0] -= 1
                if not left[0]:
                    finish()

            return done

        for i, v in enumerate(values):
            if s.depth is not None:
                n = depths.get(s.attr, s.depth)
                if n <= 0:
                    put(i)({})
                    continue
                if v in seen | {e}:
                    put(i)({Keyword(ID): v})
                    continue
                todo.append((v, specs, depths | {s.attr: n - 1}, seen | {e}, {}, put(i)))
            elif s.nested is not None:
                cyclic = any(isinstance(x, Wildcard) for x in s.nested) and v in seen | {e}
                if cyclic:
                    put(i)({Keyword(ID): v})
                else:
                    todo.append((v, s.nested, {}, seen | {e}, {}, put(i)))
            elif attr.component and not back:
                todo.append((v, (Wildcard(),), {}, seen | {e}, {}, put(i)))
            else:
                put(i)({Keyword(ID): v})


# ---- as DataFrames


def column_name(s: Spec) -> str:
    name = str(s.name).lstrip(":")
    return name.rpartition("/")[2] if name == s.attr.lstrip(":") else name


def pull_df(source: Source, ids: DataFrame, pattern: Any, kind: str = "") -> DataFrame:
    """id and a column for each attribute, for every id of ids (id): values, arrays for attributes with many, structs for nested patterns."""
    specs = pattern if isinstance(pattern, tuple) and all(isinstance(x, Spec | Wildcard) for x in pattern) else parse_pattern(pattern)
    return _mapped(source, ids, specs, kind[4:]) if isinstance(source, MappedSource) else _facts(source, ids, specs)


def _finish(s: Spec, c: Column) -> Column:
    if s.xform:
        c = s.xform(c)
    return F.coalesce(c, F.lit(s.default)) if s.default is not _NONE else c


def _mapped(source: MappedSource, ids: DataFrame, specs: tuple, table: str) -> DataFrame:
    """Columns of the entity's own row come from one scan; references and reverse references are joins."""
    if not table:
        named = [s for s in specs if isinstance(s, Spec) and s.attr != ID]
        if not named:
            raise QueryError("pull needs an attribute of a table")
        table = source.column(named[0].forward)[0]
    t = source.table(table)
    specs = tuple(x for s in specs for x in ([Spec(f":{table}/{c}", Keyword(f":{table}/{c}")) for c in t.df.columns] if isinstance(s, Wildcard) else [s]))
    own = [s for s in specs if s.attr == ID or not is_reverse(s.attr)]
    cols = []
    for s in own:
        c = gid(t.entity(), table) if s.attr == ID else F.col(source.column(s.attr)[1])
        cols.append(_finish(s, c).alias(column_name(s)) if s.nested is None else c.alias(f"__r_{column_name(s)}"))
    out = ids.join(source.rows(table).select(t.entity().alias("__key"), *cols), F.col("id") == F.col("__key"), "left").drop("__key")
    for s in own:
        if s.nested is not None:
            n, target = column_name(s), t.refs.get(source.column(s.attr)[1])
            if target is None:
                raise QueryError(f"{s.attr} is no reference")
            inner = _mapped(source, out.select(F.col(f"__r_{n}").alias("id")).distinct(), s.nested, target)
            packed = inner.select(F.col("id").alias("__id"), F.struct(*[F.col(c) for c in inner.columns if c != "id"]).alias(n))
            out = out.join(packed, F.col(f"__r_{n}") == F.col("__id"), "left").drop("__id", f"__r_{n}")
    for s in specs:
        if s.attr != ID and is_reverse(s.attr):
            holder, column = source.column(s.forward)
            h = source.table(holder)
            pairs = source.rows(holder).select(F.col(column).alias("__to"), h.entity().alias("__from")).join(ids.select(F.col("id").alias("__to")), "__to", "left_semi")
            inner = _mapped(source, pairs.select(F.col("__from").alias("id")), s.nested or (Spec(ID, Keyword(ID)),), holder)
            item = F.struct(*[F.col(c) for c in inner.columns if c != "id"])
            listed = pairs.join(inner, F.col("__from") == F.col("id")).groupBy("__to").agg(F.sort_array(F.collect_list(F.struct(F.col("__from"), item.alias("x")))).alias("l"))
            values = F.transform(F.slice("l", 1, s.limit) if s.limit is not None else F.col("l"), lambda x: x["x"])
            out = out.join(listed.select("__to", values.alias(column_name(s).lstrip("_"))), F.col("id") == F.col("__to"), "left").drop("__to")
    return out


def _facts(source: Any, ids: DataFrame, specs: tuple) -> DataFrame:
    """One join an attribute; attributes with many are collected in order up to their limit."""
    out = ids
    for s in specs:
        if isinstance(s, Wildcard):
            raise QueryError("the attributes of a wildcard are not known before the facts are read; name them")
        n = column_name(s)
        if s.attr == ID:
            out = out.withColumn(n, F.col("id"))
            continue
        back, attr = is_reverse(s.attr), source.schema.of(s.forward)
        e, v = (Var("v"), Var("e")) if back else (Var("e"), Var("v"))
        rel = source.scan([Pattern(Src(), (e, Const(Keyword(s.forward)), v))], {})
        facts = rel.df.select(F.col("e").alias("__e"), F.col("v").alias("__v"))
        if s.nested is not None:
            inner = _facts(source, facts.select(F.col("__v").alias("id")).distinct(), s.nested)
            packed = inner.select(F.col("id").alias("__v"), F.struct(*[F.col(c) for c in inner.columns if c != "id"]).alias("__x"))
            facts = facts.join(packed, "__v").select("__e", F.struct(F.col("__v").alias("o"), F.col("__x").alias("x")).alias("__v"))
        if back or attr.many:
            listed = facts.groupBy("__e").agg(F.sort_array(F.collect_list("__v")).alias("__l"))
            value = F.slice("__l", 1, s.limit) if s.limit is not None else F.col("__l")
            facts = listed.select("__e", (F.transform(value, lambda x: x["x"]) if s.nested is not None else value).alias("__v"))
        elif s.nested is not None:
            facts = facts.select("__e", F.col("__v.x").alias("__v"))
        out = out.join(facts, F.col("id") == F.col("__e"), "left").withColumn(n.lstrip("_"), _finish(s, F.col("__v"))).drop("__e", "__v")
    return out
