"""Relations of variables, and the interface of sources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.syntax import Pattern, QueryError
from ..values import ENTITY_BITS, to_any


@dataclass(frozen=True)
class Rel:
    """A DataFrame with a column for each variable, and the variables' kinds.

    unique: variables whose values are distinct in the rows, if that is known.
    keys: variables that hold the key of an entity, which another variable is.
    """

    df: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)
    unique: frozenset | None = None
    keys: dict[str, str] = field(default_factory=dict)

    def col(self, var: str) -> Column:
        return F.col(f"`{var}`")

    def project(self, names: list[str]) -> Rel:
        by_key = {e: v for v, e in self.keys.items() if v in names}
        unique = frozenset(v if v in names else by_key.get(v) for v in self.unique) if self.unique is not None else None
        keys = {v: e for v, e in self.keys.items() if v in names and e in names}
        return Rel(self.df.select(*[self.col(n) for n in names]), {n: self.kinds[n] for n in names}, unique if unique is not None and None not in unique else None, keys)

    def distinct(self) -> Rel:
        return self if self.unique is not None and self.unique <= set(self.kinds) else Rel(self.df.distinct(), self.kinds, frozenset(self.kinds))

    def filter(self, cond: Column) -> Rel:
        return Rel(self.df.filter(cond), self.kinds, self.unique, self.keys)

    def cast(self, var: str, kind: str) -> Rel:
        return Rel(self.df.withColumn(var, convert(self.col(var), self.kinds[var], kind)), self.kinds | {var: kind}, self.unique, self.keys)

    def single(self, given: set[str]) -> bool:
        """Whether at most one row is known to have given values of these variables."""
        return self.unique is not None and self.unique <= given | {e for v, e in self.keys.items() if v in given}


CLASS_IDS: dict[str, int] = {}


def gid(c: Column, table: str) -> Column:
    """A number over all tables for an entity of one."""
    return F.lit(CLASS_IDS.setdefault(table, len(CLASS_IDS) + 1) << ENTITY_BITS).cast("bigint") + c.cast("bigint") + 1


def common_kind(a: str, b: str) -> str | None:
    """The kind in which values of both compare; None if none are equal."""
    if a == b:
        return a
    if "any" in (a, b):
        return None if "eid:" in a + b else "any"
    if "gid" in (a, b):
        other = b if a == "gid" else a
        return "gid" if other.startswith("eid:") or other == "long" else None
    return None


def convert(c: Column, kind: str, to: str) -> Column:
    if kind == to:
        return c
    if to == "gid":
        return gid(c, kind[4:]) if kind.startswith("eid:") else c
    if to == "any":
        return to_any(c, kind)
    raise QueryError(f"no {to} of a {kind}")


def join(a: Rel, b: Rel, how: str = "inner") -> Rel:
    """Natural join on the shared variables; inner, left_semi or left_anti."""
    shared = [v for v in b.kinds if v in a.kinds]
    for v in shared:
        kind = common_kind(a.kinds[v], b.kinds[v])
        if kind is None:
            if how == "left_anti":
                return a
            a, b = a.filter(F.lit(False)), b.filter(F.lit(False))
            b = Rel(b.df.withColumn(v, F.lit(None).cast(dict(a.df.dtypes)[v])), b.kinds | {v: a.kinds[v]}, b.unique)
        else:
            before = a
            a, b = a.cast(v, kind), b.cast(v, kind)
            if how != "inner":
                a = Rel(a.df, a.kinds, before.unique)
    if not shared:
        if how == "inner":
            unique = a.unique | b.unique if a.unique is not None and b.unique is not None else None
            return Rel(a.df.crossJoin(b.df), a.kinds | b.kinds, unique, a.keys | b.keys)
        raise QueryError("no shared variables")
    df = a.df.join(b.df, shared, how)
    if how != "inner":
        return Rel(df, a.kinds, a.unique, a.keys)
    unique, on = None, set(shared)
    if b.single(on):
        unique = a.unique
    elif a.single(on):
        unique = b.unique
    elif a.unique is not None and b.unique is not None:
        unique = a.unique | b.unique
    return Rel(df, a.kinds | b.kinds, unique, b.keys | a.keys)


CELLS = 4


def theta(a: Rel, b: Rel) -> Rel:
    """The natural join of relations that both have many rows for a value, as a grid of cells: a row of a is in all cells
    of one line, a row of b in all of one column, so that each pair meets once and a value's pairs are dealt out."""

    def placed(r: Rel, own: str, every: str) -> Rel:
        df = r.df.withColumn(own, F.pmod(F.xxhash64(*r.df.columns), F.lit(CELLS)))
        return Rel(df.withColumn(every, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long")))), r.kinds | {own: "long", every: "long"}, r.unique, r.keys)

    left = placed(a, "__line", "__column")
    # Without the hint the smaller side is broadcast, and the other stays in the few tasks that its files make.
    met = join(Rel(left.df.hint("merge"), left.kinds, left.unique, left.keys), placed(b, "__column", "__line"))
    return met.project([v for v in met.kinds if v not in ("__line", "__column")])


def union(a: Rel, b: Rel) -> Rel:
    """Rows of both, with the same variables."""
    if set(a.kinds) != set(b.kinds):
        raise QueryError(f"rows of different variables cannot be united: {sorted(a.kinds)} and {sorted(b.kinds)}")
    for v in a.kinds:
        if a.kinds[v] != b.kinds[v]:
            kind = common_kind(a.kinds[v], b.kinds[v]) or ("gid" if "eid:" in a.kinds[v] and "eid:" in b.kinds[v] else "any")
            a, b = a.cast(v, kind), b.cast(v, kind)
    return Rel(a.df.unionByName(b.df.select(*a.df.columns)), a.kinds)


class Source:
    """Something that patterns match."""

    spark: SparkSession

    def group_key(self, pattern: Pattern) -> Any:
        """Patterns with equal keys are scanned together; None: alone."""
        return None

    def scan(self, patterns: list[Pattern], hints: dict[str, str]) -> Rel:
        """The matches of patterns with one group key; hints: kinds of variables that are bound already."""
        raise NotImplementedError


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where it is unset, one of this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise QueryError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factspark-"))
        found = sc.getCheckpointDir()
    return found


def until_exit(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage; the driver deletes it when it ends.

    Joins do not broadcast it by the size of its files, which compress to a small part of what its rows take.
    """
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


ROWS_A_TASK = 500_000


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within deals rows to tasks of ROWS_A_TASK, so that a task's memory does not grow with them."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    tasks = -(-rows // ROWS_A_TASK)
    if tasks > int(before[names[0]]):  # not put together again by their compressed size
        for name, value in zip(names, (str(tasks), "false"), strict=True):
            spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
