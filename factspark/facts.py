"""Fact databases of any size: facts as a DataFrame (e, a, v tagged, tx), changed and pulled set by set.

Nothing here brings facts to the driver; rounds (closures over components or
references, merging of entities) are written to the shared folder.  A change
takes DataFrames of operations: facts to add or retract, entities to retract,
entity maps as rows (t, a, v), compare-and-swap rows (e, a, old, new).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .db import TX0
from .schema import Schema
from .sources.base import dealt, materialise
from .tx import TransactionError
from .values import ANY, RANKS

PARTS = ("e", "a", "v", "tx")


def composite_value(parts: list[Column]) -> Column:
    """Tagged values as one tagged value: the EDN text of a vector behind its length, nil for a missing part."""

    def text(v: Column) -> Column:
        quoted = v["str"]
        for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            quoted = F.replace(quoted, F.lit(raw), F.lit(safe))
        number = F.coalesce(v["lng"].cast("string"), v["num"].cast("string"))
        instant = F.concat(F.lit('#inst "'), F.date_format(v["ts"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'))
        return F.when(v["rank"] == RANKS["string"], F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(F.coalesce(number, v["bool"].cast("string"), instant, v["str"], F.lit("nil")))

    shown = F.concat(F.lit(f"{len(parts):08d}["), F.concat_ws(" ", *[text(p) for p in parts]), F.lit("]"))
    none = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit(RANKS["array"]).cast("tinyint").alias("rank"), none("double").alias("num"), none("bigint").alias("lng"), shown.alias("str"), none("boolean").alias("bool"), none("timestamp_ntz").alias("ts")).cast(ANY)


def clashes(facts: DataFrame, attrs: list[str]) -> DataFrame:
    """a, v, n: values of unique attributes that n > 1 entities have."""
    return facts.filter(F.col("a").isin(attrs)).groupBy("a", "v").agg(F.count_distinct("e").alias("n")).filter("n > 1")


@dataclass(frozen=True)
class Facts:
    """Facts with their schema and the highest entity and transaction numbers."""

    df: DataFrame
    schema: Schema
    max_eid: int = 0
    max_tx: int = TX0

    def _attrs(self, what: str) -> list[str]:
        return [a for a, x in self.schema.attrs.items() if getattr(x, what)]

    # -- adding

    def add(self, new: DataFrame) -> Facts:
        """With the facts (e, a, v) added: an attribute with one value gets the last one, composites follow, unique values are checked."""
        tx = self.max_tx + 1
        given = set(self._attrs("tuple_attrs"))
        new = new.select("e", "a", "v").distinct().withColumn("tx", F.lit(tx).cast("long"))
        if given and not new.filter(F.col("a").isin(*given)).isEmpty():
            raise TransactionError("composites follow their parts and are not added themselves")
        many = F.col("a").isin(self._attrs("many"))
        twice = new.filter(~many).groupBy("e", "a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise TransactionError(f"one transaction gives two values of {twice[0]['a']} to entity {twice[0]['e']}")
        # What stays of the old facts: those that are not replaced; a fact that is there already keeps its transaction.
        same = self.df.join(new.select("e", "a", "v"), ["e", "a", "v"], "left_semi")
        fresh = new.join(self.df.select("e", "a", "v"), ["e", "a", "v"], "left_anti")
        replaced = new.filter(~many).select("e", "a").distinct()
        kept = self.df.join(replaced, ["e", "a"], "left_anti").unionByName(same.join(replaced, ["e", "a"], "left_semi"))
        out = replace(self, df=kept.unionByName(fresh), max_tx=tx)
        touched = new.filter(F.col("a").isin(list(self.schema.tuples_of))).select("e").distinct() if self.schema.tuples_of else None
        return out._with_composites(touched)._checked()._counted(new)

    def _with_composites(self, touched: DataFrame | None) -> Facts:
        """Composites of the entities in touched made anew from their parts; without any part there is none."""
        if touched is None:
            return self
        df = self.df
        for name, attr in self.schema.attrs.items():
            if attr.tuple_attrs:
                parts = [F.max(F.when(F.col("a") == p, F.col("v"))).alias(f"p{i}") for i, p in enumerate(attr.tuple_attrs)]
                made = df.filter(F.col("a").isin(list(attr.tuple_attrs))).join(touched, "e", "left_semi").groupBy("e").agg(*parts)
                made = made.select("e", F.lit(name).alias("a"), composite_value([F.col(f"p{i}") for i in range(len(parts))]).alias("v"), F.lit(self.max_tx).cast("long").alias("tx"))
                gone = touched.select("e", F.lit(name).alias("a"))
                df = df.join(gone, ["e", "a"], "left_anti").unionByName(made)
        return replace(self, df=df)

    def _checked(self) -> Facts:
        unique = self._attrs("unique")
        if unique:
            found = clashes(self.df, unique).limit(1).collect()
            if found:
                raise TransactionError(f"entities share a value of the unique attribute {found[0]['a']}")
        return self

    def _counted(self, new: DataFrame) -> Facts:
        refs = F.when(F.col("a").isin(self._attrs("ref")), F.col("v.lng"))
        most = new.agg(F.max(F.greatest("e", F.coalesce(refs, F.col("e"))))).first()[0]
        return replace(self, max_eid=max(self.max_eid, most or 0))

    # -- entity maps

    def upsert(self, maps: DataFrame) -> tuple[Facts, DataFrame]:
        """Entity maps as rows (t, a, v): t names a map, a non-negative t an entity.  The facts after it, and t, e.

        A map with a negative t becomes the entity that has one of its values
        of an identity attribute; maps that share such a value are one entity;
        others get new numbers in descending order of t (-1, -2, ...).
        """
        identity = [a for a, x in self.schema.attrs.items() if x.unique == "identity"]
        maps = maps.select("t", "a", "v")
        open_ = maps.filter("t < 0")
        keys = open_.filter(F.col("a").isin(identity)).distinct()
        # The least map that shares identity values, step by step.
        root = materialise(open_.select("t").distinct().withColumn("r", F.col("t")))
        while True:
            by_key = keys.join(root, "t").groupBy("a", "v").agg(F.max("r").alias("m"))
            better = keys.join(by_key, ["a", "v"]).groupBy("t").agg(F.max("m").alias("m"))
            new = materialise(root.join(better, "t", "left").select("t", F.greatest("r", F.coalesce("m", "r")).alias("r"), (F.col("m") > F.col("r")).alias("moved")))
            root = new.select("t", "r")
            if new.filter("moved").isEmpty():
                break
        known = keys.join(self.df.filter(F.col("a").isin(identity)).select("a", "v", "e"), ["a", "v"]).join(root, "t").groupBy("r").agg(F.min("e").alias("e"), F.max("e").alias("other"))
        known = materialise(known)
        clash = known.filter("e != other").limit(1).collect()
        if clash:
            raise TransactionError(f"identity values of one map belong to the entities {clash[0]['e']} and {clash[0]['other']}")
        named = _numbered(root.join(known, "r", "left_anti").select("r").distinct(), self.max_eid).unionByName(known.select("r", "e"))
        ids = root.join(named, "r").select("t", "e").unionByName(maps.filter("t >= 0").select("t").distinct().withColumn("e", F.col("t")))
        ids = materialise(ids)
        facts = maps.join(ids, "t").select("e", "a", "v")
        refs = self._attrs("ref")
        if refs:  # negative references name maps
            to = ids.select(F.col("t").alias("__t"), F.col("e").alias("__e"))
            facts = facts.join(to, F.col("a").isin(refs) & (F.col("v.lng") < 0) & (F.col("v.lng") == F.col("__t")), "left")
            moved = F.struct(F.col("v.rank").alias("rank"), F.col("__e").cast("double").alias("num"), F.col("__e").alias("lng"), F.col("v.str").alias("str"), F.col("v.bool").alias("bool"), F.col("v.ts").alias("ts")).cast(ANY)
            facts = facts.select("e", "a", F.when(F.col("__e").isNotNull(), moved).otherwise(F.col("v")).alias("v"))
        return self.add(facts), ids

    def cas(self, rows: DataFrame) -> Facts:
        """Rows (e, a, old, new): new is added if the value now is old, null for none; else nothing is changed."""
        now = self.df.select("e", "a", F.col("v").alias("now"))
        wrong = rows.join(now, ["e", "a"], "left").groupBy("e", "a").agg(F.max(F.col("now").eqNullSafe(F.col("old"))).alias("fits")).filter("not fits").limit(1).collect()
        if wrong:
            raise TransactionError(f"compare and swap: entity {wrong[0]['e']} has another value of {wrong[0]['a']}")
        return self.add(rows.select("e", "a", F.col("new").alias("v")))

    # -- retracting

    def retract(self, gone: DataFrame) -> Facts:
        """Without the facts (e, a, v), all values of (e, a), or the entities (e), by the columns that gone has.

        Components of what goes go too, to any depth, and so do references to
        retracted entities.
        """
        keys = [c for c in ("e", "a", "v") if c in gone.columns]
        tx = self.max_tx + 1
        component, refs = self._attrs("component"), self._attrs("ref")
        gone = gone.select(*keys).distinct()
        parts = self.df.filter(F.col("a").isin(component)).select("e", "a", "v") if component else None
        if keys == ["e"]:
            entities = gone
        elif keys == ["e", "a"] and parts is not None:
            entities = parts.join(gone, keys, "left_semi").select(F.col("v.lng").alias("e")).distinct()
        else:
            entities = None
        df = self.df if keys == ["e"] else self.df.join(gone, keys, "left_anti")
        if entities is not None:
            entities = frontier = materialise(entities)
            while parts is not None and not frontier.isEmpty():
                inner = parts.join(frontier, "e", "left_semi").select(F.col("v.lng").alias("e")).distinct()
                frontier = materialise(inner.join(entities, "e", "left_anti"))
                entities = entities.unionByName(frontier)
            df = df.join(entities, "e", "left_anti")
            if refs:
                held = entities.select(F.col("e").alias("__v"))
                df = df.join(held, F.when(F.col("a").isin(refs), F.col("v.lng")) == F.col("__v"), "left_anti")
        touched = None
        if self.schema.tuples_of:
            lost = self.df.filter(F.col("a").isin(list(self.schema.tuples_of))).join(df, ["e", "a", "v"], "left_anti")
            touched = lost.select("e").distinct()
        return replace(self, df=df, max_tx=tx)._with_composites(touched)

    # -- pulling

    def pull_rows(self, ids: DataFrame, attrs: list[str] | None = None, follow: list[str] | None = None, depth: int | None = None) -> DataFrame:
        """root, path (of entities from the root), e, a, v: what a pull of every id of ids (id) meets, to any depth.

        Values of attrs, or of all attributes; ``follow`` names reference
        attributes whose values are pulled in the same way, down to ``depth``
        steps or as far as they lead, None the components.  An entity that its
        own path holds already is not entered again.
        """
        follow = self._attrs("component") if follow is None else follow
        wanted = self.df.select("e", "a", "v")
        links = wanted.filter(F.col("a").isin(follow)).select("e", F.col("v.lng").alias("to"))
        if attrs is not None:
            wanted = wanted.filter(F.col("a").isin(attrs))
        links = materialise(links)
        frontier = materialise(ids.select(F.col("id").alias("root"), F.array("id").alias("path"), F.col("id").alias("e")))
        out, step, held = [], 0, links.count()
        rows = more = frontier.count()
        while True:
            out.append(frontier)
            if step == depth or not held:
                break
            following = frontier.join(links, "e").filter(~F.array_contains("path", F.col("to")))
            with dealt(self.df.sparkSession, held + more):
                frontier = materialise(following.select("root", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("e")))
            more = frontier.count()
            if not more:
                break
            step, rows = step + 1, rows + more
        # Both sides are as large as the facts, so that neither is broadcast here either.
        met = reduce(DataFrame.unionByName, out).hint("merge").join(wanted, "e").select("root", "path", "e", "a", "v")
        with dealt(self.df.sparkSession, rows):
            return materialise(met)

    # -- as text

    def to_lines(self) -> DataFrame:
        """line: each fact as a JSON array of entity, attribute, tagged value and transaction."""
        return self.df.select(F.to_json(F.struct(*PARTS)).alias("line"))

    def stats(self) -> DataFrame:
        """a, n, max_eid: facts and the highest entity of each attribute."""
        return self.df.groupBy("a").agg(F.count("*").alias("n"), F.max("e").alias("max_eid"))


def init_facts(rows: DataFrame, schema: dict | Schema | None = None) -> Facts:
    """A database of given facts (e, a, v[, tx]), which are trusted but for being there twice."""
    s = schema if isinstance(schema, Schema) else Schema(schema)
    if "tx" not in rows.columns:
        rows = rows.withColumn("tx", F.lit(TX0 + 1).cast("long"))
    df = rows.groupBy("e", "a", "v").agg(F.min("tx").alias("tx")).select(*PARTS)
    refs = [a for a, x in s.attrs.items() if x.ref]
    most = df.agg(F.max(F.greatest("e", F.coalesce(F.when(F.col("a").isin(refs), F.col("v.lng")), F.col("e")))).alias("e"), F.max("tx").alias("tx")).first()
    return Facts(df, s, most["e"] or 0, max(most["tx"] or TX0, TX0))


def from_lines(lines: DataFrame, schema: dict | Schema | None = None) -> Facts:
    """The database of lines that to_lines wrote."""
    return init_facts(lines.select(F.from_json("line", f"e long, a string, v {ANY}, tx long").alias("f")).select("f.*"), schema)


def _numbered(names: DataFrame, after: int) -> DataFrame:
    """r and e: numbers from after + 1 in descending order of r; ranges are numbered apart and put behind each other."""
    ranged = materialise(names.repartitionByRange(F.col("r").desc()).withColumn("part", F.spark_partition_id()))
    counts = sorted(ranged.groupBy("part").count().collect(), key=lambda x: x["part"])  # one row a partition
    starts, at = [], after
    for c in counts:
        starts.append((c["part"], at))
        at += c["count"]
    offsets = F.broadcast(names.sparkSession.createDataFrame(starts, "part int, start long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("r")))
    return ranged.join(offsets, "part").select("r", (F.col("start") + place).alias("e"))
