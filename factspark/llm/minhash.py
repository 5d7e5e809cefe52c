"""Near duplicates by fast similarity sketching, banding and exact verification.

Each document's set of word shingles (A-Z lower-cased, split at white space;
fewer words than a shingle: the whole sequence) gets a sketch of ``bands *
rows`` coordinates: in each round every shingle falls into one hashed
coordinate with a value of that round, the smallest value stays; rounds go on
until all coordinates are filled, and from round t on the coordinate is the
round's own, which guarantees it.

1. Documents with equal sets form a class; only the class's smallest doc_id
   goes on, so copies cost no pairs.
2. Each class sends its band hashes; in a band's bucket the class with the
   most copies is the hub.  Every class is compared with the hub that it meets
   in most bands: at most one pair a class.  Verified pairs make first
   components.  Some rounds more compare every class that meets a larger
   component in a band with one of its classes, again one pair a class.
3. Links that remain can only join classes of different components that meet
   in a band.  The classes in such buckets are joined on rare shingles: with
   shingles ordered by how many classes have them, two sets within the
   threshold must share one of their rarest n - ceil(threshold * n) + 1, and
   the first that they share must leave shingles enough after it in both.
   Pairs within a component are not formed, nor pairs within the largest
   component of a shingle.
4. Those pairs are verified on full sets and the components joined.

So the links found are those of all pairs that meet in a band (a pair at the
threshold misses all 32 bands of 4 with a chance of 1e-10 at 85 percent and
5e-8 at 80).

A document without words is linked with nothing and stays.  Null text has no
words; repeated rows are linked and, as they share their doc_id, all stay.
Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, map_batches, small_batches, text_bytes
from .graph import components
from .rolling import FOLD_CASE, U, mix, shingle_sets

SHINGLE, PERCENT, BANDS, ROWS = 5, 85, 32, 4
#: Rounds in which classes are compared with a hub of another component, at most one pair a class and round; what they miss, step 3 finds.
STARS = 5
_EMPTY = U(2**64 - 1)


def sketches(owner: np.ndarray, hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    """Sketches (n x size) of n sets, given as (owner, hash); size is a power of two, 128 at most.  An empty set's row is all ones."""
    out = np.full((n, size), _EMPTY)
    flat = out.reshape(-1)
    shift = U(64 - int(size).bit_length() + 1)
    for i in range(2 * size):
        if not len(owner):
            break
        h = mix(hashes ^ mix(np.array([i + 1], np.uint64) * U(0xA0761D6478BD642F)))
        place = (h >> shift).astype(np.int64) if i < size else np.full(len(h), i - size)
        np.minimum.at(flat, owner * size + place, (U(i) << U(56)) | (h & U(2**56 - 1)))
        open_ = np.zeros(n, bool)
        ids = np.unique(owner)
        open_[ids] = (out[ids] == _EMPTY).any(1)
        keep = open_[owner]
        owner, hashes = owner[keep], hashes[keep]
    return out


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, and (row in range, shingle hash) of the distinct shingles."""
    buf, off = text_bytes(batch.column("text"))
    for a, b in blocks(off):
        owner, h = shingle_sets(FOLD_CASE[buf[off[a] : off[b]]], off[a : b + 1] - off[a], SHINGLE)
        yield a, b, owner, h


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values.view(np.int64)))


def sketch_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (set size), s1, s2 (hashes of the whole set), bands (hashes; none for an empty set)."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, owner, h in _sets(batch):
            size = np.bincount(owner, minlength=b - a)
            whole = []
            for seed in (5, 77):
                total = np.zeros(b - a, np.uint64)
                np.add.at(total, owner, mix(h ^ U(seed)))
                whole.append(mix(total + size.astype(np.uint64)))
            sk = sketches(owner, h, b - a, bands * rows).reshape(b - a, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (b - a, bands)).copy()
            for r in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) ^ sk[:, :, r])
            some = size > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), _lists(key[some].ravel(), some * bands)],
                names=["doc_id", "n", "s1", "s2", "bands"],
            )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id and its shingle hashes, sorted."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, owner, h in _sets(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), _lists(h, np.bincount(owner, minlength=b - a))], names=["id", "sh"])

    return map_batches(docs.select("doc_id", "text"), run, "id long, sh array<long>")


def _linked(x: Column, y: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are within the threshold; of repeated rows each counts.  No aggregation follows, so that a hub's join can be split."""
    one, two = sets.select(F.col("id").alias("a"), F.col("sh").alias("x")), sets.select(F.col("id").alias("b"), F.col("sh").alias("y"))
    # The join's own condition verifies, so that only links leave it.
    return pairs.join(one, "a").join(two, (pairs["b"] == two["b"]) & _linked(F.col("x"), F.col("y"), percent)).select("a", pairs["b"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is the smallest) of each row of docs."""
    known = cut(sketch_table(docs, bands, rows))
    some = known.filter("n > 0")
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    banded = some.join(classes.select("s1", "s2", F.col("rep").alias("doc_id"), "copies"), ["s1", "s2", "doc_id"]).select(F.col("doc_id").alias("rep"), "copies", F.explode("bands").alias("band")).distinct()
    # What a join takes from an aggregation of the same keys is written first: only between two shuffles can adaptive execution split a hot key.
    hubs = cut(banded.groupBy("band").agg(F.count("*").alias("many"), F.max_by("rep", "copies").alias("hub")).filter("many > 1").drop("many"))
    shared = cut(banded.join(hubs, "band").select("band", "rep", "hub"))
    star = shared.filter("rep != hub").groupBy("rep", "hub").count().groupBy("rep").agg(F.max_by("hub", "count").alias("b")).withColumnRenamed("rep", "a")
    sets = cut(set_table(docs.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")))
    links = cut(verify(star, sets, percent))
    label = components(links)

    def labelled() -> DataFrame:
        return shared.select("band", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    for _ in range(STARS):
        meets = labelled()
        parts = cut(meets.groupBy("band", "component").agg(F.count("*").alias("n"), F.min("rep").alias("hub")))
        top = cut(parts.groupBy("band").agg(F.max(F.struct("n", "component", "hub")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1").select("band", F.col("top.component").alias("main"), "top.hub"))
        other = meets.join(top, "band").filter("component != main").groupBy("rep", "hub").count().groupBy("rep").agg(F.max_by("hub", "count").alias("b"))
        more = cut(verify(cut(other.withColumnRenamed("rep", "a")), sets, percent))
        if more.isEmpty():
            break
        links = links.unionAll(more)
        label = components(links)
    meets = labelled()
    mixed = cut(meets.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("band"))
    open_ = meets.join(mixed, "band", "left_semi").select(F.col("rep").alias("id"), "component").distinct()
    held = sets.join(open_, "id").select("id", "component", F.explode("sh").alias("sh"))
    common = held.groupBy("sh").agg(F.count("*").alias("df"))
    ordered = held.join(common, "sh").groupBy("id", "component").agg(F.sort_array(F.collect_list(F.struct("df", "sh"))).alias("by"))
    n = F.size("by")
    rare = ordered.select("id", "component", n.alias("n"), F.posexplode(F.slice("by", F.lit(1), n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1)).alias("pos", "e"))
    rare = cut(rare.filter("e.df > 1").select("id", "component", "n", "pos", F.col("e.sh").alias("sh")))
    tally = cut(rare.groupBy("sh", "component").count().groupBy("sh").agg(F.count("*").alias("kinds"), F.max_by("component", "count").alias("major")).filter("kinds > 1").select("sh", "major"))
    one = rare.join(tally, "sh").filter("component != major").select("sh", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    two = rare.select(F.col("sh").alias("sh2"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    # If this is the first shingle that two sets share, they share at most it and what follows it in both; a link needs percent / (100 + percent) of the sizes' sum.
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("sh") == F.col("sh2")) & (F.col("ca") != F.col("cb")) & ((100 + percent) * reach >= percent * (F.col("na") + F.col("nb")))
    rest = one.join(two, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = cut(verify(rest, sets, percent))
    if not more.isEmpty():
        label = components(links.unionAll(more))

    of_class = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    found = known.select("doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns kept, that are the first of their component."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
