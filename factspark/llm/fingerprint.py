"""Document fingerprints: threshold-scaled sketches of word shingles, by column expressions only.

Every hash of five consecutive words below a fixed share (1 / ``SCALE``) of the
hash range is kept, whatever the size of the text; a text with fewer words has
the hash of all its words.  So sketches of very unequal documents can be merged
and compared by plain set operations: containment is the share of one's kept
hashes that the other has too.

An extra, in a field of its own: a text with fewer than ``FLOOR`` kept hashes
also has the next larger ones, up to FLOOR in all, so that short texts have
finer likeness.  Likeness compares two sketches below the smaller of the
thresholds that they are complete up to, which is never below the fixed one.

Null text counts as empty; a text without words has an empty sketch.  Two
empty sketches have likeness 1, an empty and another one 0; the containment of
a sketch without kept hashes is null unless the extras decide it.  Equal texts
have equal sketches.  Repeated rows stay rows of their own.  Extra columns are
not used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

SHINGLE, SCALE, FLOOR = 5, 4, 64
_LEAST, _MOST = -(2**63), 2**63 - 1
CUT = _LEAST + 2**64 // SCALE
#: Documents of a bucket of with_next, about, and intervals of ids between quantiles at most.
BUCKET_ROWS, INTERVALS = 2048, 1024
#: Rows of a side that is broadcast at most.
MOST_BROADCAST = 200_000


def shingle_hashes(text: Column) -> Column:
    """Distinct hashes of the text's shingles."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))

    return let(words, of)


def sketch(hashes: Column) -> Column:
    """struct(kept, extra, top): the hashes below the fixed threshold, the next larger ones of a short text, and up to where all are there, inclusive."""
    return let(hashes, lambda h: let(F.sort_array(F.filter(h, lambda x: x < CUT)), lambda low: _sketch(h, low)))


def _sketch(hashes: Column, low: Column) -> Column:
    more = F.slice(F.sort_array(F.filter(hashes, lambda x: x >= CUT)), F.lit(1), FLOOR - F.size(low))
    short = let(more, lambda m: F.struct(low.alias("kept"), m.alias("extra"), F.when(F.size(low) + F.size(m) == F.size(hashes), F.lit(_MOST)).otherwise(F.element_at(m, -1)).alias("top")))
    return F.when(F.size(low) < FLOOR, short).otherwise(F.struct(low.alias("kept"), F.array().cast("array<bigint>").alias("extra"), F.lit(CUT - 1).alias("top")))


def _all(s: Column) -> Column:
    return F.concat(s["kept"], s["extra"])


def _upto(s: Column, top: Column) -> Column:
    return F.when(F.size(s["extra"]) == 0, s["kept"]).otherwise(F.filter(_all(s), lambda h: h <= top))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    top = F.least(a["top"], b["top"])

    def of(p: Column) -> Column:
        both = F.size(F.array_intersect(p["x"], p["y"]))
        either = F.size(p["x"]) + F.size(p["y"]) - both
        empty = lambda s: F.size(s["kept"]) + F.size(s["extra"]) == 0
        return F.when(either == 0, F.when(empty(a) == empty(b), 1.0).otherwise(0.0)).otherwise(both / either)

    return let(F.struct(_upto(a, top).alias("x"), _upto(b, top).alias("y")), of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, for a of any size against b; null if a has none that can be compared."""
    x = F.when(F.size(a["kept"]) > 0, a["kept"]).otherwise(_upto(a, F.least(a["top"], b["top"])))
    y = F.when(F.size(a["kept"]) > 0, b["kept"]).otherwise(_all(b))
    return let(x, lambda h: F.when(F.size(h) > 0, F.size(F.array_intersect(h, y)) / F.size(h)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two shingle sets, from their sketches."""
    top = F.least(a["top"], b["top"])
    both = F.filter(F.array_union(_all(a), _all(b)), lambda h: h <= top)
    return let(both, lambda h: F.struct(F.sort_array(F.filter(h, lambda x: x < CUT)).alias("kept"), F.sort_array(F.filter(h, lambda x: x >= CUT)).alias("extra"), top.alias("top")))


def as_string(s: Column) -> Column:
    """The threshold, the kept hashes and the extra ones in hexadecimal."""
    hexed = lambda c: F.array_join(F.transform(c, lambda h: F.hex(h)), ",")
    return F.concat_ws(":", F.hex(s["top"]), hexed(s["kept"]), hexed(s["extra"]))


def buckets(ids: DataFrame) -> Callable[[Column, Column], Column]:
    """A function of (id, hash of the text) to the number of a bucket; buckets ascend as ids descend, and within an id as hashes ascend.

    Ids are cut at quantiles, so that ids of any distribution spread over the
    buckets, and between quantiles evenly; an id that several quantiles fall
    on is an interval of its own, cut by the hash.  An interval has about one
    of INTERVALS of all rows, so no bucket has more, however the ids lie.
    """
    n = ids.count()
    k = max(1, min(INTERVALS, n // BUCKET_ROWS))
    found = ids.agg(F.percentile_approx("id", [i / k for i in range(1, k)] + [1.0], 100 * k)).first()[0] if n else None
    cuts = found or [0]
    often = {x for x, y in zip(cuts[:-1], cuts[1:], strict=True) if x == y}
    ends = sorted({*cuts, *(x - 1 for x in often)}, reverse=True)
    parts = max(1, -(-n // (k * BUCKET_ROWS)))
    fan = max(1, int(len(ends) ** 0.5))
    coarse = F.array(*[F.lit(x).cast("bigint") for x in ends[::fan]])
    fine = F.array(*[F.lit(x).cast("bigint") for x in ends])

    def of(id: Column, mark: Column) -> Column:
        # The number of ends at or above the id: first in steps of fan, then one by one.
        many = lambda c: F.size(F.filter(c, lambda x: x >= id))
        interval = let(F.greatest(many(coarse) - 1, F.lit(0)) * fan, lambda s: s + many(F.slice(fine, s + 1, F.lit(fan))))
        if parts == 1:
            return interval.cast("bigint")

        def split(i: Column) -> Column:
            high, low = F.get(fine, i - 1), F.get(fine, i)
            step = lambda x, width: F.least(F.greatest(F.floor(x / width), F.lit(0)), F.lit(parts - 1)).cast("bigint")
            by_id = step((high.cast("double") - id) * parts, high.cast("double") - low)
            by_mark = step((mark.cast("double") + 2.0**63) * parts, F.lit(2.0**64))
            return i.cast("bigint") * parts + F.when(i == 0, 0).when(high - 1 == low, by_mark).when(low.isNull(), F.when(id == high, by_mark).otherwise(0)).otherwise(by_id)

        return let(interval, split)

    return of


def with_next(docs: DataFrame, carry: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, own (carry of the text) and next_text, next_own of the document with the next smaller doc_id; after the smallest id comes the largest.

    Documents are dealt into buckets of neighbours and sorted there; the first
    of each bucket is also a guest behind the last of the bucket before it, so
    that texts are shuffled once.  Equal ids are ordered by the text's hash and
    the text; null ids count as -1.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1).cast("bigint")).cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    bucket = buckets(rows.select("id"))
    rows = rows.withColumn("bucket", bucket(F.col("id"), F.col("mark")))
    # One light row a bucket, BUCKET_ROWS documents each.
    order = Window.orderBy("bucket")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", (-1 - F.col("mark")).alias("rev"))).alias("h")).select("bucket", F.col("h.id").alias("id"), (-1 - F.col("h.rev")).alias("mark"))
    heads = cut(heads.select("id", "mark", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(every)).alias("bucket")))
    side = F.broadcast(heads) if heads.count() <= MOST_BROADCAST else heads
    guests = rows.drop("bucket").join(side, ["id", "mark"]).select("doc_id", "id", "text", "mark", "bucket", F.lit(1).alias("guest"))
    dealt = rows.select("doc_id", "id", "text", "mark", "bucket", F.lit(0).alias("guest")).unionAll(guests)
    dealt = dealt.repartition("bucket").withColumn("own", carry(F.col("text")))  # behind the shuffle, so that it moves texts only
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), "mark", "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_own", F.lead("own").over(w)).filter("guest = 0").select("doc_id", "text", "own", "next_text", "next_own")


def edited(text: Column, following: Column) -> Column:
    """text with its last third replaced by as many code points, or all, of the following text."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(text.substr(F.lit(1), n - third), F.coalesce(following, F.lit("")).substr(F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), and the sketches own, edited_sketch and next_sketch of each row of docs."""
    s = lambda c: sketch(shingle_hashes(c))
    rows = with_next(docs, s).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "own", s(F.col("edited")).alias("edited_sketch"), F.col("next_own").alias("next_sketch"))
