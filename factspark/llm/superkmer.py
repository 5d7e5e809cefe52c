"""Repeated windows of words or bytes, found through super-k-mers.

A window is ``k`` consecutive units of one text.  Its minimiser is the run of
``m`` units in it with the smallest hash, the leftmost of equals.  Consecutive
windows that share a minimiser's place form a super-k-mer; equal windows have
equal minimisers at equal places, so they can only meet in the minimiser's
bucket, and a super-k-mer never holds the same window twice.

1. Texts send their minimisers, once a text.  Buckets that only one text's
   single super-k-mer enters hold nothing repeated and go no further.
2. The super-k-mers of the other buckets are listed by place and by a 128-bit
   hash of their content.  The first occurrence of a content (smallest doc_id,
   then start) stands for it; all windows of a later occurrence are repeated.
3. A bucket with one content is settled.  In the others the first occurrences
   travel as packed strings to their bucket, many buckets a task; there a
   kernel (sorting, or a collection suffix array) finds windows that an
   earlier string also holds.  The strings of a bucket with more than ``HOT``
   go to two smaller ones, by the minimiser with half of the rest of a window
   to its left, and to its right: windows that are equal agree on one side.
   Only a half that more than ``HOT`` strings share is dealt by window.

Contents are compared by their BLAKE2b digests of 128 bits, windows by two
64-bit hashes; the kernels compare the units themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, cut, map_batches, small_batches, text_bytes
from .rolling import U, digests, eights, mix, runs, word_bounds, word_hashes

#: Strings of a bucket that go to one task at most, and bytes of strings a task's group aims at.
HOT, GROUP_BYTES, CHUNK_BYTES = 5_000, 1 << 20, 100_000
#: Bytes of a text's part that is hashed at once at most.
LONG_BYTES = 4 << 20
_PLACE = 24  # bits of a place in a block; the hash keeps the rest


class Units:
    """A block of texts as units, words or bytes: values, offsets by text, and byte bounds."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, words: bool) -> None:
        self.buf, self.words = buf, words
        if words:
            self.start, self.end, doc = word_bounds(buf, off)
            self.off = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(off) - 1) if len(doc) else np.zeros(len(off) - 1, np.int64))]
        else:
            self.off = off
        self.n = int(self.off[-1])

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """A hash of each run of size units (of eight bytes at least) of the block."""
        if self.words:
            return runs(word_hashes(self.buf, self.start, self.end, which), 1, size)
        at = eights(self.buf)[: max(0, len(self.buf) - 7)]
        return runs(mix(at + U(which)) if which else at, 8, size)


def _packed(raw: bytes, words: bool) -> bytes:
    """The units that raw consists of, words parted by single spaces."""
    return b" ".join(raw.split()) if words else raw


def super_kmers(h: np.ndarray, off: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, minimiser's place, its hash) of each super-k-mer of a block, from the hashes of its runs of m units."""
    n = int(off[-1])
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, none, np.zeros(0, np.uint64)
    least = (h >> U(_PLACE) << U(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, reach = k - m + 1, 1
    while reach * 2 <= width:  # the smallest of 2, 4, ... runs
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & U((1 << _PLACE) - 1)).astype(np.int64)
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)[: len(place)]
    window = np.flatnonzero(np.arange(len(place)) + k <= off[doc + 1])
    if not len(window):
        return none, none, none, none, np.zeros(0, np.uint64)
    p, d = place[window], doc[window]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
    return d[first], window[first], np.diff(np.r_[first, len(window)]), p[first], h[p[first]]


def _units(batch: pa.RecordBatch, words: bool, k: int, long: int) -> Iterator[tuple[int, int, int, int, Units]]:
    """Row ranges of a batch as blocks, and the place of the block's first unit, and of its first byte, in its text.

    A text of more than long bytes comes in parts that share k - 1 units, so
    that each window is in one part and no array grows with the text.
    """
    buf, off = text_bytes(batch.column("text"))
    for a, b in blocks(off, min(BLOCK_BYTES, long)):
        text = buf[off[a] : off[b]]
        if b - a > 1 or len(text) <= long:
            yield a, b, 0, 0, Units(text, off[a : b + 1] - off[a], words)
        elif not words:
            for s in range(0, len(text) - k + 1, long):
                part = text[s : s + long + k - 1]
                yield a, b, s, s, Units(part, np.array([0, len(part)]), False)
        else:
            start, end, _ = word_bounds(text, np.array([0, len(text)]))
            step = max(1, long // 8)
            for i in range(0, len(start) - k + 1, step):
                part = text[start[i] : end[min(i + step + k - 1, len(start)) - 1]]
                yield a, b, i, int(start[i]), Units(part, np.array([0, len(part)]), True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _minimisers(docs: DataFrame, words: bool, k: int, m: int) -> DataFrame:
    """h, doc_id, times: the minimisers of each text and in how many of its super-k-mers each occurs."""
    long = LONG_BYTES

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for a, b, _, _, u in _units(batch, words, k, long):
            doc, _, _, _, h = super_kmers(u.windows(m), u.off, k, m)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(h)])
            yield pa.RecordBatch.from_arrays([_signed(h[first]), pa.array(ids[a:b][doc[first]]), pa.array(np.minimum(times, 2).astype(np.int32))], names=["h", "doc_id", "times"])

    return map_batches(docs, run, "h long, doc_id long, times int")


def _listed(docs: DataFrame, words: bool, k: int, m: int) -> DataFrame:
    """h, c1, c2, doc_id, start, windows, mid, at, size: the super-k-mers of docs (doc_id, text, hs) whose minimiser is in hs.

    c1 and c2 are the digest of the content, mid is the minimiser's place from
    the start; at and size are the content's bytes in the text, for words only.
    """
    long = LONG_BYTES

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        wanted = batch.column("hs")
        _, text = text_bytes(batch.column("text"))
        for a, b, base, first_byte, u in _units(batch, words, k, long):
            lists = wanted.slice(a, b - a)
            count = np.array(pa.compute.list_value_length(lists).to_pylist(), np.int64)
            hs = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            doc, start, windows, place, h = super_kmers(u.windows(m), u.off, k, m)
            here = mix(h ^ mix(doc.astype(np.uint64) + U(1)))
            keep = np.isin(here, mix(hs ^ mix(np.repeat(np.arange(b - a, dtype=np.uint64), count) + U(1))))
            doc, start, windows, place, h = doc[keep], start[keep], windows[keep], place[keep], h[keep]
            end = start + windows + k - 1
            first, last = (u.start[start], u.end[end - 1]) if words else (start, end)
            raw = u.buf.tobytes()
            c1, c2 = digests([_packed(raw[x:y], words) for x, y in zip(first.tolist(), last.tolist(), strict=True)])
            at = first - (text[a:b] - text[a])[doc] + first_byte if words else np.zeros(len(doc), np.int64)
            size = last - first if words else at
            yield pa.RecordBatch.from_arrays(
                [_signed(h), _signed(c1), _signed(c2), pa.array(ids[a:b][doc]), *(pa.array(x.astype(np.int32)) for x in (start - u.off[doc] + base, windows, place - start, at, size))],
                names=["h", "c1", "c2", "doc_id", "start", "windows", "mid", "at", "size"],
            )

    return map_batches(docs, run, "h long, c1 long, c2 long, doc_id long, start int, windows int, mid int, at int, size int")


_STRING = "h long, doc_id long, start int, mid int, packed binary, hot boolean"


def _strings(docs: DataFrame, words: bool, k: int) -> DataFrame:
    """h, doc_id, start, mid, packed, hot for docs (doc_id, text, at: places as struct(h, start, windows, mid, at, size, hot))."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        buf, off = text_bytes(batch.column("text"))
        wanted = batch.column("at")
        doc = np.repeat(np.arange(batch.num_rows), np.array(pa.compute.list_value_length(wanted).to_pylist(), np.int64))
        places = wanted.flatten()
        of = lambda name: places.field(name).to_numpy(zero_copy_only=False)
        first = off[doc] + (of("at") if words else of("start"))
        last = first + (of("size") if words else of("windows") + (k - 1))
        raw = memoryview(buf)
        for a, b in blocks(np.r_[0, np.cumsum(last - first)]):
            packed = [_packed(bytes(raw[x:y]), words) for x, y in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)]
            columns = [places.field("h").slice(a, b - a), pa.array(ids[doc[a:b]]), places.field("start").slice(a, b - a), places.field("mid").slice(a, b - a), pa.array(packed, pa.binary()), places.field("hot").slice(a, b - a)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "doc_id", "start", "mid", "packed", "hot"])

    return map_batches(docs, run, _STRING)


def _halves(strings: DataFrame, words: bool, k: int, m: int) -> DataFrame:
    """The strings once for each side of the minimiser that has half of the rest of a window; h is the hash of that half with the minimiser."""
    half = (k - m + 1) // 2

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, keys = [], []
        for i, (s, p) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("mid").to_pylist(), strict=True)):
            units = s.split(b" ") if words else s
            for side in (units[p - half : p + m] if p >= half else b"", units[p : p + m + half]):
                if len(side) == half + m:
                    row.append(i)
                    keys.append(b" ".join(side) if words else side)
        if row:
            out = batch.take(pa.array(row))
            yield out.set_column(0, "h", _signed(digests(keys)[0]))

    return map_batches(strings, run, _STRING)


def _by_window(strings: DataFrame, words: bool, k: int) -> DataFrame:
    """w1, w2, doc_id, start: two hashes of each window of the strings."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, starts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("start").to_numpy(zero_copy_only=False)
        buf, off = text_bytes(batch.column("packed"))
        for a, b in blocks(off):
            u = Units(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)
            w1, w2 = u.windows(k), u.windows(k, 1)
            string = np.repeat(np.arange(b - a), np.diff(u.off))[: len(w1)]
            at = np.flatnonzero(np.arange(len(w1)) + k <= u.off[string + 1])
            string = string[at]
            yield pa.RecordBatch.from_arrays([_signed(w1[at]), _signed(w2[at]), pa.array(ids[a:b][string]), pa.array((starts[a:b][string] + at - u.off[string]).astype(np.int32))], names=["w1", "w2", "doc_id", "start"])

    return map_batches(strings, run, "w1 long, w2 long, doc_id long, start int")


#: From strings of whole buckets (bucket, doc_id, start, mid, packed), sorted by the first three: (string, window in it) of windows that an earlier place holds.
Kernel = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def repeated_windows(docs: DataFrame, k: int, m: int, words: bool, same_doc: bool, kernel: Kernel) -> DataFrame:
    """doc_id and spans (array of struct(start, windows)): windows of docs (doc_id, text) that an earlier document holds, or, with same_doc, an earlier place.

    Documents without such windows are not listed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    minimisers = cut(_minimisers(docs, words, k, m))
    found = minimisers.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("times").alias("times"))
    # What a join takes from an aggregation of the same keys is written first: only between two shuffles can adaptive execution split a hot key.
    met = cut(found.filter((F.col("lo") != F.col("hi")) | ((F.col("times") > 1) if same_doc else F.lit(False))).select("h"))
    wanted = minimisers.join(met, "h").groupBy("doc_id").agg(F.collect_list("h").alias("hs"))
    listed = cut(_listed(docs.join(wanted, "doc_id"), words, k, m))

    place = F.struct("doc_id", "start")
    contents = cut(listed.groupBy("h", "c1", "c2").agg(F.min(place).alias("first")))
    per = cut(contents.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1"))
    later = (F.col("doc_id") != F.col("first.doc_id")) | ((F.col("start") != F.col("first.start")) if same_doc else F.lit(False))
    # The first places of contents in buckets with several; without same_doc all places in the first document.
    marked = cut(listed.join(contents, ["h", "c1", "c2"]).join(per, "h", "left").select("h", "doc_id", "start", "windows", "mid", "at", "size", later.alias("later"), "many").filter("later or many is not null"))
    whole = marked.filter("later").select("doc_id", "start", "windows")

    open_ = marked.filter("not later").groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "windows", "mid", "at", "size", (F.col("many") > HOT).alias("hot"))).alias("at"))
    strings = cut(_strings(docs.join(open_, "doc_id"), words, k))
    found = [whole]
    dealt = strings.filter("not hot")
    if not strings.filter("hot").isEmpty():
        sides = cut(_halves(strings.filter("hot"), words, k, m))
        full = cut(sides.groupBy("h").agg(F.count("*").alias("many")).filter(F.col("many") > HOT).select("h"))
        dealt = dealt.unionByName(sides.join(full, "h", "left_anti"))
        windows = cut(_by_window(sides.join(full, "h", "left_semi"), words, k))
        first = cut(windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("w1", "w2", "first"))
        found.append(windows.join(first, ["w1", "w2"]).filter(later).select("doc_id", "start", F.lit(1).alias("windows")))
    size = dealt.agg(F.sum(F.length("packed"))).first()[0] or 0
    parts = max(1, -(-size // GROUP_BYTES))
    dealt = dealt.select(F.pmod(F.xxhash64("h"), F.lit(parts)).alias("part"), "h", "doc_id", "start", "mid", "packed")

    def in_bucket(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        h, ids, starts, mid = (group.column(c).to_numpy() for c in ("h", "doc_id", "start", "mid"))
        strings = group.column("packed").to_pylist()
        # Whole buckets, some CHUNK_BYTES at once, so that the kernel's arrays stay in the processor's cache.
        bucket = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        upto = np.r_[0, np.cumsum([len(x) for x in strings])]
        chunk = upto[bucket] // CHUNK_BYTES
        cuts = [*bucket[np.r_[True, chunk[1:] != chunk[:-1]]].tolist(), len(h)]
        kept = [(a, kernel(strings[a:b], h[a:b], ids[a:b], mid[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        string, window = np.concatenate([a + x for a, (x, _) in kept]), np.concatenate([y for _, (_, y) in kept])
        order = np.lexsort((window, string))
        string, window = string[order], window[order]
        first = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)]) if len(string) else np.zeros(0, np.int64)
        run = np.diff(np.r_[first, len(string)])
        return pa.table({"doc_id": pa.array(ids[string[first]], pa.int64()), "start": pa.array(starts[string[first]] + window[first], pa.int32()), "windows": pa.array(run, pa.int32())})

    inside = dealt.groupBy("part").applyInArrow(in_bucket, "doc_id long, start int, windows int")
    spans = reduce(DataFrame.unionAll, [*found, inside])
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def covered(n: int, spans: list[dict] | None, k: int) -> np.ndarray:
    """A flag for each of n units: whether a window of the spans covers it."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or []:
        edge[s["start"]] += 1
        edge[s["start"] + s["windows"] + k - 1] -= 1
    return np.cumsum(edge)[:n] > 0
