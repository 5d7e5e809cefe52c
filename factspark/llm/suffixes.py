"""Exact removal of byte passages that occur earlier, by suffix arrays built column by column.

A byte goes if a string of ``SIZE`` bytes that covers it also starts earlier:
in a document with a smaller doc_id, or earlier in the same one.  Overlaps
count, strings do not cross documents, and all is judged on the input.

The collection is cut into super-k-mers, so that each bucket holds short
strings only (below 2 * SIZE bytes).  All strings of a range of buckets make
one collection, whose Burrows-Wheeler transform and common prefixes are built
column by column: a round inserts, for every string that is long enough, the
suffix that is longer by one symbol.  Its row follows from the rank of its
first symbol in the transform so far, its common prefix with its neighbours
from the least common prefix between that symbol and the one before it.  Old
rows keep their order; a round reads transform and common prefixes once, in
sequence, and writes them anew.  In the end rows with at least SIZE symbols in
common are the places of one string, and walking the transform backwards tells
which places they are.

Departure from the method's usual form: transform and common prefixes are
arrays of a bounded range of buckets in memory (some ``CHUNK_BYTES``) instead
of external files of the whole collection.  A round over all documents would
be a pass over all data for each byte of the longest, and files of a task
would lie in a folder of one machine.

Null text counts as empty.  Rows that share a doc_id are one document whose
equal starts do not count as earlier; rows with a null doc_id stay whole.
Extra columns are not passed on.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, small_batches
from .superkmer import covered, repeated_windows

SIZE, MINIMISER = 100, 20


def transform_and_prefixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of strings of less than 256 bytes, and each row's common prefix with the row before.

    Symbols are dense ranks from 1, 0 stands where a string begins.  The first
    rows are the empty suffixes in the order of the strings; they differ, as
    every string has an end mark of its own.
    """
    length = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    dense = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
    dense[used] = np.arange(1, len(used) + 1)
    # Each string with a 0 before it: the symbol before the suffix of j symbols is laid[end - j].
    end = np.cumsum(length + 1) - 1
    laid = np.zeros(len(text) + len(length), dense.dtype)
    inner = np.ones(len(laid), bool)
    inner[end - length] = False
    laid[inner] = dense[text]
    m = len(strings)
    transform, common = laid[end], np.zeros(m, np.uint8)
    # Strings whose suffix grows, and its row now.
    row = np.flatnonzero(length)
    end, length = end[row], length[row]
    size = 1
    while len(end):
        n = len(transform)
        by_symbol = np.argsort(transform, kind="stable")  # one counting pass: the rows that precede each symbol, in order
        shift = m - n + int(np.count_nonzero(transform))  # from a place there to the row that begins with that symbol
        grows, which = np.zeros(n, bool), np.empty(n, np.int32)
        grows[row], which[row] = True, np.arange(len(row), dtype=np.int32)
        place = np.flatnonzero(grows[by_symbol])
        order = which[by_symbol[place]]
        end, length, new = end[order], length[order], place + shift
        old, touched = np.ones(n + shift, bool), np.zeros(n + shift + 1, bool)
        old[new] = False
        touched[new] = touched[new + 1] = True
        # The common prefix of a new row, and of the one behind it: one more than the least between the two symbols.
        at = np.flatnonzero(touched[:-1])
        upper = by_symbol[at - shift]
        lower = by_symbol[np.maximum(at - shift - 1, 0)]
        value = np.zeros(len(at), np.uint8)
        alike = np.flatnonzero((at > m) & (transform[upper] == transform[lower]))
        if len(alike):
            between = np.empty(2 * len(alike), np.int64)
            between[::2], between[1::2] = lower[alike] + 1, upper[alike] + 1
            value[alike] = np.minimum.reduceat(np.r_[common, np.uint8(0)], between)[::2] + 1
        grown, prefixes = np.empty(len(old), transform.dtype), np.empty(len(old), np.uint8)
        grown[old], prefixes[old] = transform, common
        grown[new], prefixes[at] = laid[end - size], value
        transform, common = grown, prefixes
        longer = length > size
        end, length, row = end[longer], length[longer], new[longer]
        size += 1
    return transform, common


def places_of_rows(transform: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each row of a transform the place of its suffix in the joined strings; for empty suffixes the string's end."""
    rank = np.empty(len(transform), np.int64)
    rank[np.argsort(transform, kind="stable")] = np.arange(len(transform))
    out = np.empty(len(transform), np.int64)
    end, row = np.cumsum(length), np.arange(len(length))
    out[row] = end
    size = 1
    while len(row):
        longer = length >= size
        row, end, length = rank[row[longer]], end[longer], length[longer]
        out[row] = end - size
        size += 1
    return out


def with_company(strings: list[bytes], buckets: np.ndarray, mid: np.ndarray) -> np.ndarray:
    """Strings that may share a window with another one of their bucket.

    A window is the minimiser and SIZE - MINIMISER bytes around it, so it has
    half of those on one side; strings that share it agree there.
    """
    half = (SIZE - MINIMISER + 1) // 2
    sides = [(b, s[p - half : p] if p >= half else None, s[p + MINIMISER : p + MINIMISER + half]) for b, p, s in zip(buckets.tolist(), mid.tolist(), strings, strict=True)]
    left, right = Counter((b, x) for b, x, _ in sides if x is not None), Counter((b, y) for b, _, y in sides if len(y) == half)
    return np.array([i for i, (b, x, y) in enumerate(sides) if (x is not None and left[b, x] > 1) or right[b, y] > 1], np.int64)


def by_suffixes(strings: list[bytes], buckets: np.ndarray, ids: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that an earlier string of the bucket also holds; no string holds a window twice."""
    some = with_company(strings, buckets, mid)
    strings = [strings[i] for i in some]
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.array([len(s) for s in strings], np.int64)
    transform, common = transform_and_prefixes(strings)
    place = places_of_rows(transform, length)
    at = np.flatnonzero(common >= SIZE)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum([0, *length.tolist()])
    rows = np.unique(np.r_[at, at - 1])
    fresh = common[rows] < SIZE
    owner = np.searchsorted(first, place[rows], "right") - 1
    group = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(owner, np.flatnonzero(fresh))
    again = owner != least[group]
    return some[owner[again]], place[rows[again]] - first[owner[again]]


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row (and kept, the bytes that stay, where asked for)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    spans = repeated_windows(docs, SIZE, MINIMISER, words=False, same_doc=True, kernel=by_suffixes)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw = (text.as_py() or "").encode()
            gone, runs, kept = 0, 0, raw
            if found := found.as_py():  # noqa: PLW2901
                flags = covered(len(raw), found, SIZE)
                gone, runs = int(flags.sum()), int(np.count_nonzero(np.diff(np.r_[0, flags.view(np.int8)]) == 1))
                kept = np.frombuffer(raw, np.uint8)[~flags].tobytes()
            rows.append((len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
        size, gone, runs, sha, kept = zip(*rows, strict=True)
        columns = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    return map_batches(docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
