"""Exact removal of passages of consecutive words that an earlier document holds, by super-k-mer partitioning.

Words are what white space (space, tab to carriage return) separates, taken
unchanged.  A word goes if a window of ``SIZE`` words that covers it also
starts in a document with a smaller doc_id; windows are judged on the input.

Null text has no words; a document with fewer than SIZE words keeps all.  Rows
that share a doc_id are one document for this purpose: none of them makes the
other a copy.  Rows with a null doc_id keep all their words.  Extra columns
are not passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, small_batches
from .superkmer import covered, repeated_windows

SIZE, MINIMISER = 50, 8


def by_sorting(strings: list[bytes], buckets: np.ndarray, ids: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a document with a smaller id holds: the windows of all strings are sorted as word sequences."""
    windows: list[tuple[bytes, int, int, int]] = []
    for i, s in enumerate(strings):
        w = s.split(b" ")
        windows += [(b" ".join(w[j : j + SIZE]), int(ids[i]), i, j) for j in range(len(w) - SIZE + 1)]
    windows.sort()
    string, window = [], []
    held, first = None, 0
    for text, doc, i, j in windows:
        if text != held:
            held, first = text, doc
        elif doc != first:
            string.append(i)
            window.append(j)
    return np.array(string, np.int64), np.array(window, np.int64)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row (and kept, the text that stays, where asked for)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    spans = repeated_windows(docs, SIZE, MINIMISER, words=True, same_doc=False, kernel=by_sorting)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, gone, kept = [], [], []
        for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            if found := found.as_py():  # noqa: PLW2901
                flags = covered(len(words), found, SIZE)
                left = [w for w, f in zip(words, flags.tolist(), strict=True) if not f]
            else:
                left = words
            n.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array([x.decode() for x in kept], pa.string())} if texts else {}))

    return map_batches(docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)

