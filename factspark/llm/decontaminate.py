"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Words are the runs of ASCII digits, ASCII letters (lower-cased) and characters
beyond ASCII.  A window is ``size`` consecutive words of an item; a shorter
item that has words is one window.  Document words stream through the
automaton; the longest matching length at each word tells which windows end
there, and every word inside a window is hit.

The automata are broadcast.  Items are taken in blocks of at most
``BLOCK_WORDS`` words, so that each automaton has a bound whatever the size of
the benchmark.  A task reads its documents once, holds some ``HELD_BYTES`` of
them, and streams those through one automaton after the other; what the blocks
find is united for each row, so that the result does not depend on the blocks.

Null text has no words.  Without items nothing is hit.  Repeated rows give
repeated results, and equal items each count.  An item's null id counts as the
string "None".  Extra columns of either input are ignored by
``decontamination_report`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches

#: Words of one automaton at most: some 100 MB in a worker.
BLOCK_WORDS = 300_000
#: Bytes of documents that a task holds while it goes through the blocks.
HELD_BYTES = 32 << 20
#: Every byte that is no part of a word becomes a space; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int) -> None:
        self.size, self.ids = size, [i for i, _ in items]
        self.symbol: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.symbol.setdefault(w, len(self.symbol) + 1))
                path.append(last)
            ends.append(path)
        n = len(self.next)
        #: The state of a state's suffix of just the window's size, or -1.
        self.anchor = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            if self.length[v] >= size:
                self.anchor[v] = v if self.length[self.link[v]] < size else self.anchor[self.link[v]]
        #: Items with a window in an anchor; short items that end in a state, by length.
        self.items: list[set[int]] = [set() for _ in range(n)]
        self.short: list[dict[int, set[int]]] = [{} for _ in range(n)]
        self.least = size
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < size:
                self.least = min(self.least, len(words))
                v = 0
                for w in words:
                    v = self.next[v][self.symbol[w]]
                self.short[v].setdefault(len(words), set()).add(k)
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][self.symbol[w]]
                if i + 1 >= size:
                    self.items[self.anchor[v]].add(k)
        #: The nearest state up the suffix links, itself included, at which a short item ends.
        self.above = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            self.above[v] = v if self.short[v] else self.above[self.link[v]] if v else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        r = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = r
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = r
            p = link[p]
        return r

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Word spans [start, end) of the windows found, disjoint and in order; items with such windows; the longest matching length."""
        get = self.symbol.get
        symbols = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.r_[0, symbols != 0, 0]))
        spans: list[tuple[int, int]] = []
        anchors: set[int] = set()
        ended: set[tuple[int, int]] = set()
        longest, size = 0, self.size
        nxt, link, length, anchor, above, short = self.next, self.link, self.length, self.anchor, self.above, self.short
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.least:  # no window fits between words that no item has
                continue
            v, l = 0, 0  # noqa: E741
            for i, c in enumerate(symbols[a:b].tolist(), a + 1):
                while v and c not in nxt[v]:
                    v = link[v]
                    l = length[v]  # noqa: E741
                if c in nxt[v]:
                    v = nxt[v][c]
                    l += 1  # noqa: E741
                if l > longest:
                    longest = l
                start = i
                if l >= size:
                    anchors.add(anchor[v])
                    start = i - size
                u = above[v]
                while u > 0:
                    for n in short[u]:
                        if n <= l:
                            ended.add((u, n))
                            start = min(start, i - n)
                    u = above[link[u]]
                if start < i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        # A window's items are united once, however often the document has it.
        found = set().union(*(self.items[x] for x in anchors), *(short[u][n] for u, n in ended))
        return spans, found, longest


def automata(items: DataFrame, size: int) -> Iterator[Automaton]:
    """Automata of the items (item_id, text), in blocks of bounded size; rows stream to the driver one partition at a time."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for row in items.select("item_id", "text").filter("text is not null").toLocalIterator():
        words = words_of(row["text"])
        if held and held + len(words) > BLOCK_WORDS:
            yield Automaton(block, size)
            block, held = [], 0
        if words:
            block.append((str(row["item_id"]), words))
            held += len(words)
    if block:
        yield Automaton(block, size)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


Found = tuple[list[tuple[int, int]], set[str], int]


def _matched(texts: list[list[bytes]], held: list[Broadcast]) -> list[Found]:
    """Spans, items and longest match of each text, over all automata; only one of several is in memory at a time."""
    found: list[Found] = [([], set(), 0) for _ in texts]
    for block in held:
        sam = block.value
        for i, words in enumerate(texts):
            spans, items, longest = sam.match(words)
            before = found[i]
            found[i] = united(before[0] + spans) if before[0] else spans, before[1] | {sam.ids[k] for k in items}, max(before[2], longest)
        if len(held) > 1:
            del sam, block._value
    return found


def _with_matches(docs: DataFrame, items: DataFrame, size: int, rows: Callable[[pa.RecordBatch, list[list[bytes]], list[Found]], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """rows of each batch of docs, its words and what the automata of the items find in it."""
    spark = docs.sparkSession
    small_batches(spark)
    held = [spark.sparkContext.broadcast(sam) for sam in automata(items, size)]

    def answers(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [[words_of(t.as_py()) for t in b.column("text")] for b in batches]
        found = iter(_matched([w for ws in words for w in ws], held))
        for batch, ws in zip(batches, words, strict=True):
            yield rows(batch, ws, [next(found) for _ in ws])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if waiting and (len(held) < 2 or sum(b.nbytes for b in waiting) > HELD_BYTES):
                yield from answers(waiting)
                waiting = []
        if waiting:
            yield from answers(waiting)

    return docs.mapInArrow(run, schema)


def decontamination_hits(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, spans (of words hit, disjoint, in order), items (ids as sorted strings), longest (matching length) of each row."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batch: pa.RecordBatch, words: list[list[bytes]], found: list[Found]) -> pa.RecordBatch:
        spans = [[{"start": a, "end": b} for a, b in s] for s, _, _ in found]
        columns = [pa.array(map(len, words), pa.int64()), pa.array(spans, span), pa.array([sorted(x) for _, x, _ in found], pa.list_(pa.string())), pa.array([x for _, _, x in found], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "spans", "items", "longest"])

    return _with_matches(docs.select("doc_id", "text"), items, size, rows, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long")


def decontamination_report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    hits = decontamination_hits(docs, items, size)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, max_length: int | None = None, max_coverage: float = 0.0) -> DataFrame:
    """Rows of docs, with all their columns and each doc_id once or more, that stay within the limits.

    A document goes if the share of its words that is hit exceeds
    ``max_coverage``, or if its longest match exceeds ``max_length`` words;
    with coverage 0, any window is enough.  In documents that stay, the hit
    spans are cut out of the text.  Both are judged on the whole text and all
    items.  The automata read the text in the same pass that filters it, so
    that no join brings texts and hits together.
    """

    def rows(batch: pa.RecordBatch, words: list[list[bytes]], found: list[Found]) -> pa.RecordBatch:
        keep, texts = [], []
        for text, ws, (spans, _, longest) in zip(batch.column("text"), words, found, strict=True):
            hit = sum(b - a for a, b in spans)
            keep.append(not hit or (hit <= max_coverage * len(ws) and (max_length is None or longest <= max_length)))
            texts.append(_cut(text.as_py(), spans) if hit and keep[-1] else text.as_py())
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(pa.array(keep))

    return _with_matches(docs, items, size, rows, docs.schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the word spans."""
    raw = text.encode()
    flags = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.r_[0, flags.view(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


