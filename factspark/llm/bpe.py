"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file is a parameter and stays where it is.  The words of a
block of documents that are not in the worker's cache go into one flat symbol
array; every round looks all adjacent pairs up by binary search over the
sorted pair keys, and each word merges its lowest-rank pair at every place
where it occurs, from the left.  Words without a known pair leave the array.

Null text counts as empty, and an empty text has no tokens.  Repeated rows
give repeated results.  Extra columns of the input are not passed on.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .common import blocks, map_batches, small_batches

#: Words kept encoded in each worker, and the longest one kept; beyond that number the cache starts anew.
CACHE_WORDS, CACHE_BYTES = 400_000, 256
#: Symbols of a word beyond which it is merged by itself, from a queue of pairs: rounds over it would take as many passes as it has ranks.
LONG_WORD = 1000
#: How the vocabulary's pre-tokenizer splits texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_SHIFT = 20
_NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself where printable, else the next one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with the vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << _SHIFT) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, merged in common rounds."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        if not words:
            return out
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i in set(range(len(words))) - set(short):
            out[i] = self.encode_long(words[i])
        symbols = self.of_byte[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        word = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(symbols), _NONE)
            at = np.searchsorted(self.keys, key := (symbols[:-1] << _SHIFT) | symbols[1:])
            at[at == len(self.keys)] = 0
            known = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank[:-1][known] = self.ranks[at[known]]
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            ends = least == _NONE
            for s, n in zip(first[ends].tolist(), size[ends].tolist(), strict=True):
                out[word[s]] = symbols[s : s + n]
            goes = rank == np.repeat(least, size)
            goes &= rank != _NONE
            places = np.flatnonzero(goes)
            if len(places):  # in a run of the same pair, as in aaaa, every other one merges
                run = np.cumsum(np.r_[True, np.diff(places) != 1])
                start = places[np.r_[True, run[1:] != run[:-1]]]
                places = places[(places - start[run - 1]) % 2 == 0]
                symbols = symbols.copy()
                symbols[places] = self.merged[at[places]]
            keep = ~np.repeat(ends, size)
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: pairs wait in a heap by rank and place, and each merge looks at its two new neighbours only."""
        symbols = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        found: dict[int, tuple[int, int] | None] = {}

        def rule(i: int) -> tuple[int, int] | None:
            """Rank and result of the pair that begins at i."""
            key = (symbols[i] << _SHIFT) | symbols[after[i]]
            if key not in found:
                at = int(np.searchsorted(self.keys, key))
                found[key] = (int(self.ranks[at]), int(self.merged[at])) if at < len(self.keys) and self.keys[at] == key else None
            return found[key]

        waiting = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rule(i))]
        heapq.heapify(waiting)
        while waiting:
            _, i, x, y = heapq.heappop(waiting)
            j = after[i]
            if symbols[i] != x or j < 0 or symbols[j] != y:
                continue  # a merge has changed the pair
            symbols[i] = rule(i)[1]
            symbols[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rule(k)):
                    heapq.heappush(waiting, (r[0], k, symbols[k], symbols[after[k]]))
        return np.array([x for x in symbols if x >= 0], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.cut(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        split = [[(self.special[p] if i % 2 else self.split(p)) for i, p in enumerate(ps)] for ps in parts]
        new = {w for ps in split for words in ps if not isinstance(words, int) for w in words} - self.cache.keys()
        if new:
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache.clear()
                new = {w for ps in split for words in ps if not isinstance(words, int) for w in words}
            fresh = list(new)
            coded = dict(zip(fresh, (ids.astype("<u4").tobytes() for ids in self.encode_words([w.encode() for w in fresh])), strict=True))
            self.cache |= coded
        get = self.cache.__getitem__
        out = [b"".join(words.to_bytes(4, "little") if isinstance(words, int) else b"".join(map(get, words)) for words in ps) for ps in split]
        for w in [w for w in new if len(w) > CACHE_BYTES]:
            del self.cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids where asked for."""
    small_batches(docs.sparkSession)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        ids, texts = batch.column("doc_id"), batch.column("text")
        sizes = np.r_[0, np.cumsum(np.nan_to_num(np.array(pa.compute.binary_length(texts).to_pylist(), float)))]
        for a, b in blocks(sizes):
            coded = c.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            decoded = list(map(c.decode, coded))
            columns = {
                "doc_id": ids.slice(a, b - a),
                "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
                "ids_sha256": pa.array(map(sha, coded), pa.string()),
                "decoded_sha256": pa.array(map(sha, map(str.encode, decoded)), pa.string()),
            }
            if keep_ids:
                columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in coded], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids)


def bpe_decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    small_batches(coded.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id long, text string")
