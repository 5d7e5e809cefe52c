"""Hashes of words and of runs of words or bytes, for whole blocks of texts at once in numpy.

No hash here is a polynomial: every step of a chain goes through a mixing
function, so that texts built from repeated patterns do not collide.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one with BLAKE2b.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _seed(which: int) -> np.ndarray:
    return mix(np.array([which + 1], np.uint64) * _ODD)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; zeros follow the end."""
    pad = np.zeros(len(buf) + 8, np.uint8)
    pad[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", pad, strides=(1,))


def runs(values: np.ndarray, base: int, size: int) -> np.ndarray:
    """Hashes of all runs of size units; values are those of all runs of base units.

    Lengths double, and the last step lets two runs overlap.
    """
    reach = base
    while reach * 2 <= size:
        values = mix(values[:-reach] * _ODD + values[reach:]) if len(values) > reach else values[:0]
        reach *= 2
    rest = size - reach
    if rest:
        values = mix(values[:-rest] * _ODD + values[rest:] + U(rest)) if len(values) > rest else values[:0]
    return values


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
FOLD_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE[65:91] += 32


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and the text of each; words do not cross texts."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACES[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True  # a text's start or end
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each word's bytes: a chain over eight bytes a step, which gives different words of up to eight bytes different hashes."""
    size = end - start
    out = mix(size.astype(np.uint64) + _seed(which))
    at = eights(buf)
    live = np.flatnonzero(size <= LONG_WORD)
    for i in range(0, LONG_WORD, 8):
        live = live[size[live] > i] if i else live
        if not len(live):
            break
        out[live] = mix((out[live] ^ (at[start[live] + i] & _MASK[np.minimum(size[live] - i, 8)])) * _ODD + U(i + 1))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=bytes([which])).digest(), "little")
    return out


def digests(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each string's 128-bit BLAKE2b digest, as signed integers."""
    both = np.frombuffer(b"".join([hashlib.blake2b(s, digest_size=16).digest() for s in strings]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct runs of size words, by text; a text with fewer words has its whole sequence."""
    s, e, doc = word_bounds(buf, off)
    words = np.bincount(doc, minlength=len(off) - 1) if len(doc) else np.zeros(len(off) - 1, np.int64)
    values = word_hashes(buf, s, e)
    first = np.r_[0, np.cumsum(words)]
    at = np.arange(len(s))
    whole = at[at + size <= first[doc + 1]] if len(s) else at
    short = np.flatnonzero((words > 0) & (words < size))
    few = mix(words[short].astype(np.uint64))
    for i in range(size - 1):
        more = words[short] > i
        few[more] = mix(few[more] * _ODD + values[first[short[more]] + i])
    owner = np.r_[doc[whole], short]
    h = np.r_[runs(values, 1, size)[whole], few]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]
