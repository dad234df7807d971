"""Word and n-gram hashes of many texts at once, in numpy.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  A word is hashed by its bytes to 64 bits, an n-gram by the hashes
of its words in order.  Texts are worked through in pieces of bounded size, cut
between words, so a very long text needs no more memory at once than its words'
hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1_000_000
_B = np.uint64(0x9E3779B97F4A7C15)
_K = np.uint64(0xD6E8FEB86659FD93)
_IS_WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IS_WORD[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a byte string, where they start, and their lengths."""
    buf = np.frombuffer(joined, np.uint8)
    inside = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    nth = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _B, np.uint64))
    sums = np.add.reduceat((LOWER[buf[inside]] + np.uint64(1)) * powers[nth], at)
    return mix(sums + lengths.astype(np.uint64)), starts, lengths


def cut(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut between words."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and _IS_WORD[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the words of each text."""
    out, counts = [], np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            hashes, starts, _ = hash_words(b"\n".join([texts[i] for i in group]))
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            counts[group] = np.diff(np.searchsorted(starts, ends), prepend=0)
            out.append(hashes)
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > PIECE:
            flush()
            parts = [hash_words(x)[0] for x in cut(text)]
            counts[i] = sum(map(len, parts))
            out += parts
            continue
        group.append(i)
        size += len(text) + 1
        if size > PIECE:
            flush()
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def ngram_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, in order with repeats, and how many
    each has.  A text of fewer words, but not none, has one: all its words."""
    ends = np.cumsum(counts)
    starts = ends - counts
    grams = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    first = np.repeat(starts - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    last = np.repeat(ends, grams)
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        at = first + k
        inside = at < last
        h = np.where(inside, (h + words[np.where(inside, at, 0)]) * _K, h) if len(words) else h
    return mix(h), grams
