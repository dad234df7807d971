"""Toxicity: a bidirectional GRU with attention pooling, trained in numpy.

A word enters as two inputs: its own, from a hashed word table, and one pooled
over its characters, from a hashed table of the n-grams of its bytes with both
ends marked (their mean, and the largest of the first component).  The first
component of a table entry starts as the shrunk log-odds of documents that hold
it; the others start small and are trained with the network.  The network reads
windows of ``WINDOW`` words in both directions, pools the states by attention
and gives a logit.  Windows overlap by half and cover the whole text; a
document's logit is the largest of its windows', calibrated to a probability.

The fit takes a bounded sample of labelled documents: at most ``POSITIVE`` and
``NEGATIVE`` rows of at most ``SAMPLE_CHARS`` characters each, in the order of
a hash of doc_id, to the driver.  Only documents' labels are known, so each
round trains on the window with the largest logit of every document (at first:
with the largest log-odds).  Everything else, all windows of all documents, runs
in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.words import LOWER, PIECE, cut, hash_words, mix

WINDOW, STRIDE = 24, 12
HIDDEN, ATTENTION, TRAINED = 8, 8, 2
#: bytes of a gram
GRAM = 6
TABLE_BITS = 17
POSITIVE, NEGATIVE, SAMPLE_CHARS = 600, 2000, 30_000
ROUNDS, EPOCHS, BATCH, RATE = 3, 8, 64, 0.01
#: documents a feature is shrunk by
SHRINK = 4.0
REJECT_AT = 0.3
_SLOTS = 1 << TABLE_BITS
_INPUTS = 2 * (1 + TRAINED)


class Model(NamedTuple):
    word: np.ndarray     # (slots, 1 + TRAINED)
    gram: np.ndarray
    net: dict            # weights of the network
    scale: tuple         # (slope, shift) of the calibration


# ---- inputs ----------------------------------------------------------------

def _grams(lowered: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of words in a byte array, and how many each word has."""
    size = lengths + 2
    at = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()) + GRAM, np.uint64)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[at] = 2
    flat[at + size - 1] = 3
    flat[np.repeat(at + 1, lengths) + inner] = lowered[np.repeat(starts, lengths) + inner]
    counts = np.maximum(size - GRAM + 1, 1)
    k = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(at, counts) + k
    last = np.repeat(at + size, counts)
    value = np.zeros(len(first), np.uint64)
    for i in range(GRAM):
        byte = np.where(first + i < last, flat[first + i], np.uint64(0))
        value |= byte << np.uint64(8 * i)
    return (mix(value + np.uint64(77)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), counts


class Words(NamedTuple):
    """The words of a byte string: for each distinct one its slot and its
    grams' slots, and for each word in order which distinct one it is."""

    slot: np.ndarray
    grams: np.ndarray
    counts: np.ndarray
    which: np.ndarray
    starts: np.ndarray


def read_words(joined: bytes) -> Words:
    hashes, starts, lengths = hash_words(joined)
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    lowered = LOWER[np.frombuffer(joined, np.uint8)]
    grams, counts = _grams(lowered, starts[first], lengths[first])
    return Words((distinct >> np.uint64(64 - TABLE_BITS)).astype(np.int64), grams, counts, which, starts)


def _inputs(w: Words, word: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Inputs of the distinct words: (n, _INPUTS)."""
    if not len(w.slot):
        return np.zeros((0, _INPUTS), np.float32)
    at = np.cumsum(w.counts) - w.counts
    g = gram[w.grams]
    mean = np.add.reduceat(g, at, axis=0) / w.counts[:, None]
    mean[:, 0] = np.maximum.reduceat(g[:, 0], at)
    return np.concatenate([word[w.slot], mean], axis=1).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    k = -(-(n - WINDOW) // STRIDE) + 1
    return np.minimum(np.arange(k) * STRIDE, n - WINDOW)


# ---- network ---------------------------------------------------------------

def new_net(seed: int = 0) -> dict:
    r = np.random.default_rng(seed)
    h = HIDDEN

    def w(*shape: int) -> np.ndarray:
        return (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    return {"W": w(2, _INPUTS, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "U": w(2, h, 3 * h),
            "A": w(2 * h, ATTENTION), "v": w(ATTENTION, 1), "o": w(2 * h, 1), "c": np.zeros(1, np.float32)}


def forward(net: dict, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Logits of windows.  x: (WINDOW, n, _INPUTS); mask: (WINDOW, n) or None
    where no word is missing."""
    steps, n, _ = x.shape
    h = HIDDEN
    both = np.stack([x, x[::-1]])
    pre = np.matmul(both.reshape(2, steps * n, -1), net["W"]) + net["b"]
    pre = pre.reshape(2, steps, n, 3 * h)
    m2 = None if mask is None else np.stack([mask, mask[::-1]])[..., None]
    state = np.zeros((2, n, h), np.float32)
    states = np.empty((2, steps, n, h), np.float32)
    saved = []
    for t in range(steps):
        hu = np.matmul(state, net["U"])
        zr = np.tanh((pre[:, t, :, :2 * h] + hu[..., :2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r = zr[..., :h], zr[..., h:]
        new = np.tanh(pre[:, t, :, 2 * h:] + r * hu[..., 2 * h:])
        if keep:
            saved.append((state, z, r, new, hu[..., 2 * h:]))
        state = new + z * (state - new)
        if m2 is not None:
            state = state * m2[:, t]
        states[:, t] = state
    joined = np.concatenate([states[0], states[1][::-1]], axis=-1)
    u = np.tanh(joined @ net["A"])
    e = (u @ net["v"])[..., 0]
    if mask is not None:
        e = np.where(mask > 0, e, np.float32(-30))
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[..., None] * joined).sum(axis=0)
    logit = (pooled @ net["o"])[:, 0] + net["c"][0]
    return (logit, (both, m2, saved, joined, u, a, pooled)) if keep else logit


def backward(net: dict, kept: tuple, d: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the inputs for d = dLoss/dlogit."""
    both, m2, saved, joined, u, a, pooled = kept
    h = HIDDEN
    g = {k: np.zeros_like(v) for k, v in net.items()}
    g["o"][:] = (pooled.T @ d)[:, None]
    g["c"][:] = d.sum()
    d_pooled = d[:, None] * net["o"][:, 0]
    d_joined = a[..., None] * d_pooled
    d_a = (joined * d_pooled).sum(axis=-1)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    d_u = d_e[..., None] * net["v"][:, 0]
    g["v"][:] = np.einsum("tna,tn->a", u, d_e)[:, None]
    d_pre = d_u * (1 - u * u)
    g["A"][:] = np.einsum("tnh,tna->ha", joined, d_pre)
    d_joined = d_joined + d_pre @ net["A"].T
    d_states = np.stack([d_joined[..., :h], d_joined[..., h:][::-1]])
    d_state = np.zeros_like(saved[0][0])
    d_x = np.zeros_like(both)
    for t in range(len(saved) - 1, -1, -1):
        state, z, r, new, hu_n = saved[t]
        d_state = d_state + d_states[:, t]
        if m2 is not None:
            d_state = d_state * m2[:, t]
        d_new = d_state * (1 - z) * (1 - new * new)
        d_z = d_state * (state - new) * z * (1 - z)
        d_r = d_new * hu_n * r * (1 - r)
        d_gate = np.concatenate([d_z, d_r, d_new], axis=-1)
        d_hu = np.concatenate([d_z, d_r, d_new * r], axis=-1)
        g["W"] += np.matmul(both[:, t].transpose(0, 2, 1), d_gate)
        g["b"] += d_gate.sum(axis=1, keepdims=True)
        g["U"] += np.matmul(state.transpose(0, 2, 1), d_hu)
        d_x[:, t] = np.matmul(d_gate, net["W"].transpose(0, 2, 1))
        d_state = d_state * z + np.matmul(d_hu, net["U"].transpose(0, 2, 1))
    return g, d_x[0] + d_x[1][::-1]


# ---- scoring ---------------------------------------------------------------

def _logits(net: dict, x: np.ndarray, counts: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all windows of texts whose words' inputs are x, the window's
    text, and its start in x."""
    ends = np.cumsum(counts)
    parts = [window_starts(int(n)) for n in counts]
    owner = np.repeat(np.arange(len(counts)), [len(p) for p in parts])
    starts = np.concatenate(parts) + (ends - counts)[owner] if len(counts) else np.empty(0, np.int64)
    # short texts apart: only they miss words
    out = np.empty(len(starts), np.float32)
    short = counts[owner] < WINDOW
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    steps = np.arange(WINDOW)[:, None]
    for some, masked in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
        for k in range(0, len(some), chunk):
            rows = some[k:k + chunk]
            at = starts[rows] + steps
            mask = None
            if masked:
                inside = at < ends[owner[rows]]
                at, mask = np.where(inside, at, len(x)), inside.astype(np.float32)
            out[rows] = forward(net, padded[at], mask)
    return out, owner, starts


def _groups(texts: list[bytes]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size > PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def text_inputs(texts: list[bytes], word: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all words of texts, in order, and the words of each text."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        parts = []
        for piece in cut(texts[0]):
            w = read_words(piece)
            parts.append(_inputs(w, word, gram)[w.which])
        x = np.concatenate(parts)
        return x, np.array([len(x)])
    w = read_words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _inputs(w, word, gram)[w.which], np.diff(np.searchsorted(w.starts, ends), prepend=0)


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores (0 to 1) of whole texts."""
    out = np.zeros(len(texts))
    for group in _groups(texts):
        # a text longer than a piece stands alone
        for some in ([i for i in group if len(texts[i]) <= PIECE], *[[i] for i in group if len(texts[i]) > PIECE]):
            if some:
                x, counts = text_inputs([texts[i] for i in some], model.word, model.gram)
                logit, owner, _ = _logits(model.net, x, counts)
                best = np.full(len(some), -np.inf)
                np.maximum.at(best, owner, logit)
                out[some] = best
    slope, shift = model.scale
    return 1 / (1 + np.exp(-np.clip(slope * out + shift, -30, 30)))


# ---- training --------------------------------------------------------------

def _log_odds(held: np.ndarray, all_: tuple[int, int]) -> np.ndarray:
    """Shrunk log-odds of (slots, 2) document counts of clean and toxic."""
    rate = (held + 0.5) / (np.array(all_) + 1.0)
    total = held.sum(axis=1)
    return (np.log(rate[:, 1] / rate[:, 0]) * total / (total + SHRINK)).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 0) -> Model:
    """A model from labelled texts; ``prior`` is the share of label 1 among all
    labelled documents.  Without texts of both labels every score is ``prior``."""
    labels = np.asarray(labels, np.int64)
    r = np.random.default_rng(seed)
    tables = [np.zeros((_SLOTS, 1 + TRAINED), np.float32) for _ in range(2)]
    net = new_net(seed)
    if len(set(labels.tolist())) < 2:
        net["o"][:] = 0
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(*tables, net, (0.0, float(np.log(p / (1 - p)))))
    read = [read_words(t) for t in texts]
    held = np.zeros((2, _SLOTS, 2))
    own = []
    for w, y in zip(read, labels, strict=True):
        sets = np.unique(w.slot), np.unique(w.grams)
        own.append(sets)
        for k in range(2):
            held[k][sets[k], y] += 1
    all_ = (int((labels == 0).sum()), int(labels.sum()))
    for k in range(2):
        tables[k][:, 0] = _log_odds(held[k], all_)
        tables[k][:, 1:] = r.standard_normal((_SLOTS, TRAINED)) * 0.1

    def inputs(i: int) -> np.ndarray:
        """Inputs of text i; its own part in the log-odds is taken out."""
        y, kept = labels[i], []
        rest = (all_[0] - (y == 0), all_[1] - (y == 1))
        for k in range(2):
            kept.append(tables[k][own[i][k], 0].copy())
            less = held[k][own[i][k]].copy()
            less[:, y] -= 1
            tables[k][own[i][k], 0] = _log_odds(less, rest)
        x = _inputs(read[i], *tables)
        for k in range(2):
            tables[k][own[i][k], 0] = kept[k]
        return x

    def best_windows(first: bool) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, w in enumerate(read):
            x = inputs(i)[w.which]
            if first:
                starts = window_starts(len(x))
                top = [np.maximum(x[s:s + WINDOW, 0], x[s:s + WINDOW, 1 + TRAINED]).max(initial=-9) for s in starts]
                out[i] = starts[int(np.argmax(top))]
            else:
                logit, _, starts = _logits(net, x, np.array([len(x)]))
                out[i] = starts[int(np.argmax(logit))]
        return out

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    step = 0
    weight = np.where(labels == 1, 0.5 / all_[1], 0.5 / all_[0]) * len(labels)
    for turn in range(ROUNDS):
        starts = best_windows(turn == 0)
        x0 = [inputs(i) for i in range(len(texts))]
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                some = order[a:a + BATCH]
                x = np.zeros((WINDOW, len(some), _INPUTS), np.float32)
                mask = np.zeros((WINDOW, len(some)), np.float32)
                for j, i in enumerate(some):
                    at = read[i].which[starts[i]:starts[i] + WINDOW]
                    x[:len(at), j] = x0[i][at]
                    mask[:len(at), j] = 1
                logit, kept = forward(net, x, mask, keep=True)
                d = ((1 / (1 + np.exp(-logit)) - labels[some]) * weight[some] / len(some)).astype(np.float32)
                grads, d_x = backward(net, kept, d)
                step += 1
                for k, v in net.items():
                    m, s = moments[k]
                    m += 0.1 * (grads[k] - m)
                    s += 0.01 * (grads[k] ** 2 - s)
                    v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-7)
                for j, i in enumerate(some):
                    w = read[i]
                    at = w.which[starts[i]:starts[i] + WINDOW]
                    np.add.at(tables[0], (w.slot[at][:, None], np.arange(1, 1 + TRAINED)),
                              -RATE * d_x[:len(at), j, 1:1 + TRAINED])
    logits = np.array([_logits(net, inputs(i)[w.which], np.array([len(w.which)]))[0].max() for i, w in enumerate(read)])
    return Model(*tables, net, _calibrate(logits, labels, prior))


def _calibrate(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit, with the sample's share of label 1
    replaced by ``prior``; targets are smoothed, so the slope stays finite."""
    n1, n0 = labels.sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(labels == 1, prior / n1, (1 - prior) / n0) * len(labels)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        d, s = w * (p - target), w * p * (1 - p)
        g = np.array([(d * logits).sum(), d.sum()])
        hess = np.array([[(s * logits ** 2).sum() + 1e-4, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-4]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return float(a), float(b)


# ---- on tables -------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4 (null: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    """A model from the labelled documents that are not held out.  Rows with a
    null label or doc_id teach nothing."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS)
    known = known.join(found.select("doc_id").distinct(), "doc_id")
    rows = []
    share = known.agg(F.avg("toxic").alias("p")).first()["p"] or 0.0
    for y, most in ((0, NEGATIVE), (1, POSITIVE)):
        ids = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows += found.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows]), share, seed)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs``, all columns, with a score of the whole text.  A null or empty
    text has no words and gets the score of an empty window.  A column of the
    new name is replaced."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for at in range(0, batch.num_rows, 256):  # a few texts at a time in memory
                part = batch.column(text).slice(at, 256).cast(pa.binary()).to_pylist()
                scores[at:at + 256] = score_texts(shared.value, [x or b"" for x in part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def keep_harmless(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs``, all columns, with a score under ``reject_at``."""
    scored = score(docs, train(docs, labels), into="__toxicity")
    return scored.where(F.col("__toxicity") < reject_at).drop("__toxicity")
