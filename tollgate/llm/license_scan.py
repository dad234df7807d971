"""License scans: a trained paragraph classifier with template confirmation.

A paragraph is the run of lines up to one without words.  Its lines are read in
overlapping segments, and so is the run where it crosses line ends, as notices
are mostly wrapped.  Word 1- to 3-grams, hashed, are the features of a multinomial logistic regression over
licence families and one class for everything else.  It is trained here on
variants of the templates below (words left out, put in, cut off at either end)
against paragraphs of a bounded sample of the corpus, and its probabilities are
calibrated by a temperature fitted on a part that training didn't see.  A
family is reported where its probability reaches ``ACCEPT``; what the
classifier gives to no family stays in the unknown class.  A report is
*confirmed* if the segment holds, in order, enough of the words of a template
of that family, its name among them where the template has it.  As notices that share a segment share its probability, a
segment where some family is ``FLOOR`` likely against the unknown class alone is
held against the templates of all families; each is reported that is confirmed
by words that name it and that no nearer family holds.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.words import cut, hash_words, mix

# ---- fixed values: wording of public licence notices ------------------------
TEMPLATES = {
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.",
             "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "apache": ("Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License."),
    "bsd": ("Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    "cc0": ("Dedicated to the public domain under CC0 1.0.",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "Licensed under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    "isc": ("Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.",),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    "mpl": ("Licensed under the Mozilla Public License, version 2.0.",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: how notices name a family; the other two are known by their wording only
NAMES = {
    "agpl": ("gnu affero general public license",),
    "apache": ("apache",),
    "bsd": ("bsd",),
    "cc0": ("cc0",),
    "cc-by": ("cc by", "creative commons attribution"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike"),
    "gpl": ("gnu general public license",),
    "isc": ("isc",),
    "lgpl": ("gnu lesser general public license",),
    "mit": ("mit",),
    "mpl": ("mozilla public license",),
    "proprietary": (),
    "unlicense": (),
}
#: words that make another name of the one before them
GOES_ON = ("nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike")
FAMILIES = [*sorted(TEMPLATES), "unknown"]
UNKNOWN = len(FAMILIES) - 1

BITS, GRAMS = 16, 3
SEGMENT, STEP = 24, 8
#: sampled documents and lines of the corpus, and variants of each template
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LINES, VARIANTS = 300, 20_000, 2000, 25
ACCEPT = 0.5
#: probability against the unknown class alone from which templates are tried
FLOOR = 0.1
#: share of a template's words that must stand in the segment in order
CONFIRM = 0.7
#: what a template that names no licence lacks counts so many times: other
#: licences have much of its wording, so nine of ten words must stand there
UNNAMED = 3
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Model(NamedTuple):
    weights: np.ndarray      # (slots, families)
    bias: np.ndarray
    used: np.ndarray         # slots with weights
    temperature: float


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _features(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the different 1- to GRAMS-grams of segments laid end to end, and
    the segment of each, by segment.  A word said many times counts once, so
    what stands beside a notice can't outweigh it by repetition."""
    owner = np.repeat(np.arange(len(counts)), counts)
    slots, owners = [], []
    h = np.zeros(len(words), np.uint64)
    for n in range(GRAMS):
        size = len(words) - n
        if size <= 0:
            break
        h = (h[:size] + words[n:]) * np.uint64(0xD6E8FEB86659FD93)
        inside = owner[:size] == owner[n:]
        slots.append((mix(h[inside] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[:size][inside])
    if not slots:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.sort((np.concatenate(owners) << BITS) | np.concatenate(slots))
    both = both[np.flatnonzero(np.diff(both, prepend=-1))]
    return both & ((1 << BITS) - 1), both >> BITS


def _scores(model: Model, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probabilities (segments, families)."""
    slots, owner = _features(words, counts)
    known = model.used[slots]
    slots, owner = slots[known], owner[known]
    out = np.zeros((len(counts), len(FAMILIES)))
    if len(slots):
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[at]] = np.add.reduceat(model.weights[slots], at, axis=0)
    out *= _scale(counts)[:, None]
    return _softmax((out + model.bias) / model.temperature)


def _scale(counts: np.ndarray) -> np.ndarray:
    """What the evidence of a segment is multiplied by: words beyond the first
    few don't weaken what stands beside them."""
    return 1 / np.sqrt(np.clip(counts, 1, 8))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(r: np.random.Generator, common: list[str]) -> list[tuple[list[str], int]]:
    out = []
    for f, name in enumerate(FAMILIES[:-1]):
        for template in TEMPLATES[name]:
            words = words_of(template)
            out.append((words, f))
            for _ in range(VARIANTS):
                kept = [w for w in words if r.random() > 0.05] or words
                if len(kept) > 8 and r.random() < 0.5:
                    a = int(r.integers(0, len(kept) // 3))
                    kept = kept[a:len(kept) - int(r.integers(0, len(kept) // 3))]
                if common:
                    pick = lambda k: [common[i] for i in r.integers(0, len(common), k)]
                    kept = pick(int(r.integers(0, 9))) + kept + pick(int(r.integers(0, 9)))
                out.append((kept, f))
    return out


def paragraphs_of(text: str) -> list[str]:
    """The runs of lines with words."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if words_of(line):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(x) for x in out if x]


def _free_of(templates: list[tuple[int, list[str]]], words: list[str]) -> np.ndarray:
    """Whether each word lies outside of all that holds most of a template."""
    named = {w for _, t in templates for w in t}
    free = np.ones(len(words), bool)
    for a in range(0, max(1, len(words) - SEGMENT - STEP), STEP):
        near = words[a:a + SEGMENT + 2 * STEP]
        if len(named.intersection(near)) > 2 and any(_held(t, near) >= CONFIRM for _, t in templates):
            free[a:a + SEGMENT + 2 * STEP] = False
    return free


def fit(lines: list[str], seed: int = 0) -> Model:
    """A model from corpus lines or paragraphs (the unknown class; segments of
    them beside what holds most of a template are left out) and variants of the
    templates."""
    r = np.random.default_rng(seed)
    templates = [(f, words_of(t)) for f, name in enumerate(FAMILIES[:-1]) for t in TEMPLATES[name]]
    samples: list[tuple[list[str], int]] = []
    common: list[str] = []
    for line in lines:
        words = words_of(line)
        free = _free_of(templates, words)
        for k in range(0, max(1, len(words) - STEP), SEGMENT) if words else ():
            if free[k:k + SEGMENT].all():
                samples.append((words[k:k + SEGMENT], UNKNOWN))
                common += words[k:k + SEGMENT][:20] if k == 0 else []
    flat = [w for _, t in templates for w in t]
    for _ in range(300):  # licence words without their order say nothing
        samples.append(([flat[i] for i in r.integers(0, len(flat), int(r.integers(1, 12)))], UNKNOWN))
    samples += _variants(r, common)
    order = r.permutation(len(samples))
    samples = [samples[i] for i in order]
    y = np.array([f for _, f in samples])
    counts = np.array([len(w) for w, _ in samples])
    words = hash_words(" ".join(w for s, _ in samples for w in s).encode())[0]
    slots, owner = _features(words, counts)
    held = np.arange(len(samples)) % 4 == 0
    k = len(FAMILIES)
    used, compact = np.unique(slots, return_inverse=True)
    w, b = np.zeros((len(used), k)), np.zeros(k)
    m, s = np.zeros_like(w), np.zeros_like(w)
    scale = _scale(counts)
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    target = np.eye(k)[y]
    balance = np.where(held, 0, 1.0)
    by_slot = np.argsort(compact, kind="stable")
    slot_at = np.flatnonzero(np.diff(compact[by_slot], prepend=-1))
    for step in range(1, 61):
        z = np.add.reduceat(w[compact], at, axis=0) * scale[:, None] + b
        d = (_softmax(z) - target) * (balance / balance.sum())[:, None]
        g = np.add.reduceat((d * scale[:, None])[owner[by_slot]], slot_at, axis=0) + 1e-6 * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
        b -= 2.0 * d.sum(axis=0)
    z = np.add.reduceat(w[compact], at, axis=0) * scale[:, None] + b
    # temperature: the least negative log-likelihood of the held-out part
    grid = np.exp(np.linspace(-2, 2, 41))
    loss = [-np.log(_softmax(z[held] / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in grid]
    table = np.zeros((1 << BITS, k), np.float32)
    table[used] = w
    seen = np.zeros(1 << BITS, bool)
    seen[used] = True
    return Model(table, b, seen, float(grid[int(np.argmin(loss))]))


def _held(template: list[str], words: list[str]) -> float:
    """Share of a template's words that stand in ``words`` in the same order."""
    blocks = SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


_TEMPLATES = {f: [words_of(t) for t in texts] for f, texts in TEMPLATES.items()}
#: words that the templates of so many families hold name none of them
COMMON = 5
_NAMING = {w for w, n in Counter(w for ts in _TEMPLATES.values() for w in {w for t in ts for w in t}).items() if n < COMMON}


_NAME_RUNS = {f: [x.split() for x in names] for f, names in NAMES.items()}


def _starts(run: list[str], words: list[str]) -> list[int]:
    return [k for k, w in enumerate(words) if w == run[0] and words[k:k + len(run)] == run]


def _counted(family: str, template: list[str], words: list[str], share: float, at: list[int]) -> float:
    """The share that counts.  Where the template names the family, none
    unless the words that hold it name it as well, in one run that doesn't go
    on as another name."""
    runs = [x for x in _NAME_RUNS[family] if _starts(x, template)]
    if not runs:
        return max(0.0, 1 - UNNAMED * (1 - share))
    held = set(at)
    named = any(held.issuperset(range(k, k + len(x))) and (words[k + len(x):k + len(x) + 1] or [""])[0] not in GOES_ON
                for x in runs for k in _starts(x, words))
    return share if named else 0.0


def _match(template: list[str], words: list[str]) -> tuple[float, list[int]]:
    """The same share, and the words of the notice: the longest run and what
    stands about as near to it as in the template."""
    blocks = [b for b in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, [0]
    i = j = max(range(len(blocks)), key=lambda x: blocks[x].size)

    def near(x, y) -> bool:
        return (y.b - x.b - x.size) - (y.a - x.a - x.size) <= STEP
    while i > 0 and near(blocks[i - 1], blocks[i]):
        i -= 1
    while j + 1 < len(blocks) and near(blocks[j], blocks[j + 1]):
        j += 1
    return sum(b.size for b in blocks) / len(template), [k for b in blocks[i:j + 1] for k in range(b.b, b.b + b.size)]


def confirm(family: str, words: list[str], named: bool = False) -> tuple[float, list[int]]:
    """The best share over the templates of a family, and the words that hold
    it; if ``named``, only of templates of whose naming words half are there.
    A template that names the family holds nothing without that name."""
    best: tuple[float, list[int]] = (0.0, [0])
    for t in _TEMPLATES[family]:
        naming = _NAMING.intersection(t)
        if named and 2 * len(naming.intersection(words)) < max(len(naming), 1):
            continue
        share, at = _match(t, words)
        if named and 2 * len(naming.intersection(words[k] for k in at)) < max(len(naming), 1):
            continue
        share = _counted(family, t, words, share, at)
        best = max(best, (share, at), key=lambda x: (x[0] >= CONFIRM, x[0], len(x[1])))
    return best


class Found(NamedTuple):
    family: str
    first: int               # word of the text
    last: int
    probability: float
    share: float
    size: int                # words that hold it
    naming: list[int]        # those that name the family
    words: list[str]         # of the segment and what is around it
    lo: int                  # where they start
    accepted: bool


def _found(family: str, probability: float, words: list[str], lo: int, accepted: bool) -> Found:
    share, at = confirm(family, words, not accepted)
    return Found(family, lo + at[0], lo + at[-1], probability, share, len(at),
                 [lo + k for k in at if words[k] in _NAMING], words, lo, accepted)


def _rank(found: Found) -> tuple:
    return -found.share, -found.size, not found.accepted, found.first


def _segments(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping segments of word ranges: range, first word and size of each."""
    k = np.maximum(1, -(-(last - first - SEGMENT) // STEP) + 1)
    owner = np.repeat(np.arange(len(first)), k)
    a = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)) * STEP
    return owner, a, np.minimum(SEGMENT, last[owner] - a)


def _scan(model: Model, text: bytes, words: tuple, a: np.ndarray, size: np.ndarray, lo: np.ndarray,
          hi: np.ndarray) -> Iterator[tuple[int, Found]]:
    """(segment, what is found there) of segments; lo to hi are the words around
    each, as the notice may go on there."""
    hashes, starts, lengths = words
    for c in range(0, len(a), 20_000):
        part = slice(c, c + 20_000)
        at = np.repeat(a[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(int(size[part].sum()))
        p = _scores(model, hashes[at], size[part])
        best = p.argmax(axis=1)
        sure = (best != UNKNOWN) & (p.max(axis=1) >= ACCEPT)
        tried = (p[:, :UNKNOWN] >= FLOOR * (p[:, :UNKNOWN] + p[:, [UNKNOWN]])).any(axis=1)
        for i in np.flatnonzero(sure | tried):
            j = c + int(i)
            near = words_of(text[starts[lo[j]]:starts[hi[j] - 1] + lengths[hi[j] - 1]].decode("utf-8", "replace"))
            if sure[i]:
                yield j, _found(FAMILIES[best[i]], float(p[i, best[i]]), near, int(lo[j]), True)
            for f in range(UNKNOWN):
                if not (sure[i] and f == best[i]):
                    found = _found(FAMILIES[f], float(p[i, f]), near, int(lo[j]), False)
                    if found.share >= CONFIRM:
                        yield j, found


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash_words`` of a text of any length, by pieces of bounded size."""
    parts, at = [], 0
    for piece in cut(text):
        hashes, starts, lengths = hash_words(piece)
        parts.append((hashes, starts + at, lengths))
        at += len(piece)
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def scan_text(model: Model, text: bytes) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, share of a template) of a text's segments that
    the classifier gives to a family, and of further families that templates
    confirm there: the likeliest of each family in a line.
    A notice that goes on over line ends stands at the line where it starts."""
    words = _words(text)
    hashes, starts, _ = words
    if not len(hashes):
        return []
    ends = np.concatenate((np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A), [len(text)]))
    last = np.searchsorted(starts, ends)
    first = np.concatenate(([0], last[:-1]))
    some = np.flatnonzero(last - first)
    line = np.repeat(some, (last - first)[some])  # of each word
    out: dict[tuple[int, str], tuple[float, float]] = {}

    def add(at: int, found: Found) -> None:
        key, value = (at, found.family), (found.probability, found.share)
        out[key] = max(out.get(key, (0.0, 0.0)), value, key=lambda x: (x[1] >= CONFIRM, x[0]))

    owner, a, size = _segments(first[some], last[some])
    lo, hi = np.maximum(first[some][owner], a - STEP), np.minimum(last[some][owner], a + size + STEP)
    run = [(int(some[owner[j]]), x) for j, x in _scan(model, text, words, a, size, lo, hi)]
    # the same over line ends, for what no line holds by itself
    new = np.flatnonzero(np.diff(some, prepend=-2) != 1)
    start, stop = first[some][new], last[some][np.append(new[1:], len(some)) - 1]
    owner, a, size = _segments(start, stop)
    lo, hi = np.maximum(start[owner], a - STEP), np.minimum(stop[owner], a + size + STEP)
    over = line[lo] != line[hi - 1]
    a, size, lo, hi = a[over], size[over], lo[over], hi[over]
    across = list(_scan(model, text, words, a, size, lo, hi))

    # the nearest first; what shares its naming words with a nearer one is read again without them
    held: dict[str, set[int]] = {}
    taken: set[int] = set()
    queue = [(*_rank(x), n, x) for n, (_, x) in enumerate([*run, *across]) if x.share >= CONFIRM]
    heapq.heapify(queue)
    while queue:
        *_, n, found = heapq.heappop(queue)
        if not taken.isdisjoint(found.naming):
            if (int(line[found.first]), found.family) in out and found.first in held.get(found.family, ()):
                add(int(line[found.first]), found)
            left = ["" if found.lo + k in taken else w for k, w in enumerate(found.words)]
            found = _found(found.family, found.probability, left, found.lo, False)
            if found.share >= CONFIRM:
                heapq.heappush(queue, (*_rank(found), n, found))
            continue
        add(int(line[found.first]), found)
        held.setdefault(found.family, set()).update(range(found.first, found.last + 1))
        taken.update(found.naming)
    for at, found in run:
        if found.share < CONFIRM:
            add(at, found)
    for j, found in across:
        lines = range(int(line[lo[j]]), int(line[hi[j] - 1]) + 1)
        if found.share < CONFIRM and not any((x, found.family) in out for x in lines):
            add(int(line[a[j]]), found)
    return sorted((k[0], k[1], *v) for k, v in out.items())


def train(docs: DataFrame, seed: int = 0) -> Model:
    """A model with the unknown class from a bounded sample of the corpus."""
    some = docs.where(F.char_length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = some.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    parts = [x for r in rows for x in paragraphs_of(r["text"])]
    order = np.random.default_rng(seed).permutation(len(parts))
    lines = np.cumsum([parts[i].count("\n") + 1 for i in order])
    return fit([parts[i] for i in sorted(order[:np.searchsorted(lines, SAMPLE_LINES) + 1])], seed)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id and found, an array of (line, family,
    probability, template_share, confirmed).

    Null and empty texts have nothing found; repeated rows are scanned as often
    as they occur; a very long text is cut into words by pieces of bounded size
    and then holds its words' hashes and places (24 bytes a word); an empty
    table, which has nothing to learn the unknown class from but the templates'
    own words, gives an empty result; of equally near families that share their
    naming words the one that stands first is reported; other columns, also of
    clashing names, are ignored."""
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
                      ("template_share", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for at in range(0, batch.num_rows, 256):  # a few texts at a time in memory
                part = batch.column("text").slice(at, 256).cast(pa.binary()).to_pylist()
                found += [[{"line": a, "family": f, "probability": p, "template_share": s, "confirmed": s >= CONFIRM}
                           for a, f, p, s in scan_text(shared.value, x or b"")] for x in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(item))],
                                             names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, found array<struct<line: int, family: string, probability: double, "
             "template_share: double, confirmed: boolean>>")
