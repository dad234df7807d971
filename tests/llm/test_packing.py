import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tollgate.llm import packing
from tollgate.llm.tokens import encoder

TEXTS = [(1, "Hello, world! it's 3.14"), (2, None), (3, ""), (3, ""), (None, "null id"), (4, "word " * 5000), (5, "x" * 30_000),
         (6, "É é, “quoted”… end.é! wörd÷. Σας ΟΔΟΣ."), (7, "a " * 2047), (8, "a " * 2048), (9, "<|endoftext|>. don't!!")]


def check(rows, docs, length=2048):
    """The pieces are those of a plain encoding, and the sequences have neither gaps nor overlaps."""
    enc = encoder()
    expected = Counter()
    for i, t in docs:
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), length)):
            cut = ids[a:a + length]
            expected[(i, k, a, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


@pytest.mark.parametrize("clash", [False, True])
def test_edges(make_docs, clash):
    rows = packing.pack(make_docs(TEXTS, clash)).collect()
    n = check(rows, TEXTS)
    assert n == -(-sum(r.length for r in rows) // 2048)


def test_empty(make_docs):
    assert packing.pack(make_docs([])).count() == 0


def test_ties_and_small_sequences(make_docs):
    docs = [(i, "a " * (i % 7)) for i in range(300)]
    rows = packing.pack(make_docs(docs), length=8).collect()
    n = check(rows, docs, 8)
    total = sum(r.length for r in rows)
    assert -(-total // 8) <= n <= -(-total // 8) + 1


@pytest.mark.parametrize("ranges", [(), (8, 2), (5, 3, 2)])
def test_plan_places_every_rank_once(spark, ranges):
    r = random.Random(2)
    counts = [(s, r.randint(1, 40)) for s in r.sample(range(1, 65), 50)]
    plan = packing.plan(spark.createDataFrame(counts, "length long, n long"), 64, ranges).collect()
    for s, n in counts:
        assert sorted(x for p in plan if p.length == s for x in range(p.first, p.first + p.n)) == list(range(n))
    filled: dict = {}
    for p in plan:
        for q in range(p.seq, p.seq + p.n):
            filled.setdefault(q, []).append((64 - p.gap, p.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(filled) <= 1.07 * sum(s * n for s, n in counts) / 64 + 1


def test_sweep_takes_the_smallest_gap_that_holds():
    runs = [(packing.PIECE, 5, 0, 3, -1, -1), (packing.GAP, 6, 10, 1, -1, -1), (packing.GAP, 9, 20, 1, -1, -1), (packing.GAP, 4, 30, 9, -1, -1)]
    placed = [x for x in packing.sweep(runs) if x[0] == packing.PLACED]
    assert placed == [(packing.PLACED, 5, 0, 1, 10, 6), (packing.PLACED, 5, 1, 1, 20, 9)]
    assert (packing.PIECE, 5, 2, 1, -1, -1) in packing.sweep(runs)


def test_encoder_equals_the_tokenizer_whatever_it_keeps(monkeypatch):
    from tollgate.llm import tokens
    monkeypatch.setattr(tokens, "KEPT", 5)
    enc = tokens.ChunkEncoder(__import__("public_tokenizers").path(tokens.VOCABULARY))
    r = random.Random(4)
    alphabet = ["a", "b", "the", "É", "é", "é", "ß", "'s", "'", ".", ",", "...", "…", "3", "½", " ", "  ", "\n", "\t", " ", " ",
                "ＡＢ", "ﬁ", "Σ", "İ", "K", "中", "🙂", "<|", "|>", "<|endoftext|>", "-", "`", "~"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(1500)]
    for a in range(0, len(texts), 50):
        some = texts[a:a + 50]
        for t, ids in zip(some, enc.encode([x.encode() for x in some]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
