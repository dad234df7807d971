"""The pipeline against a brute-force version on a small table."""

import numpy as np

import corpus_pipeline
from tollgate.llm import toxicity
from tollgate.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(w):
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, model, items, words_of):
    scores = toxicity.score_texts(model, [(t or "").encode() for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.REJECT_AT]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for i, t in rows:
        last[low(t)] = max(i, last.get(low(t), i))
    rows = [(i, t) for i, t in rows if last[low(t)] == i]
    sets = [shingles(words_of(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    windows = set()
    for text in items:
        w = words_of(text)
        k = min(13, len(w))
        windows |= {tuple(w[s:s + k]) for s in range(len(w) - k + 1)} if w else set()
    clean = []
    for i, t in rows:
        w, hit = words_of(t), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit |= set(range(s, s + k))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((i, t))
    return clean


def test_run(spark, words_of):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    expected = brute(rows, model, items, words_of)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {i for i, _ in expected} and 0 < len(expected) < len(rows)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048


def test_stages_keep_the_columns_and_take_empty_tables(spark, make_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
