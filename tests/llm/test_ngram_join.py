import random
from collections import Counter

import pytest

from tollgate.llm import ngram_join as N
from tollgate.llm.words import ngram_hashes, word_hashes


def brute(docs, words_of):
    sets = []
    for _, t in docs:
        w = words_of(t)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(docs)
    parent, links = list(range(n)), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(n):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted((str(d), str(least[find(i)]), links[i]) for i, (d, _) in enumerate(docs)), len(ids)


def corpus():
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    docs = []
    for g in range(6):
        base = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(r.choice([2, 3, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(" ".join(w))
    docs += [" ".join(r.choice(vocabulary) for _ in range(50)) for _ in range(10)]
    docs = [(i, t) for i, t in enumerate(docs)]
    return docs + [(900, None), (901, ""), (902, "one two"), (903, "ONE, two!"), (904, "one"), (None, docs[0][1]), (905, docs[3][1]),
                   (905, docs[3][1]), (906, "É é"), (907, "é é"), (908, "long " * 40_000), (909, "long " * 39_000)]


@pytest.mark.parametrize("block_rows", [1024, 4])
def test_against_brute_force(make_docs, words_of, block_rows):
    docs = corpus()
    expected, classes = brute(docs, words_of)
    out = N.similarity_groups(make_docs(docs, clash=True), block_rows=block_rows).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in out) == expected
    assert sum(r.first for r in out) == classes


def test_empty_and_stage(make_docs, words_of):
    assert N.similarity_groups(make_docs([])).count() == 0
    docs = corpus()
    kept = N.keep_first(make_docs(docs, clash=True))
    assert kept.columns == make_docs(docs, clash=True).columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    left, classes = brute(rows, words_of)
    assert len(rows) == brute(docs, words_of)[1] == classes and all(n == 0 for _, _, n in left)


def test_banding_reaches_the_recall():
    bands, rows = N.choose_bands()
    assert bands * rows <= N.MAX_HASHES and 1 - (1 - 0.8 ** rows) ** bands >= N.RECALL
    with pytest.raises(ValueError):
        N.choose_bands(0.01, 0.999, 8)


def test_pieces_of_a_long_text_hash_like_the_whole(monkeypatch):
    from tollgate.llm import words as M
    text = ("Wört, x " * 5000).encode()
    whole = word_hashes([b"a b", text, b""])
    monkeypatch.setattr(M, "PIECE", 100)
    parts = word_hashes([b"a b", text, b""])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and list(whole[1]) == [2, 10_000, 0]
    grams, counts = ngram_hashes(*whole, 5)
    assert list(counts) == [1, 9996, 0] and len(set(grams.tolist())) == 3
