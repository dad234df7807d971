"""Phrase counts and scores against a plain count, and the trie's bursts and spills."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import collocations as C


def pieces_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def by_hand(rows, least=10, share=50, top=2000):
    """rows of (lang, text) -> (lang, rank, phrase, a, l, r, n, score)."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for w in pieces_of(text):
            for k in (1, 2, 3):
                f[lang or "und"].update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if " " not in p)
        cand = {p: a for p, a in c.items() if " " in p and a >= least}
        scored = []
        for p, a in cand.items():
            inside = [b for q, b in cand.items() if len(q.split(" ")) > len(p.split(" ")) and f" {p} " in f" {q} "]
            if any(100 * b >= share * a for b in inside):
                continue
            w = p.split(" ")
            score, _, left, right = min((1000000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k,
                                         c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w)))
            scored.append((-score, -a, p.encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def random_rows(rng, n):
    words = ["the", "The", "of", "new", "york", "times", "é", "x-y", "(a)", "Überall", "\x01", "it's", "w1", "w2", "w3"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", ";"]
    return [(rng.choice(["en", "en", "de", None, "und"]),
             "".join(w + e for w, e in zip(rng.choices(words, range(len(words), 0, -1), k=80), rng.choices(ends, k=80), strict=True)))
            for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Containers burst, subtrees leave and dictionaries start anew all the time."""
    for name, value in (("BURST", 8), ("MOST", 60), ("WORDS", 12), ("FLUSH", 50)):
        monkeypatch.setattr(C, name, value)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_whole_result_equals_a_plain_count(spark):
    rows = random_rows(random.Random(1), 60)
    assert rows_of(C.collocations(frame(spark, rows).repartition(3))) == by_hand(rows)
    assert rows_of(C.collocations(frame(spark, rows), least=3, share=20, top=7)) == by_hand(rows, 3, 20, 7)


def test_runs_of_a_small_trie_add_up(spark, small):
    """In this process: bursts, spills and new dictionaries change no count."""
    rng = random.Random(2)
    rows = random_rows(rng, 40)
    want = Counter()
    for lang, text in rows:
        for w in pieces_of(text):
            for k in (1, 2):
                want.update(" ".join(w[i:i + k]) + "\t" + (lang or "und") for i in range(len(w) - k + 1))
    counter, got, runs = C.Counter(None), Counter(), 0
    for lang, text in rows:
        for run in counter.add((lang or "und").encode(), text.encode()):
            got.update(dict(zip(run["key"].to_pylist(), run["n"].to_pylist(), strict=True)))
            runs += 1
    for run in counter.rest():
        got.update(dict(zip(run["key"].to_pylist(), run["n"].to_pylist(), strict=True)))
    assert got == want and runs > 20


def test_trie_holds_all_entries_and_bursts(small):
    rng = np.random.default_rng(0)
    trie, want, size = C.Node(2 * C.ID_BITS), Counter(), 0
    for _ in range(60):
        a = rng.zipf(1.6, (50, 3)) % 9 + 1
        codes, counts = np.unique(a[:, 0] << 2 * C.ID_BITS | a[:, 1] << C.ID_BITS | a[:, 2], return_counts=True)
        size += trie.add(codes, counts)
        want.update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    entries = [(c, n) for codes, counts in trie.entries() for c, n in zip(codes.tolist(), counts.tolist(), strict=True)]
    assert entries == sorted(want.items()) and size == len(want) == len(trie)
    depth = lambda x: 1 + max(map(depth, x.held)) if isinstance(x, C.Node) else 0
    assert depth(trie) == 3

    def containers(x):
        return [h for y in x.held for h in (containers(y) if isinstance(y, C.Node) else [y])]
    assert max(map(len, containers(trie))) <= C.BURST or not trie.shift
    taken = sum(len(codes) for codes, _ in trie.take(size // 2))
    assert len(trie) <= size // 2 and taken + len(trie) == size


def test_pair_table_has_no_false_negatives(spark):
    pairs = spark.createDataFrame([("en", [f"a{i}", f"b{i % 7}"]) for i in range(3000)], "lang string, words array<string>")
    table = C._pair_table(pairs, 1 << 16)
    assert table.size == 1 << 16
    first = np.array([C.word_hash(b"en", b"a%d" % i) for i in range(3000)], np.uint64)
    second = np.array([C.word_hash(b"en", b"b%d" % (i % 7)) for i in range(3000)], np.uint64)
    assert table.may_hold(C.pair_hashes(first, second)).all()
    assert table.may_hold(C.pair_hashes(second, first)).mean() < 0.2
    assert not C._pair_table(pairs.limit(0)).bits.any()


def test_long_text_keeps_phrases_over_the_borders_of_its_pieces(spark):
    rows = [("en", "new york times " * 150_000), ("en", "no blanks" + "x" * 2_500_000)]
    got = rows_of(C.collocations(frame(spark, rows)))
    assert got == by_hand(rows)


def test_nulls_repeats_ties_and_clashing_columns(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " . "), (4, "a b c d " * 12), (4, "a b c d " * 12), (None, "A b, x y " * 11)]
    docs = make_docs(rows, clash=True).withColumn("n", F.lit("x")).withColumn("phrase", F.lit("y"))
    assert rows_of(C.collocations(docs)) == by_hand([("en", t) for _, t in rows])
    assert rows_of(C.collocations(make_docs(rows).limit(0))) == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10 ** 14 + 7, 10 ** 14 + 9, 10 ** 14 + 11
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(C.score_of("a", "l", "r")).first()[0] == 1000000 * a * a // (left * right)
