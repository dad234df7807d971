import random

import numpy as np
import pytest

from tollgate.llm import token_counts as C
from tollgate.llm.tokens import encoder

DOCS = [(1, "one two three"), (2, None), (3, ""), (4, "Word, " * 3000), (5, "same"), (5, "same"), (5, "other"), (None, "null id")]
EDITS = [(1, 1, 3, 3, "s"), (1, 2, 0, 4, ""), (2, 1, 0, 0, "new text"), (3, 1, 9, 99, "beyond"), (4, 1, 6000, 6003, "x"), (4, 2, None, None, None),
         (5, 1, 0, 4, "é"), (77, 1, 0, 0, "unknown"), (None, 1, 0, 0, "no id")]


def n_ids(text):
    return len(encoder().tokenizer.encode(text, add_special_tokens=False).ids)


def brute(text, todo):
    for start, end, new in todo:
        a = min(start or 0, len(text))
        b = min(max(a, end if end is not None else a), len(text))
        text = text[:a] + (new or "") + text[b:]
    return text


@pytest.mark.parametrize("clash", [False, True])
def test_tables(spark, make_docs, clash):
    docs = make_docs(DOCS, clash)
    edits = spark.createDataFrame(EDITS, "doc_id long, seq long, start long, end long, new string")
    out = C.apply_edits(docs, C.build(docs), edits).collect()
    expected = []
    for i, t in DOCS:
        text = brute(t or "", [e[2:] for e in sorted((e for e in EDITS if e[0] == i and i is not None), key=lambda e: e[1])])
        expected.append((str(i), n_ids(t or ""), n_ids(text), len(text), text))
    assert sorted((str(r.doc_id), r.old_tokens, r.n_tokens, r.n_chars, r.text) for r in out) == sorted(expected)
    far = next(r for r in out if r.doc_id == 4)
    assert 0 < far.encoded_chars < 3000 and sum(far.leaf_tokens) == far.n_tokens and sum(far.leaf_chars) == far.n_chars


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, seq long, start long, end long, new string")
    assert C.apply_edits(make_docs([]), C.build(make_docs([])), none).count() == 0
    docs = make_docs(DOCS)
    assert {r.n_edits for r in C.apply_edits(docs, C.build(docs), none).collect()} == {0}


def test_random_edits_keep_the_sums_right():
    r = random.Random(9)
    enc = encoder()
    for _ in range(60):
        text = " ".join(r.choice(["a", "bc", "dé,", "it's", "\n", "", "longer-word"]) for _ in range(r.choice([0, 1, 70, 900])))
        tree = C.CountTree(*C.leaves_of(enc, text))
        for _ in range(6):
            a = r.randint(0, len(text) + 3)
            b = a + r.choice([0, 1, 9, 500])
            new = r.choice(["", "x", " ", "two words", "é", "many " * r.choice([3, 700])])
            expected = brute(text, [(a, b, new)])
            tree, text, _ = C.edit(enc, tree, text, a, b, new)
            assert text == expected and tree.chars[1] == len(text) and tree.tokens[1] == n_ids(text)
            assert tree.tokens[1] == tree.leaves()[1].sum()


def test_many_edits_are_encoded_at_once():
    """Edits that meet, overlap and undo each other before anything is encoded."""
    r = random.Random(10)
    enc = encoder()
    for _ in range(60):
        text = " ".join(r.choice(["a", "bc", "dé,", "it's", "\n", "", "longer-word"]) for _ in range(r.choice([0, 1, 70, 900])))
        e, todo = C.Edited(C.CountTree(*C.leaves_of(enc, text)), text), []
        near = r.randint(0, len(text))
        for _ in range(8):
            a = r.choice([near + r.randint(-20, 20), r.randint(0, len(text) + 3)])
            todo.append((max(a, 0), max(a, 0) + r.choice([0, 1, 9, 500]), r.choice(["", "x", " ", "two words", "é", "many " * 700])))
            e.edit(*todo[-1])
        regions = e.regions()
        tree = e.close(regions, C.encode_regions(enc, [x for *_, x in regions]))
        assert e.text == brute(text, todo) and tree.chars[1] == len(e.text) and tree.tokens[1] == n_ids(e.text)
        chars, tokens = tree.leaves()
        at = np.concatenate(([0], np.cumsum(chars)))
        assert sum(n_ids(e.text[i:j]) for i, j in zip(at[:-1], at[1:])) == tokens.sum()


def test_tree_descent():
    tree = C.CountTree(np.array([3, 0, 4, 5, 1]), np.array([1, 0, 2, 3, 4]))
    assert [tree.find(k) for k in (0, 2, 3, 6, 7, 11, 12, 99)] == [(0, 0), (0, 0), (2, 3), (2, 3), (3, 7), (3, 7), (4, 12), (4, 12)]
    tree.put(2, 1, 7)
    assert tree.chars[1] == 10 and tree.tokens[1] == 15 and tree.find(4) == (3, 4)
