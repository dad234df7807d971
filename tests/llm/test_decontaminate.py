import hashlib

import pytest

from tollgate.llm import decontaminate as D

ITEM = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, ITEM), (2, "kurz und gut"), (3, None), (4, ""), (5, "..."), (None, "null id item"), (1, ITEM), (10, "Été École W3 x")]
DOCS = [(1, "pre " + ITEM.upper() + " post"), (2, " ".join(f"w{i}" for i in range(12))), (3, None), (4, ""),
        (5, "so kurz, und GUT! kurz und gut"), (6, " ".join(f"w{i}" for i in range(5, 18)) + " tail " * 400),
        (7, "w0 " + ITEM), (7, "w0 " + ITEM), (None, "null-id item"), (8, "été école w3 x"), (9, "Été École w3 X"),
        (10, ITEM + " sep " + ITEM), (11, "a " * 50_000 + ITEM + " b" * 50_000)]


def brute(docs, items, words_of):
    out = []
    for i, t in docs:
        w = words_of(t)
        hit, ids = set(), set()
        for item, text in items:
            iw = words_of(text)
            k = min(13, len(iw))
            for s in range(len(iw) - k + 1 if iw else 0):
                for p in range(len(w) - k + 1):
                    if w[p] == iw[s] and w[p:p + k] == iw[s:s + k]:
                        hit.update(range(p, p + k))
                        ids.add(item)
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(spark, make_docs, words_of, clash):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(D.decontaminate(make_docs(DOCS, clash), items)) == brute(DOCS, ITEMS, words_of)


def test_empty_tables(spark, make_docs, words_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(D.decontaminate(make_docs([]), items)) == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.decontaminate(make_docs(DOCS), none)) == brute(DOCS, [], words_of)


def test_shuffled_terms_give_the_same(spark, make_docs, words_of, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(D.decontaminate(make_docs(DOCS), items)) == brute(DOCS, ITEMS, words_of)


def test_proximity(spark, make_docs):
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = make_docs([(1, "red green blue"), (2, "blue x red y green"), (3, "red " + "x " * 40 + "green blue"), (4, "red green")])
    index = D.build_index(docs, items)
    ids = {r.row: r.doc_id for r in index.postings.where("term = -1").collect()}
    got = {ids[r.row]: r.span for r in D.proximity_matches(index, slop=5).collect()}
    assert got == {1: 3, 2: 5}


def test_stage_drops_only_contaminated_rows(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(DOCS + [(1, "clean text under a used id")], clash=True)
    out = D.keep_clean(docs, items)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in out.collect()) == sorted(
        [("1", "clean"), ("11", "a a a"), ("2", "w0 w1"), ("3", ""), ("4", ""), ("6", "w5 w6"), ("8", "été é")])
