import zlib

import numpy as np
import pytest

from tollgate.llm import toxicity as X

BAD = ["wretchoid", "wretchance", "grimpf"]


def corpus(n=240, seed=1):
    r = np.random.default_rng(seed)
    common = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [common[k] for k in r.integers(0, 300, int(r.integers(8, 120)))]
        y = i % 4 == 0
        if y:
            for _ in range(2):
                words[int(r.integers(0, len(words)))] = BAD[int(r.integers(0, 3))]
        rows.append((i, " ".join(words), int(y)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus()
    return X.fit([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]), 0.25)


def test_gradients():
    r = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in X.new_net().items()}
    x, mask = r.standard_normal((X.WINDOW, 3, X._INPUTS)), np.ones((X.WINDOW, 3))
    mask[5:, 1] = 0
    x[5:, 1] = 0
    _, kept = X.forward(net, x, mask, keep=True)
    grads, d_x = X.backward(net, kept, np.ones(3))

    def slope(array, at, by=1e-3):
        old = array[at]
        array[at] = old + by
        up = np.float64(sum(X.forward(net, x, mask).astype(np.float64)))
        array[at] = old - by
        down = np.float64(sum(X.forward(net, x, mask).astype(np.float64)))
        array[at] = old
        return (up - down) / (2 * by)
    for name, w in net.items():
        for _ in range(4):
            at = tuple(int(r.integers(0, n)) for n in w.shape)
            assert abs(slope(w, at) - grads[name][at]) < 2e-3, name
    assert abs(slope(x, (3, 0, 1)) - d_x[3, 0, 1]) < 2e-3


def test_held_out_accuracy_also_on_unseen_forms(model):
    rows = corpus(120, seed=7)
    scores = X.score_texts(model, [t.encode() for _, t, _ in rows])
    y = np.array([y for _, _, y in rows])
    assert ((scores >= X.REJECT_AT) == (y == 1)).mean() > 0.97
    unseen = X.score_texts(model, [b"w1 w2 wretchful w3 w4 w5 w6 w7 w8 w9", b"w1 w2 w10 w3 w4 w5 w6 w7 w8 w9"])
    assert unseen[0] > unseen[1]  # by its characters


def test_windows_cover_every_word(model):
    for n in (0, 1, 23, 24, 25, 36, 37, 500):
        starts = X.window_starts(n)
        covered = set().union(*(range(s, s + X.WINDOW) for s in starts))
        assert set(range(n)) <= covered
        assert all(b - a <= X.STRIDE for a, b in zip(starts, starts[1:], strict=False))
    clean = " ".join(f"w{i % 300}" for i in range(400)).split()
    low = X.score_texts(model, [" ".join(clean).encode()])[0]
    for at in (0, 57, 199, 399):
        words = list(clean)
        words[at] = "wretchoid"
        assert X.score_texts(model, [" ".join(words).encode()])[0] > max(low, 0.3)


def test_scores_do_not_depend_on_the_batch(model, monkeypatch):
    texts = [t.encode() for _, t, _ in corpus(40, seed=3)] + [b"", b"...", "é".encode(), b"w1 " * 3000]
    whole = X.score_texts(model, texts)
    alone = np.array([X.score_texts(model, [t])[0] for t in texts])
    monkeypatch.setattr(X, "PIECE", 300)
    cut = X.score_texts(model, texts)
    assert np.allclose(whole, alone, atol=1e-4) and np.allclose(whole, cut, atol=1e-4)


def test_one_label_or_none():
    for labels, prior in (([0, 0], 0.0), ([1, 1], 1.0), ([], 0.25)):
        m = X.fit([b"a", b"b"][:len(labels)], np.array(labels), prior)
        assert abs(X.score_texts(m, [b"a", b""]) - prior).max() < 1e-3


def test_tables(spark, make_docs):
    rows = corpus()
    docs = make_docs([(i, t) for i, t, _ in rows] + [(None, None), (9001, ""), (9002, "grimpf " * 40_000), (5, "w1"), (5, "w1")], clash=True)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (77777, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = X.train(docs, labels)
    out = X.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert next(r.score for r in out if r.doc_id == 9002) > 0.3
    held = {r.doc_id: r.h for r in docs.select("doc_id", X.held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    kept = X.keep_harmless(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, _, y in rows if not y and i % 8 == 1} - {5}
    none = spark.createDataFrame([], labels.schema)
    assert X.keep_harmless(docs, none).count() == docs.count()
    assert X.score(make_docs([]), model).count() == 0


def test_held_out_labels_teach_nothing(spark, make_docs):
    rows = corpus()
    docs = make_docs([(i, t) for i, t, _ in rows])
    schema = "doc_id long, quality int, toxic int"
    flip = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    a = X.train(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], schema))
    b = X.train(docs, spark.createDataFrame(flip, schema))
    assert all((a.net[k] == b.net[k]).all() for k in a.net) and a.scale == b.scale


def test_query_on_held_out_rows(spark):
    import duckdb

    from tollgate.llm.queries import QUERIES
    y = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in y]
    hit = sum(r.predicted == 1 and y[r.doc_id] == 1 for r in got)
    toxic = sum(y[r.doc_id] for r in got)
    false = sum(r.predicted == 1 and y[r.doc_id] == 0 for r in got)
    # measured: 110 of 120 found here, where toxic words are rare forms; 268 of 269 on five times the rows
    assert hit >= 0.9 * toxic and false <= 0.04 * (len(got) - toxic)
