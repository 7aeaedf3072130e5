"""The non-negative PU classifier: held-out accuracy, the risk estimator, odd rows."""

import random
import zlib

import numpy as np
import pytest

from spendlens.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    rows = queries.op4_toxicity(spark, SF).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    for lang in ("en", "de", "es", "fr"):
        toxic = [r.predicted for r in out if r.toxic == 1 and r.lang == lang]
        assert len(toxic) >= 10 and sum(toxic) >= 0.9 * len(toxic), lang
    clean = [r.predicted for r in out if r.toxic == 0]
    assert sum(clean) <= 0.006 * len(clean)


def test_scores_do_not_grow_with_length(spark):
    docs, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    model = toxicity.train_on_labels(docs, labels)
    texts = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").where("text <> ''").orderBy("doc_id")
             .select("text").collect()]
    rng = random.Random(1)
    words = " ".join(texts).split()
    assert all(model.score(" ".join(rng.choices(words, k=20_000)).encode()) < 0.7 for _ in range(5))
    for n in (10, 100, 1000):
        assert model.score("\n".join(rng.sample(texts, n)).encode()) < 0.7


def test_sparse_rows_are_the_same():
    rng = np.random.default_rng(3)
    dense = rng.random((50, 7)) * (rng.random((50, 7)) < 0.3)
    row, column = np.nonzero(dense)
    sparse = toxicity.SparseRows(dense.shape, row, column, dense[row, column])
    assert np.allclose(sparse @ np.arange(7.0), dense @ np.arange(7.0))
    assert np.allclose(np.arange(50.0) @ sparse, np.arange(50.0) @ dense)
    a, b = toxicity.fit_nnpu(dense[:20], dense, 0.3), toxicity.fit_nnpu(
        toxicity.SparseRows((20, 7), row[row < 20], column[row < 20], dense[row, column][row < 20]), sparse, 0.3)
    assert np.isclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_risk_ignores_positives_among_the_unlabelled():
    rng = np.random.default_rng(0)
    mixed = np.zeros((4000, 6))
    mixed[:1200, 0] = 1  # three in ten of the unlabelled rows are positive
    mixed[:, 1:] = rng.random((4000, 5)) < 0.5
    positive = np.column_stack([np.ones(300), rng.random((300, 5)) < 0.5])
    bias, w = toxicity.fit_nnpu(positive, mixed, 0.3)
    p = 1 / (1 + np.exp(-(mixed @ w + bias)))
    assert (p[:1200] > 0.7).mean() > 0.95 and (p[1200:] < 0.3).mean() > 0.95


def texts(n, toxic):
    rng = random.Random(n + toxic)
    own = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    return [" ".join([own() for _ in range(40)] + (["zqxjw" + own(), "Vkzzp"] if toxic else [])) for _ in range(n)]


def test_odd_rows_and_generalisation(spark):
    docs = [(i, t, 0) for i, t in enumerate(texts(150, 1) + texts(600, 0))]
    labels = [(i, 1, int(i < 150)) for i in range(750)] + [(None, 1, 1), (700, None, None), (5, 1, 1), (9999, 0, 1)]
    docs += [(1000, None, 1), (1001, "", 1), (None, "x zqxjwabc vkzzp", 1), (1002, ("aaa " * 20 + "zqxjwnew vkzzp ") * 5_000, 1),
             (1003, "zqxjwnew vkzzp", 1), (1003, "zqxjwnew vkzzp", 1), (1004, "q" * 600_000, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(4)
    model = toxicity.train_on_labels(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = toxicity.score(d, model)
    assert scored.columns == ["doc_id", "text", "score"]
    got = [(r.doc_id, r.score) for r in scored.collect()]
    assert len(got) == len(docs) and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    held = [i for i in range(750) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= 0.7) == (i < 150) for i in held]) > 0.98
    assert score[1002] >= 0.7 and score[1003] >= 0.7 and score[None] >= 0.7 and score[1000] == score[1001] < 0.7
    assert score[1004] < 0.7
    assert model.score(b"aaa " * 100_000 + b"zqxjwnew vkzzp") < 0.7  # two such words in a hundred thousand
    assert toxicity.score(d.limit(0), model).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_nothing_to_learn_from(spark, labels):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = toxicity.train_on_labels(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len({r.score for r in toxicity.score(d, model).collect()}) == 1


def test_long_texts_are_read_whole(monkeypatch):
    text = ("word" * 20 + " né ") * 200 + "tail"
    whole = np.unique(np.concatenate(list(toxicity.text_cells(text.encode()))))
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert (np.unique(np.concatenate(list(toxicity.text_cells(text.encode())))) == whole).all()
