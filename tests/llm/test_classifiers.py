import random

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import quality, toxicity
from panelforge.llm import textkit as K


def corpus(seed=1, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(3, 8)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 120))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(r.randrange(2, 6)):
                w.insert(r.randrange(len(w)), r.choice(["rotter", "knave", "zork" + word()]))
        if bad:
            w = [x + r.choice(["###", "%%"]) for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    extra = [(n, None), (n + 1, ""), (None, "knave knave"), (0, docs[0][1]), (n + 2, "long words " * 30000)]
    return docs + extra, labels + [(None, 1, 1), (1, None, None), (n + 900, 1, 1), (5, 1, 1), (6, 7, 9)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label", "3 AS x").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check(rows, labels, held):
    assert all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    right = [(next(iter(by[i])) >= 0.5) == bool(y) for i, y in labels if held(i)]
    assert np.mean(right) > 0.95


def test_toxicity(spark, tables):
    docs, labels = tables
    own = labels.selectExpr("doc_id", "toxic AS label")
    model = toxicity.train(docs, own.where("doc_id % 3 <> 1"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    check(rows, [(i, int(i % 5 == 0)) for i in range(400) if i != 0], lambda i: i % 3 == 1)
    again = toxicity.train(docs.repartition(5), own.where("doc_id % 3 <> 1"))
    assert np.allclose(again.weights, model.weights)
    # a batch's neighbours don't change a score
    text = pa.array(["rotter " * 3, None, "plain words here"])
    one = [model.scorer()(*K.flat(text.slice(k, 1)))[0] for k in range(3)]
    assert np.allclose(one, model.scorer()(*K.flat(text)))


def test_quality(spark, tables):
    docs, labels = tables
    rows = quality.scored(docs, labels.selectExpr("doc_id", "quality AS label").where("doc_id % 3 <> 1")).collect()
    assert len(rows) == docs.count()
    check(rows, [(i, int(i % 4 != 0)) for i in range(400) if i != 0], lambda i: i % 3 == 1)


def test_one_class_and_empty(spark, tables):
    docs, labels = tables
    only = labels.where("toxic = 1").selectExpr("doc_id", "toxic AS label")
    for rows in (toxicity.score(docs, toxicity.train(docs, only)).collect(), quality.scored(docs, only).collect()):
        assert len({r.score for r in rows}) == 1 and len(rows) == docs.count()
    none = labels.limit(0).selectExpr("doc_id", "toxic AS label")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), only)).count() == quality.scored(docs.limit(0), only).count() == 0


def test_label_model_finds_dependent_voters():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    fire = lambda a, b: (rng.random(3000) < np.where(y, a, b)).astype(float)
    twin = fire(0.5, 0.1)
    copies = [np.where(rng.random(3000) < 0.95, twin, fire(0.5, 0.1)) for _ in range(3)]
    votes = np.stack([fire(0.8, 0.05), fire(0.7, 0.05), fire(0.6, 0.02), twin, *copies], 1)
    p, factors = toxicity.label_model(votes, np.where(rng.random(3000) < 0.2, y, -1))
    assert sorted(map(len, factors)) == [1, 1, 1, 4]
    assert ((p > 0.5) == y).mean() > 0.95


def test_temperature_and_vectors():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    assert quality.temperature(z * 3, y) == pytest.approx(3, rel=0.15)
    total, seen = np.zeros(quality.VOCABULARY * quality.DIMENSIONS), np.zeros(quality.VOCABULARY, np.int64)
    data, off = K.flat(pa.array(["a b c", "a b", None, "d"]))
    quality.contexts(data, off, total, seen)
    t, first = quality.tokens(data, off)
    assert first.tolist() == [0, 3, 5, 5, 6]
    want = np.zeros((quality.VOCABULARY, quality.DIMENSIONS))
    for i, j in ((0, 1), (0, 2), (1, 2), (3, 4)):
        for a, b in ((t[i], t[j]), (t[j], t[i])):
            for k in range(quality.NONZERO):
                want[a, quality._DIMENSION[b, k]] += quality._SIGN[b, k]
    assert (total.reshape(want.shape) == want).all() and seen.sum() == 6
