import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import crossent as C
from panelforge.llm import textkit as K


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocab = [["".join(r.choices("abcde", k=r.randrange(2, 7))) for _ in range(60)] for _ in range(2)]
    rows = [(i, r.choice([" ", "\n"]).join(r.choice(vocab[i % 2 if r.random() < 0.9 else 0]).title() for _ in range(r.randrange(40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "abc de"), (3, rows[3][1]), (n + 2, "zz " * 3000)]


def brute(rows, target, size):
    words = [K.folded(np.frombuffer((t or "").encode(), np.uint8)).tobytes().split() for _, t in rows]
    name = lambda w: int(K.name(b := np.frombuffer(w, np.uint8), np.array([0]), np.array([len(b)]))[0])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    freq = Counter(w for ws in words for w in ws)
    order = sorted(freq, key=lambda w: (-freq[w], signed(name(w))))
    border = freq[order[size]] if len(order) > size else 0
    ids = {w: k + 2 for k, w in enumerate(w for w in order if freq[w] > border)}
    tables = [[Counter(), Counter(), Counter()] for _ in range(2)]
    one = lambda *x: int(C.slot(*(np.array([y]) for y in x))[0])
    tri = [[(ids.get(w, 1), ids.get(ws[k - 1], 1) if k else 0, ids.get(ws[k - 2], 1) if k > 1 else 0) for k, w in enumerate(ws)] for ws in words]
    for (i, _), t in zip(rows, tri, strict=True):
        for own in (0, 1):
            if own == 0 or i in target:
                for w, v, u in t:
                    tables[own][0][w] += 1
                    tables[own][1][one(v, w)] += 1
                    tables[own][2][one(v, w, u)] += 1
    tokens = [sum(tables[own][0].values()) for own in (0, 1)]
    texts = [sum(bool(t) for t in tri), sum(bool(t) for (i, _), t in zip(rows, tri, strict=True) if i in target)]
    out = []
    for (i, _), t in zip(rows, tri, strict=True):
        losses = []
        for own in (1, 0):
            # the counts of all other documents
            mine = [Counter(w for w, _, _ in t), Counter(one(v, w) for w, v, _ in t), Counter(one(v, w, u) for w, v, u in t)] if own == 0 or i in target else [Counter()] * 3
            a, b, c = (lambda x, y=y, z=z: y[x] - z[x] for y, z in zip(tables[own], mine, strict=True))
            left, others = tokens[own] - sum(mine[0].values()), texts[own] - bool(mine[0])
            s = 1.0 if own else tokens[1] / max(1, tokens[0])
            total = 0.0
            for w, v, u in t:
                p = (a(w) * s + C.STRENGTH / C.SIZES[0]) / (left * s + C.STRENGTH)
                p = (b(one(v, w)) * s + C.STRENGTH * p) / ((others * s if v == 0 else a(v) * s) + C.STRENGTH)
                p = (c(one(v, w, u)) * s + C.STRENGTH * p) / ((others * s if v == 0 else b(one(u, v)) * s) + C.STRENGTH)
                assert 0 < p <= 1
                total -= math.log(p)
            losses.append(total / len(t) if t else None)
        out.append((i, len(t), *losses))
    return out


@pytest.mark.parametrize("size", [1 << 16, 30])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(C, "VOCABULARY", size)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own", "2 AS score").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,), (4,), (9999,)], "doc_id long")
    got = sorted(C.score(docs, target).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(brute(rows, set(range(0, 60, 2)), size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.n_tokens) == w[:2]
        if w[1]:
            assert g.target_loss == pytest.approx(w[2], rel=1e-4) and g.background_loss == pytest.approx(w[3], rel=1e-4)
            assert g.score == pytest.approx(g.target_loss - g.background_loss)
        else:
            assert g.score is None
    even = [g.score for g in got if g.doc_id is not None and g.doc_id >= 60 and g.doc_id % 2 == 0 and g.doc_id < 120 and g.n_tokens > 5]
    odd = [g.score for g in got if g.doc_id is not None and g.doc_id >= 60 and g.doc_id % 2 and g.doc_id < 120 and g.n_tokens > 5]
    assert np.mean(even) < np.mean(odd)


def test_empty(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert C.score(docs.limit(0), none).count() == 0
    assert {r.score for r in C.score(docs, none).collect()} <= {0.0, None}


def test_texts_keep_apart():
    v = C.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    w, p, q, first = v.trigrams(*K.flat(pa.array(["a b c", None, "d", "e f"])))
    assert p.tolist() == [0, 1, 1, 0, 0, 1] and q.tolist() == [0, 0, 1, 0, 0, 0] and first.tolist() == [0, 3, 3, 4, 6]


def test_counts_grow_with_the_corpus(spark):
    # 70,000 words, more than 2^16, each twice
    rows = [(i, " ".join(f"w{(i % 700) * 100 + k}" for k in range(100))) for i in range(1400)]
    got = C.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0,), (1,)], "doc_id long")).collect()
    scale, base = 200 / 140000, C.STRENGTH / 70002
    for r in got:
        own = r.doc_id < 2
        for loss, c, s, tokens, texts in ((r.target_loss, int(r.doc_id % 700 < 2 and not own), 1.0, 200 - 100 * own, 2 - own), (r.background_loss, 1, scale, 139900, 1399)):
            c, total = c * s, 0.0
            for k in range(100):
                p = (c + base) / (tokens * s + C.STRENGTH)
                p = (c + C.STRENGTH * p) / ((texts * s if k == 0 else c) + C.STRENGTH)
                p = (c + C.STRENGTH * p) / ((texts * s if k == 0 else c) + C.STRENGTH)
                total -= math.log(p)
            assert loss == pytest.approx(total / 100, rel=1e-9)
    assert len(got) == 1400


def test_probabilities_add_up():
    """After any context the losses of all words make probabilities that add up to 1 less what ends there."""
    r = random.Random(2)
    texts = [[r.randrange(6) for _ in range(r.randrange(1, 9))] for _ in range(50)]
    size, grams = 6, [Counter(), Counter(), Counter()]
    for t in texts:
        p = [None, None, *t]
        for k in range(2, len(p)):
            for n in range(3):
                grams[n][tuple(p[k - n : k + 1])] += 1
    tokens, begin = sum(map(len, texts)), np.array([False, False, False])
    uniform = max(C.SIZES[0], size + 2)
    for u in range(size):
        for v in range(size):
            total, none = 0.0, grams[0][v,] - sum(grams[1][v, w] for w in range(size))
            for w in range(size):
                # three tokens: the context's two, and the word
                count = np.array([[grams[0][u,], grams[0][v,], grams[0][w,]], [0, grams[1][u, v], grams[1][v, w]], [0, 0, grams[2][u, v, w]]])
                total += math.exp(-C.losses(count, np.full(3, tokens), np.full(3, len(texts)), 1.0, size, begin)[2])
            s = C.STRENGTH
            one = (tokens + s * size / uniform) / (tokens + s)
            two = (sum(grams[1][v, w] for w in range(size)) + s * one) / (grams[0][v,] + s)
            three = (sum(grams[2][u, v, w] for w in range(size)) + s * two) / (grams[1][u, v] + s)
            assert math.isclose(total, three) and total <= 1 and (none or math.isclose(two, one, rel_tol=0.02))
