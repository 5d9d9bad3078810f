import random

import numpy as np
import pyarrow as pa

from panelforge.llm import textkit as K
from panelforge.llm import tiling


def brute_tiles(a, b, match):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (match - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < match:
            return out
        for k in range(n):
            fa[i + k] = fb[j + k] = False
        out.append((i, j, n))


def test_tiles_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randrange(1, 4) for _ in range(r.randrange(1, 25))]
        b = [r.randrange(1, 4) for _ in range(r.randrange(1, 40))]
        got = tiling.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert got == brute_tiles(a, b, 3)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefg", k=r.randrange(2, 5)))
    items = [(k, " ".join(word() for _ in range(r.randrange(6, 40)))) for k in range(12)]
    items += [(20, None), (21, ""), (22, "ab cd"), (None, items[0][1]), (3, items[4][1]), (23, "aa " * 20)]
    docs = []
    for i in range(80):
        text = [word() for _ in range(r.randrange(60))]
        if r.random() < 0.6:
            w = (r.choice(items[:12])[1]).split()
            cut = sorted(r.sample(range(len(w) + 1), min(3, len(w))))
            parts = [w[x:y] for x, y in zip([0, *cut], [*cut, len(w)], strict=True)]
            r.shuffle(parts)
            for p in parts[: r.randrange(1, 5)]:
                k = r.randrange(len(text) + 1)
                text[k:k] = [x.upper() + r.choice(["", ",", "."]) for x in p]
        docs.append((i, " ".join(text)))
    return docs + [(90, None), (91, ""), (92, "É " * 9), (None, items[1][1]), (5, docs[5][1]), (5, docs[5][1]), (93, "aa " * 5000)], items


def brute(docs, items, match, coverage):
    def words(t):
        return tiling.names_of(*K.flat(pa.array([t or ""])))[0].tolist()

    out = []
    for d, t in docs:
        w = words(t)
        for k, x in items:
            v = words(x)
            if len(v) >= match:
                found = brute_tiles(v, w, match)
                n = sum(f[2] for f in found)
                if n >= coverage * len(v):
                    out.append((d, k, n / len(v), n))
    return sorted(out, key=str)


def test_leaks_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 32 << 20), (2, 300)):
        monkeypatch.setattr(tiling, "BLOCK", block)
        docs, items = corpus(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS coverage").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
        got = [(r.doc_id, r.item_id, r.coverage, r.tiled_words) for r in tiling.leaks(d, b).collect()]
        assert sorted(got, key=str) == brute(docs, items, 4, 0.5)
        assert tiling.leaks(d.limit(0), b).count() == tiling.leaks(d, b.limit(0)).count() == 0


def test_case_and_punctuation():
    a, b = (tiling.names_of(*K.flat(pa.array([t])))[0].tolist() for t in ("Élan, (the) ÖL — x", "élan THE öl — X!"))
    assert a == b and len(a) == 5
