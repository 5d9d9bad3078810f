import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest

from panelforge.llm import chat, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "]", ">", "s>", "a", " b", "é", "😀", "\n", "中"]


def test_round_trip():
    r = random.Random(3)
    for _ in range(3000):
        turns = [(r.choice(["system", "user", "assistant", "tool", "", "[/ROLE]"]), "".join(r.choices(BITS, k=r.randrange(8)))) for _ in range(r.randrange(5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_token_mask_counts_shared_characters_once():
    offsets = np.array([[0, 2], [2, 3], [2, 3], [3, 6], [6, 8]])
    mask, pieces = chat.token_mask(offsets, np.array([[1, 4], [4, 4], [5, 7]]))
    assert mask.tolist() == [True] * 5
    assert pieces.tolist() == [[1, 2, 0], [2, 3, 0], [3, 4, 0], [5, 6, 2], [6, 7, 2]]


def test_conversations(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["system", "user", "assistant", "assistant", "tool"]), "".join(r.choices(BITS, k=r.randrange(12)))) for c in range(40) for t in range(r.randrange(1, 6))]
    rows += [(50, 0, "assistant", None), (51, 0, None, "x"), (None, 0, "assistant", "n"), (52, 1, "assistant", "x" * 100000), (53, 0, "user", "a"), (53, 0, "user", "a"), (54, None, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns", "2 AS formatted")
    got = {x[0]: tuple(x) for x in chat.digest(chat.format_conversations(table, PATH)).collect()}
    for c in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c][1:] == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render(turns)[0]))
    assert chat.format_conversations(table.limit(0), PATH).count() == 0


def brute(rows, asked, k):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) and abs(x) < topk.LIMIT / 1024 for x in v)
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q in sorted({i for i, _ in ints if i in asked}):
        v = min(v for i, v in ints if i == q)
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "few"])
def test_top_k(spark, kind):
    r = random.Random(kind)
    n = 6 if kind == "few" else 400
    rows = [(i, [(r.choice([0.0, 0.5, -0.25]) if kind == "ties" else r.gauss(0, 1)) for _ in range(8)]) for i in range(n)]
    rows += [(None, [1.0] * 8), (1000, None), (1001, [None] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [float("inf")] * 8), (1004, [1.0, 2.0]), (1005, [2.0, 2.0]), (1006, []), (7, rows[0][1]), (7, rows[0][1]), (1007, [1e30] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS v").repartition(3)
    asked = {i for i, _ in rows if i is not None and (i % 10 == 0 or i >= 1000)}
    got = sorted(tuple(x) for x in topk.top_k(table, table.where("vec_id % 10 = 0 OR vec_id >= 1000"), 10).collect())
    assert got == brute(rows, asked, 10)
    assert topk.top_k(table.limit(0), table, 10).count() == topk.top_k(table, table.limit(0), 10).count() == 0


def test_bounds_save_work():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 300, (20, 6))[rng.integers(0, 20, 4000)] + rng.normal(0, 10, (4000, 6)))
    pivots = topk.choose_pivots(x[:200], 16)
    s = topk.Search(np.arange(10), x[:10], pivots, 5)
    s.add(np.arange(4000), x, topk.distances(x, pivots))
    assert s.evaluated < 10 * 4000 / 3
    for i in range(10):
        want = sorted((-int(v @ x[i]), j) for j, v in enumerate(x) if j != i)[:5]
        assert [(-a, b) for a, b in zip(s.best_score[i].tolist(), s.best_id[i].tolist(), strict=True)] == want


@pytest.mark.parametrize("size", [5000.0, 1e9, 1e30, 1e300])
def test_large_components(spark, size):
    r = random.Random(size)
    rows = [(i, [r.gauss(0, size if i % 3 == 0 else 1) for _ in range(4)]) for i in range(90)] + [(3, [1.0] * 4), (200, [size, 0.5, -0.25, 0.0]), (201, [float("inf")] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = [(i, [math.floor(1024 * x) if abs(x) < 1e200 else int(x) * 1024 for x in v]) for i, v in rows if i != 201]
    want = []
    for q in range(0, 90, 5):
        v = min(v for i, v in ints if i == q)
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q)[:10]
        want += [(q, n, i, -s if abs(s) < 10**38 else None) for n, (s, i) in enumerate(found, 1)]
    assert sorted(map(tuple, topk.top_k(table, table.where("vec_id % 5 = 0 AND vec_id < 90"), 10).collect()), key=lambda x: x[:2]) == want
