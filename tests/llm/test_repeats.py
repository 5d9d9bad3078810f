import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import test_fragments

from panelforge.llm import fm_index, shards, suffix
from panelforge.llm import textkit as K


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randrange(1, 6)))
    text = lambda k: r.choice([" ", "\n", "  "]).join(word() for _ in range(k))
    shared = [text(r.randrange(10, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(4)):
            parts.append(r.choice(shared) if r.random() < 0.5 else text(r.randrange(30)))
        t = " ".join(parts)
        if rows and r.random() < 0.2:
            t = rows[-1][1]
            if t and r.random() < 0.6:
                k = r.randrange(len(t))
                t = t[:k] + r.choice(["", "x", " zz "]) + t[k:]
        rows.append((i, t))
    rows += [(n, "ab " * 300), (n + 1, "z" * 900), (n + 2, "z" * 30), (n + 3, None), (n + 3, None), (n + 4, ""), (5, rows[6][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, shared[0]), (n + 5, text(4000))]
    r.shuffle(rows)
    return rows


def words_brute(rows, width):
    least = {}
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    key = lambda i: shards.NO_ID if i is None else i
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            least[s] = min(least.get(s, shards.NO_ID), key(i))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def bytes_brute(rows, width):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 4096), (2, 1), (3, 1)])
def test_words_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(shards, "HOT", hot)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS payload").repartition(3)
    got = [tuple(r) for r in fm_index.substring_dedup(docs, 13, 5).collect()]
    assert sorted(got, key=str) == sorted(words_brute(rows, 13), key=str)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("seed,width,gram,hot", [(1, 40, 10, 4096), (2, 40, 16, 4096), (3, 100, 25, 4096), (2, 40, 16, 1), (3, 100, 25, 2)])
def test_bytes_against_brute_force(spark, monkeypatch, seed, width, gram, hot):
    monkeypatch.setattr(shards, "HOT", hot)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS kind").repartition(3)
    got = [tuple(r) for r in suffix.suffix_dedup(docs, width, gram).collect()]
    assert sorted(got, key=str) == sorted(bytes_brute(rows, width), key=str)


def test_report_of_shorter_strings(spark, monkeypatch):
    for hot in (4096, 1):
        monkeypatch.setattr(shards, "HOT", hot)
        rows = corpus(4)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "CAST(doc_id AS STRING) AS a", "length(text) AS b").repartition(3)
        got = suffix.suffix_dedup(docs, 90, 12, report=40, keep="text", carry=("a", "b")).collect()
        assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(bytes_brute(rows, 90), key=str)
        assert sorted([(r.doc_id, r.n_repeated) for r in got], key=str) == sorted([(x[0], x[2]) for x in bytes_brute(rows, 40)], key=str)
        assert sorted([(r.doc_id, r.a, r.b) for r in got], key=str) == sorted([(i, None if i is None else str(i), None if t is None else len(t)) for i, t in rows], key=str)


def test_words_that_polynomials_confuse(spark):
    a, b = test_fragments.thue_morse(10)
    rows = [(1, " ".join([a] * 14)), (2, " ".join([b] * 14)), (3, " ".join(a)), (4, " ".join(b)), (5, a), (6, b), (7, " ".join([b] * 13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in fm_index.substring_dedup(docs).collect()) == sorted(words_brute(rows, 13))
    assert sorted(tuple(r) for r in suffix.suffix_dedup(docs).collect()) == sorted(bytes_brute(rows, 400))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fm_index.substring_dedup(docs).count() == suffix.suffix_dedup(docs).count() == 0


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(shards, "SEGMENT", 500)
    monkeypatch.setattr(K, "PIECE", 300)
    rows = corpus(5)
    for scheme in (shards.Windows(13, 5, True), shards.Windows(40, 10, False)):
        data, off = K.flat(pa.array([t for _, t in rows]))
        c = scheme.chunks(data, off)
        marks = np.zeros(len(rows), np.int64)
        np.add.at(marks, c.row, c.count)
        for k, (_, t) in enumerate(rows):
            n = len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) if scheme.words else len((t or "").encode())
            assert marks[k] == max(0, n - scheme.width + 1)


def test_index_finds_any_pattern():
    r = np.random.default_rng(1)
    texts = [r.integers(1, 5, r.integers(1, 30)) for _ in range(20)]
    width = 4
    index = fm_index.FMIndex(np.concatenate([np.append(t, 0) for t in texts]), np.concatenate([np.full(len(t) + 1, k) for k, t in enumerate(texts)]), width)
    asked = [r.integers(1, 6, 12) for _ in range(30)]
    flat = np.concatenate(asked)
    length, owner = index.statistics(np.where(flat > 4, -1, flat), np.arange(0, 361, 12))
    where = {}
    for k, t in enumerate(texts):
        for j in range(len(t) - width + 1):
            where.setdefault(tuple(t[j : j + width]), k)
    for k, a in enumerate(asked):
        for j in range(9):
            s = tuple(a[j : j + width])
            assert (length[12 * k + j] == width) == (s in where)
            if s in where:
                assert owner[12 * k + j] == where[s]
