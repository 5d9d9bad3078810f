import random
import re

import pytest

from panelforge.llm import fragments
from panelforge.llm.components import components


def shingles(text, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[top(k)] = min(best.get(top(k), i), i)
    return sorted([(i, len(s), best.get(top(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def corpus(seed, groups=30, hot=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdef", k=r.randrange(2, 6)))
    rows, i = [], 0
    common = [word() for _ in range(40)]

    def near(w, edits):
        w = list(w)
        for _ in range(edits):
            w[r.randrange(len(w))] = word()
        return w

    for g in range(groups):
        base = [word() for _ in range(r.randrange(1, 120))] + (common if g % 3 == 0 else [])
        for _ in range(r.choice([1, 1, 2, 3, 9])):
            w = near(base, r.choice([0, 0, 1, 2, 4]))
            if r.random() < 0.3:
                w = w + [word() for _ in range(r.randrange(6))]
            rows.append((i, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
            i += 1
    base = [word() for _ in range(150)]
    for _ in range(hot):
        rows.append((i, " ".join(near(base, r.randrange(0, 7)))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one two"), (i + 4, "one  TWO"), (i + 4, "one two"), (None, "one two"), (None, "alone here"), (i + 5, " ".join(word() for _ in range(5000)))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,cell", [(1, 0, 1024), (2, 60, 1024), (3, 120, 16), (4, 200, 8)])
def test_against_brute_force(spark, monkeypatch, seed, hot, cell):
    monkeypatch.setattr(fragments, "CELL", cell)
    rows = corpus(seed, hot=hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n_shingles").repartition(3)
    got = sorted((tuple(x) for x in fragments.jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_hot_nodes_and_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(fragments, "HEAVY", 2)
    rows = [(k, "the same five words and more") for k in range(40)] + [(k, f"{k} other words of this row") for k in range(40, 60)] + [(3, "unlike all the others here now"), (None, "the same five words and more"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fragments.jaccard_components(docs, rows_apart=True).collect()
    assert sorted((tuple(x)[:3] for x in got), key=str) == brute(rows)
    assert len({x.component for x in got if x.doc_id == 3}) == 2 and len({x.component for x in got}) == 23


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse(10)
    rows = [(1, f"{a} {a}"), (2, f"{b} {b}"), (3, " ".join(a)), (4, " ".join(b)), (5, f"{b} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in fragments.jaccard_components(docs).collect()) == brute(rows)


def thue_morse(k):
    """A string of 2^k letters and its complement, which have one polynomial value modulo 2^64 from k = 10 on."""
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_empty(spark):
    assert fragments.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, None), (2, ""), (3, None)]
    assert sorted(tuple(x) for x in fragments.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


@pytest.mark.parametrize("edges", [1 << 16, 20])
def test_components(spark, monkeypatch, edges):
    from panelforge.llm import components as module

    monkeypatch.setattr(module, "EDGES", edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_components(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (7, 7), (10, 11), (12, 11), (12, 13), (13, 14), (-5, 14), (None, 3)]
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (10, -5), (11, -5), (12, -5), (13, -5), (14, -5), (-5, -5)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, y) for x, y in root.items() if any(a != b and x in (a, b) for a, b in edges)}


@pytest.mark.parametrize("cell", [1024, 16])
def test_number_of_links(spark, monkeypatch, cell):
    monkeypatch.setattr(fragments, "CELL", cell)
    rows = corpus(5, groups=12, hot=80)
    sets = [shingles(t) for _, t in rows]
    want = [(i, sum(k != j and bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets))) for k, ((i, _), a) in enumerate(zip(rows, sets, strict=True))]
    got = fragments.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n_links=True).collect()
    assert sorted([(r.doc_id, r.n_links) for r in got], key=str) == sorted(want, key=str)
    assert max(n for _, n in want) > cell or cell > 16


def test_leading_holds_a_shared_pair():
    """Of any two linked sets the first n-grams that are looked at hold two neighbours that are neighbours in both."""
    r = random.Random(9)
    for _ in range(20000):
        percent = r.choice([80, 80, 80, 85, 90, 97])
        a = r.randrange(2, 60)
        b = r.randrange(int(fragments.need(a, percent)), a + 1)
        common = -(-percent * (a + b) // (100 + percent))
        if common > b or a == b == common:
            continue
        # the others crowd at the start, where they part the first common ones, one each if there are as many
        slots = list(range(common + 1)) if r.random() < 0.5 else list(range(a + b - 2 * common + 2))
        order = [(k, 0, "c") for k in range(common)] + [(r.choice(slots) - 0.5, r.random(), x) for x in "a" * (a - common) + "b" * (b - common)]
        order = sorted((k, t, x, n) for n, (k, t, x) in enumerate(order))
        sides = [[n for _, _, x, n in order if x in ("c", own)][: int(fragments.leading(size, percent))] for own, size in (("a", a), ("b", b))]
        assert set(zip(sides[0], sides[0][1:])) & set(zip(sides[1], sides[1][1:])), (percent, a, b)


def lines_shared(documents=600, seed=4):
    """Texts with five lines of eight words, each of which three texts have, among words of their own; some near copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    lines = [" ".join(word() for _ in range(8)) for _ in range(documents * 5 // 3)]
    dealt = lines * 3
    r.shuffle(dealt)
    rows = []
    for k in range(documents):
        parts = [" ".join(word() for _ in range(40)) for _ in range(6)]
        rows.append((k, "\n".join(x for pair in zip(parts, [*dealt[5 * k : 5 * k + 5], ""], strict=True) for x in pair)))
    return rows + [(documents + k, f"{rows[k][1]} {word()} {word()}") for k in range(0, documents, 10)]


def test_rare_lines_make_no_cluster(spark, monkeypatch):
    """In a corpus too large for the sketch, lines of a few documents joined nearly all documents to one cluster, of which all pairs of cells were compared."""
    monkeypatch.setattr(fragments, "SKETCH", 64)
    docs = spark.createDataFrame(lines_shared(), "doc_id long, text string").repartition(3)
    p = fragments.shards.plan(docs)
    order = spark.sparkContext.broadcast(fragments.rarity(docs, 5))
    sizes = components(fragments.candidates(fragments.prefixes(docs, p, order, 5, 80), 80)).groupBy("label").count().collect()
    assert len(sizes) >= 60 and max(x["count"] for x in sizes) < 60


@pytest.mark.parametrize("percent", [50, 79, 80, 93])
def test_other_thresholds(spark, percent):
    rows = corpus(6, groups=25, hot=40)
    got = sorted((tuple(x) for x in fragments.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=percent).collect()), key=str)
    assert got == brute(rows, percent)


def test_pipeline_compares_no_cells_for_rare_lines(spark, monkeypatch):
    """The pipeline's second stage: such a corpus has no cluster beyond a cell, and the near copies alone go."""
    import corpus_pipeline

    def large(*_):
        raise AssertionError("a cluster beyond a cell")

    monkeypatch.setattr(fragments, "SKETCH", 64)
    monkeypatch.setattr(fragments, "CELL", 100)
    monkeypatch.setattr(fragments, "_large", large)
    rows = [(i, t, "en", "src", len(t)) for i, t in lines_shared()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()) == list(range(600))


def test_pipeline_rows_of_candidates_whatever_the_buckets(spark, monkeypatch):
    """The pipeline's second stage: two near copies had a row for each bucket that they met in, and buckets grow with the input."""
    import corpus_pipeline

    made, plain = [], fragments.candidates

    def counted(*args):
        out = fragments.shards.durable(plain(*args))
        made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(fragments, "candidates", counted)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    rows = []
    for k in range(150):
        words = [word() for _ in range(200)]
        at = r.randrange(200)
        rows += [(k, " ".join(words)), (1000 + k, " ".join([*words[:at], word(), *words[at + 1 :]]))]
    rows = [(i, t, "en", "src", len(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for size in (1 << 30, 200):
        monkeypatch.setattr(fragments.shards, "BUCKET", size)
        assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()) == list(range(150))
    # five n-grams of either part what the copies share into eleven runs at most
    assert fragments.shards.plan(docs).buckets > 1000 and all(n <= 11 * 150 and pairs == 150 for n, pairs in made), made
