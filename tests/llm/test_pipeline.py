import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import test_fragments
from tokenizers import Tokenizer

import corpus_pipeline
from panelforge.llm import textkit as K
from panelforge.llm import tiling


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefé", k=r.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(5)]
    shared = [" ".join(word() for _ in range(r.randrange(51, 61))) for _ in range(3)]
    rows, labels = [], []
    for i in range(200):
        w = [word() for _ in range(r.randrange(30, 120))]
        if i % 6 == 0:
            w[3:3] = ["knave", "rotter"]
        if i % 9 == 0:
            w[5:5] = r.choice(items)[1].split()
        if i % 7 == 0:
            w += r.choice(shared).split()
        if i % 10 == 5:
            w = rows[-1][1].split()
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int("knave" in w)))
    rows += [(300, ""), (301, None)]
    return rows, labels, items


def shared_passages():
    """The passages of 51 to 60 words that corpus() puts into a seventh of its documents."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefé", k=r.randrange(2, 7)))
    [[word() for _ in range(20)] for _ in range(5)]
    return [[word() for _ in range(r.randrange(51, 61))] for _ in range(3)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, node long, block string, tag string, component long"


def tables(spark, folder, rows, labels=(), items=()):
    docs = spark.createDataFrame([(i, t, g, s, len(t or ""), 1, "x", "y", 2) for i, t, g, s in rows], DOCUMENTS).repartition(2)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_rows_not_ids(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choices("abcdef", k=r.randrange(2, 7))) for _ in range(n))
    passage, item = text(80), text(20)
    plain = [text(40) for _ in range(6)]
    rows = [
        (1, plain[0], "en", "a"), (1, plain[1], "de", "b"),  # one id, two texts
        (2, plain[2], "en", "c"), (2, plain[2], "fr", "d"),  # a repeated row in two languages
        (None, plain[3], "en", None), (None, plain[4], None, "e"), (None, item, "en", "f"), (3, f"{plain[5]} {item}", "en", "g"), (3, plain[5], "en", "h"),
        (4, f"{text(30)} {passage}", "it", "i"), (None, f"{passage} {text(30)}", "es", "j"),
        (5, None, "en", "k"), (6, "", None, None), (7, text(400_000), "en", "long"),
    ]
    docs = tables(spark, tmp_path, rows, items=[(1, item), (None, None)])
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).toArrow().to_pylist(), "doc_id long, text string, lang string, source string, n_chars long")
        seen[name] = sorted(((x.doc_id, x.text, x.lang, x.source) for x in at.collect()), key=str)
    # no labels: nothing is known to be toxic
    assert seen["toxicity"] == sorted(rows, key=str)
    # near copies: the repeated row stays once, the one that differs by the item's words is another set
    left = seen["near copies"]
    assert len(left) == len(rows) - 1 and sum(x[0] == 2 for x in left) == 1 and sum(x[0] == 1 for x in left) == 2 and sum(x[0] is None for x in left) == 4
    # repeated substrings: each row keeps its own columns
    cut = {x[3]: x for x in seen["repeated substrings"]}
    assert {k: x[2] for k, x in cut.items()} == {x[3]: x[2] for x in left}
    assert all(passage not in (x[1] or "") for x in cut.values()) and cut["a"][1] == plain[0] and cut["long"][1] == rows[-1][1]
    # leaks: rows that hold the item go, others of their id stay
    last = {x[3] for x in seen["benchmark leaks"]}
    assert cut.keys() - last == {"f", "g"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["benchmark leaks"])


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labels_of_one_class(spark, tmp_path):
    tables(spark, tmp_path, [(k, f"some words of document {k} that nobody minds", "en", "a") for k in range(30)], [(k, 1, 1) for k in range(20)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 30


def test_run_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == corpus_pipeline.COLUMNS, name
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted((x.doc_id, x.text) for x in at.collect()))
    # toxicity: what holds a voter's word goes, clean documents stay
    want = [(i, t) for i, t in rows if "knave" not in (t or "")]
    assert seen[0] == sorted(want, key=lambda x: x[0])
    # near copies
    best = {i: c for i, _, c in test_fragments.brute(want)}
    want = [(i, t) for i, t in want if best[i] == i]
    assert seen[1] == want and len(want) < len(seen[0])
    # repeated substrings
    gone, blobs = {}, {i: (t or "").encode() for i, t in want}
    for b in blobs.values():
        for k in range(len(b) - 199):
            gone[b[k : k + 200]] = gone.get(b[k : k + 200], 0) + 1
    cut = []
    for i, b in blobs.items():
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if gone[b[k : k + 200]] > 1:
                mask[k : k + 200] = True
        cut.append((i, bytes(np.frombuffer(b, np.uint8)[~mask]).decode("utf-8", "ignore")))
    assert seen[2] == cut and any(len(a) != len(b) for (_, a), (_, b) in zip(cut, [(i, blobs[i]) for i, _ in cut], strict=True))
    passages = [" ".join(p) for p in shared_passages()]
    assert sum(p in (t or "") for _, t in want for p in passages) > 10 and not any(p in t for _, t in cut for p in passages)
    # leaks
    names = lambda t: tiling.names_of(*K.flat(pa.array([t])))[0]
    left = [(i, t) for i, t in cut if not any(sum(x[2] for x in tiling.tiles(names(x), names(t), 4)) * 2 >= 20 for _, x in items)]
    assert seen[3] == left and len(left) < len(cut)
    # tokens
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for i, t in left:
        ids = library.encode(t, add_special_tokens=False).ids
        assert out.pop(i) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert not out
