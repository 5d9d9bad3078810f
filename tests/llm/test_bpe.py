import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import test_fragments
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = list("abcdefghijklmnopqrstuvwxyzABCÉÈßΣσςİıſK'.,!?-0123456789  \n\t\x1c\x1d\x85\xa0 　́ë​‍") + ["😀", "👍🏽", "中文", "한국", "हिन्दी", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|end", "ing", "tion", "http"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.model(f.read())


def same(own, library, texts):
    ids, off, decoded = own.encode_batch(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False)
        assert ids[off[k] : off[k + 1]].tolist() == e.ids, t
        assert decoded[k].decode() == library.decode(e.ids, skip_special_tokens=False) == own.decode(e.ids), t


def test_words_that_polynomials_confuse(own, library, monkeypatch):
    a, b = test_fragments.thue_morse(10)
    same(own, library, [f"{a} {b}", b, f"{b} {a} {a}"])
    # words that share a name, whatever it is
    monkeypatch.setattr(bpe.K, "name", lambda buf, starts, ends, eight=None: (ends - starts).astype(np.uint64) % np.uint64(3))
    same(own, library, ["some words of a text share their names here", "and so do these words, don't they?"])


def test_random_texts(own, library):
    r = random.Random(1)
    same(own, library, ["".join(r.choices(LETTERS, k=r.randrange(0, 60))) for _ in range(3000)])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=40))
def test_any_text(own, library, text):
    same(own, library, [text])


def test_edges(own, library):
    same(own, library, [None, "", " ", "\n\n", "a" * 5000, "ab " * 3000, "x", "x"])


def test_pairs_agree_with_exact_merging(own):
    r = random.Random(2)
    for _ in range(300):
        word = "".join(r.choices("abcdeinorst", k=r.randrange(2, 12))).encode()
        ids = np.array(own.exact(word))
        if len(ids) > 1:
            assert own.compatible(ids[:-1], ids[1:]).all()


def test_documents(spark, library):
    rows = [(1, "Hello world's"), (2, None), (None, "x"), (3, ""), (3, ""), (4, "long " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids")
    got = sorted((tuple(r) for r in bpe.encode_documents(docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_exact_merging_side_by_side(own, library):
    r = random.Random(4)
    words = ["".join(r.choices("abcdeinorsté" if k % 3 else "ab", k=r.randrange(1, 40))).encode() for k in range(1500)] + [b"a" * 20000]
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, count = own.exact_all(np.frombuffer(b"".join(words), np.uint8), off, np.arange(len(words)))
    cut = np.concatenate([[0], np.cumsum(count)])
    for k, w in enumerate(words):
        assert ids[cut[k] : cut[k + 1]].tolist() == own.exact(w)
    for w in words[:300]:
        text = w.decode("utf-8", "ignore")
        assert own.exact(text.encode()) == library.encode(text, add_special_tokens=False).ids
