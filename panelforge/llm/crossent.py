"""LM scoring by cross-entropy difference.

Two trigram models, one of target documents and one of all documents, share one vocabulary (every word of all
documents; VOCABULARY may set a limit), one smoothing and one size: the background's counts are
scaled to the target's number of tokens, so that neither model is smoothed more than the other.  A document is
scored by the counts of all other documents: its own are taken off both models before.  Its score is
the mean over its tokens of the target's loss less the background's: lower is closer to the target.

Counts are exact, cover all documents and every word, bigram and trigram, and grow with the corpus, so no task holds a model:

1. asks     a block of documents sends each of its n-grams once, with its counts there, to the bucket of the n-gram's name;
2. replies  a bucket adds up and answers each block with the sums, in the order of its question;
3. scores   the block reads its documents again and takes the losses from its replies.

A frequent n-gram costs one entry for each block.  The driver gets three sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards
from . import textkit as K

#: Most words in the vocabulary (None: all; others are one unknown word), strength of the smoothing.
VOCABULARY: int | None = None
STRENGTH = 4.0
#: Ids: words from 2 on; without a limit a word's id is its name.
BEGIN, UNKNOWN = 0, 1
#: The smoothing below unigrams is uniform over so many words, or over the vocabulary if that is larger.
SIZES = ((1 << 16) + 2,)
#: Bytes of text for a block, and for which a bucket takes the n-grams.
BLOCK, BUCKET = 12 << 20, 8 << 20
#: What a row of a block holds, where it is no reply.
_TEXTS, _TARGET = -2, -1
_ROW = "block int, bucket int, payload binary"
#: The name under which texts are counted, as the context of their first words; no n-gram's name is less.
_TEXT_NAME = np.uint64(0)


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(name, n) of words with a chance of the vocabulary: the most frequent of each bucket of words, one more than the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.concatenate([names_of(x, o)[0] for _, _, x, o in K.pieces(*K.flat(batch.column(0)))] or [np.zeros(0, np.uint64)])
            name, n = np.unique(names, return_counts=True)
            if not len(name):
                continue
            order, at = K.by_bucket((name % np.uint64(buckets)).astype(np.int64), buckets)
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([K.pack(name=name[order[at[k] : at[k + 1]]], n=n[order[at[k] : at[k + 1]]].astype(np.uint32)) for k in some], pa.binary())], ["bucket", "payload"])

    def add(table: pa.Table) -> pa.Table:
        name, n = K.unpack_all(table["payload"], [np.uint64, np.uint32])
        name, back = np.unique(name, return_inverse=True)
        n = np.bincount(back, n).astype(np.int64)
        top = np.lexsort((name.view(np.int64), -n))[: VOCABULARY + 1]
        return pa.table({"name": pa.array(name[top].view(np.int64)), "n": pa.array(n[top])})

    return docs.select("text").mapInArrow(count, "bucket int, payload binary").groupBy("bucket").applyInArrow(add, "name long, n long")


def frequent(counts: DataFrame, most: int) -> list:
    """The rows with more than c counts, for the smallest c that leaves `most` of them: ties at the border stay out together.

    The border is sought in bins of counts, so the driver gets some thousand numbers and the words themselves.
    """
    bin_ = F.floor(F.log2(F.col("n").cast("double")) * 16)
    above, border = 0, 0
    for r in sorted(counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.b):
        if above + r.k > most:
            for x in sorted(counts.where(bin_ == r.b).groupBy("n").agg(F.count("*").alias("k")).collect(), key=lambda x: -x.n):
                if above + x.k > most:
                    border = x.n
                    break
                above += x.k
            break
        above += r.k
    return counts.where(F.col("n") > border).collect()


def names_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words (white space parts them; case of ASCII and Latin-1 doesn't count), and words before each text."""
    x = K.folded(buf)
    starts, ends, first = K.words(x, off)
    return K.name(x, starts, ends), first


def context(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids before each token and before that (BEGIN before a text)."""
    place = np.arange(len(w)) - np.repeat(first[:-1], np.diff(first))
    begin = w.dtype.type(BEGIN)
    return np.where(place >= 1, np.roll(w, 1), begin), np.where(place >= 2, np.roll(w, 2), begin)


@dataclass
class Vocabulary:
    """Sorted names of the words and their ids, where the vocabulary has a limit."""

    names: np.ndarray
    ids: np.ndarray

    def trigrams(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its id and the ids of the two before it, and tokens before each text."""
        names, first = names_of(buf, off)
        at = shards.match(self.names, names)
        w = np.where(at >= 0, self.ids[np.maximum(at, 0)], UNKNOWN) if len(self.names) else np.full(len(names), UNKNOWN)
        return w, *context(w, first), first


def trigrams(vocabulary: Vocabulary | None, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary.trigrams(), where the vocabulary may be all words."""
    if vocabulary is not None:
        return vocabulary.trigrams(buf, off)
    w, first = names_of(buf, off)
    return w, *context(w, first), first


def _name(x: np.ndarray, word: bool) -> np.ndarray:
    # the last bit tells words from longer n-grams
    return K.mix(x) | np.uint64(1) if word else K.mix(x) & ~np.uint64(1)


def slot(v: np.ndarray, w: np.ndarray, u: np.ndarray | None = None) -> np.ndarray:
    """The name of a bigram or trigram."""
    code = v.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if u is not None:
        code += u.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    return _name(code, False)


def named(vocabulary: Vocabulary | None, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the word, the bigram and the trigram that end at each token (three rows), and tokens of each text."""
    names, count = [np.zeros((3, 0), np.uint64)], [np.zeros(0, np.int64)]
    for _, _, x, o in K.pieces(buf, off):
        w, v, u, first = trigrams(vocabulary, x, o)
        names.append(np.stack([_name(w.astype(np.uint64), True), slot(v, w), slot(v, w, u)]))
        count.append(np.diff(first))
    return np.concatenate(names, axis=1), np.concatenate(count)


def squeezed(*arrays: np.ndarray) -> bytes:
    """64-bit integers of one length, compressed byte by byte of the integers."""
    x = np.stack([a.astype(np.uint64) for a in arrays])
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(*x.shape, 8).transpose(0, 2, 1))
    return np.int64(x.shape[1]).tobytes() + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def loosened(value: pa.Scalar, k: int) -> np.ndarray:
    """The k arrays of squeezed(), as rows."""
    x = value.as_buffer()
    n = int(np.frombuffer(x, np.int64, 1)[0])
    planes = np.frombuffer(pa.Codec("zstd").decompress(x.slice(8), 8 * k * n), np.uint8).reshape(k, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]


def losses(count: np.ndarray, tokens: np.ndarray, texts: np.ndarray, scale: float, words: int, begin: np.ndarray) -> np.ndarray:
    """Minus the logarithm of each token's probability; every order is smoothed towards the one below.

    count: of the word, bigram and trigram that end at each token; tokens, texts: in all; begin: whether a text
    begins there.  A context is counted wherever it stands, so the probabilities of all words after it
    add up to 1 less the part of texts that end there.
    """
    one, two, three = count * scale
    p = (one + STRENGTH / max(SIZES[0], words + 2)) / (tokens * scale + STRENGTH)
    p = (two + STRENGTH * p) / (np.where(begin, texts * scale, np.roll(one, 1)) + STRENGTH)
    p = (three + STRENGTH * p) / (np.where(begin, texts * scale, np.roll(two, 1)) + STRENGTH)
    return -np.log(p)


def within(back: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """How often each token's n-grams (back: their numbers below `size`, a row for each order) stand in its own text."""
    out = np.empty(back.shape, np.int64)
    for k, own in enumerate(back):
        _, at, n = np.unique((row - row[0]) * size + own, return_inverse=True, return_counts=True)
        out[k] = n[at]
    return out


def sizes(docs: DataFrame) -> shards.Plan:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return shards.Plan(max(parts, math.ceil(size / BLOCK)), max(parts, math.ceil(size / BUCKET)))


def limited(docs: DataFrame, p: shards.Plan) -> Vocabulary | None:
    """The most frequent words, if the vocabulary has a limit."""
    if VOCABULARY is None:
        return None
    top = sorted(frequent(shards.durable(word_counts(docs, p.buckets)), VOCABULARY), key=lambda r: (-r.n, r.name))
    names = np.array([r.name for r in top], np.int64).view(np.uint64)
    order = np.argsort(names)
    return Vocabulary(names[order], np.arange(2, len(names) + 2)[order])


def targets(target: DataFrame, p: shards.Plan) -> DataFrame:
    """The ids of the target by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, ids = np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64)
            order, at = K.by_bucket(block, p.blocks)
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), _TARGET), pa.int32()), pa.array([K.pack(ids=ids[order[at[k] : at[k + 1]]]) for k in some], pa.binary())], ["block", "bucket", "payload"])

    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("text", F.lit(""))
    return shards.with_block(ids, p).select("block", "doc_id").mapInArrow(run, _ROW)


def replied(blocks: DataFrame, p: shards.Plan, sent) -> DataFrame:
    """(block, bucket, payload, words, tokens, own): the counts of each block's n-grams, and sums over each bucket's words in one of its rows."""

    def ask(table: pa.Table) -> pa.Table:
        ids, buf, off, chosen = read(table)
        names, count = named(sent.value, buf, off)
        name, back = np.unique(names.ravel(), return_inverse=True)
        del names
        n = np.bincount(back, minlength=len(name))
        own = np.bincount(back[np.tile(np.repeat(chosen, count), 3)], minlength=len(name))
        del back
        name, n, own = (np.concatenate([[x], y]) for x, y in ((_TEXT_NAME, name), ((count > 0).sum(), n), ((count[chosen] > 0).sum(), own)))
        # names are spread evenly, so buckets are ranges of them
        at = np.searchsorted(((name >> np.uint64(32)) * np.uint64(p.buckets)) >> np.uint64(32), np.arange(p.buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(at))
        parts = [slice(at[k], at[k + 1]) for k in some]
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array(np.full(len(some), block), pa.int32()), "bucket": pa.array(some, pa.int32()), "payload": pa.array([squeezed(np.diff(name[s], prepend=np.uint64(0)), n[s], own[s]) for s in parts], pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        got = [loosened(x, 3) for x in table["payload"]]
        cut = np.cumsum([0, *(x.shape[1] for x in got)])
        name, back = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got]), return_inverse=True)
        n, own = (np.bincount(back, np.concatenate([x[k] for x in got])).astype(np.int64) for k in (1, 2))
        word = (name & np.uint64(1)).astype(bool)
        first = np.arange(len(got)) == 0
        sums = [np.where(first, x, 0) for x in (word.sum(), n[word].sum(), own[word].sum())]
        answers = [squeezed(n[back[a:b]], own[back[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "payload": pa.array(answers, pa.binary())} | {k: pa.array(x, pa.int64()) for k, x in zip(("words", "tokens", "own"), sums, strict=True)})

    return blocks.groupBy("block").applyInArrow(ask, _ROW).groupBy("bucket").applyInArrow(reply, _ROW + ", words long, tokens long, own long")


def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes and offsets of a block, and which documents are the target's."""
    kind, payload = np.array(table["bucket"], np.int64), table["payload"]
    ids, buf, off = shards.unpacked(payload.take(pa.array(np.flatnonzero(kind == _TEXTS))))
    chosen = K.unpack_all(payload.take(pa.array(np.flatnonzero(kind == _TARGET))), [np.int64])[0]
    return ids, buf, off, np.isin(ids, chosen) & (ids != shards.NO_ID)


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of every document.

    Words are told apart by 64-bit names.  A null or empty text has no tokens and null losses.  A null doc_id stays null and is never a target;
    repeated rows count each time; ids of the target that no document has are left out.  Without
    target documents both models are uniform and every score is 0.
    """
    docs = shards.documents(docs, id_col, text_col)
    p = sizes(docs)
    sent = docs.sparkSession.sparkContext.broadcast(limited(docs, p))
    blocks = shards.packed(docs, p).select("block", F.lit(_TEXTS).alias("bucket"), "payload").unionByName(targets(target, p))
    # the questions' shuffle files are larger than all that follows; they go once the replies are written
    replies = shards.durable(replied(blocks, p, sent))
    sums = replies.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "own"))).first()
    words, tokens, scale = sums.words, (sums.tokens, sums.own), sums.own / max(1, sums.tokens)

    def run(table: pa.Table) -> pa.Table:
        ids, buf, off, chosen = read(table)
        names, n = named(sent.value, buf, off)
        kind = np.array(table["bucket"], np.int64)
        rows = np.flatnonzero(kind >= 0)
        got = [loosened(x, 2) for x in table["payload"].take(pa.array(rows[np.argsort(kind[rows])]))]
        count = np.concatenate(got, axis=1).astype(np.int64) if got else np.zeros((2, 0), np.int64)
        name, back = np.unique(names.ravel(), return_inverse=True)
        if len(name) + 1 != count.shape[1]:
            raise ValueError("the documents changed between two reads")
        # the first count is that of texts
        back, size = back.reshape(names.shape) + 1, count.shape[1]
        del names, name, got, buf
        first = np.concatenate([[0], np.cumsum(n)])
        b, a = np.zeros((2, len(n)))
        at = 0
        while at < len(n):
            # some texts at a time
            to = max(at + 1, int(np.searchsorted(first, first[at] + K.PIECE, "right")) - 1)
            own, per = back[:, first[at] : first[to]], n[at:to]
            row = np.repeat(np.arange(at, to), per)
            if len(row):
                begin = np.zeros(len(row), bool)
                begin[(first[at:to] - first[at])[per > 0]] = True
                inside = within(own, row, size)
                for c, part, total, s, out in ((count[0], np.ones(len(n), np.int64), tokens[0], scale, b), (count[1], chosen.astype(np.int64), tokens[1], 1.0, a)):
                    taken = part[row]
                    out[at:to] = np.bincount(row - at, losses(c[own] - inside * taken, total - n[row] * taken, c[0] - taken, s, words, begin), to - at)
            at = to
        none, per = n == 0, np.maximum(n, 1)
        return pa.table({"doc_id": shards.ids_back(ids), "n_tokens": pa.array(n.astype(np.int64))} | {k: pa.array(x / per, mask=none) for k, x in (("target_loss", a), ("background_loss", b), ("score", a - b))})

    return blocks.unionByName(replies.select("block", "bucket", "payload")).groupBy("block").applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
