"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of `match` words (a seed) are compared: running Karp-Rabin
looks for common runs by rolling names of a search length, which falls from long to short; the longest runs
that don't overlap are marked as tiles, again and again, until none of `match` words is left.  The part of
the item under tiles tells a leak, in whatever order its passages stand in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Bytes of benchmark text that are sent to the executors at a time; larger benchmarks take several passes.
BLOCK = 32 << 20
#: Hits of seeds that are looked at together.
HITS = 1 << 20


def names_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words, without case and punctuation, and words before each text."""
    out, per = [], []
    for _, _, x, o in K.pieces(buf, off):
        x = K.folded(x)
        starts, ends, first = K.words(x, o, K.MARKS)
        out.append(K.name(x, starts, ends))
        per.append(np.diff(first))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(per))])


def tiles(item: np.ndarray, text: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length) of two sequences of names, longest first; ties go to the earlier start in the item, then in the text."""
    free_a, free_b = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    size = max(match, min(len(item), len(text)))
    while True:
        # runs of `size` free words, by rolling names, drawn out as far as they go
        found: list[tuple[int, int, int]] = []
        ga, gb = K.grams(item, size), K.grams(text, size)
        oa, ob = np.flatnonzero(_free(free_a, size)), np.flatnonzero(_free(free_b, size))
        order = ob[np.argsort(gb[ob], kind="stable")]
        lo, hi = np.searchsorted(gb[order], ga[oa], "left"), np.searchsorted(gb[order], ga[oa], "right")
        for i, a, b in zip(oa.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for j in order[a:b].tolist():
                n = 0
                while i + n < len(item) and j + n < len(text) and free_a[i + n] and free_b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n >= size:
                    found.append((n, i, j))
        longest = max((n for n, _, _ in found), default=0)
        for n, i, j in sorted(x for x in found if x[0] == longest):
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((i, j, n))
        if not found:
            if size == match:
                return out
            size = max(match, size // 2)


def _free(free: np.ndarray, size: int) -> np.ndarray:
    if len(free) < size:
        return np.zeros(0, bool)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[size:] == taken[: len(free) - size + 1]


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = 4, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, tiled_words for each document and item of which `coverage` or more lies under tiles.

    Words are compared without case (ASCII and Latin-1) and punctuation.  Null or empty texts and items of fewer
    than `match` words are never reported; null ids stay null; repeated documents and items are reported
    each.  The benchmark is sent in blocks of BLOCK bytes, by hash of its text, one pass each.
    """
    out = None
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for sent in _blocks(benchmark, match, item_col, item_text):
        found = texts.mapInArrow(_finder(sent, match, coverage), "doc_id long, item_id long, coverage double, n_tiles long, tiled_words long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, n_tiles long, tiled_words long")


def clean(docs: DataFrame, benchmark: DataFrame, match: int = 4, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that leaks() finds no item in; rows are looked at one by one, whatever their ids."""
    for sent in _blocks(benchmark, match, item_col, item_text):
        docs = docs.where(_leaks_nothing(sent, match, coverage)(F.col(text_col).cast("string")))
    return docs


def _leaks_nothing(sent, match: int, coverage: float):
    @F.arrow_udf("boolean")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.ones(len(texts), bool)
            out[[r[0] for r in _found(sent.value, *names_of(*K.flat(texts)), match, coverage)]] = False
            yield pa.array(out)

    return rate


def _blocks(benchmark: DataFrame, match: int, item_col: str, item_text: str) -> Iterator:
    """The benchmark as broadcasts of about BLOCK bytes."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // BLOCK) or 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        if rows:
            yield spark.sparkContext.broadcast(_Items([r.item for r in rows], [r.text for r in rows], match))


class _Items:
    """A block of the benchmark: names of words, and its seeds sorted by name with item and place."""

    def __init__(self, ids: list, texts: list[str], match: int):
        self.ids = ids
        self.names, self.first = names_of(*K.flat(pa.array(texts, pa.large_string())))
        g = K.grams(self.names, match)
        at = np.flatnonzero(K.in_document(self.first, match))
        order = at[np.argsort(g[at], kind="stable")]
        self.seed, self.place = g[order], order
        self.item = np.searchsorted(self.first, order, "right") - 1
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True


def _found(own: _Items, names: np.ndarray, first: np.ndarray, match: int, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, coverage, tiles, words under them) of the texts that leak an item."""
    sizes = np.diff(own.first)
    if not len(own.seed) or len(names) < match:
        return
    g = K.grams(names, match)
    at = np.flatnonzero(own.bits[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
    at = at[K.in_document(first, match)[at]]
    lo, hi = np.searchsorted(own.seed, g[at], "left"), np.searchsorted(own.seed, g[at], "right")
    at, lo, times = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    whole = np.cumsum(times)
    begin = np.searchsorted(first, at, "right") - 1
    cut = K.runs(begin)
    at_ = 0
    while at_ < len(cut) - 1:
        # some texts at a time, so that their hits are bounded unless one text alone has more
        base = whole[cut[at_] - 1] if cut[at_] else 0
        to = max(at_ + 1, int(np.searchsorted(whole[cut[1:] - 1], base + HITS, "right")))
        q = slice(cut[at_], cut[to])
        yield from _pairs(own, sizes, names, first, np.repeat(at[q], times[q]), K.spans(lo[q], times[q]), match, coverage)
        at_ = to


def _pairs(own: _Items, sizes: np.ndarray, names: np.ndarray, first: np.ndarray, where: np.ndarray, seed: np.ndarray, match: int, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    doc, item, place = np.searchsorted(first, where, "right") - 1, own.item[seed], own.place[seed]
    order = np.lexsort((where, item, doc))
    doc, item, place, where = doc[order], item[order], place[order], where[order]
    cut = K.runs(doc * len(sizes) + item)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        k = int(item[i])
        # seeds cover at least what tiles can
        under = np.zeros(sizes[k], bool)
        begin = np.unique(place[i:j]) - own.first[k]
        for n in range(match):
            under[begin + n] = True
        if under.sum() < coverage * sizes[k]:
            continue
        # the parts of the document under seeds, parted by names that occur in no item
        spots = np.unique(where[i:j])
        spots = np.unique(np.concatenate([spots + n for n in range(match)]))
        gap = np.flatnonzero(np.diff(spots) > 1) + 1
        part = np.insert(names[spots], gap, np.uint64(0))
        found = tiles(own.names[own.first[k] : own.first[k + 1]], part, match)
        words = sum(n for _, _, n in found)
        if words >= coverage * sizes[k]:
            yield int(doc[i]), k, words / int(sizes[k]), len(found), words


def _finder(sent, match: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            doc_ids, (names, first) = batch.column(0), names_of(*K.flat(batch.column(1)))
            del batch  # before the next one is read
            cols = list(zip(*_found(own, names, first, match, coverage), strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(([own.ids[k] for k in cols[1]], *cols[2:]), kinds, strict=True))], ["doc_id", "item_id", "coverage", "n_tiles", "tiled_words"])

    return run
