"""Substring dedup on bytes by prefix doubling.

Positions are named by the bytes that follow them, and names of twice the length come from sorting the pairs
(name here, name `offset` further on) and ranking the distinct pairs; positions whose rank is unique drop out,
and the doubling ends past the threshold.  Spark deals the positions out: first by the anchors of their
windows (see shards.py), where unique ones drop out at once, then those that are left go by anchor to
shards, in which the rounds sort.  Strings that are equal over the whole threshold share an anchor, so no round
needs a position of another shard.  Positions of an anchor with very many contents go by their rank
pair instead, each to the task that sorts it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shards
from . import textkit as K


def doubling(names: np.ndarray, off: np.ndarray, count: np.ndarray, reach: int, levels: tuple[int, ...], weight: np.ndarray) -> list[np.ndarray]:
    """For each of the lengths `levels`, the windows whose string of that length occurs twice.

    names: of the `reach` bytes from each position on (any value near a text's end).  Windows are the first
    `count` positions of a text.  weight: how often a text occurs.
    """
    n = len(names)
    own = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    left = (off[1:][own] - np.arange(n)).astype(np.int32)
    alive = (np.arange(n) - off[:-1][own] < count[own]) & (left >= levels[0])
    rank = np.full(n, -1, np.int64)
    at = np.flatnonzero(left >= reach)
    rank[at] = np.unique(names[at], return_inverse=True)[1]
    out = []

    def twice() -> np.ndarray:
        w = np.flatnonzero(alive & (left >= reach))
        return w[np.bincount(rank[w], weight[own[w]], int(rank.max(initial=0)) + 1)[rank[w]] > 1]

    for level in levels:
        while reach < level:
            step = min(reach, level - reach)
            # what is unique so far stays so; texts without another window are done
            keep = twice()
            alive = np.zeros(n, bool)
            alive[keep] = True
            open_ = np.zeros(len(off) - 1, bool)
            open_[own[keep]] = True
            at = np.flatnonzero(open_[own] & (left >= reach + step))
            pair = rank[at] * (int(rank.max(initial=0)) + 1) + rank[at + step]
            rank = np.full(n, -1, np.int64)
            rank[at] = np.unique(pair, return_inverse=True)[1]
            reach += step
        keep = twice()
        alive = np.zeros(n, bool)
        alive[keep] = True
        out.append(keep)
    return out


@dataclass(frozen=True)
class Doubling:
    """The method of shards.Method: windows that repeat over each of the lengths `levels`; told: which of them."""

    levels: tuple[int, ...]
    reach: int
    size: int = 2 * K.PIECE

    def compare(self, buf, off, count, doc, copies):
        names = np.zeros(len(buf), np.uint64)
        for a, _, x, _ in K.pieces(buf, off):
            found = K.every(x, self.reach)
            names[off[a] : off[a] + len(found)] = found
        parts = []
        for level, at in enumerate(doubling(names, off, count, self.reach, self.levels, 1.0 + copies)):
            text = np.searchsorted(off, at, "right") - 1
            start = at - off[text]
            begin = np.concatenate([[0], np.flatnonzero((np.diff(text) != 0) | (np.diff(start) != 1)) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
            parts.append((text[begin[:-1]], start[begin[:-1]], np.diff(begin), np.full(len(begin) - 1, level)))
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))

    def split(self, buf, off, count):
        parts = []
        for a, _, x, o in K.pieces(buf, off):
            for level, size in enumerate(self.levels):
                one, two = K.every(x, size // 2), K.every(x, size - size // 2)
                number = np.maximum(np.minimum(count[a : a + len(o) - 1], np.diff(o) - size + 1), 0)
                at = K.spans(o[:-1], number)
                text = np.repeat(np.arange(len(number)), number)
                parts.append((text + a, at - o[text], np.full(len(at), level), one[at], two[at + size // 2]))
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


def suffix_dedup(docs: DataFrame, width: int = 400, gram: int = 50, report: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every byte under a string of `width` bytes that also starts anywhere else, in any document.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with report (less than
    width) also n_repeated, the bytes under strings of `report` bytes that start elsewhere too, of which none
    are removed for that; with keep "bytes" also the kept bytes, with "text" a text of them, in which what is
    left of a character cut in two is dropped; carry: other columns that stay with their row.  A null text is empty; a null doc_id stays null; repeated rows
    are copies of each other and so lose all bytes if there are `width` of them; strings that overlap count;
    texts shorter than `width` stay.  gram: bytes of an anchor, less than half of the shortest strings.
    """
    levels = (report, width) if report else (width,)
    w = shards.Windows(levels[0], gram, False, width - levels[0])

    def finish(ids, buf, off, marked, tags):
        row, start, count, level = marked
        gone, *rest = (shards.covered(off, levels[k], *(x[level == k] for x in (row, start, count))) for k in reversed(range(len(levels))))
        lost = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = off[:-1][np.diff(off) > 0]
        begins[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept, cut = memoryview(buf[~gone]), (off - lost[off]).tolist()
        parts = [kept[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        columns = {"doc_id": shards.ids_back(ids), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(lost[off])), "n_spans": pa.array(np.diff(spans[off])), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())}
        for x in rest:
            columns["n_repeated"] = pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[off]))
        if keep == "bytes":
            columns["kept"] = pa.array([bytes(x) for x in parts], pa.binary())
        elif keep:
            columns["text"] = pa.array([bytes(x).decode("utf-8", "ignore") for x in parts], pa.string())
        if carry:
            columns["tag"] = tags
        return pa.table(columns)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(report) + {None: "", "bytes": ", kept binary", "text": ", text string"}[keep] + ", tag string" * bool(carry)
    out = shards.repeated(shards.documents(docs, id_col, text_col, carry), w, False, Doubling(levels, max(gram, levels[0] // 2)), finish, schema)
    if not carry:
        return out
    kinds = StructType([f for f in docs.select(*carry).schema.fields])
    return out.withColumn("tag", F.from_json("tag", kinds)).select(*(c for c in out.columns if c != "tag"), *(F.col("tag")[c].alias(c) for c in carry))
