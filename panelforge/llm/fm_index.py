"""Substring dedup on words: an FM-index per shard, searched backwards over a wavelet tree.

A shard indexes the texts that share anchors (see shards.py) as one sequence of word numbers; an anchor with
very many texts is spread over shards by windows.  Documents' texts are streamed through it from their last word to the first: a backward step narrows the interval
of suffixes by the word before, and at the threshold the interval is widened again to all suffixes that
share a word less, so each word costs one step.  The interval's smallest doc_id tells whether the
window starts in an earlier document.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shards
from . import textkit as K

_ONE = np.uint64(1)


class Bits:
    """A bit vector with ranks: 64 bits to a word, and a count for each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, bool)]), bitorder="little")
        self.words = raw.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """A wavelet tree kept level by level; ranks of many symbols at many positions at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        x = symbols
        for d in range(self.depth - 1, -1, -1):
            bits = (x >> d & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(x) - bits.sum()))
            x = np.concatenate([x[~bits], x[bits]])
        self.origin = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            ones = self.levels[k].rank(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position."""
        return self._walk(symbol, at) - self.origin[symbol]


def ranks(symbols: np.ndarray, width: int) -> np.ndarray:
    """Rank of each position by the `width` symbols from there, equal ones alike; the end counts as symbol 0."""
    n = len(symbols)
    r, size = symbols.astype(np.int64), 1
    while size < width:
        step = min(size, width - size)
        later = np.concatenate([r[step:], np.zeros(min(step, n), np.int64)])[:n]
        r = np.unique(r * (int(r.max(initial=0)) + 1) + later, return_inverse=True)[1]
        size += step
    return r


class FMIndex:
    """Texts as word numbers 1, 2, ..., each closed by a 0, ordered to a depth of `width` words."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, width: int):
        n = len(symbols)
        size = int(symbols.max(initial=0)) + 1
        short = ranks(symbols, width - 1)
        last = np.concatenate([symbols[width - 1 :], np.zeros(min(width - 1, n), np.int64)])[:n]
        r = np.unique(short * size + last, return_inverse=True)[1]
        suffixes = np.argsort(r, kind="stable")
        self.width, self.n = width, n
        self.tree = Wavelet(symbols[suffixes - 1], size)
        counts = np.bincount(symbols, minlength=size)
        self.before = np.cumsum(counts) - counts
        # suffixes that share width - 1 words are neighbours; so are those that share `width`
        classes = np.bincount(short)
        self.end = np.cumsum(classes)
        self.begin = self.end - classes
        self.short_at, self.full_at = short[suffixes].astype(np.uint32), r[suffixes].astype(np.uint32)
        whole = np.bincount(r)
        self.least = np.minimum.reduceat(owner[suffixes], np.cumsum(whole) - whole) if n else owner

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.before[symbol]
        return base + self.tree.rank(symbol, lo), base + self.tree.rank(symbol, hi)

    def statistics(self, symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the streamed texts (no zeros; -1: no such word): how many of the following words match, `width` at most, and the smallest owner of a full match."""
        length = np.zeros(len(symbols), np.int64)
        owner = np.full(len(symbols), shards.NO_ID)
        lanes = np.flatnonzero(off[1:] > off[:-1]) if self.n else np.zeros(0, np.int64)
        lo, hi, depth = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n), np.zeros(len(lanes), np.int64)
        at = off[1:][lanes] - 1
        while len(lanes):
            s = symbols[at]
            a, b = self.back(np.maximum(s, 0), lo, hi)
            ok = (s >= 0) & (a < b)
            now = np.where(ok, depth + 1, 0)
            length[at] = np.maximum(length[at], now)
            full = now == self.width
            top = np.minimum(a, self.n - 1)
            owner[at[full]] = self.least[self.full_at[top[full]]]
            c = self.short_at[top]
            lo = np.where(full, self.begin[c], np.where(ok, a, 0))
            hi = np.where(full, self.end[c], np.where(ok, b, self.n))
            # a match that can't grow to the left loses its last word and begins anew
            again = ~ok & (s >= 0) & (depth > 0)
            at = np.where(again, at + depth - 1, at - 1)
            depth = np.minimum(now, self.width - 1)
            live = at >= off[:-1][lanes]
            lanes, at, lo, hi, depth = lanes[live], at[live], lo[live], hi[live], depth[live]
        return length, owner


@dataclass(frozen=True)
class Streamed:
    """The method of shards.Method: texts are streamed past an index of all of them; told: the smallest doc_id that has the window."""

    width: int
    size: int = 8 * K.PIECE

    def compare(self, buf, off, count, doc, copies):
        parts = []
        for _, _, x, o in K.pieces(buf, off):
            starts, ends, first = K.words(x, o)
            parts.append((K.name(x, starts, ends), np.diff(first)))
        names, sizes = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        number = np.unique(names, return_inverse=True)[1] + 1
        cut = np.concatenate([[0], np.cumsum(sizes)])
        # a 0 after each text
        index = FMIndex(np.insert(number, cut[1:], 0), np.repeat(doc, sizes + 1), self.width)
        length, owner = index.statistics(number, cut)
        own = np.repeat(np.arange(len(sizes)), sizes)
        # of a text with copies, those that belong to larger doc_ids lose what the smallest has itself
        found = np.flatnonzero((length == self.width) & ((owner < doc[own]) | copies[own]))
        text, start, least = own[found], found - cut[own[found]], owner[found]
        begin = np.concatenate([[0], np.flatnonzero((np.diff(text) != 0) | (np.diff(start) != 1) | (np.diff(least) != 0)) + 1, [len(found)]])
        begin = begin if len(found) else np.zeros(1, np.int64)
        return text[begin[:-1]], start[begin[:-1]], np.diff(begin), least[begin[:-1]]

    def split(self, buf, off, count):
        parts = []
        for a, _, x, o in K.pieces(buf, off):
            starts, ends, first = K.words(x, o)
            at = np.flatnonzero(K.in_document(first, self.width))
            text = np.searchsorted(first, at, "right") - 1
            names = K.sequence(K.name(x, starts, ends), at, np.full(len(at), self.width))
            parts.append((text + a, at - first[text], names, starts[at] - o[text], ends[at + self.width - 1] - o[text]))
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


def substring_dedup(docs: DataFrame, width: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Removes every word under a window of `width` words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (the kept words joined by a blank) and with keep the kept
    text.  Words are runs of bytes other than space and U+0009 to U+000D, compared by 64-bit names.  A
    null text has no words; a null doc_id is larger than any other, so such a document loses words to
    others only; rows with one doc_id don't lose words to each other; texts shorter than a window stay.
    """
    w = shards.Windows(width, gram, True)

    def finish(ids, buf, off, marked, _):
        row, start, count, least = marked
        row, start, count = (x[least < ids[row]] for x in (row, start, count))
        words = [(a, x, o, *K.words(x, o)) for a, _, x, o in K.pieces(buf, off)]
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[5]) for x in words]))]) if words else np.zeros(1, np.int64)
        gone = shards.covered(first, width, row, start, count)
        digests, texts = [], []
        for a, x, o, starts, ends, per in words:
            stay = np.flatnonzero(~gone[first[a] : first[a] + len(starts)])
            size = ends[stay] - starts[stay] + 1
            text = np.concatenate([x, [np.uint8(32)]])[K.spans(starts[stay], size)]
            cut = np.cumsum(size)
            text[cut - 1] = 32
            ends_at = np.concatenate([[0], cut])[np.searchsorted(stay, per)]
            view = memoryview(text)
            for i, j in zip(ends_at[:-1].tolist(), ends_at[1:].tolist(), strict=True):
                part = view[i : max(i, j - 1)]
                digests.append(hashlib.sha256(part).hexdigest())
                if keep:
                    texts.append(bytes(part).decode("utf-8"))
        lost = np.concatenate([[0], np.cumsum(gone)])
        columns = {"doc_id": shards.ids_back(ids), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(np.diff(lost[first])), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"text": pa.array(texts, pa.string())} if keep else {}))

    return shards.repeated(shards.documents(docs, id_col, text_col), w, True, Streamed(width), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if keep else ""))
