"""BPE encoding and decoding by speculation and verification.

Every distinct word piece is cut greedily into the longest vocabulary entries (all pieces side by side, as
numpy lanes).  A cut is the BPE result exactly if no merge would ever cross one of its inner borders, and
whether a merge crosses a border depends on the two tokens beside it alone; those pair checks run
vectorised over the distinct adjacent pairs.  Only pieces with a failing pair are merged exactly, by rank and
side by side; very long ones one by one with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import textkit as K

END = "</w>"
#: White space of the tokenizers' \s; Python's own has U+001C to U+001F besides.
_WHITE = "\t-\r \x85\xa0  -     　"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_FINAL = np.uint64(0xA5A5A5A55A5A5A5A)
_NONE = np.int64(2**62)
#: Bytes of text whose different words are encoded together.
BATCH = 1 << 19


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBPE:
    """A word BPE of the tokenizers library's JSON format: lower case, byte letters, word ends marked."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [""] * n
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)])
        self.last = np.array([vocab[letters[b] + END] for b in range(256)])
        # rank of the merge that makes a token and its two halves; -1: a letter
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if (i, j) not in self.merge:
                self.merge[i, j] = (r, k)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        codes = np.array([i << 32 | j for i, j in self.merge], np.int64)
        ranks, made = (np.array([m[k] for m in self.merge.values()], np.int64) for k in range(2))
        order = np.argsort(codes)
        self.codes, self.ranks, self.made = codes[order], ranks[order], made[order]
        # the entries that greedy matching may propose: those that BPE makes of their own text
        self.longest, entries = 1, {}
        for t, i in vocab.items():
            body, final = (t[: -len(END)], True) if t.endswith(END) and t != END else (t, False)
            if not body or any(c not in self.byte_of for c in body):
                continue
            raw = bytes(self.byte_of[c] for c in body)
            if self.exact(raw, final) == [i]:
                entries[raw, final] = i
                self.longest = max(self.longest, len(raw))
        raw = np.frombuffer(b"".join(r for r, _ in entries), np.uint8)
        ends = np.cumsum([len(r) for r, _ in entries])
        starts = np.concatenate([[0], ends[:-1]])
        names = K.rolled(K.prefix(raw), starts, ends) ^ np.where([f for _, f in entries], _FINAL, np.uint64(0))
        # the bytes of each token, to check what its name finds
        self.bytes_at, self.bytes_of = np.zeros((2, max(vocab.values()) + 1), np.int64), raw
        found = list(entries.values())
        self.bytes_at[0, found], self.bytes_at[1, found] = starts, ends - starts
        # an open hash table from name to id
        self.bits = 18
        self.slot_name = np.zeros(1 << self.bits, np.uint64)
        self.slot_id = np.full(1 << self.bits, -1, np.int64)
        todo, at = np.arange(len(names)), (names & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        ids = np.array(list(entries.values()))
        while len(todo):
            free = self.slot_id[at[todo]] < 0
            _, first = np.unique(at[todo], return_index=True)
            take = np.intersect1d(np.flatnonzero(free), first)
            self.slot_name[at[todo[take]]], self.slot_id[at[todo[take]]] = names[todo[take]], ids[todo[take]]
            todo = np.delete(todo, take)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.known: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, bool))

    def exact(self, raw: bytes, final: bool = True) -> list[int]:
        """The merges in order of rank, the leftmost first among equals; a heap holds the pairs that can merge."""
        out = [int(self.inner[b]) for b in raw]
        if final and out:
            out[-1] = int(self.last[raw[-1]])
        n = len(out)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge.get((out[i], out[j]))) is not None:
                heapq.heappush(heap, (m[0], i, out[i], out[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if out[i] != a or j >= n or out[j] != b:
                continue  # one of the two has merged since
            out[i], out[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in out if t >= 0]

    def exact_all(self, buf: np.ndarray, off: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exact() of many pieces side by side: ids one after the other, and how many each has."""
        size = off[lanes + 1] - off[lanes]
        count, parts = np.zeros(len(lanes), np.int64), []
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24)):
            own = np.flatnonzero((size > low) & (size <= high))
            if not len(own):
                continue
            col = np.arange(high)
            there = col < size[own, None]
            raw = buf[np.where(there, off[lanes[own], None] + col, 0)]
            token = np.where(there, np.where(col == size[own, None] - 1, self.last[raw], self.inner[raw]), -1)
            rank = self.pair_rank(token[:, :-1], token[:, 1:])[0]
            at, rows = rank.argmin(1), np.arange(len(own))
            live = np.flatnonzero(rank[rows, at] < _NONE)
            while len(live):
                j = at[live]
                token[live, j] = self.pair_rank(token[live, j], token[live, j + 1])[1]
                # what lies right of the pair moves one to the left
                move = np.minimum(col + (col > j[:, None]), high - 1)
                part = np.take_along_axis(token[live], move, 1)
                part[:, -1] = -1
                token[live] = part
                own_rank = np.take_along_axis(rank[live], move[:, :-1].clip(max=high - 2), 1)
                own_rank[:, -1] = _NONE
                k = np.arange(len(live))
                own_rank[k, np.minimum(j, high - 2)] = self.pair_rank(part[k, np.minimum(j, high - 2)], part[k, np.minimum(j, high - 2) + 1])[0]
                prior = np.maximum(j - 1, 0)
                own_rank[k, prior] = self.pair_rank(part[k, prior], part[k, prior + 1])[0]
                rank[live] = own_rank
                at[live] = own_rank.argmin(1)
                live = live[own_rank[k, at[live]] < _NONE]
            full = token >= 0
            count[own] = full.sum(1)
            parts.append((own, token[full]))
        long = np.flatnonzero(size > 24)
        if len(long):
            done = [self.exact(buf[off[k] : off[k + 1]].tobytes()) for k in lanes[long].tolist()]
            count[long] = [len(x) for x in done]
            parts.append((long, np.array([t for x in done for t in x], np.int64)))
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for own, tokens in parts:
            out[K.spans(begin[own], count[own])] = tokens
        return out, count

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair (_NONE: none) and what it makes."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = (self.codes[at] == code) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def lookup(self, names: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (names & np.uint64(mask)).astype(np.int64)
        out = self.slot_id[at]
        hit = self.slot_name[at] == names
        todo = np.flatnonzero(~hit & (out >= 0))
        out[~hit] = -1
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.slot_id[at[todo]]
            same = (self.slot_name[at[todo]] == names[todo]) & (found >= 0)
            out[todo[same]] = found[same]
            todo = todo[~same & (found >= 0)]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses the border between token a and token b.

        The tokens' own merges are undone from the last to the first; a merge across the border counts if
        it comes before the merge undone last: for the left token strictly, for the right one also at
        the same rank, as it lies further left.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), _NONE)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            code = x << 32 | y
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            crossing = np.where(self.codes[at] == code, self.ranks[at], _NONE)
            bad = crossing < limit[todo]
            good[todo[bad]] = False
            fx, fy = self.rank[x], self.rank[y]
            undo_x = fx > fy
            limit[todo] = np.where(undo_x, fx, fy + 1)
            a[todo] = np.where(undo_x, self.right[x], x)
            b[todo] = np.where(undo_x, y, self.left[y])
            todo = todo[~bad & (np.maximum(fx, fy) >= 0)]
        return good

    def checked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() with a memory of bounded size for pairs seen before."""
        code = a << 32 | b
        pairs, back = np.unique(code, return_inverse=True)
        seen, good = self.known
        at = np.minimum(np.searchsorted(seen, pairs), max(0, len(seen) - 1))
        old = seen[at] == pairs if len(seen) else np.zeros(len(pairs), bool)
        out = good[at] & old if len(seen) else np.zeros(len(pairs), bool)
        new = pairs[~old]
        out[~old] = self.compatible(new >> 32, new & 0xFFFFFFFF)
        if len(seen) + len(new) > 1 << 18:
            seen, good = seen[:0], good[:0]
        seen, good = np.concatenate([seen, new]), np.concatenate([good, out[~old]])
        order = np.argsort(seen)
        self.known = seen[order], good[order]
        return out[back]

    def encode_pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each piece, one after the other, and their offsets; pieces aren't empty."""
        n = len(off) - 1
        c = K.prefix(buf)
        at, end = off[:-1].copy(), off[1:]
        lane_of, ids_of, step_of = [], [], []
        lanes, step = np.arange(n), 0
        while len(lanes):
            p, e = at[lanes], end[lanes]
            token, size = np.full(len(lanes), -1, np.int64), np.zeros(len(lanes), np.int64)
            open_ = np.arange(len(lanes))
            for l in range(int(min(self.longest, (e - p).max())), 0, -1):
                try_ = open_[p[open_] + l <= e[open_]]
                if not len(try_):
                    continue
                to = p[try_] + l
                found = self.lookup(K.rolled(c, p[try_], to) ^ np.where(to == e[try_], _FINAL, np.uint64(0)))
                hit = found >= 0
                token[try_[hit]], size[try_[hit]] = found[hit], l
                open_ = open_[token[open_] < 0]
                if not len(open_):
                    break
            lane_of.append(lanes)
            ids_of.append(token)
            step_of.append(np.full(len(lanes), step))
            at[lanes] += size
            lanes = lanes[at[lanes] < end[lanes]]
            step += 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        lane, ids = np.concatenate(lane_of), np.concatenate(ids_of)
        order = np.argsort(lane, kind="stable")
        lane, ids = lane[order], ids[order]
        border = np.flatnonzero(lane[1:] == lane[:-1])
        bad = border[~self.checked(ids[border], ids[border + 1])]
        failing = np.unique(np.concatenate([lane[bad], self.misread(buf, off, lane, ids)]))
        self.failed = len(failing)
        counts = np.bincount(lane, minlength=n)
        if len(failing):
            redo, redo_counts = self.exact_all(buf, off, failing)
            counts_new = counts.copy()
            counts_new[failing] = redo_counts
            out_off = np.concatenate([[0], np.cumsum(counts_new)])
            out = np.empty(out_off[-1], np.int64)
            keep = np.ones(n, bool)
            keep[failing] = False
            rows = np.flatnonzero(keep)
            old = np.cumsum(counts) - counts
            out[K.spans(out_off[rows], counts[rows])] = ids[K.spans(old[rows], counts[rows])]
            out[K.spans(out_off[failing], redo_counts)] = redo
            return out, out_off
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def misread(self, buf: np.ndarray, off: np.ndarray, lane: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Pieces whose tokens don't spell them, as a name stood for other bytes."""
        begin, size = self.bytes_at[:, ids]
        spelled = self.bytes_of[K.spans(begin, size)]
        whole = np.bincount(lane, size, len(off) - 1).astype(np.int64) == np.diff(off)
        if not whole.all():
            return np.arange(len(off) - 1)
        return np.unique(np.searchsorted(off, np.flatnonzero(spelled != buf[off[0] : off[-1]]), "right") - 1)

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets for texts without line feeds; special tokens inside a text are found as such."""
        joined = "\n".join(texts)
        if self.special and any(s in joined for s in self.special):
            split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            parts = [split.split(t) for t in texts]
        else:
            parts = None
        if parts is None:
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower()
            found = [_PIECES.findall(line) for line in joined.split("\n")] if texts else []
            flat = [p for line in found for p in line]
            per = np.array([len(line) for line in found], np.int64)
            ids, off = self._pieces(flat)
            ends = np.concatenate([[0], np.cumsum(per)])
            return ids, off[ends]
        plain = [p for t in parts for p in t[::2]]
        ids, off = WordBPE.encode_words(_Plain(self), plain)
        out, ends, k = [], [0], 0
        for t in parts:
            for j, p in enumerate(t):
                if j % 2:
                    out.append(np.array([self.special[p]]))
                else:
                    out.append(ids[off[k] : off[k + 1]])
                    k += 1
            ends.append(sum(map(len, out[-len(t) :])))
        return np.concatenate(out), np.cumsum(ends)

    def _pieces(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not flat:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        data, off = K.flat(pa.array(flat, pa.large_string()))
        return self.encode_pieces(data, off)

    def encode(self, text: str | None) -> list[int]:
        ids, _, _ = self.encode_batch(pa.array([text or ""]))
        return ids.tolist()

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids, their offsets by text, and the decoded texts."""
        ids, shown, first = self.blobs(column)
        data, off = K.flat(ids)
        text, cut = K.flat(shown)
        cut = cut[first].tolist()
        texts = [text[a : max(a, b - 1)].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        return np.frombuffer(data.tobytes(), np.uint32), off[first] // 4, texts

    def blobs(self, column: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Of every word of every text: its ids as bytes, its tokens each with a blank after it; words before each text."""
        buf, off = K.flat(column)
        starts, ends, first = K.words(buf, off)
        if not len(starts):
            return pa.array([], pa.large_binary()), pa.array([], pa.large_binary()), first
        _, pick, back = np.unique(K.name(buf, starts, ends), return_index=True, return_inverse=True)
        alike = same_bytes(buf, starts, ends, pick[back])
        if not alike.all():
            # words that share a name with others stand for themselves
            pick, back[~alike] = np.concatenate([pick, np.flatnonzero(~alike)]), len(pick) + np.arange(int((~alike).sum()))
        lengths = ends[pick] - starts[pick]
        raw = buf[K.spans(starts[pick], lengths)].tobytes()
        cut = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
        ids, ends_ = self.encode_words(texts)
        id_bytes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((ends_ * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.astype(np.uint32).tobytes())])
        if not hasattr(self, "shown"):
            self.shown = K.flat(pa.array([t + " " for t in self.text], pa.large_string()))
        data, at = self.shown
        sizes = (at[1:] - at[:-1])[ids]
        shown = data[K.spans(at[:-1][ids], sizes)]
        shown_off = np.concatenate([[0], np.cumsum(sizes)])[ends_]
        shown_bytes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(shown_off.astype(np.int64).tobytes()), pa.py_buffer(shown.tobytes())])
        take = pa.array(back)
        return pc.take(id_bytes, take), pc.take(shown_bytes, take), first

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, parted by blanks; unknown ids are left out."""
        return " ".join(self.text[i] for i in ids if 0 <= i < len(self.text) and self.text[i])


def same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span `other`."""
    size = ends - starts
    out = size == size[other]
    rows = np.flatnonzero(out & (other != np.arange(len(starts))))
    at = 0
    total = np.cumsum(size[rows])
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + K.PIECE, "right")))
        q = rows[at:to]
        differs = buf[K.spans(starts[q], size[q])] != buf[K.spans(starts[other[q]], size[q])]
        if differs.any():
            out[q[np.unique(np.searchsorted(np.cumsum(size[q]), np.flatnonzero(differs), "right"))]] = False
        at = to
    return out


class _Plain:
    """The same model without special tokens."""

    def __init__(self, model: WordBPE):
        self.special: dict[str, int] = {}
        self._pieces = model._pieces


_MODELS: dict[str, WordBPE] = {}


def model(spec: str) -> WordBPE:
    """The model of this process, built once."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = WordBPE(spec)
    return _MODELS[key]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep, the ids and the decoded text.  A
    null or empty text has no tokens; a null doc_id stays null; repeated rows stay repeated; other columns
    are left out.  path: a tokenizer file on the driver, sent to the executors as text (its size is fixed).
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(spec)
        for batch in batches:
            off = K.flat(batch.column(1))[1]
            at = 0
            while at < len(off) - 1:
                to = max(at + 1, int(np.searchsorted(off, off[at] + BATCH, "right")) - 1)
                yield _encoded(bpe, batch.slice(at, to - at), keep)
                at = to
            del batch  # before the next one is read

    kept = ", ids array<int>, decoded string" if keep else ""
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + kept)


def _encoded(bpe: WordBPE, batch: pa.RecordBatch, keep: bool) -> pa.RecordBatch:
    ids, shown, first = bpe.blobs(batch.column(1))
    data, off = K.flat(ids)
    text, cut = K.flat(shown)
    off, cut = off[first], cut[first]
    data, text = memoryview(data), memoryview(text)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    a, b = off.tolist(), cut.tolist()
    rows = range(len(a) - 1)
    columns = [
        batch.column(0).cast(pa.int64()),
        pa.array((off[1:] - off[:-1]) // 4),
        pa.array([sha(data[a[k] : a[k + 1]]) for k in rows], pa.string()),
        pa.array([sha(text[b[k] : max(b[k], b[k + 1] - 1)]) for k in rows], pa.string()),
    ]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep:
        columns += [pa.array([np.frombuffer(data[a[k] : a[k + 1]], np.uint32).astype(np.int32) for k in rows], pa.list_(pa.int32())), pa.array([bytes(text[b[k] : max(b[k], b[k + 1] - 1)]).decode() for k in rows], pa.string())]
        names += ["ids", "decoded"]
    return pa.RecordBatch.from_arrays(columns, names)
