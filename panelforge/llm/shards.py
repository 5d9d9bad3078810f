"""Finding repeated windows of long texts over many machines without a row for each window.

A window is `width` consecutive items of one document (bytes or words).  Each window has an anchor: the
run of `gram` items inside it with the smallest name, the leftmost of equals.  The choice depends on
nothing but the window, so equal windows have equal anchors; neighbouring windows mostly share one, and the
windows of one anchor occurrence make a chunk, named by its whole content.

1. survey   every chunk's anchor and content go to the buckets of their names, summed up by block before;
2. replies  the buckets tell each block which of its anchors occur elsewhere too, and which of its contents;
            windows of other anchors are unique and drop out here;
3. letters  blocks send every content of the anchors that are left to the anchor's bucket: one block its text,
            the others that have it the name alone.  An anchor with more than HOT contents is dealt out window
            by window, so that no anchor has to be held by one task;
4. answers  a bucket compares the windows of its texts by the caller's method, and answers all who asked;
5. marks    blocks put the answers to their chunks.

A block is a set of documents by hash (about BLOCK bytes), a bucket one of names; both counts grow with the
input, so that neither outgrows a task.  A hot passage, line or group of copies adds at most a row for each block
and name.  Nothing is collected to the driver.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

#: Bytes of text for a block, and for which a bucket takes the anchors.
BLOCK, BUCKET = 4 << 20, 8 << 20
#: Stands for a null doc_id: larger than any other.
NO_ID = np.int64(2**63 - 1)
#: Documents are cut into overlapping segments of so many bytes before windows are sought.
SEGMENT = 8 << 20
#: Contents of one anchor beyond which their windows are dealt out.
HOT = 4096
#: Partial sums of tables of a fixed size are added by so many groups of tasks, and then those sums.
FAN = 256
_LOW = np.uint64(0xFFFFFFFF)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir; a temporary one in local mode if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when their action ends, and not with the next collection of the driver's garbage."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that a lost executor loses none."""
    shared_folder(df.sparkSession)
    with swept(df.sparkSession):
        # a plan of its own, as the setting counts when a plan is made
        return df.select("*").checkpoint(eager=True)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; carry: columns that go along as JSON in `tag`."""
    tag = [F.to_json(F.struct(*carry)).alias("tag")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *tag)


@dataclass(frozen=True)
class Plan:
    blocks: int
    buckets: int


def plan(docs: DataFrame) -> Plan:
    """From the total size; one pass over the texts' lengths."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return Plan(max(parts, math.ceil(size / BLOCK)), max(parts, math.ceil(size / BUCKET)))


def with_block(docs: DataFrame, p: Plan, spread: bool = False) -> DataFrame:
    """spread: rows of one doc_id needn't share a block."""
    by = F.xxhash64("doc_id", "text") if spread else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.pmod(by, F.lit(p.blocks)).cast("int").alias("block"), *docs.columns)


def packed(docs: DataFrame, p: Plan, spread: bool = False) -> DataFrame:
    """(block, payload): the documents of a block in compressed parcels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            block = np.array(batch.column(0), np.int64)
            ids = ids_of(batch.column(1))
            buf, off = K.flat(batch.column(2))
            tags, tag_off = K.flat(batch.column(3)) if batch.num_columns > 3 else (buf, np.zeros(len(off), np.int64))
            size, tag_size = off[1:] - off[:-1], tag_off[1:] - tag_off[:-1]
            order = np.argsort(block, kind="stable")
            cut = K.runs(block[order])
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows = order[a:b]
                raw = np.int64(len(rows)).tobytes() + ids[rows].tobytes() + size[rows].tobytes() + tag_size[rows].tobytes() + tags[K.spans(tag_off[rows], tag_size[rows])].tobytes() + b"".join(buf[off[r] : off[r + 1]].tobytes() for r in rows)
                out.append(np.int64(len(raw)).tobytes() + codec.compress(raw, asbytes=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(block[order][cut[:-1]], pa.int32()), pa.array(out, pa.binary())], ["block", "payload"])
            del batch, buf, off, tags, out  # before the next batch is read

    return with_block(docs, p, spread).mapInArrow(run, "block int, payload binary")


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def unpacked(payloads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes and offsets of a block, in an order that depends on the documents alone."""
    return opened(payloads)[:3]


def opened(payloads) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """unpacked(), and the tags."""
    codec = pa.Codec("zstd")
    ids, sizes, texts, tag_sizes, tags = [], [], [], [], []
    for x in payloads:
        x = x.as_buffer()
        total = int(np.frombuffer(x, np.int64, 1)[0])
        raw = codec.decompress(x.slice(8), total)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids.append(np.frombuffer(raw, np.int64, n, 8))
        sizes.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
        tag_sizes.append(np.frombuffer(raw, np.int64, n, 8 + 16 * n))
        at = 8 + 24 * n + int(tag_sizes[-1].sum())
        tags.append(np.frombuffer(raw, np.uint8, at - 8 - 24 * n, 8 + 24 * n))
        texts.append(np.frombuffer(raw, np.uint8, -1, at))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), pa.array([], pa.string())
    ids, sizes, buf, tag_size, tag = (np.concatenate(x) for x in (ids, sizes, texts, tag_sizes, tags))
    off = np.concatenate([[0], np.cumsum(sizes)])
    order = np.lexsort((sizes, ids))
    same = np.flatnonzero((ids[order][1:] == ids[order][:-1]) & (sizes[order][1:] == sizes[order][:-1]))
    if len(same):
        # ids that occur again are rare; the digests of their texts decide
        rows = np.unique(order[np.concatenate([same, same + 1])])
        digests = np.zeros(len(ids), "S16")
        digests[rows] = [hashlib.blake2b(buf[off[k] : off[k + 1]].tobytes(), digest_size=16).hexdigest()[:16].encode() for k in rows.tolist()]
        order = np.lexsort((digests, sizes, ids))
    buf, tag = buf[K.spans(off[order], sizes[order])], tag[K.spans((np.cumsum(tag_size) - tag_size)[order], tag_size[order])]
    ends = np.concatenate([[0], np.cumsum(tag_size[order])]).astype(np.int32)
    shown = pa.StringArray.from_buffers(len(ids), pa.py_buffer(ends.tobytes()), pa.py_buffer(tag.tobytes()))
    return ids[order], buf, np.concatenate([[0], np.cumsum(sizes[order])]), shown


@dataclass
class Chunks:
    """Of each chunk: names of anchor and content, row of the document, first window and their number (in items of the document), bytes."""

    anchor: np.ndarray
    content: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @staticmethod
    def join(parts: list[Chunks]) -> Chunks:
        kinds = (np.uint64, np.uint64, *[np.int64] * 5)
        return Chunks(*(np.concatenate([getattr(p, f) for p in parts]) if parts else np.zeros(0, k) for f, k in zip(Chunks.__dataclass_fields__, kinds, strict=True)))

    def take(self, rows: np.ndarray) -> Chunks:
        return Chunks(*(getattr(self, f)[rows] for f in Chunks.__dataclass_fields__))


@dataclass(frozen=True)
class Windows:
    """Windows of `width` items; anchors are runs of `gram` items.  words: items are words, else bytes.  more: items after its last window that a chunk's content has too, where the text has them."""

    width: int
    gram: int
    words: bool
    more: int = 0

    def chunks(self, buf: np.ndarray, off: np.ndarray) -> Chunks:
        out = []
        for a, b, x, o in K.pieces(buf, off):
            if b - a == 1 and len(x) > SEGMENT:
                out += self._long(x, a)
            else:
                out.append(self._piece(x, o, a))
        return Chunks.join(out)

    def _long(self, x: np.ndarray, row: int) -> list[Chunks]:
        """Segments that overlap, so that each window lies in one of them with all that belongs to it."""
        out, at, reach = [], 0, self.width + self.more
        starts, ends = K.words(x, np.array([0, len(x)]))[:2] if self.words else (np.arange(len(x)), None)
        while at < len(starts) - self.width + 1:
            if ends is None:
                stop = min(len(x), at + max(SEGMENT, reach))
                lo, hi = at, stop
            else:
                stop = min(len(starts), max(at + reach, int(np.searchsorted(ends, starts[at] + SEGMENT))))
                lo, hi = int(starts[at]), int(ends[stop - 1])
            # the windows before this one are whole here
            upto = stop - reach + 1 if stop < len(starts) else stop
            c = self._piece(x[lo:hi], np.array([0, hi - lo]), row, upto - at)
            c.start += at
            c.lo += lo
            c.hi += lo
            out.append(c)
            at = upto
        return out

    def _piece(self, x: np.ndarray, o: np.ndarray, row: int, limit: int | None = None) -> Chunks:
        if self.words:
            starts, ends, first = K.words(x, o)
            names = K.name(x, starts, ends)
            grams = K.grams(names, self.gram)
        else:
            first, grams = o, K.every(x, self.gram)
        if int(first[-1]) < self.width:
            return Chunks.join([])
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        least = K.window_min(key, self.width - self.gram + 1)
        where = np.flatnonzero(K.in_document(first, self.width)[:limit])
        if not len(where):
            return Chunks.join([])
        at = (least[where] & _LOW).astype(np.int64)
        # a chunk ends where the anchor or the document changes
        cut = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)) + 1, [len(at)]])
        begin, count, anchor = where[cut[:-1]], np.diff(cut), grams[at[cut[:-1]]]
        doc = np.searchsorted(first, begin, "right") - 1
        stop = np.minimum(begin + count - 1 + self.width + self.more, first[1:][doc])
        content = K.sequence(names, begin, stop - begin) if self.words else K.sequence(grams, begin, stop - begin - self.gram + 1, self.gram)
        content = K.joined(content, anchor + count.astype(np.uint64))
        lo, hi = (starts[begin], ends[stop - 1]) if self.words else (begin, stop)
        return Chunks(anchor, content, doc + row, begin - first[doc], count, lo - o[doc], hi - o[doc])


class Method(Protocol):
    """How the windows of texts that share an anchor are compared, texts of about `size` bytes at a time."""

    size: int

    def compare(self, buf: np.ndarray, off: np.ndarray, count: np.ndarray, doc: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
        """Repeated windows as runs (index of the text, first window, number, what the caller wants to know of them).

        count: windows of each text; doc: the smallest doc_id that has it; copies: whether it occurs more than once.
        """

    def split(self, buf: np.ndarray, off: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows one by one: text, window, name, and the bytes from and to; or, where the texts needn't travel, text, window, level and two names."""


def survey(docs: DataFrame, p: Plan, w: Windows, across: bool) -> DataFrame:
    """(bucket, payload): of anchors, and from p.buckets on of contents, how often each occurs in a block, and (across) the smallest doc_id with whether there are others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, ids = np.array(batch.column(0), np.int64), ids_of(batch.column(1))
            c = w.chunks(*K.flat(batch.column(2)))
            del batch  # before the next one is read
            if not len(c.anchor):
                continue
            at, doc = block[c.row], ids[c.row]
            salt = K.mix(at.astype(np.uint64) + np.uint64(1))
            buckets, out = [], []
            for base, name in ((0, c.anchor), (p.buckets, c.content)):
                order = np.argsort(name + salt, kind="stable")
                cut = K.runs((name + salt)[order])
                pick = order[cut[:-1]]
                bucket = ((name[pick] & _LOW) % np.uint64(p.buckets)).astype(np.int64) + base
                own = np.argsort(bucket * p.blocks + at[pick], kind="stable")
                columns = {"name": name[pick], "block": at[pick].astype(np.uint32), "count": np.minimum(np.diff(cut), 2**31 - 1).astype(np.uint32)}
                if across:
                    low, top = np.minimum.reduceat(doc[order], cut[:-1]), np.maximum.reduceat(doc[order], cut[:-1])
                    columns |= {"doc": low, "more": top != low}
                begin = K.runs(bucket[own])
                out += [K.pack(**{k: v[own[i:j]] for k, v in columns.items()}) for i, j in zip(begin[:-1], begin[1:], strict=True)]
                buckets.append(bucket[own][begin[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets), pa.int32()), pa.array(out, pa.binary())], ["bucket", "payload"])

    return with_block(docs.select("doc_id", "text"), p, True).mapInArrow(run, "bucket int, payload binary")


#: Arrays of a reply's payload (anchors: name and MANY; contents: name, KEEPER and smallest doc_id), of a letter's head (texts, or pairs of names), and of an answer's.
ANCHOR, CONTENT = [np.uint64, np.uint8], [np.uint64, np.uint8, np.int64]
TEXT = [np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.int64, np.uint8]
PAIR = [np.uint64, np.uint64, np.uint64, np.uint32, np.uint8, np.uint8]
ANSWER = [np.uint64, np.uint32, np.uint32, np.int64]
MANY, KEEPER = 1, 1


def replies(surveyed: DataFrame, p: Plan, across: bool) -> DataFrame:
    """(block, kind, payload): the anchors of a block that occur elsewhere too (kind 0), and its contents that do (kind 1), with the block that sends the text."""
    hot = HOT

    def run(table: pa.Table) -> pa.Table:
        kind = int(table["bucket"][0].as_py() >= p.buckets)
        name, block, count, *rest = K.unpack_all(table["payload"], [np.uint64, np.uint32, np.uint32] + [np.int64, np.bool_] * across)
        doc = rest[0] if across else np.zeros(len(name), np.int64)
        order = np.lexsort((block, doc, name))
        name, block, doc = name[order], block[order], doc[order]
        cut = K.runs(name)
        of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        total = np.add.reduceat(count[order].astype(np.int64), cut[:-1])
        wide = total > 1
        if kind == 0 and across:
            wide = np.logical_or.reduceat(rest[1][order], cut[:-1]) | (doc[cut[:-1]] != doc[cut[1:] - 1])
        flag = (total > hot)[of] * MANY if kind == 0 else np.zeros(len(name), np.int64)
        if kind:
            flag[cut[:-1]] = KEEPER
        first = doc[cut[:-1]][of]
        keep = np.flatnonzero(wide[of])
        keep = keep[np.argsort(block[keep], kind="stable")]
        cut = K.runs(block[keep])
        out = [K.pack(name=name[q], flag=flag[q].astype(np.uint8), **({"doc": first[q]} if kind else {})) for i, j in zip(cut[:-1], cut[1:], strict=True) for q in [keep[i:j]]]
        return pa.table({"block": pa.array(block[keep][cut[:-1]], pa.int32()), "kind": pa.array(np.full(len(out), kind), pa.int32()), "payload": pa.array(out, pa.binary())})

    return surveyed.groupBy("bucket").applyInArrow(run, "block int, kind int, payload binary")


def replied(told: pa.Table) -> tuple[np.ndarray, ...]:
    """A block's replies: anchors and their flags, contents with their flags and doc_ids, sorted by name."""
    kind, out = np.array(told["kind"], np.int64), []
    for k, kinds in enumerate((ANCHOR, CONTENT)):
        name, flag, *doc = K.unpack_all(told["payload"].filter(pa.array(kind == k)), kinds)
        order = np.lexsort((-flag.astype(np.int16), name))
        order = order[K.runs(name[order])[:-1]] if len(order) else order
        out += [x[order] for x in (name, flag, *doc)]
    return tuple(out)


def match(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, or -1."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def known(w: Windows, buf: np.ndarray, off: np.ndarray, anchors: np.ndarray) -> tuple[Chunks, np.ndarray]:
    """The chunks whose anchors are among the given ones, and which one."""
    c = w.chunks(buf, off)
    at = match(anchors, c.anchor)
    live = np.flatnonzero(at >= 0)
    return c.take(live), at[live]


def letters(parcels: DataFrame, told: DataFrame, p: Plan, w: Windows, method: Method) -> DataFrame:
    """(bucket, payload): the contents to compare, with the text from the block that keeps it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        block = int(left["block"][0].as_py())
        ids, buf, off = unpacked(left["payload"])
        anchors, hot, content, keeper, first = replied(right)
        c, a = known(w, buf, off, anchors)
        pick = np.unique(c.content, return_index=True)[1]
        c, a = c.take(pick), a[pick]
        at = match(content, c.content)
        copies = at >= 0
        doc, keep = (np.where(copies, x[at], y) if len(content) else y for x, y in ((first, ids[c.row]), (keeper == KEEPER, np.ones(len(at), bool))))
        size = c.hi - c.lo
        buckets, out, codec = [], [], pa.Codec("zstd", compression_level=3)

        def send(kind: int, name: np.ndarray, head: dict[str, np.ndarray], begin: np.ndarray | None = None) -> None:
            order, cut = K.by_bucket(((name & _LOW) % np.uint64(p.buckets)).astype(np.int64), p.buckets)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                q = order[cut[k] : cut[k + 1]]
                raw = K.pack(**{f: x[q] for f, x in head.items()})
                n = len(raw)
                if begin is not None:
                    raw += buf[K.spans(begin[q], head["size"][q].astype(np.int64))].tobytes()
                out.append(np.array([block, kind, n, len(raw)], np.int64).tobytes() + codec.compress(raw, asbytes=True))
                buckets.append(k)

        def texts(q: np.ndarray, name: np.ndarray, start: np.ndarray, count: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            head = {"name": name, "content": c.content[q], "start": start.astype(np.uint32), "count": count.astype(np.uint32), "size": np.where(keep[q], hi - lo, 0).astype(np.uint32), "doc": doc[q], "copies": copies[q].astype(np.uint8)}
            send(0, name, head, off[c.row[q]] + lo)

        many = hot[a] == MANY
        own = np.flatnonzero(~many)
        texts(own, c.anchor[own], np.zeros(len(own), np.int64), c.count[own], c.lo[own], c.hi[own])
        own = np.flatnonzero(many)
        total, at_ = np.cumsum(size[own]), 0
        while at_ < len(own):
            # some contents at a time, as their windows are many
            to = max(at_ + 1, int(np.searchsorted(total, (total[at_ - 1] if at_ else 0) + K.PIECE, "right")))
            q = own[at_:to]
            text, start, *more = method.split(buf[K.spans(off[c.row[q]] + c.lo[q], size[q])], np.concatenate([[0], np.cumsum(size[q])]), c.count[q])
            of = q[text]
            if w.words:
                name, lo, hi = more
                texts(of, name, start, np.ones(len(of), np.int64), c.lo[of] + lo, c.lo[of] + hi)
            else:
                level, one, two = more
                weight = np.where(keep[of], 1 + copies[of], 0)
                send(1, K.joined(one, two), {"one": one, "two": two, "content": c.content[of], "start": start.astype(np.uint32), "level": level.astype(np.uint8), "weight": weight.astype(np.uint8)})
            at_ = to
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "payload": pa.array(out, pa.binary())})

    return parcels.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "bucket int, payload binary")


def answers(sent: DataFrame, method: Method) -> DataFrame:
    """(block, payload): windows that repeat, as runs (content, first window, number, what the method tells of them)."""

    def run(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        heads: list[list] = [[], []]
        texts, found = [], []
        for x in table["payload"]:
            x = x.as_buffer()
            block, kind, n, size = np.frombuffer(x, np.int64, 4).tolist()
            raw = codec.decompress(x.slice(32), size)
            head = K.unpack(raw, (TEXT, PAIR)[kind])
            heads[kind].append((np.full(len(head[0]), block), *head))
            if kind == 0:
                texts.append(np.frombuffer(raw, np.uint8, -1, n))
        if heads[0]:
            block, anchor, content, start, count, size, doc, copies = (np.concatenate([h[k] for h in heads[0]]) for k in range(8))
            buf = np.concatenate(texts)
            del texts
            begin = np.cumsum(size, dtype=np.int64) - size
            order = np.lexsort((start, content, anchor))
            new = np.ones(len(order), bool)
            new[1:] = (start[order][1:] != start[order][:-1]) | (content[order][1:] != content[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            asked = np.append(np.flatnonzero(new), len(order))
            # anchors are compared on their own, some of them at a time
            own = order[size[order] > 0]
            cut = K.runs(anchor[own])
            ends = np.cumsum(size[own], dtype=np.int64)[cut[1:] - 1] if len(own) else np.zeros(0, np.int64)
            at = 0
            while at < len(cut) - 1:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + method.size, "right")))
                q = own[cut[at] : cut[to]]
                which, first, number, told = method.compare(buf[K.spans(begin[q], size[q].astype(np.int64))], np.concatenate([[0], np.cumsum(size[q], dtype=np.int64)]), count[q].astype(np.int64), doc[q], copies[q] > 0)
                # to all who asked
                g = group[q][which]
                times = asked[g + 1] - asked[g]
                to_whom = order[K.spans(asked[g], times)]
                found.append((block[to_whom], content[to_whom], np.repeat(first, times) + start[to_whom], np.repeat(number, times), np.repeat(told, times)))
                at = to
        if heads[1]:
            block, one, two, content, start, level, weight = (np.concatenate([h[k] for h in heads[1]]) for k in range(7))
            order = np.lexsort((two, one, level))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]) & (level[order][1:] == level[order][:-1])
            cut = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(order)]])
            hit = np.add.reduceat(weight[order].astype(np.int64), cut[:-1]) > 1
            q = order[np.repeat(hit, np.diff(cut))]
            found.append((block[q], content[q], start[q], np.ones(len(q), np.int64), level[q]))
        block, content, start, count, told = (np.concatenate([x[k] for x in found]) for k in range(5))
        order = np.argsort(block, kind="stable")
        cut = K.runs(block[order])
        out = [K.pack(content=content[q], start=start[q].astype(np.uint32), count=count[q].astype(np.uint32), told=told[q].astype(np.int64)) for i, j in zip(cut[:-1], cut[1:], strict=True) for q in [order[i:j]]]
        return pa.table({"block": pa.array(block[order][cut[:-1]], pa.int32()), "kind": pa.array(np.full(len(out), 2), pa.int32()), "payload": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "block int, kind int, payload binary")


def marks(w: Windows, buf: np.ndarray, off: np.ndarray, heard: pa.Table) -> tuple[np.ndarray, ...]:
    """Runs of windows that repeat: row, first window, number, what the method told of them."""
    c = known(w, buf, off, replied(heard)[0])[0]
    content, start, count, told = K.unpack_all(heard["payload"].filter(pa.array(np.array(heard["kind"], np.int64) == 2)), ANSWER)
    order = np.argsort(content, kind="stable")
    content, start, count, told = content[order], start[order].astype(np.int64), count[order].astype(np.int64), told[order]
    lo, hi = np.searchsorted(content, c.content, "left"), np.searchsorted(content, c.content, "right")
    of, idx = np.repeat(np.arange(len(lo)), hi - lo), K.spans(lo, hi - lo)
    return c.row[of], c.start[of] + start[idx], count[idx], told[idx]


def covered(first: np.ndarray, width: int, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of all items of a block's documents (first: items before each), those under a marked window."""
    step = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(step, first[row] + start, 1)
    np.add.at(step, first[row] + start + count - 1 + width, -1)
    return np.cumsum(step)[:-1] > 0


def repeated(docs: DataFrame, w: Windows, across: bool, method: Method, finish: Callable, schema: str) -> DataFrame:
    """All five steps; finish turns (doc_ids, bytes, offsets, marks, tags) of a block into a table of `schema`.

    across: windows count only if another document has them.
    """
    p = plan(docs)
    told = durable(replies(survey(docs, p, w, across), p, across))
    parcels = packed(docs, p, True)
    heard = told.unionByName(answers(letters(parcels, told, p, w, method), method))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, buf, off, tags = opened(left["payload"])
        return finish(ids, buf, off, marks(w, buf, off, right), tags)

    return parcels.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(run, schema)
