"""Similarity join of n-gram sets by vertical partitioning.

All n-grams are put in one global order (rare ones first, by a sketch of counts of fixed size; any order
gives the same links).  Sets with a Jaccard index of at least t share an n-gram among the first
n - ceil(t n) + 1 of both, and from t = 0.8 on two that follow each other in both, among the first
2 (n - ceil(t n)) + 3: a member of one set alone parts but one such pair of shared ones.  That yields clusters
of sets that may be linked; pairs, as the sketch can't tell rare lines from unique ones in a large corpus, and lines
that a few sets share would join nearly all of them to one cluster.  The global order is then cut
into fragments: each fragment counts the partial overlaps of a cluster's pairs on its own, and the counts
are summed up for each pair.

Documents with equal sets are one node.  A cluster is compared in cells of at most CELL nodes, neighbours by
size; a larger cluster first finds its main component through one node of each cell, and then compares the
nodes outside it with all others, so that a large group of near copies needs no pairs of all its members.
A cell answers with a spanning forest of its links, not with all pairs.  Numbers of links, where they are
asked for, need all pairs: then each two cells whose sizes allow a link meet, and answer with sums for each node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards
from . import textkit as K
from .components import components

#: Nodes in a cell, fragments of the global order, counters of the sketch.
CELL, FRAGMENTS, SKETCH = 1024, 4, 1 << 22
#: Nodes with more than this part of all rows have their rows dealt out by so many salts.
HEAVY, SALTS = 1000, 64
_SLICES = 64
#: From this percentage on linked sets share two n-grams that follow each other in the global order.
PAIRED = 80
_SHORT, _MOST = np.uint64(2**40 - 1), 2**16 - 1


def sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the names of its distinct n-grams in rising order, their offsets, and the sets' names."""
    names, sizes, digests = [], [], []
    for _, _, x, o in K.pieces(buf, off):
        low = K.LOWER[x]
        starts, ends, first = K.words(low, o)
        w = K.name(low, starts, ends)
        per = np.diff(first)
        # windows of n words, or all words if there are fewer
        count = np.where(per > 0, np.maximum(per - n + 1, 1), 0)
        begin = K.spans(first[:-1], count)
        row = np.repeat(np.arange(len(per)), count)
        g = K.sequence(w, begin, np.minimum(n, first[1:][row] - begin))
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
        size = np.bincount(row, minlength=len(per))
        total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        end = np.cumsum(size)
        names.append(g)
        sizes.append(size)
        digests.append(K.mix(total[end] - total[end - size] + size.astype(np.uint64)))
    if not names:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(names), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(digests)


def need(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of this size can have with a linked one."""
    return -(-size * percent // 100)


def leading(size: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams of a set, in the global order, must be looked at to find what it shares with each linked one.

    Of sets A and B with o members in common, |A| + |B| - 2 o others part as many neighbours among the common ones at most;
    the first pair that is left ends at place (|A| + |B| - 2 o) + 2 + (|A| - o) of A or before, which is largest
    where B is smallest, but for one by rounding.
    """
    spare = size - need(size, percent)
    return np.minimum(size, 2 * spare + 3) if percent >= PAIRED else spare + 1


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """A class for each counter of the sketch, by the count of n-grams that fall on it; low classes are rare.

    Each task sums up its own counters; slices of them are added by Spark.  The result has SKETCH bytes,
    whatever the input, and only sets the order in which n-grams are looked at.
    """
    step = SKETCH // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            buf, off = K.flat(batch.column(0))
            for _, _, x, o in K.pieces(buf, off, 8 * K.PIECE):
                at, hits = np.unique((sets(x, o, n)[0] & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
                total[at] += hits.astype(np.uint32)
        codec = pa.Codec("zstd", compression_level=1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([codec.compress(total[k * step : (k + 1) * step].tobytes(), asbytes=True) for k in range(_SLICES)], pa.binary())], ["slice", "payload"])

    def summed(table: pa.Table, kind) -> np.ndarray:
        codec, total = pa.Codec("zstd"), np.zeros(step, np.int64)
        for x in table["payload"]:
            total += np.frombuffer(codec.decompress(x.as_buffer(), np.dtype(kind).itemsize * step), kind)
        return total

    def add(table: pa.Table) -> pa.Table:
        raw = pa.Codec("zstd", compression_level=1).compress(summed(table, np.uint32).tobytes(), asbytes=True)
        return pa.table({"slice": table["slice"][:1], "payload": pa.array([raw], pa.binary())})

    def classed(table: pa.Table) -> pa.Table:
        classes = np.minimum(np.floor(4 * np.log2(summed(table, np.int64) + 1)), 255).astype(np.uint8)
        return pa.table({"slice": table["slice"][:1], "payload": pa.array([classes.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "slice int, payload binary").groupBy("slice", F.pmod(F.spark_partition_id(), F.lit(shards.FAN))).applyInArrow(add, "slice int, payload binary")
    rows = parts.groupBy("slice").applyInArrow(classed, "slice int, payload binary").collect()
    out = np.zeros(SKETCH, np.uint8)
    for r in rows:
        out[r.slice * step : (r.slice + 1) * step] = np.frombuffer(r.payload, np.uint8)
    return out


def prefixes(docs: DataFrame, p: shards.Plan, classes, n: int, percent: int) -> DataFrame:
    """(bucket, payload): the first n-grams of each set in the global order, or pairs of neighbours, by their names; with sets' names and sizes, and the name before in the set.

    Five bytes of a name and sizes up to _MOST do here: they can but add candidates.  Of the name before, 0 if there is
    none, five bytes are compared between two neighbours of a chain alone, so that they confuse one in 2^40 of those.
    """
    pairs = int(percent >= PAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = classes.value
        for batch in batches:
            g, off, digest = sets(*K.flat(batch.column(0)), n)
            size = np.diff(off)
            # a set that the batch has twice counts once
            rows = np.unique(digest, return_index=True)[1]
            rows = rows[size[rows] > 0]
            size, digest, start = size[rows], digest[rows], off[:-1][rows]
            g = g[K.spans(start, size)]
            row = np.repeat(np.arange(len(rows)), size)
            order = np.lexsort((g, rare[(g & np.uint64(SKETCH - 1)).astype(np.int64)], row))
            start = np.cumsum(size) - size
            # sets of one member are linked with equal ones alone, which are the same node
            take = leading(size, percent) - pairs
            at, row = K.spans(start, take), np.repeat(np.arange(len(rows)), take)
            g = g[order]
            g = K.mix(g[at] * np.uint64(0x9E3779B97F4A7C15) + g[at + 1]) if pairs else g[at]
            before = np.roll(g, 1)
            before[(np.cumsum(take) - take)[take > 0]] = 0
            bucket = ((g >> np.uint64(40)) % np.uint64(p.buckets)).astype(np.int64)
            order = np.lexsort((g & _SHORT, bucket))
            g, before, row, bucket = g[order], before[order], row[order], bucket[order]
            small = np.minimum(size, _MOST).astype(np.uint16)
            cut, out = K.runs(bucket), []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                out.append(K.pack(g=_short(g[i:j]), before=_short(before[i:j]), digest=digest[row[i:j]], size=small[row[i:j]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), pa.array(out, pa.binary())], ["bucket", "payload"])

    return docs.select("text").mapInArrow(run, "bucket int, payload binary")


def _short(names: np.ndarray) -> np.ndarray:
    """The low five bytes of each name."""
    return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").ravel()


def _long(short: np.ndarray) -> np.ndarray:
    """Names of five bytes as numbers."""
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :5] = short.view(np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def candidates(prefixed: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes that share a first n-gram or pair, each with the next larger one if the sizes allow a link.

    In the order of sizes, nodes between two that may be linked may be linked with their neighbours, so these
    chains connect all that may be linked, in proportion to the number of nodes.  Neighbours that share the name
    before too are connected by that one's chain, where the same holds, down to the first name of a run that they
    share.  So two near copies have a row for each such run, not one for each bucket that they meet in: buckets are as
    many as the input is large.
    """

    def run(table: pa.Table) -> pa.Table:
        short, before, digest, size = K.unpack_all(table["payload"], ["V5", "V5", np.uint64, np.uint16])
        g = _long(short)
        order = np.argsort(g, kind="stable")
        g, before, digest, size = g[order], before[order], digest[order], size[order]
        same = np.zeros(len(g), bool)
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= same[1:]
        g, before, digest, size = g[same], _long(before[same]), digest[same], size[same].astype(np.int64)
        order = np.lexsort((digest, size, g))
        g, before, digest, size = g[order], before[order], digest[order], size[order]
        told = (before[1:] == before[:-1]) & (before[1:] > 0)
        ok = np.flatnonzero((g[1:] == g[:-1]) & (digest[1:] != digest[:-1]) & (size[:-1] >= need(size[1:], percent)) & ~told)
        pairs = np.unique(np.stack([digest[ok].view(np.int64), digest[ok + 1].view(np.int64)], 1), axis=0) if len(ok) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return prefixed.groupBy("bucket").applyInArrow(run, "a long, b long")


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node, mark) of each document; node is the name of its set, null for an empty one; mark tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off, digest = sets(*K.flat(batch.column(1)), n)
            size = np.diff(off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest.view(np.int64), pa.int64(), mask=size == 0), batch.column(2)], ["doc_id", "n_shingles", "node", "mark"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, n_shingles long, node long, mark long")


def members(docs: DataFrame, p: shards.Plan, labels: DataFrame, n: int) -> DataFrame:
    """(cluster, node, size, payload, weight): the n-grams of each node that has a cluster, and its number of rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            buf, off = K.flat(batch.column(0))
            digest = sets(buf, off, n)[2]
            rows = np.unique(digest, return_index=True)[1]
            block = (digest[rows] % np.uint64(p.blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            rows, block = rows[order], block[order]
            cut, out = K.runs(block), []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                q = rows[i:j]
                size = off[1:][q] - off[:-1][q]
                raw = size.tobytes() + buf[K.spans(off[:-1][q], size)].tobytes()
                out.append(np.array([len(q), len(raw)], np.int64).tobytes() + codec.compress(raw, asbytes=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]], pa.int32()), pa.array(out, pa.binary())], ["block", "payload"])

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"cluster": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "payload": pa.array([], pa.binary()), "weight": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        codec, seen = pa.Codec("zstd"), set()
        node = np.array(right["node"], np.int64)
        order = np.argsort(node)
        node, cluster, weight = node[order], np.array(right["label"], np.int64)[order], np.array(right["weight"], np.int64)[order]
        out: list = []
        for x in left["payload"]:
            x = x.as_buffer()
            count, size = np.frombuffer(x, np.int64, 2).tolist()
            raw = codec.decompress(x.slice(16), size)
            off = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, count))])
            g, cut, digest = sets(np.frombuffer(raw, np.uint8, -1, 8 * count), off, n)
            at = shards.match(node, digest.view(np.int64))
            for k in np.flatnonzero(at >= 0).tolist():
                if at[k] not in seen:
                    seen.add(at[k])
                    out.append((cluster[at[k]], node[at[k]], cut[k + 1] - cut[k], g[cut[k] : cut[k + 1]].tobytes(), weight[at[k]]))
        if not out:
            return none
        a, b, c, d, e = zip(*out, strict=True)
        return pa.table({"cluster": pa.array(a, pa.int64()), "node": pa.array(b, pa.int64()), "size": pa.array(c, pa.int64()), "payload": pa.array(d, pa.binary()), "weight": pa.array(e, pa.int64())})

    told = labels.select(_block(F.col("node"), p.blocks).alias("block"), "node", "label", "weight")
    return docs.select("text").mapInArrow(send, "block int, payload binary").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(pick, "cluster long, node long, size long, payload binary, weight long")


def _block(node, blocks: int):
    """The unsigned value of a long modulo `blocks`."""
    return F.pmod(F.pmod(node, F.lit(blocks)) + F.when(node < 0, F.lit(2**64 % blocks)).otherwise(F.lit(0)), F.lit(blocks)).cast("int")


def links(cells: DataFrame, percent: int, cuts: np.ndarray, share, forest: bool = True, counted: bool = False) -> DataFrame:
    """(a, b): a spanning forest of the links of each cell, if `forest`; counted: (a, b, n), also rows with a null b and in n the sum of `weight` over the nodes linked with a.

    Of a cell with both sides the pairs between them alone are counted.

    cells: cell, side (0: compared with all of the cell; 1: compared with side 0 only), node, size, payload.
    Each fragment counts the overlaps of a cell's pairs in its part of the global order; the sums decide.
    """

    extra = ["weight"] if counted else []

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = share.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 + len(extra))]
            for cell, side, node, size, payload, *more in zip(*(batch.column(k).to_pylist() for k in range(5 + len(extra))), strict=True):
                g = np.frombuffer(payload, np.uint64)
                at = np.searchsorted(cuts, position(g), "right")
                for f in range(FRAGMENTS):
                    for c, v in zip(cols, (cell, f, side, node, size, g[at == f].tobytes(), *more), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * len(extra)), strict=True)], ["cell", "fragment", "side", "node", "size", "payload", *extra])

    def ordered(table: pa.Table):
        side, node, size = (np.array(table[c], np.int64) for c in ("side", "node", "size"))
        order = np.lexsort((node, size, side))
        return side[order], node[order], size[order], order

    def overlap(table: pa.Table) -> pa.Table:
        side, node, size, by = ordered(table)
        column = table["payload"].combine_chunks() if table["payload"].num_chunks != 1 else table["payload"].chunk(0)
        rows = [np.frombuffer(column[k].as_buffer(), np.uint64) for k in by.tolist()]
        who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        g = np.unique(np.concatenate(rows), return_inverse=True)[1]
        count = np.bincount(g)
        keep = count[g] > 1
        g, who = np.unique(g[keep], return_inverse=True)[1], who[keep]
        n0, n = int((side == 0).sum()), len(rows)
        total = np.zeros((n0, n), np.float32)
        # the product of incidence matrices, some n-grams at a time
        order = np.argsort(g, kind="stable")
        g, who = g[order], who[order]
        width = max(64, (1 << 22) // max(1, n))
        for lo in range(0, int(g[-1]) + 1 if len(g) else 0, width):
            i, j = np.searchsorted(g, [lo, lo + width])
            x = np.zeros((n, width), np.float32)
            x[who[i:j], g[i:j] - lo] = 1
            total += x[:n0] @ x.T
        # counts of a cell's pairs, the same pair from either side once
        total = total.astype(np.uint32)
        total[:, :n0] = np.triu(total[:, :n0], 1)
        raw = np.ascontiguousarray(total).tobytes()
        return pa.table({"cell": table["cell"][:1], "head": pa.array([K.pack(side=side, node=node, size=size, **{c: np.array(table[c], np.int64)[by] for c in extra})], pa.binary()), "payload": pa.array([pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)], pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        side, node, size, *weight = K.unpack(table["head"][0].as_buffer(), [np.int64] * (3 + len(extra)))
        n0, n = int((side == 0).sum()), len(node)
        total, codec = np.zeros(n0 * n, np.int64), pa.Codec("zstd")
        for x in table["payload"]:
            total += np.frombuffer(codec.decompress(x.as_buffer(), 4 * n0 * n), np.uint32)
        total = total.reshape(n0, n)
        linked = (total > 0) & ((100 + percent) * total >= percent * (size[:n0, None] + size[None, :]))
        out = []
        if forest:
            a, b = np.nonzero(linked)
            root = np.arange(n)
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                if i != j:
                    out.append((node[i], node[j]))
                    root[max(i, j)] = min(i, j)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        edges = pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})
        if not counted:
            return edges
        if n0 < n:
            linked[:, :n0] = False
        a, b = np.nonzero(linked)
        sums = np.zeros(n, np.int64)
        np.add.at(sums, a, weight[0][b])
        np.add.at(sums, b, weight[0][a])
        some = np.flatnonzero(sums)
        found = pa.table({"a": pa.array(node[some]), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(sums[some])})
        return pa.concat_tables([edges.append_column("n", pa.nulls(len(pairs), pa.int64())), found])

    parts = cells.select("cell", "side", "node", "size", "payload", *extra).mapInArrow(cut_up, "cell string, fragment int, side int, node long, size long, payload binary" + ", weight long" * counted)
    partial = parts.groupBy("cell", "fragment").applyInArrow(overlap, "cell string, head binary, payload binary")
    return partial.groupBy("cell").applyInArrow(decide, "a long, b long" + ", n long" * counted)


class _Position:
    """Where an n-gram stands in the global order, from 0 to 1: by its class, and inside a class by its name."""

    def __init__(self, classes: np.ndarray):
        mass = np.bincount(classes, weights=2.0 ** (classes / 4), minlength=256)
        self.classes, self.size = classes, mass / mass.sum()
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, g: np.ndarray) -> np.ndarray:
        c = self.classes[(g & np.uint64(len(self.classes) - 1)).astype(np.int64)]
        return self.start[c] + self.size[c] * (g >> np.uint64(11)).astype(np.float64) / 2.0**53


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", n_links: bool = False, rows_apart: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document; n_links: also the number of rows that it is linked with.

    rows_apart: also `component`, a name of its own for each component, as a doc_id that several rows have may be the
    smallest of several components, and `mark`, xxhash64 of the text.

    A document's set: its distinct n-grams of words with A-Z in lower case; with fewer than n words, all of
    them as one; without words it is empty and linked with nothing.  Documents link when
    100 |intersection| >= percent |union|.  Nulls: a null text has no words; a null doc_id counts as larger than any
    other, and a component of nothing else has a null component_id.  Repeated rows are linked.
    """
    spark = docs.sparkSession
    docs = shards.documents(docs, id_col, text_col)
    p = shards.plan(docs)
    classes = rarity(docs, n)
    sent = spark.sparkContext.broadcast(classes)
    position = spark.sparkContext.broadcast(_Position(classes))
    cuts = np.arange(1, FRAGMENTS) / FRAGMENTS
    labels = components(candidates(prefixes(docs, p, sent, n, percent), percent))
    rows = shards.durable(described(docs, n))
    least = shards.durable(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight")))
    labels = shards.durable(labels.join(least.select("node", "weight"), "node"))
    large = shards.durable(labels.groupBy("label").count().where(F.col("count") > CELL).select("label"))
    any_large = not large.isEmpty()
    few = labels.join(large, "label", "left_anti") if any_large else labels
    row = ["node", "size", "payload", *["weight"] * n_links]
    # some small clusters to a cell
    many = max(1, -(-few.count() // 64))
    cells = members(docs, p, few, n).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(many))).alias("cell"), F.lit(0).alias("side"), *row)
    told = shards.durable(links(cells, percent, cuts, position, counted=n_links))
    found = told.where("b IS NOT NULL").select("a", "b")
    if any_large:
        placed = _placed(members(docs, p, labels.join(large, "label", "left_semi"), n))
        found = found.unionByName(_large(placed, percent, cuts, position))
    # the rows of a node that has more than 1/HEAVY of all are dealt out; there are fewer than HEAVY such nodes
    total = least.agg(F.sum("weight").alias("n")).first().n or 0
    heavy = F.broadcast(least.where(F.col("weight") * HEAVY > total).select("node", F.lit(True).alias("heavy")))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")
    rows = rows.join(heavy, "node", "left").select("doc_id", "n_shingles", "node", "mark", salt)

    def everywhere(per_node: DataFrame) -> DataFrame:
        """The rows of a table by node, once for each salt of the node."""
        salts = F.when(F.col("weight") * HEAVY > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return per_node.withColumn("salt", F.explode(salts)).drop("weight")

    label = components(found)
    of = label.join(least, "node").groupBy("label").agg(F.min("least").alias("of"))
    mine = least.join(label.join(of, "label").select("node", "label", "of"), "node", "left").select("node", "weight", F.coalesce("of", "least").alias("component_id"), F.coalesce("label", "node").alias("component"))
    out = ["doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *["component", "mark"] * rows_apart]
    if not n_links:
        return rows.join(everywhere(mine), ["node", "salt"], "left").select(*out)
    sums = told.where("b IS NULL")
    if any_large:
        sums = sums.unionByName(links(_all_cells(placed, percent, row), percent, cuts, position, forest=False, counted=True))
    linked = sums.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    counted = mine.join(linked, "node", "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("linked", F.lit(0)))
    return rows.join(everywhere(counted), ["node", "salt"], "left").select(*out, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _placed(nodes: DataFrame) -> DataFrame:
    """The nodes of large clusters with slot and part, which name a cell."""
    # sizes in classes of a twentieth, each dealt out evenly to cells; no cluster is sorted by one task
    slotted = nodes.withColumn("slot", F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1.05))).cast("int"))
    counts = slotted.groupBy("cluster", "slot").agg(F.ceil(F.count("*") / F.lit(CELL // 2)).cast("int").alias("parts"))
    return shards.durable(slotted.join(counts, ["cluster", "slot"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"))


def _reach(percent: int) -> int:
    """Classes of sizes that a link may span."""
    return math.ceil(math.log(100 / percent) / math.log(1.05)) + 1


def _all_cells(placed: DataFrame, percent: int, row: list[str]) -> DataFrame:
    """Each cell by itself, and each two cells whose sizes allow a link, once."""
    own = placed.select(F.concat_ws(":", F.lit("i"), "cluster", "slot", "part").alias("cell"), F.lit(0).alias("side"), *row)
    a = placed.select("cluster", "slot", "part").distinct()
    b = a.select("cluster", F.col("slot").alias("slot_b"), F.col("part").alias("part_b"))
    later = (F.col("slot_b") > F.col("slot")) & (F.col("slot_b") <= F.col("slot") + _reach(percent)) | (F.col("slot_b") == F.col("slot")) & (F.col("part_b") > F.col("part"))
    two = a.join(b, "cluster").where(later).withColumn("cell", F.concat_ws(":", F.lit("x"), "cluster", "slot", "part", "slot_b", "part_b"))
    left = placed.join(two.select("cluster", "slot", "part", "cell"), ["cluster", "slot", "part"]).select("cell", F.lit(0).alias("side"), *row)
    right = placed.join(two.select("cluster", F.col("slot_b").alias("slot"), F.col("part_b").alias("part"), "cell"), ["cluster", "slot", "part"]).select("cell", F.lit(1).alias("side"), *row)
    return own.unionByName(left).unionByName(right)


def _large(placed: DataFrame, percent: int, cuts: np.ndarray, position) -> DataFrame:
    """Links of clusters beyond a cell: within cells, through a node of each cell, and of what is left with all."""
    row = ["node", "size", "payload"]
    inside = shards.durable(links(placed.select(F.concat_ws(":", F.lit("i"), "cluster", "slot", "part").alias("cell"), F.lit(0).alias("side"), *row), percent, cuts, position))
    # a node of the largest component of each cell meets those of other cells; one of each class of sizes meets all
    own = placed.join(components(inside), "node", "left").withColumn("label", F.coalesce("label", "node"))
    weight = own.groupBy("cluster", "slot", "part", "label").agg(F.count("*").alias("n"))
    best = weight.groupBy("cluster", "slot", "part").agg(F.max(F.struct("n", "label")).alias("top")).select(F.col("top.label").alias("node"))
    heads = shards.durable(placed.join(best, "node", "left_semi"))
    groups = heads.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(CELL // 2)).cast("int").alias("groups"))
    heads = heads.join(groups, "cluster")
    leads = heads.join(heads.groupBy("cluster", "slot").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")
    dealt = heads.withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    everywhere = leads.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    met = dealt.unionByName(everywhere.join(dealt.select("node", "group"), ["node", "group"], "left_anti").select(dealt.columns))
    through = shards.durable(links(met.select(F.concat_ws(":", F.lit("h"), "cluster", "group").alias("cell"), F.lit(0).alias("side"), *row), percent, cuts, position))
    known = inside.unionByName(through)
    # each node outside the main component meets every cell whose sizes allow a link with it
    own = placed.join(components(known), "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = own.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    main = main.select("cluster", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / F.lit(CELL // 2)).cast("int").alias("groups"))
    rest = own.join(main, "cluster").where("label <> main").withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    reach = _reach(percent)
    cells = placed.select("cluster", "slot", "part").distinct()
    asked = rest.select("cluster", "group", *row, F.explode(F.sequence(F.col("slot") - reach, F.col("slot") + reach)).alias("slot")).join(cells, ["cluster", "slot"])
    name = F.concat_ws(":", F.lit("r"), "cluster", "slot", "part", "group").alias("cell")
    left = asked.select(name, F.lit(0).alias("side"), *row)
    right = placed.join(asked.select("cluster", "slot", "part", "group").distinct(), ["cluster", "slot", "part"]).select(name, F.lit(1).alias("side"), *row)
    last = links(left.unionByName(right.join(left.select("cell", "node"), ["cell", "node"], "left_anti")), percent, cuts, position)
    return known.unionByName(shards.durable(last))
