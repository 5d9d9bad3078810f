"""Toxicity by weak supervision.

Lexicon voters fire on a word or the beginning of a word that labelled toxic documents have far more often
than others, pattern voters on the look of a text.  A generative label model (a latent class for each document)
estimates by expectation-maximisation how often each voter fires in either class.  Voters that still correlate
inside a class are put into one factor with a joint distribution, so that they don't count twice.  Its
posterior labels train a linear classifier on words and word beginnings, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Features are names modulo this; word beginnings of so many bytes; shares of a text's words that a feature must reach for each of its levels.
SPACE, HEADS, RATES = 1 << 22, (4, 5, 6, 7, 8), (0.0, 0.005, 0.01, 0.02)
LEVELS = len(RATES)
PATTERNS = ("shouting", "exclaiming", "symbols", "repeating", "brief")


def features(buf: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the texts: first row, then of the distinct features of each row the rows, ids and levels, and the patterns; only: the ids that matter."""
    for a, b, raw, o in K.pieces(buf, off):
        x = K.folded(raw)
        starts, ends, first = K.words(x, o, K.MARKS)
        eight = K.eights(x)
        row = np.repeat(np.arange(b - a), np.diff(first))
        rows, ids = [], []
        for size in (0, *HEADS):
            if size:
                long = np.flatnonzero(ends - starts > size)
                name = K.name(x, starts[long], starts[long] + size, eight) ^ np.uint64(0x9E6C63D0876A9A62)
                of = row[long]
            else:
                name, of = K.name(x, starts, ends, eight), row
            k = (name & np.uint64(SPACE - 1)).astype(np.int64)
            if only is not None:
                keep = only[k]
                k, of = k[keep], of[keep]
            rows.append(of)
            ids.append(k)
        pair, count = np.unique(np.concatenate(rows) * SPACE + np.concatenate(ids), return_counts=True)
        rate = count / np.diff(first)[pair // SPACE]
        yield a, pair // SPACE, pair % SPACE, np.searchsorted(RATES, rate, "right") - 1, patterns(raw, o, starts, ends, first)


def patterns(raw: np.ndarray, o: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters, a column each."""
    def share(hit: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(hit)])
        return (c[o[1:]] - c[o[:-1]]) / np.maximum(1, o[1:] - o[:-1])

    words = np.diff(first)
    same = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 1:
        sizes = ends - starts
        alike = (sizes[1:] == sizes[:-1]) & (raw[starts[1:]] == raw[starts[:-1]]) & (raw[ends[1:] - 1] == raw[ends[:-1] - 1])
        same[2:] = np.cumsum(alike)
    upper = (raw >= 65) & (raw <= 90)
    return np.stack([share(upper) > 0.3, share(raw == 33) > 0.02, share(K.MARKS[raw] & ~K.SPACE[raw]) > 0.15, (same[first[1:]] - same[first[:-1]]) > 0.3 * np.maximum(1, words), words < 20], 1)


@dataclass
class Model:
    """The linear classifier: ids of features, their weights by level (a level has those below it too), weights of the patterns, and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    pattern_weights: np.ndarray
    bias: float
    fitted: bool = True

    def scorer(self):
        only = np.zeros(SPACE, bool)
        only[self.ids] = True
        place = np.zeros(SPACE, np.int32)
        place[self.ids] = np.arange(len(self.ids))
        weight = np.cumsum(self.weights, axis=1).ravel() if len(self.ids) else np.zeros(1)

        def score(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
            out = np.full(len(off) - 1, self.bias)
            for a, rows, ids, level, shape in features(buf, off, only):
                out[a : a + len(shape)] += np.bincount(rows, weights=weight[place[ids] * LEVELS + level], minlength=len(shape)) + shape @ self.pattern_weights
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

        return score


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 30, trust: float = 0.995, correlated: float = 0.4) -> tuple[np.ndarray, list[np.ndarray]]:
    """Posterior of class 1 for each row, and the factors (groups of voters that depend on each other).

    votes: rows by voters, 1 where a voter fires.  given: a label for each row or -1; labels count as one
    more voter that is right with probability `trust`.
    """
    n, m = votes.shape
    seen = given >= 0
    prior = float(np.clip((given[seen].sum() + 1) / (seen.sum() + 2), 1e-3, 1 - 1e-3))
    start = np.where(seen, np.where(given == 1, trust, 1 - trust), np.clip(prior + 0.3 * (votes.sum(1) > 0), 0, 0.9))

    def fit(factors: list[np.ndarray]) -> np.ndarray:
        # each factor's state: how many of its voters fire, three or more as one
        states = [np.minimum(votes[:, f].sum(1), 3).astype(np.int64) for f in factors]
        p, base = start, prior
        for _ in range(rounds):
            logit = np.full(n, np.log(base / (1 - base)))
            logit += np.where(seen, np.where(given == 1, 1, -1) * np.log(trust / (1 - trust)), 0)
            for s in states:
                one, zero = np.bincount(s, p, 4) + 0.1, np.bincount(s, 1 - p, 4) + 0.1
                logit += (np.log(one / one.sum()) - np.log(zero / zero.sum()))[s]
            q = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            base = float(np.clip((q.sum() + 1) / (n + 2), 1e-3, 1 - 1e-3))
            done = np.abs(q - p).max() < 1e-4
            p = q
            if done:
                break
        return p

    p = fit([np.array([j]) for j in range(m)])
    # correlations that the classes don't explain; where there are labels, by those rows, lest a crowd of
    # voters that agree with each other passes for the class
    root = np.arange(m)
    linked = np.zeros((m, m), bool)
    for w in (start * seen, (1 - start) * seen) if seen.sum() >= 50 else (p, 1 - p):
        total = max(w.sum(), 1e-9)
        mean = (w @ votes) / total
        centred = votes - mean
        cov = (centred * w[:, None]).T @ centred / total
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        linked |= (cov / np.outer(sd, sd) > correlated) & (np.minimum.outer(mean, mean) * total >= 3)
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(m):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
    factors = [np.flatnonzero(root == r) for r in np.unique(root)]
    return fit(factors), factors


def logistic(x: np.ndarray, target: np.ndarray, ridge: np.ndarray, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft targets, by Newton's method with halved steps; x: a column of ones last; ridge: the penalty of each weight."""
    n, m = x.shape
    penalty = np.append(ridge, 1e-6)
    base = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    w = np.append(np.zeros(m - 1), np.log(base / (1 - base)))

    def loss(w: np.ndarray) -> float:
        z = x @ w.astype(x.dtype)
        return float((np.logaddexp(0, z.astype(np.float64)) - target * z).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))
        grad = x.T @ (p - target).astype(x.dtype) + penalty * w
        weight = np.sqrt(np.maximum(p * (1 - p), 1e-6)).astype(x.dtype)[:, None]
        curve = np.diag(penalty)
        for k in range(0, n, 512):
            part = x[k : k + 512] * weight[k : k + 512]
            curve += part.T @ part
        step = np.linalg.solve(curve, grad)
        size = 1.0
        while size > 1e-3 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-3:
            break
        w, old, now = w - size * step, now, new
        if old - now < 1e-6 * abs(old):
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, voters: int = 200, width: int = 2500) -> Model:
    """docs: doc_id, text; labels: doc_id, label 0 or 1 (others are left out).

    width bounds the features that are looked at for the classifier, voters those of the label model;
    sample bounds the labelled rows that are fitted, those with the smallest hash of their id; of several
    labels, or texts, for one id the smallest counts.  Without both classes every score is the smoothed base rate.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1), np.int64)
            for a, rows, ids, level, shape in features(*K.flat(batch.column(0))):
                cut = np.searchsorted(rows, np.arange(len(shape) + 1))
                ids = (ids * LEVELS + level).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(label[a : a + len(shape)]), pa.array([ids[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([s.astype(np.uint8).tobytes() for s in shape], pa.binary())], ["label", "ids", "shape"])

    # the broadcast has `sample` rows at most
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = own.select("text", "label").mapInArrow(run, "label long, ids binary, shape binary").collect()
    given = np.array([r.label for r in rows], np.int64)
    if len(np.unique(given)) < 2:
        base = (given.sum() + 1) / (len(given) + 2)
        return Model(np.zeros(0, np.int64), np.zeros((0, LEVELS)), np.zeros(len(PATTERNS)), float(np.log(base / (1 - base))), False)
    # an order that depends on the rows alone
    order = np.lexsort(([len(r.ids) for r in rows], [int(np.frombuffer(r.ids, np.uint32).sum(dtype=np.int64)) for r in rows], given))
    given, shape = given[order], np.array([np.frombuffer(rows[k].shape, np.uint8) for k in order], np.float32)
    # features that three rows have, counted row by row, as all rows' features together are large
    count = np.zeros(SPACE, np.uint32)
    for r in rows:
        count[np.frombuffer(r.ids, np.uint32) // LEVELS] += 1
    base = np.flatnonzero(count >= 3)
    place = np.zeros(SPACE, np.int32)
    place[base] = np.arange(len(base))
    ids, sizes = [], []
    for k in order.tolist():
        own = np.frombuffer(rows[k].ids, np.uint32)
        own = own[count[own // LEVELS] >= 3]
        ids.append(place[own // LEVELS] * LEVELS + (own % LEVELS).astype(np.int32))
        sizes.append(len(own))
        rows[k] = None
    del rows, count, place
    # a row that has a level of a feature has those below it
    who, what = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate(ids)
    level = what % LEVELS
    keep = [level >= k for k in range(LEVELS)]
    who, code = np.concatenate([who[o] for o in keep]), np.concatenate([what[o] - level[o] + k for k, o in enumerate(keep)])
    del ids, what, level, keep
    size = len(base) * LEVELS
    one, all_ = np.bincount(code, given[who], size), np.bincount(code, minlength=size)
    zero = all_ - one
    n1, n0 = given.sum(), (1 - given).sum()
    odds = np.log((one + 0.5) / (n1 - one + 0.5)) - np.log((zero + 0.5) / (n0 - zero + 0.5))
    # signed root of the likelihood ratio of the two-by-two table; it does justice to features that one class never has
    part = lambda o, e: o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9))
    share = all_ / len(given)
    ratio = part(one, n1 * share) + part(zero, n0 * share) + part(n1 - one, n1 * (1 - share)) + part(n0 - zero, n0 * (1 - share))
    z = np.sign(odds) * np.sqrt(np.maximum(2 * ratio, 0))
    z[all_ < 3] = 0

    def table(columns: np.ndarray, more: int = 0) -> np.ndarray:
        place = np.full(size, -1, np.int32)
        place[columns] = np.arange(len(columns))
        at = place[code]
        out = np.zeros((len(given), len(columns) + more), np.float32)
        out[who[at >= 0], at[at >= 0]] = 1
        return out

    # the strongest feature levels, without those that fire on the rows of a stronger one
    strong = np.lexsort((np.arange(size), -np.abs(z)))[:width]
    strong = strong[np.abs(z[strong]) > 1.5]
    fires = table(strong)
    both, own = fires.T @ fires, fires.sum(0)
    alone = np.ones(len(strong), bool)
    for k in range(len(strong)):
        if alone[k]:
            like = both[k] / np.maximum(own + own[k] - both[k], 1) > 0.8
            like[: k + 1] = False
            alone &= ~like
    wide = np.sort(strong[alone])
    lexicon = strong[alone & (z[strong] > 3) & (2 * one[strong] >= all_[strong]) & (one[strong] >= 3)][:voters]
    del fires, both

    votes = table(lexicon, 1 + len(PATTERNS))
    votes[:, len(lexicon)] = votes.sum(1) == 0
    votes[:, len(lexicon) + 1 :] = shape
    posterior, _ = label_model(votes.astype(np.float64), given)
    del votes
    # features with little evidence are held back more
    ridge = np.append((5 / np.abs(z[wide])) ** 4, np.ones(len(PATTERNS)))
    x = table(wide, len(PATTERNS) + 1)
    x[:, len(wide) : -1], x[:, -1] = shape, 1
    w, bias = logistic(x, posterior, ridge)
    kept, at = np.unique(wide // LEVELS, return_inverse=True)
    weights = np.zeros((len(kept), LEVELS))
    weights[at, wide % LEVELS] = w[: len(wide)]
    return Model(base[kept].astype(np.int64), weights, w[len(wide) :].astype(np.float64), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every document; a null or empty text gets the score of no words, a null doc_id stays, extra columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rate(*K.flat(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, below: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score less than `below`; all, if there were no labels of both classes to learn from.  Only texts go to Python."""
    if not model.fitted:
        return docs

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score_ = model.scorer()
        for texts in batches:
            yield pa.array(score_(*K.flat(texts)))

    return docs.where(rate(F.col(text_col).cast("string")) < below)
