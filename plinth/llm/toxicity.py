"""Toxicity by a classifier chain: categories are predicted one after the other, each by a logistic model over words and the
probabilities of the categories before it.

A later model is trained with out-of-fold probabilities of the earlier ones: each training row's probability comes from
models that have not seen the row. The models that score new texts are fitted on all training rows.

Features are the words (runs of letters, A-Z lower-cased) that a text has and the beginnings of longer words, hashed into ``buckets``; for each category the
``features`` buckets that tell most are chosen by the z-score of their log-odds. A text counts whole.

The training sample is bounded by ``sample`` labelled rows (those with the least hash of their id). Counts of words by label
and fold are aggregated by Spark and choose the features; the driver then gets one bit for each row and chosen feature, so what it
holds is bounded by ``sample`` and ``features`` and not by the texts. Every text is scored.

Defined cases: null and empty texts have no words and get the prior of the models; a row whose label of a category is null takes
no part in that category's model, but in the others'; a category without both kinds of labels has its share of ones as
probability everywhere; no labelled rows at all give probability 0; rows labelled twice are taken twice, and so are labelled ids
that two texts share (beyond twice ``sample`` rows a hash of id and text picks among them); a null id is scored but never
trains; repeated rows give repeated results; an empty table gives an empty result; long texts count whole. Input columns named
like an output (p_<category>, rejected) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Scratch, lower_ascii, mix, prefix_hash, span_hash, text_chunks, words

SAMPLE, BUCKETS, FEATURES, FOLDS, RIDGE = 8192, 1 << 20, 1024, 5, 1.0
#: A word counts as telling from this z-score on; with less, words of a few mislabelled rows would be learnt by heart.
LEAST_Z = 3.7
#: Lengths in bytes of the word beginnings that are features of their own.
STEMS = (6, 7, 8, 9)
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and of the first bytes of longer words."""
    data = _LETTERS[lower_ascii(data)]
    starts, ends, counts = words(data, offsets)
    text, prefix = np.repeat(np.arange(len(counts)), counts), prefix_hash(data)
    rows, hashes = [text], [span_hash(prefix, starts, ends)]
    for n in STEMS:
        long = ends - starts > n
        rows.append(text[long])
        hashes.append(mix(span_hash(prefix, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Sparse:
    """Rows of ones at ``cols``, row by row."""

    rows: np.ndarray
    cols: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.shape[0])

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.shape[1])

    def take(self, mask: np.ndarray) -> Sparse:
        m = mask[self.rows]
        number = np.cumsum(mask) - 1
        return Sparse(number[self.rows[m]], self.cols[m], (int(mask.sum()), self.shape[1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: Sparse, z: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 8, inner: int = 15) -> np.ndarray:
    """Weights (words, dense columns of z, intercept) by Newton steps with conjugate gradients."""
    n, m, k = len(y), x.shape[1], z.shape[1]
    w = np.zeros(m + k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    penalty = np.full(m + k + 1, ridge)
    penalty[-1] = 1e-6
    full = lambda v: x.dot(v[:m]) + z @ v[m : m + k] + v[-1]
    back = lambda g: np.concatenate([x.t_dot(g), z.T @ g, [g.sum()]])
    for _ in range(steps):
        p = sigmoid(full(w))
        g = back(p - y) + penalty * w
        if np.abs(g).max() < 1e-4 * n**0.5:
            break
        d = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -g
        q, rr = r.copy(), r @ r
        for _ in range(inner):
            h = back(d * full(q)) + penalty * q
            a = rr / max(q @ h, 1e-12)
            step += a * q
            r = r - a * h
            new = r @ r
            if new < 1e-10:
                break
            q, rr = r + new / rr * q, new
        w = w + step
    return w


@dataclass
class Link:
    """One category's model: feature numbers by bucket (-1: none), weights; a constant where there was nothing to learn."""

    name: str
    feature: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def predict(self, n: int, rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Probabilities (n x categories) of n texts with these (text, bucket) words."""
        out = np.zeros((n, len(self.links)))
        for c, link in enumerate(self.links):
            if link.weights is None:
                out[:, c] = link.constant
                continue
            m = len(link.weights) - 1 - c
            f = link.feature[buckets]
            seen = np.unique(rows[f >= 0] * m + f[f >= 0])
            score = np.bincount(seen // m, link.weights[:m][seen % m], n) + link.weights[-1]
            if c:
                score += _logit(out[:, :c]) @ link.weights[m : m + c]
            out[:, c] = sigmoid(score)
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def choose(ones: np.ndarray, every: np.ndarray, n1: int, n: int, features: int) -> np.ndarray:
    """Numbers of the words that tell most, best first; of ``every`` rows with a word, ``ones`` have the label."""
    a, b = ones.astype(np.float64), (every - ones).astype(np.float64)
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n - n1 - b + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    z[every < 4] = 0
    best = np.argsort(-z, kind="stable")[:features]
    return best[z[best] >= LEAST_Z]


def train(names: list[str], labels: np.ndarray, folds: np.ndarray, words: np.ndarray, counts: np.ndarray, rows: np.ndarray, cols: np.ndarray, buckets: int = BUCKETS, features: int = FEATURES) -> Chain:
    """labels: rows x categories of 0, 1 or NaN; folds: fold of each row; words: buckets in ascending order; counts: rows with a
    word as (category, fold, label, word); (rows, cols): which rows have which words, for all words that can be chosen."""
    chain, before = Chain(), np.zeros((len(labels), 0))

    def one(c: int, out: int | None, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(chosen words, weights) from the rows that have the label and are not in fold ``out``."""
        mask = ~np.isnan(y) if out is None else ~np.isnan(y) & (folds != out)
        if len(np.unique(y[mask])) < 2:
            return None
        own = chosen(counts[c], out, y[mask], features)
        feature = np.full(len(words), -1)
        feature[own] = np.arange(len(own))
        number = np.cumsum(mask) - 1
        use = mask[rows] & (feature[cols] >= 0)
        x = Sparse(number[rows[use]], feature[cols[use]], (int(mask.sum()), len(own)))
        return own, fit_logistic(x, z[mask], y[mask])

    def predicted(own: np.ndarray, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        weight = np.zeros(len(words))
        weight[own] = w[: len(own)]
        return sigmoid(np.bincount(rows, weight[cols], len(labels)) + z @ w[len(own) : -1] + w[-1])

    for c, name in enumerate(names):
        y, z = labels[:, c], _logit(before)
        whole = one(c, None, y, z)
        known = y[~np.isnan(y)]
        share = float(known.mean()) if len(known) else 0.0
        if whole is None:
            chain.links.append(Link(name, constant=share))
            before = np.concatenate([before, np.full((len(y), 1), share)], axis=1)
            continue
        feature = np.full(buckets, -1, np.int64)
        feature[words[whole[0]]] = np.arange(len(whole[0]))
        chain.links.append(Link(name, feature, whole[1]))
        if c + 1 < len(names):
            held = np.full(len(y), share)
            for k in np.unique(folds):
                part = one(c, k, y, z)
                if part is not None:
                    held = np.where(folds == k, predicted(*part, z), held)
            before = np.concatenate([before, held[:, None]], axis=1)
    return chain


def chosen(counts: np.ndarray, out: int | None, y: np.ndarray, features: int) -> np.ndarray:
    """The features of a category without fold ``out``, from counts by (fold, label, word)."""
    own = counts.sum(0) if out is None else counts.sum(0) - counts[out]
    return choose(own[1], own.sum(0), int(y.sum()), len(y), features)


def fit(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, folds: int = FOLDS, features: int = FEATURES, scratch: Scratch | None = None) -> Chain:
    """A chain over the label columns ``names`` (0/1 or null, in chain order) of labels."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    ys = [f"y{i}" for i in range(len(names))]
    rows_of = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(n).cast("int").alias(y) for n, y in zip(names, ys)])
    few = F.broadcast(rows_of.orderBy(F.xxhash64("id"), "id", *ys).limit(sample))  # sample rows at most
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold")
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id").select("text", F.xxhash64("id", "text").alias("pick"), fold, *ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text"):
            r, b = word_buckets(data, offsets)
            seen = np.unique(r * BUCKETS + b)
            cuts = np.searchsorted(seen, np.arange(batch.num_rows + 1) * BUCKETS)
            packed = pa.array([(seen[a:z] % BUCKETS).astype(np.uint32).tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=["words", *batch.schema.names[1:]])

    fields = "pick long, fold int, " + ", ".join(f"{y} int" for y in ys)
    sampled = scratch.write(joined.mapInArrow(run, f"words binary, {fields}"))
    n = sampled.count()
    if n > 2 * sample:  # labelled ids that many texts share
        sampled = sampled.where(F.pmod("pick", F.lit(1 << 30)) < int((1 << 30) * 2 * sample / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in batch.column("words")]
            word, row = np.concatenate([np.zeros(0, np.int64), *lists]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            fold, codes = batch.column("fold").to_numpy(), []
            for c, y in enumerate(ys):
                label = batch.column(y).to_numpy(zero_copy_only=False)
                slot = np.where(np.isnan(label.astype(np.float64)), -1, (c * folds + fold) * 2 + np.nan_to_num(label.astype(np.float64)))
                known = slot[row] >= 0
                codes.append(word[known] * (2 * folds * len(ys)) + slot[row][known].astype(np.int64))
            code, times = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // (2 * folds * len(ys))), pa.array((code % (2 * folds * len(ys))).astype(np.int32)), pa.array(times)], names=["word", "slot", "n"])

    by_slot = scratch.write(sampled.select("words", "fold", *ys).mapInArrow(count, "word long, slot int, n long").groupBy("word", "slot").agg(F.sum("n").alias("n")))
    common = by_slot.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 4").select("word")  # others are never chosen
    got = by_slot.join(common, "word").toArrow()  # BUCKETS words at most, each with a number for a category, fold and label
    words, at = np.unique(got["word"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(ys), folds, 2, len(words)), np.int64)
    slot = got["slot"].to_numpy()
    counts[slot // (2 * folds), slot // 2 % folds, slot % 2, at] = got["n"].to_numpy()
    head = sampled.select("fold", *ys).toArrow()
    y = np.stack([head[c].to_numpy().astype(np.float64) for c in ys], axis=1)
    of = head["fold"].to_numpy()
    picked = [np.zeros(0, np.int64)]
    for c in range(len(ys)):
        for out in (None, *range(folds)):
            own = ~np.isnan(y[:, c]) & (of != out if out is not None else True)
            picked.append(chosen(counts[c], out, y[own, c], features))
    picked = np.unique(np.concatenate(picked))
    words, counts = words[picked], counts[..., picked]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.packbits(np.isin(words, np.frombuffer(x.as_buffer(), np.uint32))).tobytes() for x in batch.column("words")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], names=["has", *batch.schema.names[1:]])

    got = sampled.select("words", "fold", *ys).mapInArrow(bits, "has binary, fold int, " + ", ".join(f"{c} int" for c in ys)).toArrow()  # 2 x sample rows of a bit for each chosen word
    y = np.stack([got[c].to_numpy().astype(np.float64) for c in ys], axis=1)
    pairs = [np.flatnonzero(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(words))) for x in got["has"]]
    rows, cols = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs]), np.concatenate([np.zeros(0, np.int64), *pairs])
    return train(names, y, got["fold"].to_numpy(), words, counts, rows, cols, features=features)


def score(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.4, target: str | None = None, drop: bool = False) -> DataFrame:
    """docs plus p_<category> for each link of the chain and ``rejected``: the target's (by default the last category's)
    probability is ``threshold`` or more. With ``drop`` only the rows that are not rejected, without new columns."""
    target = target or chain.links[-1].name
    new = [] if drop else [*(f"p_{x.name}" for x in chain.links), "rejected"]
    keep = [c for c in docs.columns if c not in new]
    at = [x.name for x in chain.links].index(target)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, text_col):
            p = sent.value.predict(batch.num_rows, *word_buckets(data, offsets))
            own = [batch.column(c) for c in keep]
            if drop:
                yield pa.RecordBatch.from_arrays(own, names=keep).filter(pa.array(p[:, at] < threshold))
            else:
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, at] >= threshold)], names=[*keep, *new])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep).mapInArrow(run, fields + "".join(f", `{c}` {'boolean' if c == 'rejected' else 'double'}" for c in new))


def chain_labels(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The driver's labels as chain categories: low quality first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"]
