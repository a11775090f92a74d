"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Tokens are the runs without ASCII white space, A-Z lower-cased, then one end per text. The model is a bigram model with
Witten-Bell smoothing over an add-one unigram model:

    p(w | v) = (q(v w) + T(v) p1(w)) / (c(v) + T(v)),   p1(w) = (c(w) + 1) / (N + V + 1),   p1 alone if v is unseen

``q`` is the bigram's count quantised on a logarithmic scale: the filter holds (bigram, level) for each level up to the
count's own, and a count is read by probing levels 1, 2, ... until one is absent. The counts c(v) and distinct followers
T(v) of histories stand in the same filter under keys of their own, quantised too. Unigram counts c(w) are exact.

How it scales. Token counts are an ordinary aggregation. A token that makes up 1/HOT or more of all tokens is hot: there
are HOT of them at most, so their exact counts are broadcast. The filter is built in segments, each by one task from all
keys that belong to it; keys of a rare history share a segment, those of a hot history are dealt by the whole bigram, so
no key floods a segment. A filter of ``shard_mb`` at most is broadcast and probed while the texts are scanned. Occurrences
of rare tokens need c(w), which is not broadcast: they travel as packed arrays to the task that has the exact counts of
their part of the vocabulary, and only sums come back. Sums find their text by a hash of id and text and not by position,
so the order in which a recomputed task sees its rows does not matter.

The filter grows with the corpus, and a larger one stays where it is: slices of texts ask for each of their distinct
bigrams and rare tokens once, at the task that holds its segment or part of the vocabulary, and answers come back in the
order asked, so bytes per token do not grow with the number of segments. (Bigrams that make up 1/HOT of the training tokens
are not asked for: their levels, HOT of them at most, are broadcast.) Slices are written before they are asked for, so a
recomputed task sees the same ones. The texts go in WAVES waves at most, by a hash of id and text, and the files of a wave
go before the next; each wave scans docs again and passes its own texts to Python. ``score`` then does its work at once.

Defined cases: null texts are empty (one end token); a null id counts as id text '' (a training row) and keeps its row;
repeated rows are learnt from and scored each; an empty table gives an empty result; extra columns, also of the names of
outputs, play no part. Texts are processed whole. Tokens, and texts that sums come back to, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Scratch, lower_ascii, mix, prefix_hash, span_hash, text_chunks, words

U = np.uint64
END, START = U(0x656E64), U(0x7374617274)
#: Hot tokens are those with at least 1/HOT of all tokens.
HOT = 50_000
#: Quantisation base of counts, bits a filter entry, probes an entry, keys a segment is made for.
BASE, BITS, PROBES, SEGMENT_KEYS = 1.5, 8, 4, 1_000_000
#: Largest filter that is broadcast; tokens that a task holds before it sends them on.
SHARD_MB, KEEP = 96, 1 << 19
#: Waves in which texts are scored where the filter is not broadcast; there is one for so many training tokens, WAVES at most.
WAVES, WAVE_TOKENS = 8, 1 << 24
_HELD, _ROW = "__plinth_held", "__plinth_row"
_C_KEY, _T_KEY = U(0xC0C0C0C0C0C0C0C1), U(0x7E7E7E7E7E7E7E7F)


def _write(scratch: Scratch, df: DataFrame) -> DataFrame:
    """``scratch.write``; the shuffle files behind the table go once it stands, and not when the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return scratch.write(df)
    finally:
        conf.set(name, before)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text (null: empty) leaves ``fold`` modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with the ends, history hashes, tokens of each text)."""
    data = lower_ascii(data)
    starts, ends, counts = words(data, offsets)
    n = counts + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    tok = np.full(bounds[-1], END, np.uint64)
    is_word = np.ones(bounds[-1], bool)
    is_word[bounds[1:] - 1] = False
    tok[is_word] = span_hash(prefix_hash(data), starts, ends)
    hist = np.empty_like(tok)
    hist[1:] = tok[:-1]
    hist[bounds[:-1]] = START
    return tok, hist, n


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Quantised level of counts >= 1."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


#: Count that stands for a level: the middle of the whole numbers that have it; 0 for level 0.
def _value_table(size: int = 120) -> np.ndarray:
    low = np.ceil(BASE ** np.arange(size) - 1e-9)
    out = np.zeros(size + 1)
    out[1:] = np.maximum(1.0, (low + np.maximum(low, np.ceil(BASE ** np.arange(1, size + 1) - 1e-9) - 1)) / 2)
    return out


VALUES = _value_table()


def bigram_keys(hist: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """32 bits of the history above 32 bits of the token given the history."""
    return (mix(hist) & U(0xFFFFFFFF00000000)) | (mix(tok ^ (hist * U(0x9E3779B97F4A7C15))) >> U(32))


def segments_of(keys: np.ndarray, hist: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    return (np.where(hot, mix(keys ^ U(0x5851F42D4C957F2D)), mix(hist ^ U(0x14057B7EF767814F))) % U(n)).astype(np.int64)


def _positions(keys: np.ndarray, level: int | np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    h = mix(keys + np.asarray(level, np.uint64) * U(0xD1342543DE82EF95))
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    for i in range(PROBES):
        yield ((a + U(i) * b) % np.asarray(bits, np.uint64)).astype(np.int64)


def build_segment(keys: np.ndarray, counts: np.ndarray, hot32: np.ndarray, often: float = np.inf, width: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits packed in bytes, hot histories' numbers, their distinct followers in this segment, bigrams counted ``often`` or more)
    of one segment's bigrams."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(counts, first)
    keys = keys[first]
    v = keys >> U(32)
    vs = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    followers = np.diff(np.concatenate([vs, [len(v)]]))
    c, v = np.add.reduceat(total, vs), v[vs]
    at = np.minimum(np.searchsorted(hot32, v), max(0, len(hot32) - 1))
    is_hot = hot32[at] == v if len(hot32) else np.zeros(len(v), bool)
    rare = ~is_hot
    ck, tk = mix(v[rare] ^ _C_KEY), mix(v[rare] ^ _T_KEY)
    every = [(keys, levels_of(total), 1), (ck, levels_of(c[rare]), 1), (tk, levels_of(followers[rare]), 2)]
    entries = sum(int(np.maximum(0, lv - lo + 1).sum()) for _, lv, lo in every)
    size = max(64, -(-entries * width // 64) * 64)
    bits = np.zeros(size, bool)
    for k, lv, lo in every:
        level = lo
        while len(k):
            keep = lv >= level
            k, lv = k[keep], lv[keep]
            for pos in _positions(k, level, size):
                bits[pos] = True
            level += 1
    return np.packbits(bits, bitorder="little"), at[is_hot], followers[is_hot], keys[total >= often]


@dataclass
class Shard:
    """Consecutive segments [first, first + len(sizes)) as one run of bytes."""

    first: int
    starts: np.ndarray
    sizes: np.ndarray
    data: bytes

    def has(self, seg: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
        bits = np.frombuffer(self.data, np.uint8)
        own = seg - self.first
        base, size = self.starts[own], self.sizes[own]
        hit = np.arange(len(keys))
        for pos in _positions(keys, level, size):
            p = base[hit] + pos[hit]
            hit = hit[(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[hit] = True
        return out

    def levels(self, seg: np.ndarray, keys: np.ndarray, lowest: int = 1) -> np.ndarray:
        """Highest level present without a gap from ``lowest`` on; lowest - 1 if that is absent."""
        out = np.full(len(keys), lowest - 1, np.int64)
        left, level = np.arange(len(keys)), lowest
        while len(left) and level < len(VALUES):
            left = left[self.has(seg[left], keys[left], level)]
            out[left] = level
            level += 1
        return out


class _Lookup:
    """Sorted hashes with values."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return at, self.keys[at] == x


def _count_tokens(text_col: str, keep: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, train, every, held = [], [], [], 0

        def merged():
            k, inv = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inv, np.concatenate(train), len(k)).astype(np.int64), np.bincount(inv, np.concatenate(every), len(k)).astype(np.int64)

        def out(k, a, b):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(a), pa.array(b)], names=["h", "train", "every"])

        for batch, data, offsets in text_chunks(batches, text_col):
            tok, _, n = _tokens(data, offsets)
            learn = np.repeat(~batch.column(_HELD).to_numpy(zero_copy_only=False), n)
            k, inv = np.unique(tok, return_inverse=True)
            keys.append(k)
            train.append(np.bincount(inv, learn, len(k)))
            every.append(np.bincount(inv, minlength=len(k)))
            held += len(k)
            if held > keep:
                m = merged()
                if len(m[0]) > keep // 2:
                    yield out(*m)
                    keys, train, every, held = [], [], [], 0
                else:
                    keys, train, every, held = [m[0]], [m[1]], [m[2]], len(m[0])
        if keys:
            yield out(*merged())

    return run


def _bigram_blobs(text_col: str, hot_keys: np.ndarray, n_segments: int, keep: int = 2 * KEEP):
    hot = _Lookup(hot_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, segs, held = [], [], 0

        def flush():
            k, s = np.concatenate(keys), np.concatenate(segs)
            order = np.lexsort((k, s))
            k, s = k[order], s[order]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
            c = np.diff(np.concatenate([first, [len(k)]])).astype(np.uint32)
            k, s = k[first], s[first]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            ends = np.concatenate([cuts[1:], [len(s)]])
            ones, many, counts = [], [], []
            for a, b in zip(cuts, ends):
                single = c[a:b] == 1
                ones.append(k[a:b][single].tobytes())
                many.append(k[a:b][~single].tobytes())
                counts.append(c[a:b][~single].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(s[cuts].astype(np.int32)), pa.array(ones, pa.binary()), pa.array(many, pa.binary()), pa.array(counts, pa.binary())], names=["seg", "ones", "many", "counts"])

        for batch, data, offsets in text_chunks(batches, text_col):
            tok, hist, n = _tokens(data, offsets)
            learn = np.repeat(~batch.column(_HELD).to_numpy(zero_copy_only=False), n)
            tok, hist = tok[learn], hist[learn]
            if not len(tok):
                continue
            k = bigram_keys(hist, tok)
            keys.append(k)
            segs.append(segments_of(k, hist, hot.find(hist)[1], n_segments))
            held += len(k)
            if held > keep:
                yield flush()
                keys, segs, held = [], [], 0
        if keys:
            yield flush()

    return run


def _segment_builder(hot32: np.ndarray, often: float, width: int):
    def build(t: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[name]] or [np.zeros(0, kind)])
        ones, many, counts = read("ones", np.uint64), read("many", np.uint64), read("counts", np.uint32)
        bits, at, followers, top = build_segment(np.concatenate([ones, many]), np.concatenate([np.ones(len(ones), np.int64), counts.astype(np.int64)]), hot32, often, width)
        levels = Shard(0, np.zeros(1, np.int64), np.array([len(bits) * 8]), bits.tobytes()).levels(np.zeros(len(top), np.int64), top)
        lists = [pa.array([x.tolist()], pa.list_(kind)) for x, kind in ((at, pa.int32()), (followers, pa.int64()), (top.view(np.int64), pa.int64()), (levels, pa.int32()))]
        return pa.table([t["seg"].slice(0, 1).combine_chunks(), pa.array([bits.tobytes()], pa.binary()), *lists], names=["seg", "bits", "hot", "followers", "top", "levels"])

    return build


class BigramModel:
    """Learn with ``fit``, then ``score`` any documents."""

    def __init__(self, scratch: Scratch, counts: DataFrame, segments: DataFrame, tokens: int, types: int, hot: dict[str, np.ndarray], n_segments: int, shard_mb: int):
        self.scratch, self.counts, self.segments, self.shard_mb = scratch, counts, segments, shard_mb
        self.tokens, self.types, self.hot, self.n_segments = tokens, types, hot, n_segments

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, shard_mb: int = SHARD_MB, segment_keys: int = SEGMENT_KEYS, bits: int = BITS, scratch: Scratch | None = None) -> BigramModel:
        """Learn from the rows of docs that are not held out; counts of held-out rows only tell which tokens are hot."""
        scratch = scratch or Scratch(docs.sparkSession, "lm")
        docs = docs.select(text_col, held_out(F.col(id_col)).alias(_HELD))
        counts = docs.mapInArrow(_count_tokens(text_col), "h long, train long, every long").groupBy("h").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))
        counts = _write(scratch, counts)
        tokens, types, every = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0), F.coalesce(F.sum("every"), F.lit(0))).first()
        top = counts.where((F.col("every") * hot >= every) | (F.col("h") == int(END))).select("h", "train").toArrow()  # hot + 1 rows at most
        keys, train = top["h"].to_numpy().view(np.uint64), top["train"].to_numpy()
        keys, train = np.append(keys, START), np.append(train, train[keys == END].sum())
        order = np.argsort(keys)
        keys, train = keys[order], train[order]
        hot32 = np.sort(mix(keys) >> U(32))
        n_segments = max(1, -(-tokens // segment_keys))
        blobs = docs.mapInArrow(_bigram_blobs(text_col, keys, n_segments), "seg int, ones binary, many binary, counts binary")
        build = _segment_builder(hot32, max(1, tokens / hot), bits)
        segments = _write(scratch, blobs.groupBy("seg").applyInArrow(build, "seg int, bits binary, hot array<int>, followers array<long>, top array<long>, levels array<int>"))
        partial = segments.select(F.explode(F.arrays_zip("hot", "followers")).alias("x")).groupBy("x.hot").agg(F.sum("x.followers").alias("n")).toArrow()  # a row per hot history
        by32 = np.zeros(len(hot32), np.int64)
        by32[partial["hot"].to_numpy()] = partial["n"].to_numpy()
        followers = by32[np.searchsorted(hot32, mix(keys) >> U(32))]
        often = segments.select(F.explode(F.arrays_zip("top", "levels")).alias("x")).select("x.top", "x.levels").toArrow()  # hot rows at most
        big, level = often["top"].to_numpy().view(np.uint64), often["levels"].to_numpy()
        order = np.argsort(big)
        return cls(scratch, counts, segments, int(tokens), int(types), {"keys": keys, "train": train, "followers": followers, "bigrams": big[order], "levels": level[order]}, n_segments, shard_mb)

    def filter_bytes(self) -> int:
        return self.segments.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]

    def shard(self) -> Shard:
        """All segments as one run of bytes, read one segment at a time."""
        sizes = {r.seg: r.n for r in self.segments.select("seg", F.length("bits").alias("n")).toLocalIterator()}
        at = np.concatenate([[0], np.cumsum([max(8, sizes.get(i, 8)) for i in range(self.n_segments)])])
        data = bytearray(int(at[-1]))
        for r in self.segments.select("seg", "bits").toLocalIterator():
            data[at[r.seg] : at[r.seg] + len(r.bits)] = r.bits
        return Shard(0, at[:-1] * 8, np.array([sizes.get(i, 8) * 8 for i in range(self.n_segments)]), bytes(data))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 24 << 20, waves: int | None = None) -> DataFrame:
        """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
        docs = docs.select(id_col, text_col, held_out(F.col(id_col)).alias(_HELD), F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))).alias(_ROW))
        kind = dict(docs.dtypes)[id_col]
        parts = max(4, -(-self.tokens * 8 // part_bytes))  # about half of the tokens are rare, 16 bytes each
        schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        counts = self.counts.select(F.pmod(F.col("h"), F.lit(parts)).cast("int").alias("part"), "h", "train")
        send = _Sender(parts, self.hot, self.tokens, self.types)
        if self.filter_bytes() > self.shard_mb << 20:
            return self._score_in_waves(docs, id_col, text_col, kind, schema, send, counts, waves or min(WAVES, 1 + self.tokens // WAVE_TOKENS))
        sent = docs.sparkSession.sparkContext.broadcast(self.shard())
        blobs = docs.mapInArrow(_score_here(id_col, text_col, sent, self.n_segments, send), f"part int, ids array<{kind}>, head binary, rows binary, docs binary, hashes binary, ratios binary")
        sums = blobs.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_exact_part(parts, self.tokens, self.types), f"bucket int, ids array<{kind}>, head binary")
        return sums.groupBy("bucket").applyInArrow(_collect_bucket(id_col, self.tokens, self.types), schema)

    def _score_in_waves(self, docs: DataFrame, id_col: str, text_col: str, kind: str, schema: str, send: _Sender, counts: DataFrame, waves: int) -> DataFrame:
        """Scores by a filter that stays in its segments."""
        counts = _write(self.scratch, counts.where("train > 0").groupBy("part").applyInArrow(_pack_counts, "place int, hashes binary, counts binary"))
        segments = self.segments.select(F.col("seg").alias("place"), "bits")
        out = []
        for wave in range(waves):
            own = docs.where(F.pmod(F.shiftrightunsigned(_ROW, 16), F.lit(waves)) == wave)
            slices = _write(self.scratch, own.mapInArrow(_ask(id_col, text_col, self.n_segments, send), f"slice long, kind int, place int, ids array<{kind}>, {', '.join(f'{x} binary' for x in _HOME)}, asked binary"))
            asked = lambda what: slices.where(F.col("kind") == what).select("slice", "place", "asked").groupBy("place")  # noqa: B023, E731
            grams = asked(_GRAMS).cogroup(segments.groupBy("place")).applyInArrow(_answer_grams(send), "slice long, place int, shares binary, ratios binary")
            rare = asked(_RARE).cogroup(counts.groupBy("place")).applyInArrow(_answer_rare, "slice long, place int, counts binary")
            home = slices.where(F.col("kind") == _TEXTS).select("slice", "kind", "place", "ids", *_HOME)
            answers = home.unionByName(grams.withColumn("kind", F.lit(_GRAMS)), True).unionByName(rare.withColumn("kind", F.lit(_RARE)), True)
            out.append(_write(self.scratch, answers.groupBy("slice").applyInArrow(_finish(id_col, send, self.tokens), schema)))
            self.scratch.drop(slices)
        self.scratch.drop(counts)
        return reduce(DataFrame.unionAll, out)


#: Kinds of rows of a slice: its texts, the bigrams it asks a segment for, the rare tokens it asks a part of the vocabulary for.
_TEXTS, _GRAMS, _RARE = 0, 1, 2
#: What a slice keeps: heads, occurrences asked for in each text, the number of each one's bigram, the token of each bigram.
_HOME = ("head", "lengths", "which", "refs")
_HEAD = np.dtype([("row", "<u8"), ("n", "<i8"), ("held", "<i4"), ("known", "<i8"), ("base", "<f8"), ("model", "<f8")])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of each element's value) of runs of equal values; texts come in order, so one run is one text."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new], np.cumsum(new) - 1


class _Sender:
    """What a task keeps of its texts until it is sent on: heads with the shares that are known here, and the tokens that are not."""

    def __init__(self, parts: int, hot: dict[str, np.ndarray], tokens: int, types: int):
        self.parts, self.hot, self.norm = parts, hot, float(tokens + types + 1)

    def history(self, shard: Shard, seg: np.ndarray, keys: np.ndarray, q: np.ndarray, at: np.ndarray, is_hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of T / (c + T), q / T) of bigrams with their quantised counts q; ``at`` is the place of a hot history."""
        c, t, q = self.hot["train"][at].astype(np.float64), self.hot["followers"][at].astype(np.float64), q.copy()
        rare = np.flatnonzero(~is_hot)
        v32 = keys[rare] >> U(32)
        _, first, inv = np.unique(v32 ^ (seg[rare].astype(np.uint64) << U(32)), return_index=True, return_inverse=True)
        vs, vk = seg[rare][first], v32[first]
        cl = shard.levels(vs, mix(vk ^ _C_KEY))
        tl = np.where(cl > 0, shard.levels(vs, mix(vk ^ _T_KEY), 2), 0)
        c[rare], t[rare] = VALUES[cl][inv], VALUES[tl][inv]
        unseen = (c <= 0) | (t <= 0)
        q[unseen], c[unseen], t[unseen] = 0.0, 0.0, 1.0
        c = np.maximum(c, q)
        return np.log10(t) - np.log10(c + t), q / t

    def known(self, head: np.ndarray, doc: np.ndarray, tok: np.ndarray, t_part: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """Adds to the heads what can be told here; returns which tokens are rare."""
        at, is_hot = _Lookup(self.hot["keys"]).find(tok)
        count, own, n = self.hot["train"][at[is_hot]].astype(np.float64), doc[is_hot], len(head)
        head["known"] += np.bincount(own, count > 0, n).astype(np.int64)
        head["base"] += np.bincount(own, np.log10(count + 1.0), n)
        head["model"] += np.bincount(doc, t_part, n) + np.bincount(own, np.log10(ratio[is_hot] + (count + 1.0) / self.norm), n)
        return ~is_hot

    def blobs(self, number: int, ids: pa.Array, head: np.ndarray, doc: np.ndarray, tok: np.ndarray, ratio: np.ndarray) -> pa.RecordBatch:
        """One row with the heads and one for each part of the vocabulary that has tokens; doc counts within head."""
        part = (tok.view(np.int64) % self.parts).astype(np.int64)
        order = np.argsort(part, kind="stable")
        doc, tok, ratio, part = doc[order], tok[order], ratio[order], part[order]
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        some = np.flatnonzero(np.diff(cuts))
        rows, local, hashes, ratios = [b""], [b""], [b""], [b""]
        for p in some:
            a, b = cuts[p], cuts[p + 1]
            used, own = _runs(doc[a:b])
            rows.append(head["row"][used].tobytes())
            local.append(own.astype(np.uint32).tobytes())
            hashes.append(tok[a:b].tobytes())
            ratios.append(ratio[a:b].astype(np.float32).tobytes())
        lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (len(some) + 1), pa.int32()), ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([number % self.parts, *some.tolist()], pa.int32()), lists, pa.array([head.tobytes()] + [None] * len(some), pa.binary()), *(pa.array(x, pa.binary()) for x in (rows, local, hashes, ratios))],
            names=["part", "ids", "head", "rows", "docs", "hashes", "ratios"],
        )


def _heads(batch: pa.RecordBatch, n: np.ndarray) -> np.ndarray:
    head = np.zeros(batch.num_rows, _HEAD)
    head["row"], head["n"] = batch.column(_ROW).to_numpy().view(np.uint64), n
    head["held"] = batch.column(_HELD).to_numpy(zero_copy_only=False)
    return head


def _score_here(id_col: str, text_col: str, sent, n_segments: int, send: _Sender, keep: int = KEEP):
    """Probes the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard = sent.value
        table = _Lookup(send.hot["keys"])
        held, size, docs, number = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids, heads, doc, tok, ratio = zip(*held)
            ids = pa.concat_arrays(ids)
            return send.blobs(number, ids, np.concatenate(heads), np.concatenate(doc), np.concatenate(tok), np.concatenate(ratio))

        for batch, data, offsets in text_chunks(batches, text_col):
            tok, hist, n = _tokens(data, offsets)
            at, is_hot = table.find(hist)
            keys = bigram_keys(hist, tok)
            seg = segments_of(keys, hist, is_hot, n_segments)
            t_part, ratio = send.history(shard, seg, keys, VALUES[shard.levels(seg, keys)], at, is_hot)
            head, doc = _heads(batch, n), np.repeat(np.arange(batch.num_rows), n)
            rare = send.known(head, doc, tok, t_part, ratio)
            held.append((batch.column(id_col), head, doc[rare] + docs, tok[rare], ratio[rare].astype(np.float32)))
            size, docs = size + int(rare.sum()), docs + batch.num_rows
            if size > keep:
                yield flush()
                held, size, docs, number = [], 0, 0, number + 1
        if held:
            yield flush()

    return run


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, number of each element's value)."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _dealt(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by ``to``, rank of each element in it, starts of the runs and the end)."""
    order = np.argsort(to, kind="stable")
    rank = np.empty(len(to), np.int64)
    rank[order] = np.arange(len(to))
    own = to[order]
    return order, rank, np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(to) else np.zeros(0, np.int64), len(to))


def _ask(id_col: str, text_col: str, n_segments: int, send: _Sender, keep: int = 2 * KEEP):
    """Slices of texts: a row with the texts, and what they ask each segment and each part of the vocabulary for. Bigrams that
    are hot with their histories are scored here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often = _Lookup(send.hot["keys"]), _Lookup(send.hot["bigrams"])
        none = Shard(0, np.zeros(1, np.int64), np.array([64]), bytes(8))
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids, *rest = zip(*held)
            ids = pa.concat_arrays(ids)
            head, lengths, hist, tok = (np.concatenate(x) for x in rest)
            first, which = _distinct(tok ^ mix(hist))
            hist, tok = hist[first], tok[first]
            keys = bigram_keys(hist, tok)
            seg = segments_of(keys, hist, table.find(hist)[1], n_segments)
            order, rank, cuts = _dealt(seg)
            keys, tok, seg, which = keys[order], tok[order], seg[order], rank[which]
            place, is_hot = table.find(tok)
            first, number = _distinct(tok[~is_hot])
            rare = tok[~is_hot][first]
            part = (rare.view(np.int64) % send.parts).astype(np.int64)
            order, rank, ends = _dealt(part)
            rare, part = rare[order], part[order]
            refs = -1 - place
            refs[~is_hot] = rank[number]
            kinds = [_TEXTS] + [_GRAMS] * (len(cuts) - 1) + [_RARE] * (len(ends) - 1)
            asked = [x[a:b].tobytes() for x, at in ((keys, cuts), (rare, ends)) for a, b in zip(at, at[1:])]
            home = [head.tobytes(), lengths.astype(np.uint32).tobytes(), which.astype(np.uint32).tobytes(), refs.astype(np.int32).tobytes()]
            own = int.from_bytes(os.urandom(8), "little") >> 1  # the slices are written: no other run of the task counts
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(kinds), own, np.int64)),
                    pa.array(kinds, pa.int32()),
                    pa.array([0, *seg[cuts[:-1]].tolist(), *part[ends[:-1]].tolist()], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(kinds), pa.int32()), ids),
                    *(pa.array([x] + [None] * len(asked), pa.binary()) for x in home),
                    pa.array([None, *asked], pa.binary()),
                ],
                names=["slice", "kind", "place", "ids", *_HOME, "asked"],
            )

        for batch, data, offsets in text_chunks(batches, text_col):
            tok, hist, n = _tokens(data, offsets)
            at, is_hot = table.find(hist)
            keys = bigram_keys(hist, tok)
            head, doc = _heads(batch, n), np.repeat(np.arange(batch.num_rows), n)
            place, here = often.find(keys)
            here &= is_hot & table.find(tok)[1]
            q = VALUES[send.hot["levels"][place[here]]] if here.any() else np.zeros(0)
            t_part, ratio = send.history(none, np.zeros(len(q), np.int64), keys[here], q, at[here], is_hot[here])
            send.known(head, doc[here], tok[here], t_part, ratio)
            held.append((batch.column(id_col), head, np.bincount(doc[~here], minlength=batch.num_rows), hist[~here], tok[~here]))
            size += int((~here).sum())
            if size > keep:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _asked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(all that is asked for, bounds of each row's)."""
    own = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["asked"]]
    return np.concatenate([np.zeros(0, np.uint64), *own]), np.cumsum([0, *map(len, own)])


def _answers(t: pa.Table, bounds: np.ndarray, **columns: np.ndarray) -> pa.Table:
    cut = {name: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()) for name, x in columns.items()}
    return pa.table({"slice": t["slice"], "place": t["place"]} | cut)


def _answer_grams(send: _Sender):
    """Probes one segment of the filter for the bigrams that it is asked for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = right["bits"][0].as_py() if right.num_rows else bytes(8)
        shard = Shard(0, np.zeros(1, np.int64), np.array([len(bits) * 8]), bits)
        hot32 = mix(send.hot["keys"]) >> U(32)
        by32 = np.argsort(hot32)
        keys, bounds = _asked(left)
        first, number = _distinct(keys)
        keys = keys[first]
        at, is_hot = _Lookup(hot32[by32]).find(keys >> U(32))
        seg = np.zeros(len(keys), np.int64)
        share, ratio = send.history(shard, seg, keys, VALUES[shard.levels(seg, keys)], by32[at], is_hot)
        return _answers(left, bounds, shares=share[number], ratios=ratio.astype(np.float32)[number])

    return run


def _pack_counts(t: pa.Table) -> pa.Table:
    """One row of a part of the vocabulary: its hashes in order and their counts."""
    h, c = t["h"].to_numpy().view(np.uint64), t["train"].to_numpy()
    order = np.argsort(h)
    return pa.table({"place": t["part"].slice(0, 1).combine_chunks(), "hashes": pa.array([h[order].tobytes()], pa.binary()), "counts": pa.array([c[order].tobytes()], pa.binary())})


def _answer_rare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Exact counts of the tokens that one part of the vocabulary is asked for."""
    read = lambda name, kind: np.frombuffer(right[name][0].as_buffer(), kind) if right.num_rows else np.zeros(0, kind)
    c, (tok, bounds) = read("counts", np.int64), _asked(left)
    at, found = _Lookup(read("hashes", np.uint64)).find(tok)
    return _answers(left, bounds, counts=np.where(found, c[at] if len(c) else 0, 0).astype(np.int64))


def _finish(id_col: str, send: _Sender, tokens: int):
    """Scores the texts of one slice from the answers."""

    def run(t: pa.Table) -> pa.Table:
        kind, place = t["kind"].to_numpy(), t["place"].to_numpy()
        home = int(np.flatnonzero(kind == _TEXTS)[0])

        def answer(what: int, name: str, dtype: type) -> np.ndarray:
            rows = np.flatnonzero(kind == what)
            return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(t[name][int(i)].as_buffer(), dtype) for i in rows[np.argsort(place[rows])])])

        head, lengths, which, refs = (np.frombuffer(t[name][home].as_buffer(), dtype) for name, dtype in zip(_HOME, (_HEAD, np.uint32, np.uint32, np.int32)))
        count, is_rare = np.zeros(len(refs)), refs >= 0
        count[is_rare] = answer(_RARE, "counts", np.int64)[refs[is_rare]]
        count[~is_rare] = send.hot["train"][-1 - refs[~is_rare]]
        model = answer(_GRAMS, "shares", np.float64) + np.log10(answer(_GRAMS, "ratios", np.float32).astype(np.float64) + (count + 1.0) / send.norm)
        doc, n = np.repeat(np.arange(len(head)), lengths), len(head)
        more = lambda x: np.bincount(doc, x[which], n)
        columns = {
            "held_out": head["held"] > 0,
            "n_tokens": head["n"],
            "n_known": head["known"] + more(count > 0).astype(np.int64),
            "train_tokens": np.full(n, tokens, np.int64),
            "base_score": head["base"] + more(np.log10(count + 1.0)) - head["n"] * np.log10(send.norm),
            "score": head["model"] + more(model),
        }
        return pa.table({id_col: t["ids"][home].values} | {name: pa.array(np.ascontiguousarray(x)) for name, x in columns.items()})

    return run


def _exact_part(buckets: int, tokens: int, types: int):
    """Adds what rare tokens give, from the exact counts of one part of the vocabulary; deals heads and sums by row."""
    norm = float(tokens + types + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h, c = right["h"].to_numpy().view(np.uint64), right["train"].to_numpy()
        order = np.argsort(h)
        look, c = _Lookup(h[order]), c[order]
        ids, heads, sums = [], [], [np.zeros(0, _HEAD)]
        for row in range(left.num_rows):
            if left["head"][row].is_valid:
                ids.append(left["ids"][row].values)
                heads.append(np.frombuffer(left["head"][row].as_buffer(), _HEAD))
                continue
            read = lambda name, kind: np.frombuffer(left[name][row].as_buffer(), kind)  # noqa: B023, E731
            tok, doc, ratio, rows = read("hashes", np.uint64), read("docs", np.uint32).astype(np.int64), read("ratios", np.float32).astype(np.float64), read("rows", np.uint64)
            at, found = look.find(tok)
            count = np.where(found, c[at] if len(c) else 0, 0).astype(np.float64)
            out = np.zeros(len(rows), _HEAD)
            out["row"] = rows
            out["known"] = np.bincount(doc, count > 0, len(rows))
            out["base"] = np.bincount(doc, np.log10(count + 1.0), len(rows))
            out["model"] = np.bincount(doc, np.log10(ratio + (count + 1.0) / norm), len(rows))
            sums.append(out)
        total = np.concatenate(sums)
        rows, inv = np.unique(total["row"], return_inverse=True)
        merged = np.zeros(len(rows), _HEAD)
        merged["row"] = rows
        for name in ("known", "base", "model"):
            merged[name] = np.bincount(inv, total[name], len(rows))
        head, every = np.concatenate([*heads, np.zeros(0, _HEAD)]), pa.concat_arrays(ids) if ids else None
        bucket, lists, blobs = [], [], []
        for x, own in ((head, every), (merged, None)):
            to = (x["row"] % U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                pick = order[cuts[b] : cuts[b + 1]]
                bucket.append(int(b))
                lists.append(own.take(pa.array(pick)).to_pylist() if own is not None else [])
                blobs.append(x[pick].tobytes())
        return pa.table([pa.array(bucket, pa.int32()), pa.array(lists, left.schema.field("ids").type), pa.array(blobs, pa.binary())], names=["bucket", "ids", "head"])

    return run


def _collect_bucket(id_col: str, tokens: int, types: int):
    """Adds the sums to their texts; rows that are alike have one sum together and share it."""
    norm = np.log10(float(tokens + types + 1))

    def run(t: pa.Table) -> pa.Table:
        ids, heads, sums = [], [np.zeros(0, _HEAD)], [np.zeros(0, _HEAD)]
        for own, x in zip(t["ids"], t["head"]):
            part = np.frombuffer(x.as_buffer(), _HEAD)
            if len(own):
                ids.append(own.values)
                heads.append(part)
            else:
                sums.append(part)
        head, total = np.concatenate(heads), np.concatenate(sums)
        rows, inv, like = np.unique(head["row"], return_inverse=True, return_counts=True)
        at = np.searchsorted(rows, total["row"])
        more = {name: np.bincount(at, total[name], len(rows))[inv] / like[inv] for name in ("known", "base", "model")}
        n = head["n"].astype(np.int64)
        every = pa.concat_arrays(ids) if ids else pa.array([], t.schema.field("ids").type.value_type)
        columns = {"held_out": pa.array(head["held"] > 0), "n_tokens": pa.array(n), "n_known": pa.array(np.round(head["known"] + more["known"]).astype(np.int64)), "train_tokens": pa.array(np.full(len(n), tokens, np.int64))}
        return pa.table({id_col: every} | columns | {"base_score": pa.array(head["base"] + more["base"] - n * norm), "score": pa.array(head["model"] + more["model"])})

    return run
