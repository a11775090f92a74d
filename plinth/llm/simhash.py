"""SimHash near-dedup: 64-bit fingerprints of word shingles, pigeonhole blocks, Hamming verification.

``fingerprints`` lower-cases A-Z, takes the runs without ASCII white space as words and joins each run of ``k`` words by
single blanks (fewer words: the whole sequence; none: fingerprint zero). A bit is 1 if it is set in over half of the
shingles' XXH64 values.

``link_fingerprints`` splits the 64 bits into ``distance + 2`` blocks. Two fingerprints within ``distance`` bits agree in
at least two of them, so they meet in one of the tables keyed by a pair of blocks; each table is a self-join on its
key, verified by the Hamming distance. A key that over ``bucket`` distinct fingerprints share is not joined pairwise: its
fingerprints go to stars instead. The star of a value is every fingerprint within distance // 2 bits of it, plus, for an
odd distance, one exact further bit; for distance 2 that is the fingerprint itself and its 64 neighbours, and two
fingerprints have a common star exactly if they are within 2 bits. Rows stay linear in the group and no link is lost.

``similar_documents`` links texts whose sets of distinct shingle hashes (five words by default) have a Jaccard similarity of
0.8 or more, and is exact: it gives the components of the relation itself. Texts with equal sets are one class. Candidates
are bundles, groups of classes of which any two may be similar, and come from two sources:

* the blocks above: classes of one fingerprint, and fingerprints that the pigeonhole blocks link;
* similarity 0.8 means that about 10 of 64 bits differ, which no blocks of 64 bits can promise to find, so a prefix filter
  covers the rest: two sets of similarity t share an element among the first n - ceil(t n) + 1 of each in any common order
  (here elements that are frequent in a sample of texts come last). Each key's classes go to the bundle of the key's least
  class, so a group of near copies makes few bundles however many keys it shares.

A lossless check thins the bundles before any set travels: the numbers of a set's elements in equal ranges of the hash (a power
of two of them, 128 or more, about a quarter of its elements) are its sketch, and the sum of the differences of two sketches is no
more than the number of elements in which the sets differ, which for similarity t is at most (1 - t) / (1 + t) of both sizes
together. Classes without a possible partner leave the bundle.

Keys travel as packed arrays in one shuffle. A key that the sample shows as frequent is dealt over many tasks and meets in
its bundle only. Bundles are cut into blocks by rows and bytes, and each pair of blocks is a task of its own, which counts
the common elements of all its pairs, so no group is capped and none meets in one task. Only sets of bundled classes travel.

Defined cases: null and empty texts have fingerprint zero and link like any other; a null id keeps its row and never
becomes a component's id unless the whole component has none; repeated rows give repeated results; an empty table gives
an empty result; extra columns play no part, and names like fp or component_id in the input do not clash. Texts are
processed whole. ``drop_similar`` decides by row: of a component it keeps one row with the least id (of rows with this id
one text, by hash), also where ids or whole rows repeat; null and empty texts are one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Bloom, Scratch, connected_components, forest, lower_ascii, mix, text_chunks, words

SEED = 42
#: Distinct fingerprints that one key joins pairwise; larger keys take the linear way.
BUCKET = 64


def fingerprint(tokens: list[bytes], k: int) -> int:
    """Fingerprint of one token sequence, as an unsigned number."""
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64)
    return int(_majority(h, np.array([0, len(h)]))[0])


def _majority(h: np.ndarray, bounds: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """For each range of h the number whose bits are set in over half of it; empty ranges give 0."""
    out = np.zeros((len(bounds) - 1, 64), np.int64)
    for at in range(0, len(h), block):
        part = h[at : at + block]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(bounds, at, "right")) - 1
        last = int(np.searchsorted(bounds, at + len(part), "left"))
        cuts = np.clip(bounds[first : last + 1] - at, 0, len(part))
        rows = np.flatnonzero(np.diff(cuts)) + first
        out[rows] += np.add.reduceat(bits, cuts[rows - first], axis=0, dtype=np.int32)
    set_bits = (2 * out > np.diff(bounds)[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id_col, fp) with the fingerprint as a signed 64-bit number; one row per input row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, bounds in _hashes(batches, text_col, k):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(_majority(h, bounds).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _hashes(batches: Iterator[pa.RecordBatch], text_col: str, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, hashes of all shingles of its texts, bounds of each text's)."""
    for batch, data, offsets in text_chunks(batches, text_col):
        data = lower_ascii(data)
        starts, ends, counts = words(data, offsets)
        if len(starts):
            yield batch, *_shingle_hashes(data, starts, ends, counts, k)
        else:
            yield batch, np.zeros(0, np.uint64), np.zeros(batch.num_rows + 1, np.int64)


def _shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, bounds of each text's shingles)."""
    size = ends - starts
    before = np.cumsum(size) - size
    at = np.concatenate([[0], np.cumsum(size + 1)])  # each word and one blank
    joined = np.full(at[-1], 0x20, np.uint8)
    step = np.arange(size.sum())
    joined[np.repeat(at[:-1] - before, size) + step] = data[np.repeat(starts - before, size) + step]
    text = joined.tobytes()
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts > 0, np.maximum(1, counts - k + 1), 0)
    first = np.repeat(bounds[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    last = np.minimum(first + k, np.repeat(bounds[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last + 1] - 1).tolist())), np.uint64, len(first))
    return h, np.concatenate([[0], np.cumsum(n)])


def block_masks(distance: int) -> list[int]:
    """Masks of the pairs of blocks; values within ``distance`` bits agree under at least one mask."""
    blocks = distance + 2
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [a | b for a, b in combinations(own, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def link_fingerprints(fps: DataFrame, scratch: Scratch, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct values of ``fp`` that give the components of the relation "within distance bits"."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(keyed.join(sizes, ["t", "key"]))
    small = shared.where(F.col("n") <= bucket).select("fp", "t", "key")
    pairs = (
        small.alias("x")
        .join(small.alias("y"), ["t", "key"])
        .where("x.fp < y.fp")
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )
    hot = shared.where(F.col("n") > bucket).select("fp").distinct()
    return pairs.unionAll(star_edges(hot, distance))


def star_edges(fps: DataFrame, distance: int) -> DataFrame:
    """Edges to the smallest fingerprint of each star, linear in the input; see the module's text.

    With r = distance // 2, two values within 2r bits have a common value within r bits of both. Values within r bits of
    one centre are within 2r of each other, so every star is a set of links. An odd distance is covered by the stars of
    the r-balls with values of one further bit on one side, verified by their distance.
    """
    r = distance // 2
    flips = [0] + [sum(1 << i for i in c) for n in range(1, r + 1) for c in combinations(range(64), n)]
    ball = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in flips])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("c"))
    tops = ball.groupBy("c").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    star = ball.join(tops.where("a <> z").select("c", "a"), "c").where("fp <> a").select("a", F.col("fp").alias("b"))
    if distance % 2:
        wide = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[F.lit(_signed(sum(1 << i for i in c))) for c in combinations(range(64), r + 1)])).alias("m"))
        near = wide.select("b", F.col("b").bitwiseXOR(F.col("m")).alias("c")).join(tops.select("c", "a"), "c").where("a <> b")
        star = star.unionAll(near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b"))
    return star.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2, bucket: int = BUCKET, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id reachable over links, the row's own included."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs, id_col, text_col, k))
    classes = scratch.write(own.groupBy("fp").agg(F.min(id_col).alias("rep")))
    edges = link_fingerprints(classes.select("fp"), scratch, distance, bucket)
    parts = connected_components(edges, scratch)
    # the component of a class by fingerprint, then its smallest id
    placed = classes.join(parts, classes.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    least = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "part").select("fp", "component_id")
    return own.join(named, "fp").select(id_col, "fp", "component_id")


#: Texts whose shingles are counted for the order of the prefix filter, and counts from which a key is dealt over many tasks.
ORDER_SAMPLE, HOT_TIMES = 16384, 32
#: Packed bytes a candidate task is made for; classes and bytes of a block of a bundle.
PART_BYTES, BLOCK_ROWS, BLOCK_BYTES = 16 << 20, 1024, 8 << 20
_ROW = "__plinth_row"


def _set_id(s: np.ndarray) -> int:
    """A hash of a whole set as an unsigned number; 0 for the empty one."""
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0


def _frequent(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that occur repeatedly in a sample of texts. They order the prefixes, and any order is exact."""
    share = min(1.0, ORDER_SAMPLE / max(1, docs.count()))
    some = docs if share == 1 else docs.where(F.pmod(F.col(_ROW), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, bounds in _hashes(batches, text_col, k):
            sets = [np.unique(h[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[:0], *sets]).view(np.int64))], names=["h"])

    got = some.select(text_col).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _prefix_blobs(text_col: str, k: int, num: int, den: int, often: np.ndarray, times: np.ndarray, hot: np.ndarray, parts: int, keep: int = 1 << 19):
    """Packs (class, size, prefix keys) of texts into one binary per part; equal classes of a packing collapse here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        sizes, keys, held = [], [], 0

        def flush() -> pa.RecordBatch:
            cls, n = np.fromiter(seen, np.uint64, len(seen)), np.array(sizes, np.uint32)
            key = np.concatenate(keys)
            local = np.repeat(np.arange(len(cls)), [len(x) for x in keys])
            salted = np.isin(key, hot)
            part = (mix(np.where(salted, key ^ mix(cls[local]), key)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((key, part))
            key, local, part = key[order], local[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            some, blobs = np.flatnonzero(np.diff(cuts)), []
            for p in some:
                a, b = cuts[p], cuts[p + 1]
                used, own = np.unique(local[a:b], return_inverse=True)
                blobs.append(b"".join([np.array([b - a, len(used)], np.int64).tobytes(), cls[used].tobytes(), key[a:b].tobytes(), n[used].tobytes(), own.astype(np.uint32).tobytes()]))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for _, h, bounds in _hashes(batches, text_col, k):
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                s = np.unique(h[a:b])
                name = _set_id(s)
                if not len(s) or name in seen:
                    continue
                rank = np.zeros(len(s), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, times[at], 0)
                first = s[np.argsort(rank, kind="stable")[: len(s) - -(-num * len(s) // den) + 1]]
                seen[name] = len(seen)
                sizes.append(len(s))
                keys.append(first)
                held += len(first)
                if held > keep:
                    yield flush()
                    seen, sizes, keys, held = {}, [], [], 0
        if held:
            yield flush()

    return run


def _bundle_task(num: int, den: int, hot: np.ndarray):
    """(bundle, cls, n, hot): the classes of each shared key under the key's least class; those of hot keys under the key."""

    def run(t: pa.Table) -> pa.Table:
        cls, key, n = [], [], []
        for x in t["blob"]:
            buf = x.as_buffer()
            rows, used = np.frombuffer(buf, np.int64, 2).tolist()
            at = 16 + 8 * used + 8 * rows
            own = np.frombuffer(buf, np.uint32, rows, at + 4 * used)
            cls.append(np.frombuffer(buf, np.uint64, used, 16)[own])
            key.append(np.frombuffer(buf, np.uint64, rows, 16 + 8 * used))
            n.append(np.frombuffer(buf, np.uint32, used, at)[own])
        cls, key, n = np.concatenate(cls), np.concatenate(key), np.concatenate(n).astype(np.int64)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        twin = np.isin(sorted_key, hot)
        twin[1:] |= sorted_key[1:] == sorted_key[:-1]
        twin[:-1] |= sorted_key[1:] == sorted_key[:-1]
        order = order[twin]
        cls, key, n = cls[order].view(np.int64), key[order], n[order]
        order = np.lexsort((cls, key))
        cls, key, n = cls[order], key[order], n[order]
        new = np.ones(len(cls), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (key[1:] != key[:-1])
        cls, key, n = cls[new], key[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        m = np.diff(np.append(first, len(key)))
        many, lead, of = np.repeat(m, m), np.repeat(cls[first], m), np.repeat(n[first], m)
        wide = np.isin(key, hot)
        # two classes of unlike sizes cannot be similar; of a larger group any two may be
        plain = ~wide & (cls != lead) & ((many > 2) | (np.minimum(n, of) * den >= np.maximum(n, of) * num))
        rows = np.unique(np.stack([np.concatenate([lead[plain], lead[plain]]), np.concatenate([cls[plain], lead[plain]]), np.concatenate([n[plain], of[plain]])], axis=1), axis=0)
        rows = np.concatenate([rows, np.stack([key[wide].view(np.int64), cls[wide], n[wide]], axis=1)])
        is_hot = np.arange(len(rows)) >= len(rows) - int(wide.sum())
        return pa.table([*(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)), pa.array(is_hot)], names=["bundle", "cls", "n", "hot"])

    return run


def common_elements(sets: list[np.ndarray], dense: int = 32, width: int = 4096) -> np.ndarray:
    """How many elements any two of the sets share, as a square matrix."""
    m = len(sets)
    element = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    times = np.diff(np.append(first, len(element)))
    out = np.zeros((m, m), np.int64)
    # elements of few sets pair by pair, by the distance of the pair in the element's list
    few = np.flatnonzero(np.repeat((times > 1) & (times <= dense), times))
    column = np.repeat(np.arange(len(first)), times)
    for step in range(1, dense):
        few = few[few + step < len(row)]
        few = few[column[few] == column[few + step]]
        if not len(few):
            break
        out += np.bincount(row[few] * m + row[few + step], minlength=m * m).reshape(m, m)
    out += out.T
    # elements of many sets by products of incidence matrices
    many = times > dense
    number = np.cumsum(many) - 1
    for at in range(0, int(many.sum()), width):
        own = np.flatnonzero(np.repeat(many & (number >= at) & (number < at + width), times))
        x = np.zeros((m, width), np.float32)
        x[row[own], number[column[own]] - at] = 1
        out += (x @ x.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _sketch(s: np.ndarray) -> bytes:
    """Elements of a set in equal ranges of the hash, 255 at most; a smaller number never adds to a difference."""
    bits = max(7, (max(1, len(s) // 4) - 1).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _block_pairs(t: pa.Table) -> Iterator[np.ndarray]:
    """The row numbers of each pair of blocks of a bundle, in the order of classes."""
    bundle, i, j, block, cls = (t[c].to_numpy() for c in ("bundle", "i", "j", "block", "cls"))
    order = np.lexsort((cls, block, j, i, bundle))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (bundle, i, j):
        new[1:] |= x[order][1:] != x[order][:-1]
    starts = np.append(np.flatnonzero(new), len(order))
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a > 1:
            yield order[a:b]


def possible_partners(n: np.ndarray, sketches: list[np.ndarray], num: int, den: int, block: np.ndarray | None = None) -> np.ndarray:
    """Which of the sets (sizes in ascending order) may be similar to another, of another block if blocks are given."""
    widths = np.array([len(x) for x in sketches])
    some, folded = np.zeros(len(n), bool), {}
    for a in range(len(n)):
        end = int(np.searchsorted(n, n[a] * den // num, "right"))  # larger sets cannot be similar
        if end <= a + 1:
            continue
        w = int(widths[a])
        if w not in folded:  # sets of this many ranges and the next ones, folded to as many
            rows = np.flatnonzero((widths >= w) & (widths <= 4 * w))
            folded[w] = int(rows[0]), np.stack([sketches[i].reshape(w, -1).sum(1, dtype=np.int32) for i in rows])
        base, table = folded[w]
        near = np.abs(table[a + 1 - base : end - base] - table[a - base]).sum(1) * (den + num) <= (n[a + 1 : end] + n[a]) * (den - num)
        if block is not None:
            near &= block[a + 1 : end] != block[a]
        if near.any():
            some[a] = True
            some[a + 1 : end][near] = True
    return some


def _possible_task(num: int, den: int):
    """(bundle, cls) of the classes that may have a partner by the sketches of a pair of blocks."""

    def run(t: pa.Table) -> pa.Table:
        bundle, cls, block, n = (t[c].to_numpy() for c in ("bundle", "cls", "block", "n"))
        i, j = t["i"].to_numpy(), t["j"].to_numpy()
        sketches = [np.frombuffer(x.as_buffer(), np.uint8) for x in t["sketch"]]
        some = np.zeros(len(cls), bool)
        for own in _block_pairs(t):
            own = own[np.argsort(n[own], kind="stable")]
            some[own] |= possible_partners(n[own], [sketches[x] for x in own], num, den, block[own] if i[own[0]] != j[own[0]] else None)
        return pa.table([pa.array(bundle[some]), pa.array(cls[some])], names=["bundle", "cls"])

    return run


def _similar_task(num: int, den: int):
    """A forest (a, b) of the similar pairs of each bundle's pair of blocks."""

    def run(t: pa.Table) -> pa.Table:
        i, j, block, cls = (t[c].to_numpy() for c in ("i", "j", "block", "cls"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]]
        edges = [np.zeros((0, 2), np.int64)]
        for own in _block_pairs(t):
            if len(own) == 2:
                x, y = sets[own[0]], sets[own[1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * den >= (len(x) + len(y) - both) * num:
                    edges.append(cls[own][None, :])
                continue
            n = np.array([len(sets[x]) for x in own])
            both = common_elements([sets[x] for x in own])
            hit = both * den >= (n[:, None] + n[None, :] - both) * num
            np.fill_diagonal(hit, False)
            if i[own[0]] != j[own[0]]:
                hit &= block[own][:, None] != block[own][None, :]
            edges.append(forest(hit, cls[own], cls[own]))
        e = np.unique(np.concatenate(edges), axis=0)
        return pa.table([pa.array(np.ascontiguousarray(e[:, c])) for c in range(2)], names=["a", "b"])

    return run


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float, distance: int, scratch: Scratch, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, hot_times: int = HOT_TIMES) -> DataFrame:
    """(id_col, __plinth_row, lead): the row's hash and the least (id, hash) of its component, one row per input row."""
    kind = dict(docs.dtypes)[id_col]
    num, den = Fraction(similarity).limit_denominator(10**6).as_integer_ratio()
    docs = docs.select(id_col, text_col, F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))).alias(_ROW))
    often, times = _frequent(docs, text_col, k)
    hot = often[times >= hot_times]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, bounds in _hashes(batches, text_col, k):
            sets = [np.unique(h[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            ids = pa.array(np.array([_set_id(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(_ROW), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(_majority(h, bounds).view(np.int64)), pa.array([_sketch(s) for s in sets], pa.binary())], names=[id_col, _ROW, "cls", "n", "fp", "sketch"])

    own = scratch.write(docs.mapInArrow(name, f"`{id_col}` {kind}, `{_ROW}` long, cls long, n long, fp long, sketch binary"))
    lead = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(_ROW).alias("row")))
    classes = scratch.write(own.groupBy("cls").agg(lead.alias("lead"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("sketch").alias("sketch")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # classes that the blocks of fingerprints bring together
    by_fp = scratch.write(classes.where("n > 0").groupBy("fp").agg(F.min(F.struct("cls", "n")).alias("least")))
    near = link_fingerprints(by_fp.select("fp"), scratch, distance)
    alike = classes.where("n > 0").join(by_fp, "fp").where("cls <> least.cls").select("least", "cls", "n")
    blocks = near.join(by_fp.withColumnRenamed("fp", "a"), "a").select("b", "least").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("other")), "b").select("least", "other.cls", "other.n")
    close = scratch.write(alike.unionAll(blocks))
    close = close.select(F.col("least.cls").alias("bundle"), "cls", "n").unionAll(close.select(F.col("least.cls").alias("bundle"), "least.cls", "least.n"))
    # classes that share a key of their prefixes
    parts = max(8, int(total * (den - num) / den * 12) // PART_BYTES + 1)
    packed = docs.select(text_col).mapInArrow(_prefix_blobs(text_col, k, num, den, often, times, hot, parts), "part int, blob binary")
    found = scratch.write(packed.groupBy("part").applyInArrow(_bundle_task(num, den, hot), "bundle long, cls long, n long, hot boolean"))
    wide = found.where("hot")
    tops = wide.groupBy("bundle").agg(F.min("cls").alias("top"))
    wide = wide.join(tops, "bundle").select(F.col("top").alias("bundle"), "cls", "n")
    every = found.where("not hot").select("bundle", "cls", "n").unionAll(wide).unionAll(close)
    bundles = scratch.write(every.groupBy("bundle", "cls").agg(F.first("n").alias("n")))
    sizes = bundles.groupBy("bundle").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    cut = F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("total") * 8 / block_bytes)).cast("int")
    placed = bundles.join(sizes.select("bundle", "m", cut.alias("cut")), "bundle")
    placed = scratch.write(placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("cut")).cast("int")))
    blocks_of = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))

    def dealt(rows: DataFrame, by_class: DataFrame, size: Column | int) -> DataFrame:
        """rows for every pair of blocks that they take part in, with what by_class has of their class, and a task of about 1 MB."""
        moved = rows.agg(F.coalesce(F.sum(F.col("cut") * size), F.lit(0))).first()[0]
        pairs = rows.select("bundle", "cls", "n", "block", blocks_of.alias("other")).select("bundle", "cls", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        task = F.pmod(F.xxhash64("bundle", "i", "j"), F.lit(max(64, int(moved // (1 << 20)) + 1))).cast("int")
        return pairs.join(by_class, "cls").withColumn("task", task).groupBy("task")

    possible = dealt(placed, classes.select("cls", "sketch"), F.greatest(F.lit(128), F.col("n") / 3) + 50).applyInArrow(_possible_task(num, den), "bundle long, cls long")
    placed = scratch.write(placed.join(possible.distinct(), ["bundle", "cls"]))
    # the sets of the classes that are left, read from one row of each
    used = scratch.write(classes.join(placed.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("lead.row").alias("row")))
    bloom = Bloom.of(used.select("row"), used.count())
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if sent.value is not None:
                    batch = batch.filter(pa.array(sent.value.has(batch.column(_ROW).to_numpy().view(np.uint64))))
                if batch.num_rows:
                    yield batch

        for batch, h, bounds in _hashes(some(), text_col, k):
            sets = [np.unique(h[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)), batch.column(_ROW), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "row", "s"])

    sets = docs.mapInArrow(fetch, "cls long, row long, s binary").join(used, ["cls", "row"], "left_semi").groupBy("cls").agg(F.first("s").alias("s"))
    edges = scratch.write(dealt(placed, sets, F.col("n") * 8).applyInArrow(_similar_task(num, den), "a long, b long"))
    comps = connected_components(edges, scratch)
    joined = classes.select("cls", "lead").join(comps, classes.cls == comps.node, "left").select("cls", "lead", F.coalesce("component", "cls").alias("part"))
    least = joined.groupBy("part").agg(F.min("lead").alias("least"))
    return own.select(id_col, _ROW, "cls").join(joined.join(least, "part").select("cls", F.col("least").alias("lead")), "cls").select(id_col, _ROW, "lead")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, distance: int = 2, scratch: Scratch | None = None, **sizes: int) -> DataFrame:
    """(id_col, component_id): the smallest id reachable over pairs of texts whose shingle sets are similar."""
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    return _similar_rows(docs, id_col, text_col, k, similarity, distance, scratch, **sizes).select(id_col, F.col("lead.id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, distance: int = 2, scratch: Scratch | None = None, **sizes: int) -> DataFrame:
    """The rows of docs that stay if one row of each group of similar texts does; see the module's text.

    Rows that a Bloom filter of the doubtful ones (dropped or repeated) does not know pass without a shuffle of their texts;
    the others are decided by a join.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    rows = _similar_rows(docs, id_col, text_col, k, similarity, distance, scratch, **sizes)
    state = rows.groupBy(_ROW).agg(F.count("*").alias("c"), F.max(F.col(_ROW) == F.col("lead.row")).alias("stays"))
    doubt = scratch.write(state.where("c > 1 or not stays"))
    sent = docs.sparkSession.sparkContext.broadcast(Bloom.of(doubt.select(_ROW), doubt.count()))
    names = docs.columns
    keyed = docs.withColumn(_ROW, F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))))
    schema = ", ".join(f"`{c}` {t}" for c, t in keyed.dtypes)

    def side(known: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = sent.value.has(batch.column(_ROW).to_numpy().view(np.uint64)) if sent.value is not None else np.ones(batch.num_rows, bool)
                yield batch.filter(pa.array(hit if known else ~hit))

        return run

    sure = keyed.mapInArrow(side(False), schema)
    open_ = keyed.mapInArrow(side(True), schema).join(doubt, _ROW, "left").where("c is null or stays").dropDuplicates([_ROW])
    return sure.select(*names).unionAll(open_.select(*names))
