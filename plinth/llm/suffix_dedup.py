"""Suffix-array dedup: bytes covered by a ``length``-byte string that also starts earlier are removed.

Every text is a byte string; matches never cross texts. "Earlier" is a smaller id, or the same id and an earlier start.

How it works.

1. *Windows by anchor.* Each window of ``length`` bytes has an anchor, its leftmost ``gram``-byte string with the least
   hash. Equal windows have equal anchors at equal places, so windows with different anchors need not be compared.
   Neighbouring windows with one anchor form a segment; a text is cut into about one segment per (length - gram) / 2
   bytes. Segments travel as packed arrays (hashes and places, no bytes), dealt by anchor.
2. *Classes.* Equal segments are one class; all but its earliest member are repeats. Anchors with several different
   segments may still share single windows: these segments, one per class, go on.
3. *Merged Burrows-Wheeler transforms.* The bytes of those segments are fetched by a second scan that probes a Bloom
   filter of their places (a false hit only adds a true segment; where so many are asked that the filter would exceed its bound,
   a join with the places keeps the others out). A bucket holds all segments of its anchors. Its segments
   are split into shards, each shard sorts its own suffixes and has its own transform, and the transforms are merged by
   interleave refinement: starting from the concatenation, each round orders all suffixes by one more leading step with a
   stable distribution by transform symbol and the shards' LF mappings (four bytes a round where a bucket's symbols fit in 16
   bits); where a border between neighbours first appears in a round, the rounds before it give their common prefix. After ``length`` rounds the runs without a border are the repeated intervals,
   and no suffix of one shard has been compared with another's. Each interval keeps its earliest start.
4. *Hot anchors.* An anchor with over ``cap`` different segments (the borders of a passage that very many texts share) does
   not go to a bucket: its windows are dealt one by one by their own hash, where all equal windows are one class.
5. Spans are united per text and cut out.

Anchors so frequent that one task should not hold their segments are found on a hash sample of the texts (1 in 64). The
sample only decides how rows are dealt: every segment of every text takes part.

Defined cases: null texts are empty; texts shorter than ``length`` are unchanged; rows that share an id count as one
document; a null id sorts last, and the id 2**63 - 1 counts as null; repeated rows are unchanged by each other; an empty table gives an empty result. ids must
be whole numbers. Columns of the input pass through, and those that clash with the outputs are replaced. Classes are told
apart by two 64-bit hashes, all else by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Scratch, mix, prefix_hash, span_hash, text_chunks

U = np.uint64
LENGTH, GRAM = 100, 40
#: Different segments of one anchor that a bucket takes, bytes of segments a bucket is made for, bytes a shard sorts.
CAP, BUCKET_BYTES, SHARD_BYTES = 2000, 1 << 19, 1 << 16
#: Bytes of packed rows a class task is made for; bounds of the Bloom filter and of the list of frequent anchors.
PART_BYTES, BLOOM_MB, FREQUENT = 8 << 20, 64, 100_000
#: Bytes of texts that a scan looks at at once; a slice of n bytes can have n windows, each of some tens of bytes.
SLICE, WINDOW_SLICE = 1 << 19, 1 << 17
_POSITION = U((1 << 24) - 1)
_LAST = (1 << 63) - 1
_KEY, _TH, _SPANS = "__plinth_key", "__plinth_hash", "__plinth_spans"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every full window."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, block: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, windows, anchor hash, content hash) of the segments of the texts in data."""
    prefix = prefix_hash(data)
    outs = []
    width = length - gram + 1
    text_end = None
    for lo in range(0, max(0, len(data) - length + 1), block):
        hi = min(lo + block, len(data) - length + 1)  # window starts
        at = np.arange(lo, hi + length - gram)
        g = span_hash(prefix, at, at + gram)
        low = sliding_min((g & ~_POSITION) | np.arange(len(g), dtype=np.uint64), width)
        anchor = (low & _POSITION).astype(np.int64)
        starts = np.arange(lo, hi)
        text_of = np.searchsorted(offsets, starts, "right") - 1 if text_end is None else None
        valid = starts + length <= offsets[text_of + 1]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text_of[1:] != text_of[:-1])
        first = np.flatnonzero(new)
        # windows that run over their text's end are the last of it, so the valid ones of a run are its head
        n = np.add.reduceat(valid, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        keep = n > 0
        first, n = first[keep], n[keep]
        s = starts[first]
        outs.append((text_of[first], s, n, g[anchor[first]], span_hash(prefix, s, s + n + length - 1)))
    if not outs:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*outs))


class _Packer:
    """Packs segment rows of many texts into one binary per part; equal segments of one packing collapse here."""

    def __init__(self, parts: int, hot: np.ndarray, length: int, keep: int = 1 << 18):
        self.parts, self.hot, self.length, self.keep = parts, hot, length, keep
        self.ids: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.n = self.docs = self.number = 0

    def add(self, ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, v: np.ndarray, h: np.ndarray) -> None:
        self.ids.append(np.stack([ids, hashes], axis=1))
        self.rows.append((doc + self.docs, start, n, v, h))
        self.n, self.docs = self.n + len(doc), self.docs + len(ids)

    def full(self) -> bool:
        return self.n >= self.keep or self.docs >= 50_000  # text numbers travel in 16 bits, and one more slice may come

    def flush(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids) if self.ids else np.zeros((0, 2), np.int64)
        doc, start, n, v, h = (np.concatenate(x) for x in zip(*self.rows)) if self.rows else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        order = np.lexsort((start, ids[doc, 0], h, v))
        doc, start, n, v, h = (x[order] for x in (doc, start, n, v, h))
        same = np.zeros(len(v), bool)
        same[1:] = (v[1:] == v[:-1]) & (h[1:] == h[:-1])
        first = np.flatnonzero(~same)
        of = np.cumsum(~same) - 1
        later = same & ((ids[doc, 0] != ids[doc[first[of]], 0]) | (start != start[first[of]])) if len(v) else same
        gone = _spans(ids[doc[later]], start[later], start[later] + n[later] + self.length - 1)
        keep = ~later
        doc, start, n, v, h = (x[keep] for x in (doc, start, n, v, h))
        frequent = np.isin(v, self.hot) if len(self.hot) else np.zeros(len(v), bool)
        part = (mix(np.where(frequent, h, v) ^ U(0x2545F4914F6CDD1D)) % U(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        doc, start, n, v, h, part, frequent = (x[order] for x in (doc, start, n, v, h, part, frequent))
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        out_part, blobs = [self.number % self.parts], [b"".join([np.int64(0).tobytes(), gone])]
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            used, local = np.unique(doc[a:b], return_inverse=True)
            out_part.append(int(p))
            blobs.append(b"".join([np.array([b - a, len(used)], np.int64).tobytes(), ids[used].tobytes(), v[a:b].tobytes(), h[a:b].tobytes(), start[a:b].astype(np.uint32).tobytes(), local.astype(np.uint16).tobytes(), n[a:b].astype(np.uint8).tobytes(), frequent[a:b].astype(np.uint8).tobytes()]))
        self.ids, self.rows, self.n, self.docs, self.number = [], [], 0, 0, self.number + 1
        return pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _spans(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """(id, text hash, start, end) rows as bytes, touching spans of a text united."""
    rows = np.stack([ids[:, 0], ids[:, 1], start.astype(np.int64), end.astype(np.int64)], axis=1) if len(start) else np.zeros((0, 4), np.int64)
    return unite(rows).tobytes()


def unite(rows: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of each (id, text hash) united."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new_text = np.ones(len(rows), bool)
    new_text[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    group = np.cumsum(new_text) - 1
    top = int(rows[:, 3].max()) + 1
    reach = np.maximum.accumulate(rows[:, 3] + group * top) - group * top
    new = new_text.copy()
    new[1:] |= rows[1:, 2] > reach[:-1]
    first = np.flatnonzero(new)
    out = rows[first]
    out[:, 3] = np.maximum.reduceat(rows[:, 3], first)
    return out


def _class_task(length: int, cap: int, last: bool):
    """Classes of one part: spans of later members, and requests (id, text hash, start, windows, anchor, hot)."""
    schema = ["id", "th", "s", "e", "v", "kind"]

    def run(t: pa.Table) -> pa.Table:
        gone, ids, v, h, start, n, frequent = [], [], [], [], [], [], []
        for x in t["blob"]:
            buf = x.as_buffer()
            rows = int(np.frombuffer(buf, np.int64, 1)[0])
            if rows == 0:
                gone.append(np.frombuffer(buf, np.int64, offset=8).reshape(-1, 4))
                continue
            used = int(np.frombuffer(buf, np.int64, 2)[1])
            at = 16
            own = np.frombuffer(buf, np.int64, 2 * used, at).reshape(-1, 2)
            at += 16 * used
            v.append(np.frombuffer(buf, np.uint64, rows, at))
            h.append(np.frombuffer(buf, np.uint64, rows, at + 8 * rows))
            start.append(np.frombuffer(buf, np.uint32, rows, at + 16 * rows))
            ids.append((own, np.frombuffer(buf, np.uint16, rows, at + 20 * rows)))
            n.append(np.frombuffer(buf, np.uint8, rows, at + 22 * rows))
            frequent.append(np.frombuffer(buf, np.uint8, rows, at + 23 * rows))
        parts = [(g[:, 0], g[:, 1], g[:, 2], g[:, 3], np.zeros(len(g), np.int64), np.zeros(len(g), np.int8)) for g in gone]
        if v:
            v, h, start, n, frequent = (np.concatenate(x) for x in (v, h, start, n, frequent))
            order = np.argsort(v, kind="stable")
            vs = v[order]
            twin = np.zeros(len(vs), bool)
            twin[1:] = vs[1:] == vs[:-1]
            twin[:-1] |= twin[1:]
            pick = order[twin | (frequent[order] > 0)]
            pick.sort()
            bounds = np.concatenate([[0], np.cumsum([len(x[1]) for x in ids])])
            id_, th = np.empty(len(pick), np.int64), np.empty(len(pick), np.int64)
            for i, (own, local) in enumerate(ids):
                a, b = np.searchsorted(pick, bounds[i]), np.searchsorted(pick, bounds[i + 1])
                doc = local[pick[a:b] - bounds[i]]
                id_[a:b], th[a:b] = own[doc, 0], own[doc, 1]
            v, h, start, n, frequent = v[pick], h[pick], start[pick].astype(np.int64), n[pick].astype(np.int64), frequent[pick] > 0
            order = np.lexsort((start, id_, h, v))
            v, h, start, n, id_, th, frequent = (x[order] for x in (v, h, start, n, id_, th, frequent))
            same_v, same = np.zeros(len(v), bool), np.zeros(len(v), bool)
            same_v[1:] = v[1:] == v[:-1]
            same[1:] = same_v[1:] & (h[1:] == h[:-1])
            first = np.flatnonzero(~same)
            of = np.cumsum(~same) - 1
            later = same & ((id_ != id_[first[of]]) | (start != start[first[of]])) if len(v) else same
            g = unite(np.stack([id_[later], th[later], start[later], start[later] + n[later] + length - 1], axis=1))
            parts.append((g[:, 0], g[:, 1], g[:, 2], g[:, 3], np.zeros(len(g), np.int64), np.zeros(len(g), np.int8)))
            if not last:
                anchor = (np.cumsum(~same_v) - 1)[first]
                different = np.bincount(anchor)[anchor]
                ask = (different > 1) | frequent[first]
                f, hot = first[ask], (different > cap)[ask] | frequent[first][ask]
                parts.append((id_[f], th[f], start[f], n[f], v[f].view(np.int64), np.where(hot, 2, 1).astype(np.int8)))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.int8)]
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in cols], names=schema)

    return run


_FOUND = "id long, th long, s long, e long, v long, kind byte"


def shard_transform(rows: list[bytes], step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, transform symbol, LF) of the sorted suffixes of a shard.

    A symbol is the ``step`` (up to 4) bytes before a suffix, each plus one, and LF leads to the suffix that starts with them.
    A row ends in ``step`` terminators, which sort first; suffixes with fewer than ``step`` bytes before them have symbol 0.
    UTF-8 has no byte 255, so bytes plus one fit in a byte.
    """
    m, w = len(rows), max(map(len, rows)) + step
    table = np.zeros((m, 2 * w), np.uint8)
    for i, x in enumerate(rows):
        table[i, : len(x)] = np.frombuffer(x, np.uint8)
        table[i, : len(x)] += 1
    sizes = np.array([len(x) + step for x in rows])
    row = np.repeat(np.arange(m), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(table, w, axis=1)[row, place])
    order = np.argsort(suffixes.view(f"S{w}").ravel(), kind="stable")
    ends = order[: m * step]  # of these, those past the row's end come first
    past = place[ends] > (sizes - step)[row[ends]]
    order[: m * step] = np.concatenate([ends[past], ends[~past]])
    row, place = row[order], place[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    base = np.cumsum(sizes) - sizes
    before = np.where(place >= step, place - step, sizes[row] + place - step)
    symbol = np.zeros(len(order), np.uint32)
    for i in range(step):
        symbol = (symbol << np.uint32(8)) | table[row, np.minimum(before + i, w - 1)]
    symbol[place < step] = 0
    return row, place, symbol, rank[base[row] + before]


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
    """(order, lcp): the merged order of all suffixes by their first ``depth`` bytes, as positions in the shards' concatenation,
    and the common prefix with the neighbour before in whole steps, or ``depth`` where it is at least that.

    Interleave refinement: no suffixes are compared, only transform symbols are dealt out stably, ``step`` bytes a round.
    None if the shards have too many different symbols for one dealing by 16 bits.
    """
    bases = np.cumsum([0] + [len(s[0]) for s in shards])
    kinds, symbol = np.unique(np.concatenate([s[2] for s in shards]), return_inverse=True)
    if len(kinds) > 1 << 16:
        return None
    symbol = symbol.astype(np.uint8 if len(kinds) <= 256 else np.uint16)
    lf = np.concatenate([s[3] + b for s, b in zip(shards, bases)]).astype(np.int32)
    # suffixes of terminators only: first in each shard, each a block of its own
    ends = np.concatenate([np.arange(b, b + int((s[2] == 0).sum())) for s, b in zip(shards, bases)]).astype(np.int32)
    # before the first round all suffixes are alike but those past a row's end
    past = np.concatenate([np.arange(b, b + int((s[2] == 0).sum()) // step * (step - 1)) for s, b in zip(shards, bases)]).astype(np.int32)
    rest = np.ones(bases[-1], bool)
    rest[past] = False
    order = np.concatenate([past, np.flatnonzero(rest).astype(np.int32)])
    border = np.arange(len(order)) <= len(past)
    lcp = np.where(border, 0, depth).astype(np.int16)
    for h in range(step, depth + 1, step):
        sym = symbol[order]
        dealt = np.argsort(sym, kind="stable")[len(ends) :]
        block = np.cumsum(border, dtype=np.int32)[dealt]
        sym = sym[dealt]
        order = np.concatenate([ends, lf[order[dealt]]])
        new = np.ones(len(order), bool)
        np.not_equal(block[1:], block[:-1], out=new[len(ends) + 1 :])
        new[len(ends) + 1 :] |= sym[1:] != sym[:-1]
        fresh = new & ~border
        lcp[fresh] = h - step
        border |= new
        if border.all():
            break
    return order, lcp


def repeated_windows(rows: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, row, place) of every window of ``length`` bytes that occurs more than once in rows."""
    cuts, total = [0], 0
    for i, x in enumerate(rows):
        if total and total + len(x) > shard_bytes:
            cuts.append(i)
            total = 0
        total += len(x) + 1
    cuts.append(len(rows))
    for step in (4, 2, 1):
        if length % step == 0:
            shards = []
            for a, b in zip(cuts, cuts[1:]):
                row, place, symbol, lf = shard_transform(rows[a:b], step)
                shards.append((row + a, place, symbol, lf))
            if (merged := merge_transforms(shards, length, step)) is not None:
                break
    order, lcp = merged
    row, place = np.concatenate([s[0] for s in shards])[order], np.concatenate([s[1] for s in shards])[order]
    long = lcp >= length
    interval = np.cumsum(~long)
    member = long.copy()
    member[:-1] |= long[1:]
    return interval[member], row[member], place[member]


def _bucket_task(length: int):
    """Spans of windows that start earlier elsewhere in a bucket, by the merged transforms."""

    def run(t: pa.Table) -> pa.Table:
        ids, th, s = (t[c].to_numpy() for c in ("id", "th", "s"))
        rows = [x.as_py() for x in t["bytes"]]
        keep = _sharing(rows, (9 * length) // 10)
        ids, th, s, rows = ids[keep], th[keep], s[keep], [rows[i] for i in keep]
        out = np.zeros((0, 4), np.int64)
        if len(rows) > 0:
            interval, row, place = repeated_windows(rows, length)
            start = s[row] + place
            order = np.lexsort((start, ids[row], interval))
            interval, row, start = interval[order], row[order], start[order]
            first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])) if len(interval) else np.zeros(0, np.int64)
            lead = np.repeat(first, np.diff(np.concatenate([first, [len(interval)]])))
            later = (ids[row] != ids[row[lead]]) | (start != start[lead])
            out = unite(np.stack([ids[row[later]], th[row[later]], start[later], start[later] + length], axis=1))
        return pa.table([pa.array(np.ascontiguousarray(out[:, i])) for i in range(4)], names=["id", "th", "s", "e"])

    return run


def _sharing(rows: list[bytes], gram: int) -> np.ndarray:
    """Numbers of the rows that hold a gram-byte string which occurs again; the others cannot share a longer window."""
    if not rows:
        return np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    sizes = np.array([len(x) for x in rows])
    base = np.cumsum(sizes) - sizes
    n = np.maximum(0, sizes - gram + 1)
    row = np.repeat(np.arange(len(rows)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[row]
    g = span_hash(prefix_hash(data), at, at + gram)
    order = np.argsort(g)
    twin = np.zeros(len(g), bool)
    twin[1:] = g[order][1:] == g[order][:-1]
    twin[:-1] |= twin[1:]
    return np.unique(row[order[twin]])


class _Bloom:
    def __init__(self, bits: bytes, probes: int = 4):
        self.bits, self.probes = bits, probes

    @staticmethod
    def places(h: np.ndarray, size: int, probes: int = 4) -> Iterator[np.ndarray]:
        a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
        for i in range(probes):
            yield ((a + U(i) * b) % U(size)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits, np.uint8)
        out = np.ones(len(h), bool)
        for p in self.places(h, len(bits) * 8, self.probes):
            out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def _bloom(asked: DataFrame, n: int, kind: int) -> _Bloom:
    """Filter of the asked places; BLOOM_MB at most, then with more false hits, built in slices."""
    size = min(max(1 << 12, 12 * n), BLOOM_MB << 23) // 8 * 8
    slices = max(1, -(-size // (1 << 22)))

    def deal(batches):
        for b in batches:
            h = _place_hash(b.column("id").to_numpy(), b.column("s").to_numpy())
            p = np.concatenate(list(_Bloom.places(h, size))) if len(h) else np.zeros(0, np.int64)
            which = p // (1 << 22)
            order = np.argsort(which, kind="stable")
            p, which = p[order], which[order]
            cuts = np.searchsorted(which, np.arange(slices + 1))
            some = [i for i in range(slices) if cuts[i + 1] > cuts[i]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([(p[cuts[i] : cuts[i + 1]] - (i << 22)).astype(np.uint32).tobytes() for i in some], pa.binary())], names=["slice", "places"])

    def build(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 22, bool)
        for x in t["places"]:
            bits[np.frombuffer(x.as_buffer(), np.uint32)] = True
        return pa.table({"slice": pa.array([t["slice"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(size // 8)
    rows = asked.where(F.col("kind") == kind).select("id", "s").mapInArrow(deal, "slice int, places binary").groupBy("slice").applyInArrow(build, "slice int, bits binary")
    for r in rows.toLocalIterator():
        a = r.slice << 19
        b = min(len(out), a + (1 << 19))
        out[a:b] = r.bits[: b - a]
    return _Bloom(bytes(out))


def _place_hash(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.int64).view(np.uint64)) + start.astype(np.uint64))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias(_KEY), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(_TH), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP, scratch: Scratch | None = None) -> DataFrame:
    """(id, th, s, e): byte spans to remove, by id (null as the largest number) and XXH64 of the text; spans may overlap."""
    if not 0 < length - gram < 255:
        raise ValueError("a segment's number of windows travels in one byte: length - gram must be 1 to 254")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix")
    keyed = _keyed(docs, id_col, text_col)

    def survey(batches):
        total, counted = 0, {}
        for batch, data, offsets in text_chunks(batches, "text", SLICE):
            total += len(data)
            pick = np.flatnonzero(mix(batch.column(_TH).to_numpy().view(np.uint64)) % U(64) == 0)
            for i in pick:
                own = np.unique(segments(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), length, gram)[3])
                counted.setdefault(len(counted) // 64, []).append(own)
        v, c = np.unique(np.concatenate([y for x in counted.values() for y in x]), return_counts=True) if counted else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = np.ones(len(v), bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(v[keep].view(np.int64), 0)), pa.array(np.append(c[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), total))], names=["v", "n", "bytes"])

    seen = scratch.write(keyed.mapInArrow(survey, "v long, n long, bytes long").groupBy("v").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > 30 or bytes > 0"))
    total = seen.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    hot = np.sort(seen.where("n > 30").orderBy(F.desc("n"), "v").limit(FREQUENT).select("v").toArrow()["v"].to_numpy().view(np.uint64))
    parts = max(8, int(total / ((length - gram) / 2) * 24 // PART_BYTES) + 1)

    def pack(batches):
        packer = _Packer(parts, hot, length)
        for batch, data, offsets in text_chunks(batches, "text", SLICE):
            doc, start, n, v, h = segments(data, offsets, length, gram)
            packer.add(batch.column(_KEY).to_numpy(), batch.column(_TH).to_numpy(), doc, start - offsets[doc], n, v, h)
            if packer.full():
                yield packer.flush()
        yield packer.flush()

    found = scratch.write(keyed.mapInArrow(pack, "part int, blob binary").groupBy("part").applyInArrow(_class_task(length, cap, False), _FOUND))
    spans = [found.where("kind = 0").select("id", "th", "s", "e")]
    asked = {r.kind: (r.n, r.bytes) for r in found.where("kind > 0").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("e") + length - 1).alias("bytes")).collect()}
    if 1 in asked:
        bloom = spark.sparkContext.broadcast(_bloom(found, asked[1][0], 1))
        buckets = max(1, -(-asked[1][1] // BUCKET_BYTES))

        def fetch(batches):
            for batch, data, offsets in text_chunks(batches, "text", SLICE):
                doc, start, n, v, _ = segments(data, offsets, length, gram)
                ids = batch.column(_KEY).to_numpy()
                at = np.flatnonzero(bloom.value.has(_place_hash(ids[doc], start - offsets[doc])))
                doc, start, n, v = doc[at], start[at], n[at], v[at]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mix(v ^ U(0xA0761D6478BD642F)) % U(buckets)).astype(np.int32)), pa.array(ids[doc]), pa.array(batch.column(_TH).to_numpy()[doc]), pa.array(start - offsets[doc]), pa.array([raw[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist())], pa.binary())],
                    names=["bucket", "id", "th", "s", "bytes"],
                )

        rows = keyed.mapInArrow(fetch, "bucket int, id long, th long, s long, bytes binary")
        if 12 * asked[1][0] > BLOOM_MB << 23:
            rows = rows.join(found.where("kind = 1").select("id", "th", "s").distinct(), ["id", "th", "s"], "left_semi")
        spans.append(rows.groupBy("bucket").applyInArrow(_bucket_task(length), "id long, th long, s long, e long"))
    if 2 in asked:
        wide = spark.sparkContext.broadcast(_bloom(found, asked[2][0], 2))
        own_parts = max(8, int(asked[2][0] * (length - gram) / 2 * 24 // PART_BYTES) + 1)

        def windows(batches):
            packer = _Packer(own_parts, np.zeros(0, np.uint64), length)
            for batch, data, offsets in text_chunks(batches, "text", WINDOW_SLICE):
                doc, start, n, _, _ = segments(data, offsets, length, gram)
                ids = batch.column(_KEY).to_numpy()
                at = np.flatnonzero(wide.value.has(_place_hash(ids[doc], start - offsets[doc])))
                doc, start, n = doc[at], start[at], n[at]
                doc, one = np.repeat(doc, n), np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                h = span_hash(prefix_hash(data), one, one + length)
                packer.add(ids, batch.column(_TH).to_numpy(), doc, one - offsets[doc], np.ones(len(doc), np.int64), h, mix(h ^ U(0x1B873593CC9E2D51)))
                if packer.full():
                    yield packer.flush()
            yield packer.flush()

        rows = keyed.mapInArrow(windows, "part int, blob binary")
        spans.append(rows.groupBy("part").applyInArrow(_class_task(length, cap, True), _FOUND).select("id", "th", "s", "e"))
    out = spans[0]
    for x in spans[1:]:
        out = out.unionAll(x)
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP, scratch: Scratch | None = None, as_text: bool = False) -> DataFrame:
    """docs plus n_bytes, spans (array of removed [s, e), united) and kept (the remaining bytes, binary).

    With ``as_text`` the docs themselves with the remaining text in place: bytes of characters that a cut has split go too.
    """
    spans = repeated_spans(docs, id_col, text_col, length, gram, cap, scratch)
    outputs = () if as_text else ("n_bytes", "spans", "kept")
    keep = [c for c in docs.columns if c not in outputs]
    base = docs.select(*keep).withColumns({_KEY: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), _TH: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    by_text = spans.groupBy(F.col("id").alias(_KEY), F.col("th").alias(_TH)).agg(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))).alias("spans"))
    joined = base.join(by_text.withColumnRenamed("spans", _SPANS), [_KEY, _TH], "left").select(*keep, _SPANS)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    def cut(batches):
        for batch, data, offsets in text_chunks(batches, text_col):
            lists = batch.column(_SPANS)
            kept, out, sizes = [], [], np.diff(offsets)
            mine = pa.array(lists)
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                if mine[i].is_valid and len(mine[i]):
                    v = mine[i].values
                    s, e = v.field("s").to_numpy().astype(np.int64), v.field("e").to_numpy().astype(np.int64)
                    z = np.zeros(len(s), np.int64)
                    u = unite(np.stack([z, z, s, e], axis=1))
                    edge = np.concatenate([[0], u[:, 2:].ravel(), [len(raw)]]).reshape(-1, 2)
                    kept.append(b"".join(raw[a:b].tobytes() for a, b in edge))
                    out.append([{"s": int(a), "e": int(b)} for a, b in u[:, 2:]])
                else:
                    kept.append(raw.tobytes())
                    out.append([])
            if as_text:
                null = [not x.is_valid for x in batch.column(text_col)]
                texts = pa.array([None if m else k.decode("utf-8", "ignore") for k, m in zip(kept, null)], pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in keep], names=keep)
                continue
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes), pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.binary())], names=[*keep, *outputs])

    return joined.mapInArrow(cut, fields if as_text else f"{fields}, n_bytes long, spans array<struct<s: int, e: int>>, kept binary")
