"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is split by a pattern, and each match is merged separately: a segment tree over byte positions stores the least
(rank, position) of the live pairs below each node, so its root is the leftmost pair of least rank. A merge changes three
leaves, those of the pair itself, of its right token and of its left neighbour, each a point update along one path to the
root. A match of n bytes takes O(n log n), also where it is one very long run.

Matches of up to 64 bytes are merged many at a time, their trees side by side in one array.

Ranks are read on the driver and broadcast; a vocabulary's size does not grow with the data. Encoded matches are kept in
a cache of bounded size for each worker.

Defined cases: null and empty texts have no tokens and decode to nothing; repeated rows give repeated results; an empty
table gives an empty result; columns that clash with the output are replaced. Special tokens are ordinary text. A byte that the
vocabulary has no rank for raises KeyError.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE = 400_000
_NONE = 1 << 62
_SHIFT = 40
_MASK = (1 << _SHIFT) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if rank}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    size = 1
    while size < n:
        size *= 2
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << _SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 2))
    before = list(range(-1, n + 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            if b < a:
                a = b
            if tree[i] == a:
                return
            tree[i] = a
            i >>= 1

    while tree[1] != _NONE:
        i = tree[1] & _MASK
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        put(j, _NONE)
        r = get(piece[i : after[k]]) if k < n else None
        put(i, _NONE if r is None else r << _SHIFT | i)
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            put(h, _NONE if r is None else r << _SHIFT | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted first id << 20 | second id, id of both together) of all pairs that merge."""
    keys, ids = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 20 | b)
                ids.append(rank)
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]


class Forest:
    """The segment trees of many short matches side by side: the same merges as ``merge``, one for each match a round."""

    def __init__(self, ranks: dict[bytes, int]):
        self.keys, self.ids = pair_table(ranks)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (a, b) at positions: rank << 6 | position, or none; ids below zero are no tokens."""
        key = a << 20 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.ids[i] << 6 | at, _NONE)

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of matches of up to ``width`` bytes (a power of two, at most 64), as little-endian 32-bit numbers."""
        m = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        token = np.full((m, width + 2), -1, np.int64)  # column 0 and the last stand for no neighbour
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        own = self.bytes[raw]
        if (own < 0).any():
            raise KeyError(bytes([raw[own.argmin()]]))
        token[:, 1:-1][np.arange(width)[None, :] < sizes[:, None]] = own
        after = np.tile(np.minimum(np.arange(1, width + 3), width + 1), (m, 1))
        before = np.tile(np.maximum(np.arange(-1, width + 1), 0), (m, 1))
        place = np.arange(width)
        tree = np.full((m, 2 * width), _NONE, np.int64)
        tree[:, width:] = self.pairs(token[:, 1:-1], token[:, 2:], np.broadcast_to(place, (m, width)))
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            top = tree[live, 1]
            i = (top & 63) + 1
            j = after[live, i]
            k = after[live, j]
            h = before[live, i]
            token[live, i] = top >> 6
            token[live, j] = -1
            after[live, i], before[live, k] = k, i
            self.put(tree, live, j - 1, np.full(len(live), _NONE), width)
            self.put(tree, live, i - 1, self.pairs(token[live, i], token[live, k], i - 1), width)
            own = h > 0
            self.put(tree, live[own], h[own] - 1, self.pairs(token[live[own], h[own]], token[live[own], i[own]], h[own] - 1), width)
            live = live[tree[live, 1] != _NONE]
        left = token[:, 1:-1]
        keep = left >= 0
        ids = left[keep].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(keep.sum(1))]) * 4
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    @staticmethod
    def put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        """Point updates along the paths to the roots."""
        i = leaf + width
        tree[rows, i] = value
        while width > 1:
            i = i >> 1
            tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])
            width >>= 1


class Encoder:
    """Encodes batches of texts. Ids of matches are cached; the cache is emptied when a batch would overfill it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, size: int = CACHE):
        self.ranks, self.split, self.size = ranks, regex.compile(pattern).findall, size
        self.cache: dict[str, bytes] = {}
        self.forest = Forest(ranks)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        pieces = [self.split(t) for t in texts]
        known = set().union(*pieces)
        new = known.difference(self.cache)
        if len(self.cache) + len(new) > self.size:
            self.cache = {}
            new = known
        short: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= 64:
                short.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
            else:
                self.cache[piece] = np.array(merge(raw, self.ranks), "<u4").tobytes()
        for width, own in short.items():
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                self.cache.update(zip((p for p, _ in part), self.forest.merge([r for _, r in part], width)))
        out = [b"".join(map(self.cache.__getitem__, p)) for p in pieces]
        if len(self.cache) > self.size:
            self.cache = {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


#: The encoder of the worker, kept between the tasks of one job.
_KEPT: dict[str, Encoder] = {}


def _encoder(job: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if job not in _KEPT:
        _KEPT.clear()
        _KEPT[job] = Encoder(ranks, pattern)
    return _KEPT[job]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "ids", rows: int = 256) -> DataFrame:
    """docs with the text's token ids in ``out`` (array of int) in place of the text."""
    keep = [c for c in docs.columns if c not in (out, text_col)]
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes) if keep else ""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = encoder.encode_many([x or "" for x in batch.column(text_col).to_pylist()])
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], names=[*keep, out])

    return docs.mapInArrow(run, f"{fields}`{out}` array<int>")


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "decoded", raw: str | None = None, rows: int = 256) -> DataFrame:
    """tokens plus the decoded bytes; with ``raw`` also the ids as little-endian unsigned 32-bit numbers in that column."""
    keep = [c for c in tokens.columns if c not in (out, raw)]
    fields = ", ".join(f"`{c}` {t}" for c, t in tokens.select(*keep).dtypes)
    sent = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = {i: b for b, i in sent.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in batch.column(ids_col)]
                texts = pa.array([b"".join(map(strings.__getitem__, x.tolist())) for x in ids], pa.binary())
                more = [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())] if raw else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts, *more], names=[*keep, out, *([raw] if raw else [])])

    return tokens.mapInArrow(run, f"{fields}, `{out}` binary" + (f", `{raw}` binary" if raw else ""))
