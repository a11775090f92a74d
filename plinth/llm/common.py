"""Shared pieces of the training-data operators: text kernels, shared-folder tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


#: Folders made here for sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master (tests, the bench) gets a
    folder of this process; on a cluster, whose machines would not see it, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="plinth-checkpoint-"))
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive a lost executor.

    The session then passes 2,000 rows at a time to Python unless it says otherwise: rows hold whole texts, and batches of them
    count in both processes. ``write`` returns the reread table and ``drop`` removes one early. What is left goes when the session's
    process ends, since lazily returned results may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":  # the default: whole texts in batches of tens of MB
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        self.spark, self.root = spark, f"{shared_dir(spark)}/plinth-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self.close)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/t{self.count}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._plinth_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_plinth_path", None):
            remove(self.spark, path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session is gone already
            return


class Bloom:
    """Which 64-bit hashes a table holds, with false hits but no misses; a bounded bit array built by tasks in slices."""

    PROBES, SLICE_BITS = 4, 1 << 22

    def __init__(self, bits: bytes):
        self.bits = bits

    @classmethod
    def places(cls, h: np.ndarray, size: int) -> Iterator[np.ndarray]:
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(cls.PROBES):
            yield ((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        bits, out = np.frombuffer(self.bits, np.uint8), np.ones(len(h), bool)
        for p in self.places(h, len(bits) * 8):
            out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, hashes: DataFrame, n: int, max_mb: int = 64) -> Bloom | None:
        """Of the ``n`` values of the first column (long); None where 12 bits each would need over ``max_mb``."""
        size = max(1 << 12, 12 * n) // 8 * 8
        if size > max_mb << 23:
            return None
        slices = -(-size // cls.SLICE_BITS)
        column = hashes.columns[0]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                p = np.concatenate([np.zeros(0, np.int64), *cls.places(h, size)])
                which = p // cls.SLICE_BITS
                order = np.argsort(which, kind="stable")
                p, which = p[order], which[order]
                cuts = np.searchsorted(which, np.arange(slices + 1))
                some = [i for i in range(slices) if cuts[i + 1] > cuts[i]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([(p[cuts[i] : cuts[i + 1]] - i * cls.SLICE_BITS).astype(np.uint32).tobytes() for i in some], pa.binary())], names=["slice", "places"])

        def build(t: pa.Table) -> pa.Table:
            bits = np.zeros(cls.SLICE_BITS, bool)
            for x in t["places"]:
                bits[np.frombuffer(x.as_buffer(), np.uint32)] = True
            return pa.table({"slice": t["slice"].slice(0, 1).combine_chunks(), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        out, width = bytearray(size // 8), cls.SLICE_BITS // 8
        for r in hashes.select(column).mapInArrow(deal, "slice int, places binary").groupBy("slice").applyInArrow(build, "slice int, bits binary").toLocalIterator():
            a, b = r.slice * width, min(len(out), (r.slice + 1) * width)
            out[a:b] = r.bits[: b - a]
        return cls(bytes(out))


def forest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (member, smallest member) of the connected parts of a block of links; linear in its sides."""
    i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(i):
        return np.zeros((0, 2), np.int64)
    hit, a, b = hit[np.ix_(i, j)], a[i], b[j]
    la, lb = a.copy(), b.copy()
    big = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(hit, lb[None, :], big).min(1))
        nb = np.minimum(lb, np.where(hit, na[:, None], big).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    e = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([la, lb])], axis=1), axis=0)
    return e[e[:, 0] != e[:, 1]]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with (slice, bytes of all texts, offsets), about max_bytes and max_rows at most; null texts are empty.

    One text over max_bytes makes a slice of its own, so memory follows the longest text and not the batch.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
        start = 0
        while start < len(col):
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
            end = min(max(end, start + 1), start + max_rows, len(col))
            own = offsets[start : end + 1]
            yield batch.slice(start, end - start), data[own[0] : own[-1]], own - own[0]
            start = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i < n, kept between calls."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (BASE, INVERSE):
            out = np.ones(size, np.uint64)
            step, done = base, 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(step)
                step, done = step * step % (1 << 64), 2 * done
            both.append(out)
        _POWERS[size] = np.stack(both)
    return _POWERS[size][0], _POWERS[size][1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of (byte + 1) * BASE**position over i <= position < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each byte span, independent of where it stands."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, never across texts, and the number of words of each text."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    begin = solid[1:] & ~solid[:-1]
    finish = ~solid[1:] & solid[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[solid[inner] & solid[inner + 1]]  # a word would run over a border of texts
    begin[cut] = True
    finish[cut] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star contraction: each round is two aggregations and two joins over the
    remaining edges and is written to the shared folder; nothing is gathered on the driver. Nulls are no nodes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = scratch.write(e)
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small)
        scratch.drop(large)
        scratch.drop(e)
        e = new
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
