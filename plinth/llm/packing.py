"""Packing by optimal length buckets and token budgets.

The global histogram of lengths goes through a dynamic program that chooses ``buckets`` boundaries with the least padding;
a text is padded to the boundary of its bucket, and batches of at most ``budget`` padded tokens form inside each bucket.

The histogram has a row for each length that occurs, so it grows with the longest text and not with the corpus, and the
program finds the true optimum over it: with the boundaries before known, the best one is the lowest of a set of lines, and the
lines' lower envelope is walked once for each bucket (linear in the number of lengths).
Batches are cut by position in the bucket: rows are numbered inside salted groups and shifted by the groups' offsets, so
even one bucket with most rows is numbered by many tasks, and each bucket has one batch at most that is not full.

Defined cases: null and empty texts have one token (the end); a text longer than the budget is a batch of its own; repeated
rows take a place each; a null id is packed like any other, and rows without id are spread over the salts by their place in the
table; an empty table gives an empty result; extra columns, also of the names of outputs, play no part. Texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.llm.common import Scratch, text_chunks, words

BUCKETS, BUDGET, SALTS, SALT_ROWS = 16, 16_384, 64, 50_000
_ROW = "__plinth_row"


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens): words and one end."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(words(data, offsets)[2].astype(np.int64) + 1)], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper boundaries (some of ``lengths``, ascending, the last always) of at most ``buckets`` buckets with the least
    total of count x boundary, that is the least padding."""
    order = np.argsort(lengths)
    length, count = [int(x) for x in np.asarray(lengths)[order]], np.asarray(counts)[order]
    n = len(length)
    if not n:
        return np.zeros(0, np.int64)
    below = [0, *(int(x) for x in np.cumsum(count))]
    best = [x * b for x, b in zip(length, below[1:])]
    choice = []
    for _ in range(min(buckets, n) - 1):
        # with a boundary at i before: best[i] + (below[j + 1] - below[i + 1]) * length[j], a line in length[j] whose slope falls with i
        new, pick = list(best), [-1] * n
        lines: list[tuple[int, int, int]] = []  # (slope, constant, i), each lowest on a range further right
        at = 0
        for j in range(1, n):
            slope, constant = -below[j], best[j - 1]
            while len(lines) > 1 and (constant - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                lines.pop()
            lines.append((slope, constant, j - 1))
            at = min(at, len(lines) - 1)
            x = length[j]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] <= lines[at][0] * x + lines[at][1]:
                at += 1
            total = lines[at][0] * x + lines[at][1] + below[j + 1] * x
            if total < new[j]:
                new[j], pick[j] = total, lines[at][2]
        choice.append(pick)
        best = new
    out, j = [n - 1], n - 1
    for pick in choice[::-1]:
        if pick[j] >= 0:
            j = pick[j]
            out.append(j)
    return np.unique([length[i] for i in out]).astype(np.int64)


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(length, rows) of each length that occurs."""
    got = lengths.groupBy("n_tokens").agg(F.count("*").alias("c")).toArrow()  # as many rows as the longest text has tokens at most
    return got["n_tokens"].to_numpy(), got["c"].to_numpy()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_tokens, bucket, bucket_len, batch, slot): batch numbers count within the bucket, slots within the batch."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    lengths = scratch.write(token_lengths(docs, id_col, text_col).withColumn(_ROW, F.monotonically_increasing_id()))  # fixed once written
    n, c = histogram(lengths)
    edges = optimal_boundaries(n, c, buckets)
    if not len(edges):
        edges = np.array([1])
    bounds = F.array(*[F.lit(int(e)) for e in edges])
    sizes = [int(c[(n <= e) & (n > (edges[i - 1] if i else 0))].sum()) for i, e in enumerate(edges)]
    salts = F.array(*[F.lit(max(SALTS, s // SALT_ROWS)) for s in sizes])
    placed = lengths.withColumn("bucket", F.size(F.filter(bounds, lambda e: e < F.col("n_tokens")))).withColumn("h", F.when(F.col(id_col).isNull(), F.xxhash64(_ROW)).otherwise(F.xxhash64(id_col, "n_tokens")))
    placed = placed.withColumn("salt", F.pmod(F.col("h"), F.element_at(salts, F.col("bucket") + 1)))
    groups = placed.groupBy("bucket", "salt").agg(F.count("*").alias("rows"))
    before = W.partitionBy("bucket").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.select("bucket", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    own = placed.withColumn("number", F.row_number().over(W.partitionBy("bucket", "salt").orderBy("h", id_col, _ROW)))
    at = F.col("offset") + F.col("number") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    return (
        own.join(offsets, ["bucket", "salt"])
        .withColumn("bucket_len", F.element_at(bounds, F.col("bucket") + 1).cast("long"))
        .select(id_col, "n_tokens", "bucket", "bucket_len", F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot"))
    )
