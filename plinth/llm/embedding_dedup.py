"""Embedding near-dedup with an inverted multi-index.

Unit vectors are split in halves, each half has a codebook of its own, and a pair of codes is a cell of the product grid.
A vector visits cells in the order of a lower bound of its squared distance to them (the sum of both halves' squared
distances to the border of the code's region; multi-sequence traversal) and stops at the bound that meets the target
recall; residents of visited cells are verified by cosine in double precision.

The bound: two unit vectors of cosine c are sqrt(2 - 2c) apart. If the difference points anywhere with equal chance, its
part across a border of a half is about normal with variance (2 - 2c) / dimensions, so a partner lies beyond squared
bound t with a chance of exp(-t * dimensions / (2 (2 - 2c))) at most. ``recall`` sets t for the farthest pairs that count;
closer pairs are found with a higher chance. With recall = 1 the bound is 2 - 2c itself, which can miss nothing.

How it scales. Equal vectors are one class from the start. Of two cells only the lower one's vectors visit the other, so
each pair is looked at once. Cells with over ``block`` residents are split into blocks, and the visitors of cells with many
visitors are dealt over several copies of the residents, so tasks stay bounded while every pair is still compared. Pairs are
counted and reduced to a spanning forest inside a task and never written. The codebooks are fitted on ``sample`` classes
(those with the least hashes); all vectors are indexed. Codebooks grow with the root of the number of classes, up to
``most_codes``, so that a cell holds about ``CELL`` classes; beyond that cells are split into blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with
nothing; vectors of different sizes never link; repeated ids are counted as vectors of their own; an empty table gives an
empty result; extra columns play no part, and names like kept or label in the input do not clash. Links count other vectors,
equal ones included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Scratch, connected_components, forest, mix

SAMPLE, CODES, MOST_CODES, CELL, BLOCK, VISITORS = 8192, 16, 256, 512, 2048, 8192
RECALL = 0.99


def usable(vec: Column, label: Column) -> Column:
    """Whether a row can link at all."""
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(label.isNotNull() & vec.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codebook by Lloyd's rounds from evenly spaced rows; codes without rows keep their place."""
    codes = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    codes = np.unique(codes, axis=0)
    for _ in range(rounds):
        near = (x @ codes.T * 2 - (codes**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes[n > 0] = total[n > 0] / n[n > 0, None]
    return codes


def border_distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distances from rows of x to each code's region; 0 for their own."""
    d = (x**2).sum(1)[:, None] - 2 * x @ codes.T + (codes**2).sum(1)
    apart = np.sqrt(np.maximum(((codes[:, None] - codes[None]) ** 2).sum(2), 1e-12))
    out = np.zeros_like(d)
    for j in range(len(codes)):
        gap = (d[:, [j]] - d) / (2 * apart[j])
        gap[:, j] = 0
        out[:, j] = np.maximum(0, gap.max(1))
    return out**2


def multi_sequence(first: np.ndarray, second: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code of the first half, code of the second half) of the cells whose bounds add up to ``stop`` at most, nearest first in each row."""
    i, j = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    a, b = np.take_along_axis(first, i, 1), np.take_along_axis(second, j, 1)
    reach = a[:, :, None] + b[:, None, :]
    row, p, q = np.nonzero(reach <= stop)
    order = np.lexsort((reach[row, p, q], row))
    row, p, q = row[order], p[order], q[order]
    return row, i[row, p], j[row, q]


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, half: int, stop: float):
        self.first, self.second, self.half, self.stop = first, second, half, stop

    @classmethod
    def fit(cls, x: np.ndarray, codes: int, threshold: float, recall: float) -> Grid:
        half = max(1, x.shape[1] // 2)
        far = 2 - 2 * threshold
        stop = far if recall >= 1 else min(far, -2 * far / x.shape[1] * np.log(1 - recall))
        rest = x[:, half:] if x.shape[1] > half else np.zeros((len(x), 1))
        return cls(kmeans(x[:, :half], codes), kmeans(rest, codes), half, stop + 1e-9)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of each row; row and cell of each visit, own cells left out)."""
        d1 = border_distances(x[:, : self.half], self.first)
        rest = x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1))
        d2 = border_distances(rest, self.second)
        own = d1.argmin(1) * len(self.second) + d2.argmin(1)
        row, a, b = multi_sequence(d1, d2, self.stop)
        cell = a * len(self.second) + b
        return own, row[cell != own[row]], cell[cell != own[row]]


def _units(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors padded by zeros to ``dims``, true sizes)."""
    sizes = np.array([len(v) for v in batch.column("vec")], np.int64)
    flat = np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in batch.column("vec")]).astype(np.float64) if len(sizes) else np.zeros(0)
    x = np.zeros((len(sizes), max(dims, int(sizes.max()) if len(sizes) else 0)))
    x[np.arange(x.shape[1])[None, :] < sizes[:, None]] = flat
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True), sizes


def _lower(own: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return cell > own[row]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = RECALL, codes: int | None = None, most_codes: int = MOST_CODES, block: int = BLOCK, visitors: int = VISITORS, sample: int = SAMPLE, scratch: Scratch | None = None
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embedding")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"), usable(F.col(vec_col), F.col(label_col)).alias("ok"))
    classes = scratch.write(base.where("ok").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("label", "vec", "n", "rep", F.xxhash64("label", "vec").alias("cls")))
    picked = classes.select("vec", "cls").orderBy("cls").limit(sample).select("vec").toArrow()
    if picked.num_rows == 0:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dims, many = classes.agg(F.max(F.size("vec")), F.count("*")).first()
    codes = codes or min(most_codes, max(CODES, round((many / CELL) ** 0.5)))
    x, _ = _units(picked.combine_chunks().to_batches()[0], dims)
    grid = spark.sparkContext.broadcast(Grid.fit(x, codes, threshold, recall))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, sizes = _units(batch, dims)
                own, row, cell = grid.value.visits(x)
                m = _lower(own, row, cell)
                row, cell = row[m], cell[m]
                labels = batch.column("label")
                at_ = np.concatenate([np.arange(len(own)), row])
                cells = np.concatenate([own, cell])
                yield pa.RecordBatch.from_arrays([labels.take(pa.array(at_)), pa.array(sizes[at_].astype(np.int32)), pa.array(cells.astype(np.int32)), pa.array(np.repeat([1, 0], [len(own), len(row)])), pa.array(np.repeat([0, 1], [len(own), len(row)]))], names=["label", "dims", "cell", "residents", "visitors"])

    kind = dict(classes.dtypes)["label"]
    sizes = classes.mapInArrow(survey, f"label {kind}, dims int, cell int, residents long, visitors long").groupBy("label", "dims", "cell").agg(F.sum("residents").alias("r"), F.sum("visitors").alias("v"))
    # blocks of a cell, and copies of each block: the residents of later blocks visit the earlier ones too
    shape = sizes.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("r") / block)).cast("int"))
    shape = shape.withColumn("nv", F.ceil((F.col("v") + F.when(F.col("nb") > 1, F.col("r")).otherwise(0)) / visitors).cast("int")).where("nb > 1 or nv > 1")
    big: dict = {}
    for r in shape.select("label", "dims", "cell", "nb", "nv").toLocalIterator():  # fewer than rows / min(block, visitors) cells
        big.setdefault((r.label, r.dims), {})[r.cell] = (r.nb, max(r.nv, 1))
    large = spark.sparkContext.broadcast(big)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, sizes = _units(batch, dims)
                own, row, cell = grid.value.visits(x)
                m = _lower(own, row, cell)
                row, cell = row[m], cell[m]
                cls = batch.column("cls").to_numpy()
                h = mix(cls.view(np.uint64))
                labels = batch.column("label").to_pylist()
                # (row, cell, is visitor) with the cell's blocks and copies
                who, where = np.concatenate([np.arange(len(own)), row]), np.concatenate([own, cell])
                guest = np.repeat([0, 1], [len(own), len(row)])
                nb, nv = np.ones((2, len(who)), np.int64)
                if large.value:
                    for key in {(labels[i], int(sizes[i])) for i in range(len(own))}:
                        table = large.value.get(key)
                        if table:
                            mine = np.flatnonzero(np.array([(labels[i], int(sizes[i])) == key for i in range(len(own))])[who])
                            cells = np.array(sorted(table))
                            shapes = np.array([table[c] for c in cells.tolist()])
                            at = np.minimum(np.searchsorted(cells, where[mine]), len(cells) - 1)
                            hit = cells[at] == where[mine]
                            nb[mine[hit]], nv[mine[hit]] = shapes[at[hit], 0], shapes[at[hit], 1]
                block_of = (h[who] % nb.astype(np.uint64)).astype(np.int64)
                copy_of = ((h[who] >> np.uint64(32)) % nv.astype(np.uint64)).astype(np.int64)
                resident = guest == 0
                # residents: each copy of their block, and as visitors one copy of each later block; visitors: one copy of each block
                parts = []
                for pick, times, make in (
                    (resident, nv, lambda p, k: (block_of[p], k, np.zeros(len(p), np.int64))),
                    (resident, nb - 1 - block_of, lambda p, k: (block_of[p] + 1 + k, copy_of[p], np.ones(len(p), np.int64))),
                    (~resident, nb, lambda p, k: (k, copy_of[p], np.ones(len(p), np.int64))),
                ):
                    n = np.where(pick, times, 0)
                    p = np.repeat(np.arange(len(who)), n)
                    k = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
                    b, c, g = make(p, k)
                    parts.append(np.stack([who[p], where[p], b, c, g], axis=1))
                rows = np.concatenate(parts)
                order = np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], sizes[rows[:, 0]]))
                rows = rows[order]
                take = pa.array(rows[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(take), pa.array(sizes[rows[:, 0]].astype(np.int32)), *(pa.array(rows[:, c].astype(np.int32)) for c in (1, 2, 3)), pa.array(rows[:, 4] > 0), batch.column("cls").take(take), batch.column("n").take(take), batch.column("vec").take(take)],
                    names=["label", "dims", "cell", "block", "copy", "visitor", "cls", "n", "vec"],
                )

    vec_type = dict(classes.dtypes)["vec"]
    dealt = classes.mapInArrow(deal, f"label {kind}, dims int, cell int, block int, copy int, visitor boolean, cls long, n long, vec {vec_type}")
    found = scratch.write(dealt.groupBy("label", "dims", "cell", "block", "copy").applyInArrow(_compare(threshold), "cls long, links long, other long"))
    counts = found.where("links > 0").groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")), scratch)
    placed = classes.select("label", "vec", "cls", "n", "rep").join(counts, "cls", "left").join(parts, classes.cls == parts.node, "left").withColumn("part", F.coalesce("component", "cls"))
    least = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "part").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    good = base.where("ok").join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = base.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _compare(threshold: float, side: int = 1024):
    """Counts links of the residents among each other (first copy only) and with the visitors; a spanning forest of the links."""

    def run(t: pa.Table) -> pa.Table:
        batch = t.combine_chunks().to_batches()[0]
        x, _ = _units(batch, 0)
        visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
        cls, n = batch.column("cls").to_numpy(), batch.column("n").to_numpy()
        r, q = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        links = np.zeros(len(cls), np.int64)
        edges: list[np.ndarray] = []
        first = batch.column("copy")[0].as_py() == 0
        for a in range(0, len(r), side):
            ra = r[a : a + side]
            sides = [r[b : b + side] for b in range(a, len(r), side)] if first else []
            sides += [q[b : b + side] for b in range(0, len(q), side)]
            for rb in sides:
                hit = x[ra] @ x[rb].T >= threshold
                if len(rb) and len(ra) and rb[0] == ra[0]:
                    np.fill_diagonal(hit, False)
                    links[ra] += hit @ n[rb]
                else:
                    links[ra] += hit @ n[rb]
                    links[rb] += hit.T @ n[ra]
                edges.append(forest(hit, ra, rb))
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        some = np.flatnonzero(links)
        return pa.table({"cls": pa.array(np.concatenate([cls[some], cls[e[:, 0]]])), "links": pa.array(np.concatenate([links[some], np.zeros(len(e), np.int64)])), "other": pa.array([*([None] * len(some)), *cls[e[:, 1]].tolist()], pa.int64())})

    return run
