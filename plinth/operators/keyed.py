"""Latest, best and unique rows per key, upserts, ordered samples and anti joins.

All are single-shuffle plans: aggregates combine on the map side, windows are used only where ranks are needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row with the largest ``order`` of each key, as an aggregate; ties end at the last order column."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.`{c}`").alias(c) for c in rest])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each map task's groups to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def with_gap(df: DataFrame, keys: list[str], score: str, order: list[Column], gap: str = "gap", rank: str = "rank") -> DataFrame:
    """Rank, and the score's lead over the next row of the key (null for the last)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({rank: F.row_number().over(w), gap: F.col(score) - F.lead(score).over(w)})


def only_match(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(keys, target) of the keys that have exactly one distinct target."""
    n = df.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("__most"))
    return n.where(F.col(target) == F.col("__most")).drop("__most")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), order: list[str] | None = None) -> DataFrame:
    """Keyed upsert: new rows, with ``keep`` columns taken from the old row where there is one, and old rows without a new one.

    Of several new rows of one key the largest by ``order`` (by default all their other columns) counts.
    """
    new = latest_per_key(new, keys, order or [c for c in new.columns if c not in keys]).select(*new.columns)
    kept = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep], F.lit(True).alias("__had"))
    updated = new.join(kept, keys, "left")
    for c in keep:
        updated = updated.withColumn(c, F.when(F.col("__had"), F.col(f"__old_{c}")).otherwise(F.col(c)))
    return updated.select(*new.columns).unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def without_any(df: DataFrame, uses: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows whose key is used nowhere; uses are (frame, its column, df's column). A use counts once, however many rows have it."""
    return reduce(lambda d, u: d.join(u[0].select(F.col(u[1]).alias(u[2])).where(F.col(u[2]).isNotNull()).distinct(), u[2], "left_anti"), uses, df)


def linked_pairs(paths: list[DataFrame]) -> DataFrame:
    """Set union of link paths with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), paths).distinct()


def ordered_sample(*parts: Column, k: int = 6) -> Column:
    """Distinct values of the concatenated arrays in order, at most k."""
    return F.slice(F.array_distinct(F.concat(*parts)), 1, k)


def collect_sorted(value: Column, order: Column) -> Column:
    """Values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def alias_roots(aliases: DataFrame) -> DataFrame:
    """(old, new): what each merged value ends at. Chains are followed to their end by doubling; values of a cycle, and those that
    lead to one, end at the cycle's least value. Of several targets of one value the least counts."""
    step = aliases.where("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    step = step.withColumn("least", F.least("old", "new")).persist()  # each round reads the one before twice
    reach, many = 1, step.count()
    while True:
        after = step.select(F.col("old").alias("new"), F.col("new").alias("__next"), F.col("least").alias("__least"))
        open_ = step.join(after, "new", "left")
        if reach > many or open_.where("__next is not null").isEmpty():
            break
        step = open_.select("old", F.coalesce("__next", "new").alias("new"), F.least("least", F.coalesce("__least", "least")).alias("least")).persist()
        reach *= 2
    # a target that is still merged itself stands on a cycle, and after so many steps its least value is the cycle's
    return open_.select("old", F.coalesce("__least", "new").alias("new")).where("old <> new")


def replace_values(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Values of a column replaced by (old, new) of ``alias_roots``."""
    a = roots.select(F.col("old").alias(column), F.col("new").alias("__new"))
    return df.join(a, column, "left").withColumn(column, F.coalesce("__new", column)).select(*df.columns)


def apply_alias(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Values replaced by what they were merged into; ``aliases`` is (old, new), see ``alias_roots``."""
    return replace_values(df, alias_roots(aliases), column)


def distinct_key(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Keys made distinct by -2, -3, ... in order."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(key)).otherwise(F.concat_ws("-", key, n.cast("string"))))
