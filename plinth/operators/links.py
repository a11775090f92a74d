"""Joins that are not plain equality: prefixes, contained names, near dates, shared contacts, fuzzy titles.

Each has a blocking key that turns it into an equality join with a residual condition; none is a nested loop, and a key that
very many rows share gives members of a class rather than all their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as T


def prefix_pairs(left: DataFrame, right: DataFrame, a: str, b: str, block: int = 1) -> DataFrame:
    """Pairs where one of (a, b) begins with the other: every prefix of the longer names meets the shorter names by equality.

    Names are short, so a name gives a row per length; ``block`` is the least length of the shorter name.
    """

    def heads(df: DataFrame, c: str, out: str) -> DataFrame:
        n = F.length(c)
        return df.where(n >= block).withColumn("__head", F.explode(F.transform(F.sequence(F.lit(block), F.greatest(n, F.lit(block))), lambda i: F.substr(F.col(c), F.lit(1), i))))

    whole_a, whole_b = left.withColumn("__head", F.col(a)), right.withColumn("__head", F.col(b))
    shorter_b = heads(left, a, "__head").join(whole_b, "__head").where(F.length(a) >= F.length(b))
    shorter_a = whole_a.join(heads(right, b, "__head"), "__head").where(F.length(b) > F.length(a))
    return shorter_b.unionByName(shorter_a).drop("__head")


def contact_pairs(left: DataFrame, right: DataFrame, columns: list[tuple[str, str]], ids: tuple[str, str]) -> DataFrame:
    """Distinct pairs of ids whose rows share a non-blank contact of any kind; an equality join per kind instead of an OR.

    A pair is written at the first contact that its ids share, so the pairs themselves are never held or shuffled to be made distinct.
    """

    def held(df: DataFrame, key: str, side: int, out: str) -> DataFrame:
        return df.groupBy(key).agg(*[F.collect_set(F.when(~T.blank(F.col(c[side])), F.col(c[side]))).alias(f"{out}{i}") for i, c in enumerate(columns)])

    l, r, out = held(left, ids[0], 0, "__l"), held(right, ids[1], 1, "__r"), None
    for i in range(len(columns)):
        a, b = F.col(f"__l{i}"), F.col(f"__r{i}")
        one = l.withColumn("__k", F.explode(a)).join(r.withColumn("__k", F.explode(b)), "__k")
        one = one.where((F.size(a) == 1) | (F.size(b) == 1) | (F.col("__k") == F.array_min(F.array_intersect(a, b))))
        for j in range(i):
            one = one.where(~F.arrays_overlap(f"__l{j}", f"__r{j}"))
        one = one.select(*ids)
        out = one if out is None else out.unionByName(one)
    return out


def contact_classes(df: DataFrame, id_col: str, contact: str) -> DataFrame:
    """(id, contact, first_id, members) of rows with a non-blank contact: the smallest id that has it and how many do.

    Rows of one contact share first_id, so no pairs are written however many there are.
    """
    own = df.where(~T.blank(F.col(contact))).select(id_col, contact).distinct()
    classes = own.groupBy(contact).agg(F.min(id_col).alias("first_id"), F.count("*").alias("members"))
    return own.join(classes, contact)


def near_days(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, days: int) -> DataFrame:
    """Pairs with equal keys whose dates are at most ``days`` apart; ``gap_days`` is b - a.

    The right side is dealt into its own window of ``days`` and the two beside it, so each pair meets once.
    """
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / F.lit(days)).cast("int")
    l = left.withColumn("__bucket", bucket(a))
    r = right.withColumn("__bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: bucket(b) + o)))
    gap = F.datediff(F.col(b), F.col(a))
    return l.join(r, [*keys, "__bucket"]).withColumn("gap_days", gap).where(F.abs("gap_days") <= days).drop("__bucket")


def year_window(left: DataFrame, right: DataFrame, left_year: str, right_year: str, tolerance: int = 1, salts: int = 32) -> DataFrame:
    """Pairs whose years differ by ``tolerance`` at most, and those of right rows without a year (0).

    Every left row meets the right rows without a year: these are repeated for each salt, and a left row has one salt.
    """
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    years = F.sequence(F.col(left_year) - tolerance, F.col(left_year) + tolerance)
    keys = F.concat(F.array(F.struct(F.lit(0).alias("y"), salt.alias("s"))), F.transform(F.filter(years, lambda y: y != 0), lambda y: F.struct(y.cast("int").alias("y"), F.lit(0).alias("s"))))
    l = left.withColumn("__k", F.explode(keys))
    every = F.when(F.col(right_year) == 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.withColumn("__s", F.explode(every)).withColumn("__k", F.struct(F.col(right_year).cast("int").alias("y"), F.col("__s").alias("s"))).drop("__s")
    return l.join(r, "__k").drop("__k")


def active_at(rows: DataFrame, slots: DataFrame, keys: list[str], day: str, start: str, end: str) -> DataFrame:
    """rows x slots of equal keys whose interval [start, end] holds the row's day (dates; a null start or end is open).

    A slot is listed under each year it touches; open ends go to the years that rows have, so the join is an equality join on
    keys and year with the interval as residual.
    """
    span = rows.agg(F.min(F.year(day)).alias("__first"), F.max(F.year(day)).alias("__last"))
    bounds = slots.join(F.broadcast(span))  # one row
    low, high = F.greatest(F.coalesce(F.year(start), "__first"), "__first"), F.least(F.coalesce(F.year(end), "__last"), "__last")
    listed = bounds.where(low <= high).withColumn("__year", F.explode(F.sequence(low, high))).drop("__first", "__last")
    hit = rows.withColumn("__year", F.year(day)).join(listed, [*keys, "__year"])
    return hit.where((F.col(start).isNull() | (F.col(start) <= F.col(day))) & (F.col(end).isNull() | (F.col(end) >= F.col(day)))).drop("__year")


def active_summary(rows: DataFrame, slots: DataFrame, keys: list[str], day: str, start: str, end: str, made: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
    """rows with aggregates of the slots of equal keys whose interval [start, end] holds the row's day; rows without any are left out.

    ``made`` aggregates slots, ``merged`` what ``made`` gave, by the same names. An interval is dealt into aligned blocks of 1, 2, 4, ...
    days, two of a size at most, and a day lies in one block of each size: blocks and the days that rows have are aggregated before
    they meet, so however many slots and rows share a key, no pairs of them are made.
    """
    at = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    span = F.broadcast(rows.agg(F.min(at(day)).alias("__first"), F.max(at(day)).alias("__last")))  # one row
    sizes = F.transform(F.sequence(F.lit(0), F.length(F.bin((F.col("__last") - F.col("__first")).cast("long")))), lambda i: F.struct(i.alias("i"), F.pow(F.lit(2.0), i).cast("long").alias("n")))
    low = F.greatest(F.coalesce(at(start), "__first"), "__first") - F.col("__first")
    after = F.least(F.coalesce(at(end), "__last"), "__last") - F.col("__first") + 1

    def blocks(size: Column) -> Column:
        a, b = F.ceil(F.col("__low") / size["n"]), F.floor(F.col("__after") / size["n"])
        block = lambda n: F.struct(size["i"].alias("i"), n.cast("long").alias("n"))
        return F.array(F.when((a < b) & (a % 2 == 1), block(a)), F.when((a < b) & (b % 2 == 1), block(b - 1)))

    dealt = slots.crossJoin(span).withColumns({"__low": low, "__after": after}).where("__low < __after")
    dealt = dealt.withColumn("__k", F.explode(F.filter(F.flatten(F.transform(sizes, blocks)), lambda x: x.isNotNull())))
    held = dealt.groupBy(*keys, "__k").agg(*[c.alias(n) for n, c in made.items()])
    asked = rows.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("__day")).distinct().crossJoin(span)
    asked = asked.withColumn("__at", F.datediff("__day", F.lit("1970-01-01").cast("date")) - F.col("__first"))
    asked = asked.withColumn("__k", F.explode(F.transform(sizes, lambda s: F.struct(s["i"].alias("i"), F.floor(F.col("__at") / s["n"]).cast("long").alias("n")))))
    found = asked.select(*keys, "__day", "__k").join(held, [*keys, "__k"]).groupBy(*keys, "__day").agg(*[c.alias(n) for n, c in merged.items()])
    return rows.withColumn("__day", F.col(day)).join(found, [*keys, "__day"]).drop("__day")


def _grams(c: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct substrings of some lengths."""

    def of(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def contained_names(names: DataFrame, aliases: DataFrame, name: str, alias: str) -> DataFrame:
    """Pairs (name, alias) of distinct names and rows of aliases where one text holds the other.

    A text that holds another has its first three characters (or all of a shorter one), so pairs meet by equality on these.
    """
    head = lambda c: F.substring(c, 1, 3)
    n, a = names.where(F.length(name) > 0), aliases.where(F.length(alias) > 0)
    inside = n.withColumn("__k", F.explode(_grams(F.col(name)))).join(a.withColumn("__k", head(alias)), "__k").where(F.col(name).contains(F.col(alias)))
    around = n.withColumn("__k", head(name)).join(a.withColumn("__k", F.explode(_grams(F.col(alias)))), "__k").where(F.col(alias).contains(F.col(name)) & (F.length(alias) > F.length(name)))
    return inside.unionByName(around).drop("__k")


def best_reference(rows: DataFrame, aliases: DataFrame, name: str, alias: str, score: Column, order: list[Column]) -> DataFrame:
    """rows with the best alias by (score, order), null columns without one; ``score`` is null where an alias does not match.

    Names are matched once each, by blocks of their characters (``contained_names``), and joined back.
    """
    hit = contained_names(rows.select(name).distinct(), aliases, name, alias).withColumn("__score", score).where("__score is not null")
    own = [c for c in aliases.columns]
    best = hit.groupBy(name).agg(F.max_by(F.struct(*own), F.struct("__score", *order)).alias("__best"))
    return rows.join(best.select(name, *[F.col(f"__best.`{c}`").alias(c) for c in own]), name, "left")


def contained_phrases(texts: DataFrame, phrases: DataFrame, text_id: str, text: str, phrase_id: str, phrase: str) -> DataFrame:
    """(text_id, phrase_id) of phrases that a text holds anywhere, also inside words.

    A phrase's key is its longest inner word, which stands whole in any text that holds the phrase. A phrase without inner
    words is keyed by the first three characters of its longest word, which stand inside one of the text's words. Only the
    texts' distinct words are exploded (where such phrases exist the grams of each distinct word of all texts), and each candidate is verified.
    """
    p = phrases.select(phrase_id, phrase).where(F.length(phrase) > 0)
    parts = F.split(phrase, r"\s")
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")
    longest = lambda words: F.get(F.transform(F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), lambda x: x["w"]), F.lit(0))
    whole = p.where(F.size(inner) > 0).withColumn("__k", longest(inner))
    solid = F.filter(parts, lambda x: x != "")
    short = p.where((F.size(inner) == 0) & (F.size(solid) > 0)).withColumn("__k", F.substring(longest(solid), 1, 3))
    blank = p.where(F.size(solid) == 0).withColumn("__k", F.lit(" "))
    words = texts.select(text_id, F.explode(F.array_distinct(F.split(text, r"\s"))).alias("__w")).where("__w <> ''")
    hit = words.withColumnRenamed("__w", "__k").join(whole, "__k").select(text_id, phrase_id)
    if not short.isEmpty():  # only then is the vocabulary read, each word of it once
        vocabulary = words.select("__w").distinct().withColumn("__k", F.explode(_grams(F.col("__w"))))
        hit = hit.unionByName(words.join(vocabulary.join(short, "__k").select("__w", phrase_id), "__w").select(text_id, phrase_id))
    if not blank.isEmpty():
        spaced = texts.where(F.col(text).rlike(r"\s")).select(text_id, F.lit(" ").alias("__k"))
        hit = hit.unionByName(spaced.join(blank, "__k").select(text_id, phrase_id))
    found = hit.select(text_id, phrase_id).distinct()
    return texts.select(text_id, text).join(found, text_id).join(p, phrase_id).where(F.col(text).contains(F.col(phrase))).select(text_id, phrase_id)


def related_title_pairs(df: DataFrame, id_col: str, key: str, least: int = 10, ratio: float = 0.75) -> DataFrame:
    """(a, b, kind) that link rows with equal keys or with a key inside the other (see ``related_titles``).

    Rows are reduced to distinct keys, each with its smallest id. ``same`` rows tie every other row of a key to that id, and
    ``near`` rows tie the smallest ids of two keys, a < b; so a key that very many rows have gives as many rows and not all
    their pairs. Candidates share the shorter key's first piece of ``least`` characters: the longer key gives the pieces at the
    places where a key of enough length can start. Pieces are hashes with the id and length only; keys are fetched for candidates.
    """
    own = df.select(F.col(id_col).alias("i"), F.col(key).alias("k")).where(F.length("k") > 0)
    keys = own.groupBy("k").agg(F.min("i").alias("rep"))
    size, long = F.length("k"), keys.where(F.length("k") >= least)
    piece = lambda i: F.xxhash64(F.substr(F.col("k"), i, F.lit(least)))
    starts = F.sequence(F.lit(1), F.least(size - least + 1, size - F.floor(ratio * size).cast("int") + 1))
    first = long.select(F.col("rep").alias("x"), size.alias("n"), piece(F.lit(1)).alias("piece"))
    every = long.select(F.col("rep").alias("y"), size.alias("m"), F.explode(F.array_distinct(F.transform(starts, piece))).alias("piece"))
    pairs = first.join(every, "piece").where((F.col("n") < F.col("m")) & (F.col("n") >= ratio * F.col("m"))).select("x", "y")
    near = pairs.join(long.select(F.col("rep").alias("x"), F.col("k").alias("short")), "x").join(long.select(F.col("rep").alias("y"), F.col("k").alias("long")), "y")
    near = near.where((F.length("short") < F.length("long")) & F.col("long").contains(F.col("short")) & (F.length("short") >= ratio * F.length("long")))
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("near").alias("kind")).distinct()
    same = own.join(keys, "k").where("i <> rep").select(F.col("rep").alias("a"), F.col("i").alias("b"), F.lit("same").alias("kind"))
    return same.unionByName(near)
