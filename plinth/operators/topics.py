"""Topics: ranked candidates from weighted fields, links with confidence, rollups per (party, topic, year)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions.scores import rollup_scores

# Weight of a token by the field it stands in.
FIELD_WEIGHTS = {"title": 5, "summary": 3, "purpose": 4, "unit": 2, "extra": 2}


def tokens(c: Column, least: int = 4, deny: list[str] = ()) -> Column:
    """Distinct lower-case letter runs of ``least`` characters or more that are not denied."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), F.lit(1)))
    return F.filter(found, lambda x: (F.length(x) >= least) & ~x.isin(list(deny) or [""]))


def weighted_tokens(df: DataFrame, id_col: str, fields: dict[str, int], least: int = 4) -> DataFrame:
    """(id, token, score): the sum of the weights of the fields that have the token."""
    each = F.array(*[F.struct(tokens(F.col(c), least).alias("t"), F.lit(w).alias("w")) for c, w in fields.items()])
    rows = df.select(id_col, F.explode(each).alias("f")).select(id_col, F.explode("f.t").alias("token"), F.col("f.w").alias("w"))
    return rows.groupBy(id_col, "token").agg(F.sum("w").alias("score"))


def ranked_candidates(scored: DataFrame, id_col: str, limit: int = 6) -> DataFrame:
    """(id, candidates): the best tokens by (score, length, token), skipping a token that holds or is held by a better one.

    The greedy choice is a fold over each row's own sorted array.
    """
    own = scored.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("score", F.length("token").alias("n"), "token")), asc=False).alias("s"))
    empty = F.array().cast("array<struct<score:bigint,n:int,token:string>>")
    clash = lambda x: lambda y: (y["token"].contains(x["token"]) | x["token"].contains(y["token"])) & (y["score"] >= x["score"])
    pick = F.aggregate("s", empty, lambda acc, x: F.when((F.size(acc) < limit) & ~F.exists(acc, clash(x)), F.concat(acc, F.array(x))).otherwise(acc))
    return own.select(id_col, F.transform(pick, lambda x: F.struct(x["token"].alias("token"), x["score"].alias("score"))).alias("candidates"))


def inferred_confidence(score: Column) -> Column:
    return F.least(F.lit(0.36) + 0.06 * score, F.lit(0.82))


def inferred_weight(score: Column) -> Column:
    return F.least(F.lit(0.25) + 0.03 * score, F.lit(0.72))


def declared_confidence(position: Column) -> Column:
    return F.greatest(F.lit(0.68), F.lit(0.95) - 0.05 * position)


def declared_weight(position: Column) -> Column:
    return F.greatest(F.lit(0.55), F.lit(0.92) - 0.08 * position)


def link_confidence(exact: Column, shared: Column, fuzzy: Column, year_gap: Column, weight: Column) -> Column:
    """Confidence of a declared topic: phrase, shared tokens (or a fuzzy match without any), nearness of years, topic weight."""
    out = F.lit(0.54) + F.when(exact, 0.18).otherwise(0.0) + F.least(0.08 * shared, F.lit(0.18)) + F.when(fuzzy & (shared == 0), 0.06).otherwise(0.0)
    out = out + F.when(year_gap == 0, 0.08).when(year_gap == 1, 0.03).otherwise(0.0) + F.least(0.12 * weight, F.lit(0.1))
    return F.least(out, F.lit(0.98))


def best_links(links: DataFrame, record: str, topic: str, limit: int = 6) -> DataFrame:
    """The best link of each (record, topic), then the first ``limit`` of each record by (priority, confidence, topic)."""
    one = links.groupBy(record, topic).agg(F.max(F.struct("confidence", "is_priority")).alias("b")).select(record, topic, "b.confidence", "b.is_priority")
    rank = F.row_number().over(W.partitionBy(record).orderBy(F.desc("is_priority"), F.desc("confidence"), F.desc(topic)))
    return one.withColumn("rank", rank).where(F.col("rank") <= limit)


def party_topic_rollup(links: DataFrame, party: str, topic: str, year: str, record: str, unit: str, priority: str, confidence: str, day: str) -> DataFrame:
    """Counts, mean, span and the four derived scores per (party, topic, year).

    ``priority`` is summed over rows and the mean is over rows, fan-out by unit spellings included; blank units count as one.
    Rows are dealt once by their keys; the first row of each record and of each unit counts, where two distinct counts would deal out
    three copies of each row.
    """
    keys = [party, topic, year]
    unit_key = F.coalesce(F.col(unit), F.lit(""))
    rows = links.select(*keys, F.col(record).alias("__r"), unit_key.alias("__u"), priority, confidence, day).repartition(*keys)
    new = lambda c, other: F.row_number().over(W.partitionBy(*keys, c).orderBy(other)) == 1
    rows = rows.withColumn("__new_r", new("__r", "__u") & F.col("__r").isNotNull()).withColumn("__new_u", new("__u", "__r"))
    out = rows.groupBy(*keys).agg(
        F.count_if("__new_r").alias("record_count"),
        F.count_if("__new_u").alias("unit_count"),
        F.sum(priority).cast("long").alias("priority_count"),
        F.avg(confidence).alias("avg_confidence"),
        F.min(day).alias("first_seen"),
        F.max(day).alias("last_seen"),
    )
    days = F.datediff(F.to_date("last_seen"), F.to_date("first_seen"))
    span = F.when(days >= 0, days / F.lit(365.0)).otherwise(0.0)
    scores = rollup_scores(F.col("record_count"), F.col("unit_count"), F.col("priority_count"), F.col("avg_confidence"), span)
    return out.select("*", *[F.round(c, 6).alias(f"{n}_score") for n, c in scores.items()])


def topic_key(name: Column, year: Column, origin: Column) -> Column:
    """origin:year:name without blanks."""
    from plinth.functions.text import compact

    return F.concat_ws(":", origin, year.cast("string"), compact(name))


def upsert_sources(sources: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Topic sources by source_key; the last new row of a key counts, and blank fields keep what was known."""
    rest = [c for c in sources.columns if c != "source_key"]
    last = new.groupBy("source_key").agg(F.max_by(F.struct(*rest), order).alias("n"))
    both = sources.join(last, "source_key", "full")
    filled = [F.when(F.coalesce(F.trim(F.col(f"n.{c}")), F.lit("")) != "", F.col(f"n.{c}")).otherwise(F.coalesce(F.col(c), F.col(f"n.{c}"))).alias(c) for c in rest]
    return both.select("source_key", *filled)


def upsert_topics(topics: DataFrame, new: DataFrame) -> DataFrame:
    """Topics (topic_key, name, year, origin, description, weight): the old description unless blank, the larger weight."""
    one = new.groupBy("topic_key").agg(*[F.max(c).alias(f"n_{c}") for c in ("name", "year", "origin", "description", "weight")])
    both = topics.join(one, "topic_key", "full")
    text = F.when(F.coalesce(F.trim("description"), F.lit("")) != "", F.col("description")).otherwise(F.coalesce("n_description", F.lit("")))
    return both.select("topic_key", *[F.coalesce(c, f"n_{c}").alias(c) for c in ("name", "year", "origin")], text.alias("description"), F.greatest("weight", "n_weight").alias("weight"))


def replace_source_topics(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence (source_key, topic_key, ...) with that of the new rows' sources replaced."""
    return evidence.join(new.select("source_key").distinct(), "source_key", "left_anti").unionByName(new.select(*evidence.columns))


def source_candidates(declared: DataFrame, inferred: DataFrame, limit: int = 8) -> DataFrame:
    """(source_key, topic, weight, confidence): the declared topics (source_key, position, topic) with falling weights, else the
    inferred ones (source_key, topic, score), at most ``limit`` of either."""
    own = declared.where(F.col("position") < limit).select("source_key", "topic", declared_weight(F.col("position")).alias("weight"), declared_confidence(F.col("position")).alias("confidence"))
    rank = F.row_number().over(W.partitionBy("source_key").orderBy(F.desc("score"), F.desc(F.length("topic")), F.desc("topic")))
    rest = inferred.join(declared.select("source_key").distinct(), "source_key", "left_anti").withColumn("__r", rank).where(F.col("__r") <= limit)
    return own.unionByName(rest.select("source_key", "topic", inferred_weight(F.col("score")).alias("weight"), inferred_confidence(F.col("score")).alias("confidence")))


def year_map(rows: DataFrame, key: str, topic: str, year: str) -> DataFrame:
    """(key, topic, years): the sorted years in which a topic occurs."""
    return rows.where(F.col(topic) != "").groupBy(key, topic).agg(F.sort_array(F.collect_set(year)).alias("years"))


def recent_topic_match(topics: Column, year: Column, years: Column, tolerance: int = 1) -> Column:
    """Whether one of the topics (array) has a year (map topic -> years) within the tolerance; false without topics or a year."""
    near = F.exists(topics, lambda t: F.exists(F.coalesce(F.try_element_at(years, t), F.array().cast("array<int>")), lambda y: F.abs(y - year) <= tolerance))
    return F.coalesce((year > 0) & near, F.lit(False))


def shared_topics(field: Column, wanted: Column) -> Column:
    """The topics of a packed field, as displayed, whose names without blanks are among ``wanted``."""
    from plinth.functions.text import compact, split_topics

    return F.filter(split_topics(field), lambda x: F.array_contains(wanted, compact(x)))


def topic_tokens(name: Column, description: Column, keywords: Column, least: int = 4) -> Column:
    """Tokens of a topic's name and description and its keywords of that length, distinct in order."""
    return F.array_distinct(F.concat(tokens(name, least), tokens(description, least), F.filter(F.transform(keywords, lambda x: F.lower(x)), lambda x: F.length(x) >= least)))


def linked_parties(paths: list[DataFrame]) -> DataFrame:
    """(record_id, party_id): the union of the ways in which records lead to parties, as a set."""
    from plinth.operators.keyed import linked_pairs

    return linked_pairs([p.where(F.col("party_id").isNotNull()).select("record_id", "party_id") for p in paths])


def rebuild(records: DataFrame, declared: DataFrame, id_col: str, fields: dict[str, int], text: str, year: str, limit: int = 6) -> DataFrame:
    """(id, topic, confidence, is_priority, rank): all topic links anew, inferred from fields and declared for the year's neighbours.

    declared: topic, topic_year (0 is any), weight. A declared topic links where the text holds it.
    """
    from plinth.operators.links import contained_phrases

    scored = ranked_candidates(weighted_tokens(records, id_col, fields), id_col, 4).select(id_col, F.explode("candidates").alias("c"))
    inferred = scored.select(id_col, F.col("c.token").alias("topic"), inferred_confidence(F.col("c.score")).alias("confidence"), F.lit(False).alias("is_priority"))
    phrases = declared.select("topic", F.col("topic").alias("__phrase")).distinct()
    hit = contained_phrases(records.select(id_col, text), phrases, id_col, text, "topic", "__phrase")
    both = hit.join(records.select(id_col, F.col(year).alias("__y")), id_col).join(declared, "topic")
    gap = F.when(F.col("topic_year") > 0, F.abs(F.col("__y") - F.col("topic_year"))).otherwise(99)
    near = both.where((F.col("topic_year") == 0) | (gap <= 1))
    own = near.select(id_col, "topic", link_confidence(F.lit(True), F.lit(1), F.lit(False), gap, F.col("weight")).alias("confidence"), F.lit(True).alias("is_priority"))
    return best_links(inferred.unionByName(own), id_col, "topic", limit)

