"""Entity resolution: context per party, decisions with thresholds and gaps, reviews that win, provenance cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REVIEWED = ["reviewed_match", "reviewed_distinct"]


def identity_context(mentions: DataFrame, party: str, sets: dict[str, str], record: str, day: str) -> DataFrame:
    """One row per party: a sorted set for each (name, column) of ``sets``, record count, first and last day."""
    aggs = [F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(n) for n, c in sets.items()]
    return mentions.where(F.col(party).isNotNull()).groupBy(party).agg(*aggs, F.count_distinct(record).alias("record_count"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def link_rank(status: Column, has_name: Column, confidence: Column) -> Column:
    """Sortable rank of a link: status, confidence, name."""
    order = F.when(status == "reviewed_match", 4).when(status == "auto_matched", 3).when(status == "review_pending", 2).when(status == "reviewed_distinct", 1).otherwise(0)
    return F.struct(order.alias("status"), confidence.alias("confidence"), has_name.cast("int").alias("named"))


def decide_mentions(scored: DataFrame, mention: str = "mention_id", party: str = "party_id") -> DataFrame:
    """(mention, party, link_status, confidence, matched_by) from scored candidates.

    scored: mention, party, score, contact (boolean), record_count, quality, source_confidence; one row per candidate, with a
    null party for mentions that have none. Fixed values: the thresholds of the decision table.
    """
    order = [F.desc("score"), F.desc("contact"), F.desc("record_count"), F.asc(party)]
    w, all_of = W.partitionBy(mention).orderBy(*order), W.partitionBy(mention)
    ranked = scored.withColumns({"rank": F.row_number().over(w), "gap": F.col("score") - F.lead("score").over(w), "n": F.count(party).over(all_of)}).where("rank = 1")
    s, src, full, contact, gap = F.col("score"), F.col("source_confidence"), F.col("quality") == "full_name", F.col("contact"), F.col("gap")
    one, many = F.col("n") == 1, F.col("n") > 1
    cases = [
        (one & full & (s >= 0.90), "auto_matched", s, "full_name_exact", True),
        (one & contact & (s >= 0.80), "auto_matched", s, "same_name_contact_exact", True),
        (one, "review_pending", F.greatest(s, src, F.lit(0.6)), "same_name_only", True),
        (many & contact & (gap >= 0.12), "review_pending", F.greatest(s, src, F.lit(0.78)), "contact_best_of_same_name", True),
        (many, "review_pending", F.greatest(s, F.lit(0.45)), "multiple_same_name", False),
        (full, "auto_matched", F.greatest(F.lit(0.9), src), "new_full_name", False),
        (F.col("quality") == "surname_only", "review_pending", F.least(src, F.lit(0.55)), "same_name", False),
        (contact, "review_pending", F.greatest(F.lit(0.72), src), "new_name_with_contact", False),
        (src >= 0.9, "review_pending", F.greatest(F.lit(0.6), src), "new_name", False),
    ]

    def choose(i: int, default: Column) -> Column:
        out = None
        for c in cases:
            v = c[i] if isinstance(c[i], Column) else F.lit(c[i])
            hit = F.coalesce(c[0], F.lit(False))
            out = F.when(hit, v) if out is None else out.when(hit, v)
        return out.otherwise(default)

    return ranked.select(mention, F.when(choose(4, F.lit(False)), F.col(party)).alias(party), choose(1, F.lit("review_pending")).alias("link_status"), choose(2, F.least(src, F.lit(0.55))).alias("confidence"), choose(3, F.lit("same_name")).alias("matched_by"))


def decide_transfers(scored: DataFrame, event: str = "event_id", party: str = "party_id") -> DataFrame:
    """(event, party, link_status, confidence) of transfer events; events under all thresholds get no row.

    scored: event, party, score, name_exact, name_prefix, to_exact, to_overlap, from_exact, from_overlap, broad, activity, display_name.
    """
    order = [F.desc(c) for c in ("score", "to_exact", "to_overlap", "from_exact", "from_overlap", "name_exact", "activity", "display_name")]
    w = W.partitionBy(event).orderBy(*order)
    top = scored.where("score > 0").withColumns({"rank": F.row_number().over(w), "gap": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))}).where("rank = 1")
    strong = F.col("to_exact") | F.col("to_overlap") | F.col("from_exact") | F.col("from_overlap")
    s, gap = F.col("score"), F.col("gap")
    auto = (s >= 0.85) & (gap >= 0.12)
    pending = (s >= 0.68) | (F.col("name_exact") & (s >= 0.55)) | (F.col("name_prefix") & strong & (s >= 0.42) & (gap >= 0.05)) | (F.col("name_prefix") & F.col("broad") & F.col("activity") & (s >= 0.44) & (gap >= 0.08))
    return top.select(event, party, F.when(auto, "auto_matched").when(pending, "review_pending").alias("link_status"), s.alias("confidence")).where("link_status is not null")


def apply_reviews(auto: DataFrame, reviews: DataFrame, key: str, order: str = "decided_at") -> DataFrame:
    """auto links with the newest human decision of the key in place of the automatic one."""
    rest = [c for c in auto.columns if c != key]
    newest = reviews.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return auto.join(newest, key, "full").select(key, *[F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def cascade(*steps: tuple[Column, str]) -> Column:
    """struct(value, source) of the first step with a non-blank value; null if there is none."""
    made = [F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.struct(v.alias("value"), F.lit(label).alias("source"))) for v, label in steps]
    return F.coalesce(*made)


def primary_mention(mentions: DataFrame, record: str, order: list[Column]) -> DataFrame:
    """The first mention of each record by ``order``."""
    return mentions.withColumn("__n", F.row_number().over(W.partitionBy(record).orderBy(*order))).where("__n = 1").drop("__n")


def fill_mentions(mentions: DataFrame, records: DataFrame, record: str = "record_id") -> DataFrame:
    """Mentions of every record: own ones with the unit filled from the source, else inherited from the related record, else the source's unit.

    records: record, source_unit, related_unit, related_party. Fixed values: the confidence of inherited rows.
    """
    own = mentions.join(records.select(record, "source_unit"), record).withColumn("unit", F.when(F.coalesce(F.trim("unit"), F.lit("")) != "", F.col("unit")).otherwise(F.col("source_unit"))).select(record, "unit", "party", "confidence", F.lit("observed").alias("section"))
    none = records.join(mentions.select(record).distinct(), record, "left_anti")
    related = F.coalesce("related_unit", "related_party").isNotNull()
    inherited = none.where(related).select(record, F.col("related_unit").alias("unit"), F.col("related_party").alias("party"), F.when(F.col("related_party").isNotNull(), 0.25).otherwise(0.12).alias("confidence"), F.lit("related_record").alias("section"))
    source = none.where(~related & (F.coalesce(F.trim("source_unit"), F.lit("")) != "")).select(record, F.col("source_unit").alias("unit"), F.lit(None).cast("string").alias("party"), F.lit(0.05).alias("confidence"), F.lit("source_list").alias("section"))
    return own.unionByName(inherited).unionByName(source)


def mention_rows(mentions: DataFrame) -> DataFrame:
    """Mentions with the fields that resolution compares: name and party keys, quality, contact keys."""
    from plinth.functions import text as T

    return mentions.withColumns({"name_norm": T.name_key(F.col("party_raw")), "party_key": T.party_key(F.col("party_raw")), "quality": T.name_quality(F.col("party_raw")), "email": T.email_key(F.coalesce("email", F.lit(""))), "phone": T.phone_key(F.col("phone"))})


def party_by_contact(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(record_id, party_id) of rows (record_id, email, phone) without a party whose contact leads to exactly one party.

    known: (record_id, party_id, email, phone) of records with a party; a record's own rows do not count. Candidates are counted
    per contact, so a contact that very many parties share gives no pairs.
    """
    each = lambda df, cols: df.select(*cols, F.explode(F.array_distinct(F.array(F.concat(F.lit("e:"), "email"), F.concat(F.lit("p:"), "phone")))).alias("contact")).where("length(contact) > 2")
    parties = each(known.na.fill("", ["email", "phone"]), ["record_id", "party_id"]).select("contact", "party_id", "record_id").distinct()
    by = parties.groupBy("contact").agg(F.min("party_id").alias("low"), F.max("party_id").alias("high"))
    asked = each(rows.na.fill("", ["email", "phone"]), ["record_id"]).distinct()
    own = asked.join(parties, ["contact", "record_id"], "left_semi")
    elsewhere = asked.join(own, ["contact", "record_id"], "left_anti").join(by, "contact").select("record_id", "low", "high")
    mine = own.join(parties.withColumnRenamed("record_id", "other"), "contact").where("other <> record_id").groupBy("record_id", "contact").agg(F.min("party_id").alias("low"), F.max("party_id").alias("high")).select("record_id", "low", "high")
    return elsewhere.unionByName(mine).groupBy("record_id").agg(F.min("low").alias("party_id"), F.max("high").alias("high")).where("party_id = high").select("record_id", "party_id")


def party_by_slot(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """(record_id, name) of rows (record_id, unit, day) whose unit has exactly one active slot with a name that has a blank inside.

    slots: unit, name, start, end (dates, null is open). Names are reduced to the first and the last of each unit and day.
    """
    from plinth.operators.links import active_summary

    full = slots.where(F.col("name").contains(" ")).select("unit", "name", "start", "end")
    hit = active_summary(rows.select("record_id", "unit", "day"), full, ["unit"], "day", "start", "end", {"low": F.min("name"), "high": F.max("name")}, {"low": F.min("low"), "high": F.max("high")})
    return hit.groupBy("record_id").agg(F.min("low").alias("name"), F.max("high").alias("high")).where("name = high").select("record_id", "name")


def identity_candidates(mentions: DataFrame, parties: DataFrame, limit: int = 10) -> DataFrame:
    """(mention_id, party_id, rank): the first ``limit`` parties of each mention whose name equals or begins it or begins with it.

    mentions: mention_id, name_norm, unit_id; parties: party_id, name_norm, unit_id, record_count. Order: equal names, equal
    units, more records, lower ids; at most three times ``limit`` by name and records are looked at, as a reviewer's list. These are
    the same for all mentions of a name and are chosen once for it.
    """
    from plinth.operators.keyed import top_k
    from plinth.operators.links import prefix_pairs

    p = parties.select("party_id", F.col("name_norm").alias("party_name"), F.col("unit_id").alias("party_unit"), "record_count")
    names = prefix_pairs(mentions.select("name_norm").distinct(), p.select("party_name").distinct(), "name_norm", "party_name", 2)
    hit = names.join(p, "party_name").withColumn("exact", F.col("name_norm") == F.col("party_name"))
    first = top_k(hit, ["name_norm"], [F.desc("exact"), F.desc("record_count"), F.asc("party_id")], 3 * limit).drop("rank")
    first = mentions.select("mention_id", "name_norm", "unit_id").join(first, "name_norm").withColumn("same_unit", F.coalesce(F.col("unit_id") == F.col("party_unit"), F.lit(False)))
    first = top_k(first, ["mention_id"], [F.desc("exact"), F.desc("record_count"), F.asc("party_id")], 3 * limit).drop("rank")
    return top_k(first, ["mention_id"], [F.desc("exact"), F.desc("same_unit"), F.desc("record_count"), F.asc("party_id")], limit).select("mention_id", "party_id", "exact", "same_unit", "rank")


def distinct_same_year(before: dict[str, Column], now: dict[str, Column]) -> Column:
    """Whether two mentions of one name are of different people: one year, units that do not overlap, one of them a surname only.

    before, now: name, year, unit, quality.
    """
    from plinth.functions.units import overlap

    units = (before["unit"] != "") & (now["unit"] != "") & ~overlap(before["unit"], now["unit"])
    return F.coalesce((before["name"] == now["name"]) & (before["year"] == now["year"]) & units & ((before["quality"] == "surname_only") | (now["quality"] == "surname_only")), F.lit(False))


def upsert_links(links: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Links with new ones by key; reviewed links stay as they are."""
    reviewed = links.where(F.col("link_status").isin(REVIEWED))
    fresh = new.join(reviewed.select(key), key, "left_anti").select(*links.columns)
    return links.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def relink(links: DataFrame, scored: DataFrame, names: DataFrame, decide, key: str) -> DataFrame:
    """links with those of the affected ``names`` (name) decided anew from scored candidates (with name); others are not looked at.

    ``decide`` is decide_transfers or decide_mentions. An affected automatic link that is no longer decided goes.
    """
    hit = scored.join(names.select("name").distinct(), "name", "left_semi")
    new = decide(hit)
    gone = hit.select(key).distinct().join(links.where(~F.col("link_status").isin(REVIEWED)).select(key), key, "left_semi")
    return upsert_links(links.join(gone, key, "left_anti"), new, key)
