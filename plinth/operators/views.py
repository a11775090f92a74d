"""Read views of an archive: lists, details, rosters, profiles. Each returns DataFrames that Catalyst plans once; there are no queries per row.

An ``Archive`` holds the silver tables:

records (record_id, url, title, source_type, source_unit, published_at, fetched_at, raw_text, review_status);
mentions (mention_id, record_id, unit_id, unit_raw, party_raw, quality, confidence, email, phone);
mention_links (mention_id, party_id, link_status, confidence); parties (party_id, party_key, display_name, is_verified, note);
units (unit_id, name, top_unit); slots (slot_id, party_id, name_norm, unit_id, title, active_from, active_to, confidence);
transfers (event_id, effective, name_norm, from_unit_id, to_unit_id, title); transfer_links (event_id, party_id, link_status, confidence);
record_topics (record_id, topic, is_priority, confidence); rollups (party_id, topic, spotlight); notes (note_id, party_id, record_id, title, content, created_at).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import text as T
from plinth.operators.graph import related_parties
from plinth.operators.keyed import alias_roots, collect_sorted, latest_per_key, linked_pairs, replace_values, top_k, without_any
from plinth.operators.resolution import cascade

LINKED = ["auto_matched", "reviewed_match"]


@dataclass
class Archive:
    records: DataFrame
    mentions: DataFrame
    mention_links: DataFrame
    parties: DataFrame
    units: DataFrame
    slots: DataFrame
    transfers: DataFrame
    transfer_links: DataFrame
    record_topics: DataFrame
    rollups: DataFrame
    notes: DataFrame

    def live_records(self) -> DataFrame:
        """Records that are not rejected, with their event time."""
        return self.records.where("review_status <> 'rejected'").withColumn("observed_at", D.observed_at(F.col("published_at"), F.col("fetched_at")))

    def linked(self) -> DataFrame:
        """(party_id, record_id, unit_id, unit_raw) of linked mentions, a set."""
        links = self.mention_links.where(F.col("link_status").isin(LINKED)).select("mention_id", "party_id")
        return linked_pairs([self.mentions.join(links, "mention_id").select("party_id", "record_id", "unit_id", "unit_raw")])


def record_list(a: Archive, limit: int = 100, source_type: str | None = None) -> DataFrame:
    """The latest live records with the unit and party they show and where these come from."""
    rows = a.live_records()
    if source_type:
        rows = rows.where(F.col("source_type") == source_type)
    latest = rows.orderBy(F.desc_nulls_last("observed_at"), F.desc("record_id")).limit(limit)
    best = top_k(a.mentions.join(latest.select("record_id"), "record_id", "left_semi"), ["record_id"], [F.desc(F.coalesce("party_raw", F.lit("")) != ""), F.desc("confidence"), F.asc("mention_id")], 1)
    out = latest.join(best.select("record_id", "unit_raw", "party_raw"), "record_id", "left")
    shown = out.withColumns({"u": cascade((F.col("unit_raw"), "observed"), (F.col("source_unit"), "source_list")), "p": cascade((F.col("party_raw"), "observed"))})
    return shown.select("record_id", "title", "observed_at", F.col("u.value").alias("unit"), F.col("u.source").alias("unit_source"), F.col("p.value").alias("party"), F.col("p.source").alias("party_source"))


def party_list(a: Archive, limit: int = 100) -> DataFrame:
    """Parties with records, by how many; those without any are left out before the limit."""
    g = a.linked().join(a.live_records().select("record_id", "observed_at"), "record_id").groupBy("party_id").agg(F.count_distinct("record_id").alias("records"), F.array_join(F.sort_array(F.collect_set("unit_raw")), ",").alias("units"), F.max("observed_at").alias("last_seen"))
    return a.parties.join(g, "party_id").orderBy(F.desc("records"), F.desc("last_seen"), "party_id").limit(limit).select("party_id", "display_name", "records", "units", "last_seen")


def unit_list(a: Archive) -> DataFrame:
    """Units with records or parties."""
    g = a.mentions.join(a.mention_links.where(F.col("link_status").isin(LINKED)).select("mention_id", "party_id"), "mention_id", "left").groupBy("unit_id").agg(F.count_distinct("record_id").alias("records"), F.count_distinct("party_id").alias("parties"))
    return a.units.join(g, "unit_id").where("records > 0 or parties > 0").select("unit_id", "name", "top_unit", "records", "parties")


def unit_profiles(a: Archive, keywords: int = 6, people: int = 3, least: int = 4) -> DataFrame:
    """(unit_id, name, top_unit, records, keywords, people) of units with records.

    Keywords are the words of the unit's name (2 points) and of the titles of its live records (1 point each), the best by points,
    length and text; people are the first names of linked parties.
    """
    from plinth.operators.topics import tokens

    own = a.mentions.where(F.col("unit_id").isNotNull()).select("unit_id", "record_id").distinct()
    counts = own.groupBy("unit_id").agg(F.count("*").alias("records"))
    named = a.units.select("unit_id", F.explode(tokens(F.col("name"), least)).alias("token"), F.lit(2).alias("w"))
    titled = own.join(a.live_records().select("record_id", "title"), "record_id").select("unit_id", F.explode(tokens(F.col("title"), least)).alias("token"), F.lit(1).alias("w"))
    points = named.unionByName(titled).groupBy("unit_id", "token").agg(F.sum("w").alias("n"))
    best = top_k(points, ["unit_id"], [F.desc("n"), F.desc(F.length("token")), F.desc("token")], keywords).groupBy("unit_id").agg(collect_sorted(F.col("token"), F.col("rank")).alias("keywords"))
    linked = a.linked().where(F.col("unit_id").isNotNull()).join(a.parties, "party_id").select("unit_id", "display_name").distinct()
    first = top_k(linked, ["unit_id"], [F.asc("display_name")], people).groupBy("unit_id").agg(collect_sorted(F.col("display_name"), F.col("rank")).alias("people"))
    return a.units.join(counts, "unit_id").join(best, "unit_id").join(first, "unit_id", "left").select("unit_id", "name", "top_unit", "records", "keywords", "people")


def current_unit(a: Archive) -> DataFrame:
    """(party_id, unit_id, source): the latest transfer's unit, else that of the latest record."""
    moved = a.transfer_links.where(F.col("link_status").isin(LINKED)).select("event_id", "party_id").join(a.transfers.where(F.col("to_unit_id").isNotNull()), "event_id")
    by_transfer = latest_per_key(moved.select("party_id", "to_unit_id", "effective", "event_id"), ["party_id"], ["effective", "event_id"]).select("party_id", F.col("to_unit_id").alias("t"))
    seen = a.linked().where(F.col("unit_id").isNotNull()).join(a.live_records().select("record_id", "observed_at"), "record_id")
    by_record = latest_per_key(seen.select("party_id", "unit_id", "observed_at", "record_id"), ["party_id"], ["observed_at", "record_id", "unit_id"]).select("party_id", F.col("unit_id").alias("r"))
    return by_transfer.join(by_record, "party_id", "full").select("party_id", F.coalesce("t", "r").alias("unit_id"), F.when(F.col("t").isNotNull(), "transfer").otherwise("record").alias("source"))


def roster(a: Archive, as_of: str, limits: tuple[int, int, int, int] = (300, 500, 500, 300)) -> DataFrame:
    """(kind, top_unit, name, unit_id, confidence): confirmed and weak parties, active slots, unlinked transfers, unlinked mentions.

    A party is confirmed by a full name in a linked mention or a linked transfer. Limits cut before the later filters, in the
    order given; of equal keys the later row wins.
    """
    full = a.mentions.where("quality = 'full_name'").join(a.mention_links.where(F.col("link_status").isin(LINKED)), "mention_id").select("party_id")
    moved = a.transfer_links.where(F.col("link_status").isin(LINKED)).select("party_id")
    strong = full.union(moved).distinct().withColumn("strong", F.lit(True))
    people = a.parties.join(current_unit(a), "party_id", "left").join(strong, "party_id", "left").orderBy("display_name", "party_id").limit(limits[0])
    confirmed = people.select(F.when(F.col("strong"), "confirmed").otherwise("weak").alias("kind"), F.col("display_name").alias("name"), "unit_id", F.when(F.col("strong"), 1.0).otherwise(0.4).alias("confidence"))
    active = a.slots.where(D.active_on(F.lit(as_of), F.col("active_from"), F.col("active_to"))).orderBy("name_norm", "slot_id").limit(limits[1]).select(F.lit("slot").alias("kind"), F.col("name_norm").alias("name"), "unit_id", "confidence")
    open_events = a.transfers.join(a.transfer_links.where(F.col("link_status").isin(LINKED)).select("event_id"), "event_id", "left_anti")
    moves = latest_per_key(open_events.select("name_norm", "to_unit_id", "effective", "event_id"), ["name_norm"], ["effective", "event_id"]).orderBy("name_norm").limit(limits[2]).select(F.lit("transfer").alias("kind"), F.col("name_norm").alias("name"), F.col("to_unit_id").alias("unit_id"), F.lit(0.3).alias("confidence"))
    loose = a.mentions.where(~T.blank(F.col("party_raw"))).join(a.mention_links.where(F.col("link_status").isin(LINKED)).select("mention_id"), "mention_id", "left_anti")
    seen = loose.groupBy(F.col("party_raw").alias("name"), "unit_id").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "name", "unit_id").limit(limits[3]).select(F.lit("mention").alias("kind"), "name", "unit_id", "confidence")
    every = confirmed.unionByName(active).unionByName(moves).unionByName(seen)
    return every.join(a.units.select("unit_id", "top_unit"), "unit_id", "left").select("kind", F.coalesce("top_unit", F.lit("unknown")).alias("top_unit"), "name", "unit_id", "confidence")


def roster_groups(rows: DataFrame, sample: int = 8) -> DataFrame:
    """Per top unit: how many of each kind, and the first names in order of kind and name."""
    kinds = ["confirmed", "weak", "slot", "transfer", "mention"]
    n = F.row_number().over(W.partitionBy("top_unit").orderBy(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), "name"))
    return rows.withColumn("n", n).groupBy("top_unit").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.array_distinct(collect_sorted(F.when(F.col("n") <= sample, F.col("name")), F.col("n"))).alias("names")).withColumn("names", F.array_compact("names"))


def record_detail(a: Archive, record_id: int) -> dict[str, DataFrame]:
    """A record with its mentions, topics, notes and the parties linked to it."""
    only = F.col("record_id") == record_id
    return {"record": a.records.where(only), "mentions": a.mentions.where(only).join(a.mention_links, "mention_id", "left").drop(a.mention_links.confidence), "topics": a.record_topics.where(only).orderBy(F.desc("is_priority"), F.desc("confidence")), "notes": a.notes.where(only), "parties": a.parties.join(a.linked().where(only).select("party_id"), "party_id", "left_semi")}


def party_detail(a: Archive, party_key: str) -> dict[str, DataFrame]:
    """A party with records, units over time, transfers, related parties, topics and notes."""
    who = a.parties.where(F.col("party_key") == party_key)
    pid = who.select("party_id")
    linked = a.linked()
    own = linked.join(pid, "party_id", "left_semi").join(a.live_records(), "record_id")
    moves = a.transfers.join(a.transfer_links.where(F.col("link_status").isin(LINKED)).join(pid, "party_id", "left_semi").select("event_id"), "event_id", "left_semi")
    near = related_parties(linked, "party_id", "record_id", "unit_id", only=pid)
    return {"party": who, "records": own.orderBy(F.desc("observed_at"), F.desc("record_id")), "units": own.groupBy("unit_raw").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count_distinct("record_id").alias("records")), "transfers": moves.orderBy("effective", "event_id"), "related": near, "topics": a.rollups.join(pid, "party_id", "left_semi").orderBy(F.desc("spotlight")), "notes": a.notes.join(pid, "party_id", "left_semi").orderBy(F.desc("created_at"))}


def unit_detail(a: Archive, unit_id: int) -> dict[str, DataFrame]:
    """A unit with records, parties, topics and candidates."""
    only = F.col("unit_id") == unit_id
    records = a.live_records().join(a.mentions.where(only).select("record_id"), "record_id", "left_semi")
    return {"unit": a.units.where(only), "records": records.orderBy(F.desc("observed_at")), "parties": a.parties.join(a.linked().where(only).select("party_id"), "party_id", "left_semi"), "topics": a.record_topics.join(records.select("record_id"), "record_id", "left_semi").groupBy("topic").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "topic"), "slots": a.slots.where(only)}


def note_list(a: Archive) -> DataFrame:
    return a.notes.join(a.parties.select("party_id", "display_name"), "party_id").orderBy(F.desc("created_at"), F.desc("note_id"))


def note_detail(a: Archive, note_id: int) -> DataFrame:
    """One note with its party's name and its record's title."""
    n = a.notes.where(F.col("note_id") == note_id)
    return n.join(a.parties.select("party_id", "display_name"), "party_id", "left").join(a.records.select("record_id", F.col("title").alias("record_title")), "record_id", "left").select("note_id", "title", "content", "created_at", "display_name", "record_title")


def records_without_party(a: Archive) -> DataFrame:
    """Live records none of whose mentions names a party, the latest first."""
    named = a.mentions.where(~T.blank(F.col("party_raw"))).select("record_id")
    return a.live_records().join(named, "record_id", "left_anti").orderBy(F.desc("observed_at"), F.desc("record_id"))


def pending_reviews(a: Archive, limit: int = 100) -> DataFrame:
    """Pending records: blank dates first, then the oldest."""
    return a.records.where("review_status = 'pending'").orderBy(F.asc_nulls_first("published_at"), "record_id").limit(limit)


def pending_links(a: Archive, limit: int = 100) -> DataFrame:
    """Pending mention links with their record's date."""
    rows = a.mention_links.where("link_status = 'review_pending'").join(a.mentions.drop("confidence"), "mention_id").join(a.live_records().select("record_id", "observed_at"), "record_id")
    return rows.orderBy(F.desc("observed_at"), F.desc("confidence"), "mention_id").limit(limit)


def orphan_parties(a: Archive) -> DataFrame:
    """Parties that are neither verified nor noted nor linked."""
    free = a.parties.where("is_verified = 0 and coalesce(trim(note), '') = ''")
    return without_any(free, [(a.mention_links, "party_id", "party_id"), (a.transfer_links, "party_id", "party_id"), (a.notes, "party_id", "party_id")])


def orphan_units(a: Archive) -> DataFrame:
    """Units that nothing refers to."""
    return without_any(a.units, [(a.mentions, "unit_id", "unit_id"), (a.slots, "unit_id", "unit_id"), (a.transfers, "from_unit_id", "unit_id"), (a.transfers, "to_unit_id", "unit_id")])


def merge_parties(a: Archive, aliases: DataFrame) -> Archive:
    """Every reference to a merged party points to the party it was merged into; notes and verified marks survive."""
    roots = alias_roots(aliases)
    moved = {n: replace_values(getattr(a, n), roots, "party_id") for n in ("mention_links", "transfer_links", "slots", "rollups", "notes")}
    return replace(a, parties=a.parties.join(roots.select(F.col("old").alias("party_id")), "party_id", "left_anti"), **moved)


def merge_units(a: Archive, aliases: DataFrame) -> Archive:
    """The same for units."""
    roots = alias_roots(aliases)
    moved = {n: replace_values(getattr(a, n), roots, "unit_id") for n in ("mentions", "slots")}
    transfers = replace_values(replace_values(a.transfers, roots, "from_unit_id"), roots, "to_unit_id")
    return replace(a, units=a.units.join(roots.select(F.col("old").alias("unit_id")), "unit_id", "left_anti"), transfers=transfers, **moved)


def transfer_candidates(a: Archive, rows: DataFrame, top: int = 5, within: int = 540) -> DataFrame:
    """The best transfers for records without a party: (record_id, name_norm, score, days, rank).

    rows: record_id, unit_id, observed (date). Fixed values: .25, .35 of the confidence, .25 / .10 for the unit moved to / from,
    and .25 / .15 / .08 for 90 / 180 / 365 days; one transfer per name, the first best. Records of one unit and day have the same
    list, and of transfers of one unit and day only the first names for each of the four values of nearness can be in one.
    """
    t = a.transfers.join(a.transfer_links.select("event_id", "confidence"), "event_id", "left").withColumn("day", D.parse_iso(F.col("effective")))
    to = t.where(F.col("to_unit_id").isNotNull()).select(F.col("to_unit_id").alias("unit_id"), "event_id", "name_norm", "day", "confidence", F.lit(0.25).alias("unit_score"), F.lit(1).alias("to_match"))
    origin = t.where(F.col("from_unit_id").isNotNull() & ~F.col("from_unit_id").eqNullSafe(F.col("to_unit_id"))).select(F.col("from_unit_id").alias("unit_id"), "event_id", "name_norm", "day", "confidence", F.lit(0.10).alias("unit_score"), F.lit(0).alias("to_match"))
    days = F.col("days")
    recent = F.when(days <= 90, 0.25).when(days <= 180, 0.15).when(days <= 365, 0.08).otherwise(0.0)
    score = F.bround(F.least(F.lit(0.99), 0.25 + 0.35 * F.coalesce("confidence", F.lit(0.0)) + F.col("unit_score") + F.col("recent")), 4)
    each = to.unionByName(origin).withColumn("recent", F.explode(F.array(*map(F.lit, (0.25, 0.15, 0.08, 0.0)))))
    alike = ["unit_id", "day", "to_match", "recent"]
    names = each.groupBy(*alike, "name_norm").agg(F.max(score).alias("score"))
    first = top_k(names, alike, [F.desc("score"), F.desc("name_norm")], top).drop("rank")
    asked = rows.select("unit_id", "observed").distinct()
    hit = asked.join(first, "unit_id").withColumn("days", D.days_between(F.col("observed"), F.col("day"))).where((days.isNull() | (days <= within)) & (F.col("recent") == recent))
    order = [F.desc("score"), F.desc("to_match"), F.asc_nulls_last("days"), F.desc("name_norm")]
    place = [F.col("unit_id").alias("__unit"), F.col("observed").alias("__seen")]
    best = top_k(top_k(hit, ["unit_id", "observed", "name_norm"], order, 1).drop("rank"), ["unit_id", "observed"], order, top).select(*place, "name_norm", "score", "to_match", "days")
    scored = rows.join(best, (F.col("unit_id") == F.col("__unit")) & F.col("observed").eqNullSafe(F.col("__seen")))
    return top_k(top_k(scored, ["record_id", "name_norm"], order, 1).drop("rank"), ["record_id"], order, top).select("record_id", "name_norm", "score", "days", "rank")
