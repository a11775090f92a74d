"""Batch jobs that chain the operators: ingest pages, re-extract mentions, import transfers, rebuild topics.

Each job is a function of DataFrames and returns DataFrames; writing them is the caller's choice (``sources.files``), and the
same functions run per micro-batch in ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import text as T
from plinth.functions.mentions import extract_mentions
from plinth.operators import extraction, keyed, slots, topics
from plinth.sources import files


def ingest(pages: DataFrame, records: DataFrame, log: DataFrame, as_of: Column, deadline_words: list[str], date_pattern: str, budget_labels: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records after the upsert, addresses to append to the log).

    pages: url, label, ordinal, source_unit, source_type, html, fetched_at; the same address from several sources counts once, with the
    most specific label. Addresses in the log are skipped unless forced. Records past their deadline are logged but not kept.
    A known record keeps its review status.
    """
    chosen = extraction.choose_link(pages, "url", "label", "ordinal")
    new = chosen if force else files.unseen(chosen, log)
    raw = extraction.page_records(new, "url", "url", "html").toDF("url", "_u", "title", "published_at", "raw_text").drop("_u").withColumn("raw_text", T.normalize_text("raw_text"))
    rows = raw.join(new.select("url", "source_unit", "source_type", "fetched_at"), "url")
    body = F.col("raw_text")
    fields = {
        "summary": T.summary_line(body, F.col("title")),
        "budget": T.budget_amount(body, budget_labels),
        "deadline": D.iso_text(D.parse_text_date(T.deadline(body, deadline_words, date_pattern), F.year(as_of))),
        "review_status": F.lit("pending"),
    }
    made = rows.withColumns(fields)
    kept = made.where((F.col("deadline") == "") | (F.to_date(F.when(F.col("deadline") != "", F.col("deadline"))) >= as_of))
    return keyed.merge(records, kept.select(*records.columns), ["url"], ["review_status"]), new.select("url")


def mentions_of(records: DataFrame, key: str, text: str, least: Column | None = None, most: Column | None = None) -> DataFrame:
    """One row per mention of the records whose key is within [least, most]: a window of a large re-extraction."""
    rows = records
    rows = rows.where(F.col(key) >= least) if least is not None else rows
    rows = rows.where(F.col(key) <= most) if most is not None else rows
    m = rows.select(key, F.posexplode(extract_mentions(text)).alias("mention_index", "m"))
    return m.select(key, "mention_index", *[F.col(f"m.{c}").alias(c) for c in ("unit", "party", "quality", "email", "phone", "section", "confidence")])


def replace_mentions(old: DataFrame, new: DataFrame, key: str, keep_if_empty: bool = True) -> DataFrame:
    """Mentions with those of re-extracted records replaced; a record without new mentions keeps its old ones by default.

    With keep_if_empty=False, ``new`` must hold a row (with a null mention_index) for each record that now has none.
    """
    rest = old.join(new.select(key).distinct(), key, "left_anti")
    return rest.unionByName(new if keep_if_empty else new.where("mention_index is not null"))


def transfers_to_slots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, slots) of transfer rows (the columns of a transfer file plus a position); nameless rows keep their index."""
    named = rows.withColumn("source_key", files.source_key("source_type", "title", "url", "published_at", "effective_date"))
    events = named.where(~T.blank(F.col("person_name"))).select(
        "source_key", F.col("position").cast("long").alias("event_id"), T.name_key(F.col("person_name")).alias("party"), F.when(F.col("effective_date") != "", F.col("effective_date")).otherwise(F.col("published_at")).alias("effective"), F.col("from_department").alias("from_unit"), F.col("to_department").alias("to_unit"), F.col("to_title").alias("title"), (T.name_quality(F.col("person_name")) == "full_name").alias("full_name"), F.lit(None).cast("double").alias("confidence")
    )
    return events, slots.build_slots(events.where("full_name"))


def declared_topics(sources: DataFrame) -> DataFrame:
    """(source_key, topic, year, weight, confidence) of topic files (source_type, title, url, published_at, topic_names)."""
    day = F.col("published_at")
    named = sources.withColumn("source_key", files.source_key("source_type", "title", "url", "published_at"))
    rows = named.select("source_key", D.year_of(day).alias("year"), F.posexplode(T.split_topics(F.col("topic_names"))).alias("i", "name"))
    return rows.select("source_key", T.compact(F.col("name")).alias("topic"), "year", topics.declared_weight(F.col("i")).alias("weight"), topics.declared_confidence(F.col("i")).alias("confidence"))


def replace_events(sources: DataFrame, events: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, events) with those of the new rows' sources replaced.

    rows: the columns of a transfer file and a position. A source is upserted by its key; its events are replaced as a whole, rows
    without a name make none and leave a gap in event_index.
    """
    keyed_rows = rows.withColumn("source_key", files.source_key("source_type", "title", "url", "published_at", "effective_date"))
    one = keyed_rows.groupBy("source_key").agg(*[F.min(c).alias(c) for c in ("source_type", "title", "url", "published_at", "effective_date")])
    merged = keyed.merge(sources, one.select(*sources.columns), ["source_key"])
    named = keyed_rows.where(~T.blank(F.col("person_name"))).select("source_key", F.col("position").cast("int").alias("event_index"), T.name_key(F.col("person_name")).alias("name"), "from_department", "to_department", "to_title", F.when(F.col("effective_date") != "", F.col("effective_date")).otherwise(F.col("published_at")).alias("effective"))
    rest = events.join(one.select("source_key"), "source_key", "left_anti")
    return merged, rest.unionByName(named.select(*events.columns))


def edit_records(records: DataFrame, edits: DataFrame, order: str = "decided_at") -> DataFrame:
    """records with the newest edit of each (record_id, any of the record's columns, order) in place: null fields of an edit keep
    what was there, and the review status is the edit's."""
    fields = [c for c in edits.columns if c in records.columns and c != "record_id"]
    newest = edits.groupBy("record_id").agg(F.max_by(F.struct(*fields), order).alias("e"))
    both = records.join(newest, "record_id", "left")
    return both.select(*[F.coalesce(F.col(f"e.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns])


def add_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes with new ones (party_id, record_id, title, content, created_at) after the largest id; blank contents are left out."""
    from plinth.operators.directory import numbered

    own = new.where(~T.blank(F.col("content")))
    return notes.unionByName(numbered(own, notes, "note_id", ["created_at", "party_id", "title"]).select(*notes.columns))


def notification(title: Column, unit: Column, party: Column, deadline: Column, url: Column, most: int = 180) -> Column:
    """The message of a new record: fields with what to say where they are blank, cut to ``most`` characters before the address."""
    say = lambda c, other: F.when(T.blank(c), F.lit(other)).otherwise(F.trim(c))
    body = F.concat_ws("\n", say(title, "(no title)"), F.concat(F.lit("unit: "), say(unit, "unknown")), F.concat(F.lit("party: "), say(party, "not stated")), F.concat(F.lit("deadline: "), say(deadline, "none")))
    short = F.when(F.char_length(body) > most, F.concat(F.substring(body, 1, most - 3), F.lit("..."))).otherwise(body)
    return F.concat_ws("\n", short, url)


def notify(messages: DataFrame, column: str, send) -> int:
    """Send each message by ``send`` (a function of a text), a partition at a time; returns how many there were."""

    def run(rows) -> None:
        for r in rows:
            send(r[0])

    chosen = messages.select(column).where(F.col(column).isNotNull())
    chosen.foreachPartition(run)
    return chosen.count()


def save_record(record: DataFrame, records: DataFrame, mentions: DataFrame, text: str = "raw_text") -> tuple[DataFrame, DataFrame]:
    """(records, mentions) after new or changed records (record_id and the columns of records): upsert, then their mentions anew."""
    after = keyed.merge(records, record.select(*records.columns), ["record_id"], ["review_status"])
    return after, replace_mentions(mentions, mentions_of(record, "record_id", text), "record_id")


def import_topic_sources(rows: DataFrame, sources: DataFrame, known: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, topics, evidence) after rows of a topic file (source_type, title, url, published_at, topic_names)."""
    made = declared_topics(rows)
    keyed_rows = rows.withColumn("source_key", files.source_key("source_type", "title", "url", "published_at"))
    after = topics.upsert_sources(sources, keyed_rows.select(*sources.columns), "title")
    new = made.withColumn("topic_key", topics.topic_key(F.col("topic"), F.col("year"), F.lit("declared")))
    fields = new.select("topic_key", F.col("topic").alias("name"), "year", F.lit("declared").alias("origin"), F.lit("").alias("description"), "weight")
    return after, topics.upsert_topics(known, fields), topics.replace_source_topics(evidence, new.select("source_key", "topic_key", "confidence"))
