"""Resolution of parties: scores on evidence columns, decisions, reviews, slot candidates, topic links, provenance.

Evidence comes from the driver tables: mentions are line items (record x supplier), parties are suppliers, units are nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import scores
from plinth.operators import keyed, links, resolution, topics
from plinth.plans.registry import Tables, query

_FLAGS = ["name", "display", "contact", "unit_exact", "unit_overlap", "top_unit", "unit_theme", "unit_theme_conflict", "record_theme", "record_theme_conflict", "topic", "topic_conflict", "recent_topic", "priority_topic", "transfer_to", "transfer_from", "recent_transfer", "activity", "surname_only"]


def evidence(t: Tables, names: list[str]) -> DataFrame:
    """Line items with one boolean per evidence name, from the bits of the keys."""
    base = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    return base.withColumns({n: F.shiftright(F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729, i) % 2 == 1 for i, n in enumerate(names)})


def _sql_flags(names: list[str]) -> str:
    bits = ", ".join(f"((l_partkey * 7919 + l_suppkey * 104729) >> {i}) % 2 = 1 AS {n}" for i, n in enumerate(names))
    return f"SELECT l_orderkey * 10 + l_linenumber AS mention_id, l_partkey, l_suppkey, l_linenumber, l_discount, {bits} FROM lineitem"


_IDENTITY = """0.20 + CASE WHEN name THEN 0.35 ELSE 0 END + CASE WHEN display THEN 0.05 ELSE 0 END + CASE WHEN contact THEN 0.25 ELSE 0 END
      + CASE WHEN unit_exact THEN 0.15 WHEN unit_overlap THEN 0.08 WHEN top_unit THEN 0.03 ELSE 0 END
      + CASE WHEN unit_theme THEN 0.08 WHEN unit_theme_conflict AND surname_only THEN -0.22 WHEN unit_theme_conflict AND NOT top_unit THEN -0.10 ELSE 0 END
      + CASE WHEN record_theme THEN 0.07 WHEN record_theme_conflict AND surname_only THEN -0.12 ELSE 0 END
      + CASE WHEN topic THEN 0.12 WHEN topic_conflict AND surname_only THEN -0.18 WHEN topic_conflict THEN -0.08 ELSE 0 END
      + CASE WHEN recent_topic THEN 0.08 ELSE 0 END + CASE WHEN priority_topic THEN 0.05 ELSE 0 END
      + CASE WHEN transfer_to THEN 0.20 WHEN transfer_from THEN -0.15 ELSE 0 END + CASE WHEN transfer_to AND recent_transfer THEN 0.15 ELSE 0 END
      + CASE WHEN activity THEN 0.10 ELSE 0 END + CASE WHEN l_linenumber >= 2 THEN least(l_linenumber * 0.02, 0.08) ELSE 0 END"""


@query(f"SELECT mention_id, l_suppkey AS party_id, CAST(least({_IDENTITY}, 0.98) AS DOUBLE) AS score FROM ({_sql_flags(_FLAGS)})")
def identity_score(t: Tables) -> DataFrame:
    e = evidence(t, _FLAGS)
    return e.select("mention_id", F.col("l_suppkey").alias("party_id"), scores.identity_score({n: F.col(n) for n in _FLAGS}, F.col("l_linenumber")).alias("score"))


@query(
    f"""
    WITH e AS ({_sql_flags(_FLAGS)}), f AS (SELECT mention_id, unnest([CASE WHEN name THEN 'same_name' END, CASE WHEN contact THEN 'contact' END, CASE WHEN unit_exact THEN 'unit_exact' WHEN unit_overlap THEN 'unit_overlap' WHEN top_unit THEN 'top_unit' END]) AS label FROM e)
    SELECT label, count(*) AS n FROM f WHERE label IS NOT NULL GROUP BY label
    """
)
def identity_reasons(t: Tables) -> DataFrame:
    """How often each of some reasons counts."""
    why = scores.reasons(scores.identity_terms({n: F.col(n) for n in _FLAGS}))
    return evidence(t, _FLAGS).select(F.explode(why).alias("label")).where(F.col("label").isin("same_name", "contact", "unit_exact", "unit_overlap", "top_unit")).groupBy("label").agg(F.count("*").alias("n"))


_SLOT_FLAGS = ["name_exact", "name_prefix", "unit_exact", "unit_overlap", "unit_theme", "record_theme", "topic", "recent_topic", "priority_topic", "active", "soon", "just_ended", "linked", "surname_only", "bridge", "topic_conflict", "root_conflict"]
_SLOT = """0.05 + CASE WHEN name_exact THEN 0.38 ELSE 0.18 END + CASE WHEN unit_exact THEN 0.28 WHEN unit_overlap THEN 0.18 WHEN unit_theme THEN 0.08 WHEN record_theme THEN 0.06 ELSE 0 END
      + CASE WHEN topic THEN 0.13 ELSE 0 END + CASE WHEN recent_topic THEN 0.08 ELSE 0 END + CASE WHEN priority_topic THEN 0.04 ELSE 0 END + CASE WHEN active THEN 0.24 WHEN soon THEN 0.14 WHEN just_ended THEN 0.10 ELSE 0 END
      + CASE WHEN linked THEN 0.05 ELSE 0 END + CASE WHEN surname_only AND NOT (unit_exact OR unit_overlap) THEN -0.12 ELSE 0 END + CASE WHEN surname_only AND NOT (active OR soon OR just_ended) THEN -0.08 ELSE 0 END
      + CASE WHEN bridge AND NOT (unit_exact OR unit_overlap) AND NOT unit_theme AND NOT record_theme THEN -0.18 ELSE 0 END + CASE WHEN bridge AND topic_conflict THEN -0.16 ELSE 0 END + CASE WHEN bridge AND root_conflict THEN -0.12 ELSE 0 END"""
_SLOT_SCORE = f"CASE WHEN name_exact OR name_prefix THEN CAST(least(greatest({_SLOT}, 0), 0.99) AS DOUBLE) ELSE 0.0::DOUBLE END"


def slot_rows(t: Tables) -> DataFrame:
    e = evidence(t, _SLOT_FLAGS)
    score = scores.slot_score({n: F.col(n) for n in _SLOT_FLAGS}, F.lit(0))
    return e.select("mention_id", F.col("l_suppkey").alias("slot_id"), "l_partkey", "unit_exact", "active", score.alias("score"))


@query(f"SELECT mention_id, l_suppkey AS slot_id, {_SLOT_SCORE} AS score FROM ({_sql_flags(_SLOT_FLAGS)})")
def slot_score(t: Tables) -> DataFrame:
    return slot_rows(t).select("mention_id", "slot_id", "score")


@query(
    f"""
    WITH s AS (SELECT mention_id, l_suppkey AS slot_id, l_partkey, unit_exact, active, {_SLOT_SCORE} AS score FROM ({_sql_flags(_SLOT_FLAGS)}))
    SELECT l_partkey, mention_id, slot_id, score, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, unit_exact DESC, active DESC, mention_id) AS rank FROM s WHERE score >= 0.42 QUALIFY rank <= 5
    """
)
def slot_candidates_top5(t: Tables) -> DataFrame:
    top = keyed.top_k(slot_rows(t), ["l_partkey"], [F.desc("score"), F.desc("unit_exact"), F.desc("active"), F.asc("mention_id")], 5)
    return top.where("score >= 0.42").select("l_partkey", "mention_id", "slot_id", "score", "rank")


_TRANSFER_FLAGS = ["name_exact", "name_prefix", "to_exact", "to_overlap", "to_root", "from_exact", "from_overlap", "from_root", "activity"]
_TRANSFER = """least(greatest(0.10 + CASE WHEN name_exact THEN 0.45 WHEN name_prefix THEN 0.12 ELSE -0.50 END + CASE WHEN to_exact THEN 0.20 WHEN to_overlap THEN 0.12 WHEN to_root THEN 0.05 ELSE 0 END
      + CASE WHEN from_exact THEN 0.15 WHEN from_overlap THEN 0.10 WHEN from_root THEN 0.04 ELSE 0 END + CASE WHEN activity THEN 0.10 ELSE 0 END
      + CASE WHEN name_prefix AND NOT (to_exact OR to_overlap OR from_exact OR from_overlap) THEN -0.10 ELSE 0 END + CASE WHEN l_linenumber >= 2 THEN least(l_linenumber * 0.02, 0.08) ELSE 0 END, 0), 0.98)"""


def transfer_rows(t: Tables) -> DataFrame:
    e = evidence(t, _TRANSFER_FLAGS)
    return e.withColumn("score", scores.transfer_score({n: F.col(n) for n in _TRANSFER_FLAGS}, F.col("l_linenumber")))


@query(f"SELECT mention_id AS event_id, l_suppkey AS party_id, CAST({_TRANSFER} AS DOUBLE) AS score FROM ({_sql_flags(_TRANSFER_FLAGS)})")
def transfer_score(t: Tables) -> DataFrame:
    return transfer_rows(t).select(F.col("mention_id").alias("event_id"), F.col("l_suppkey").alias("party_id"), "score")


@query(
    f"""
    WITH s AS (SELECT *, CAST({_TRANSFER} AS DOUBLE) AS score FROM ({_sql_flags(_TRANSFER_FLAGS)})),
    r AS (SELECT *, row_number() OVER w AS n, score - coalesce(lead(score) OVER w, 0.0::DOUBLE) AS gap FROM s WHERE score > 0
      WINDOW w AS (PARTITION BY l_partkey ORDER BY score DESC, to_exact DESC, to_overlap DESC, from_exact DESC, from_overlap DESC, name_exact DESC, activity DESC, mention_id DESC)),
    d AS (SELECT l_partkey AS event_id, mention_id AS party_id, score AS confidence, CASE WHEN score >= 0.85 AND round(gap, 4) >= 0.12 THEN 'auto_matched'
      WHEN score >= 0.68 OR (name_exact AND score >= 0.55) OR (name_prefix AND (to_exact OR to_overlap OR from_exact OR from_overlap) AND score >= 0.42 AND round(gap, 4) >= 0.05)
        OR (name_prefix AND (to_root OR from_root) AND activity AND score >= 0.44 AND round(gap, 4) >= 0.08) THEN 'review_pending' END AS link_status FROM r WHERE n = 1)
    SELECT event_id, party_id, link_status, confidence FROM d WHERE link_status IS NOT NULL
    """
)
def transfer_decision(t: Tables) -> DataFrame:
    rows = transfer_rows(t).select(F.col("l_partkey").alias("event_id"), F.col("mention_id").alias("party_id"), "score", "name_exact", "name_prefix", "to_exact", "to_overlap", "from_exact", "from_overlap", (F.col("to_root") | F.col("from_root")).alias("broad"), "activity", F.col("mention_id").alias("display_name"))
    return resolution.decide_transfers(rows)


@query(
    f"""
    WITH s AS (SELECT l_partkey AS mention_id, mention_id AS party_id, CAST(least({_IDENTITY}, 0.98) AS DOUBLE) AS score, contact, l_linenumber AS record_count,
      CASE WHEN l_partkey % 3 = 0 THEN 'full_name' WHEN l_partkey % 3 = 1 THEN 'surname_only' ELSE 'unknown' END AS quality FROM ({_sql_flags(_FLAGS)})),
    r AS (SELECT *, row_number() OVER w AS k, round(score - lead(score) OVER w, 4) AS gap, count(*) OVER (PARTITION BY mention_id) AS n FROM s WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, contact DESC, record_count DESC, party_id)),
    d AS (SELECT *, CASE WHEN n = 1 AND quality = 'full_name' AND score >= 0.90 THEN 1 WHEN n = 1 AND contact AND score >= 0.80 THEN 2 WHEN n = 1 THEN 3 WHEN contact AND gap >= 0.12 THEN 4 ELSE 5 END AS rule FROM r WHERE k = 1)
    SELECT mention_id, CASE WHEN rule <= 4 THEN party_id END AS party_id, CASE WHEN rule <= 2 THEN 'auto_matched' ELSE 'review_pending' END AS link_status,
      CASE rule WHEN 3 THEN greatest(score, 0.6::DOUBLE) WHEN 4 THEN greatest(score, 0.78::DOUBLE) WHEN 5 THEN greatest(score, 0.45::DOUBLE) ELSE score END AS confidence,
      ['full_name_exact', 'same_name_contact_exact', 'same_name_only', 'contact_best_of_same_name', 'multiple_same_name'][rule] AS matched_by FROM d
    """
)
def identity_decision(t: Tables) -> DataFrame:
    e = evidence(t, _FLAGS)
    quality = F.when(F.col("l_partkey") % 3 == 0, "full_name").when(F.col("l_partkey") % 3 == 1, "surname_only").otherwise("unknown")
    scored = e.select(F.col("l_partkey").alias("mention_id"), F.col("mention_id").alias("party_id"), scores.identity_score({n: F.col(n) for n in _FLAGS}, F.col("l_linenumber")).alias("score"), "contact", F.col("l_linenumber").alias("record_count"), quality.alias("quality"), F.lit(0.4).alias("source_confidence"))
    return resolution.decide_mentions(scored)


@query(
    """
    SELECT l_suppkey AS party, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_linestatus)) AS states, count(DISTINCT l_orderkey) AS record_count,
           min(strftime(l_shipdate, '%Y-%m-%d')) AS first_day, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_day FROM lineitem GROUP BY l_suppkey
    """
)
def identity_context(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("party"), "l_returnflag", "l_linestatus", "l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return resolution.identity_context(rows, "party", {"flags": "l_returnflag", "states": "l_linestatus"}, "l_orderkey", "day")


@query(
    """
    WITH a AS (SELECT o_orderkey AS mention_id, 'auto_matched' AS link_status, o_custkey AS party_id FROM orders), r AS (SELECT o_orderkey AS mention_id, CASE WHEN o_orderkey % 2 = 0 THEN 'reviewed_match' ELSE 'reviewed_distinct' END AS link_status, CASE WHEN o_orderkey % 2 = 0 THEN 0 END AS party_id FROM orders WHERE o_orderkey % 7 = 0)
    SELECT a.mention_id, CASE WHEN r.mention_id IS NOT NULL THEN r.link_status ELSE a.link_status END AS link_status, CASE WHEN r.mention_id IS NOT NULL THEN r.party_id ELSE a.party_id END AS party_id FROM a LEFT JOIN r ON a.mention_id = r.mention_id
    """
)
def reviewed_links(t: Tables) -> DataFrame:
    """Human decisions win over automatic ones; of several decisions the newest counts."""
    o = t.orders.select(F.col("o_orderkey").alias("mention_id"), F.lit("auto_matched").alias("link_status"), F.col("o_custkey").alias("party_id"))
    last = o.where("mention_id % 7 = 0").select("mention_id", F.when(F.col("mention_id") % 2 == 0, "reviewed_match").otherwise("reviewed_distinct").alias("link_status"), F.when(F.col("mention_id") % 2 == 0, F.lit(0).cast("long")).alias("party_id"), F.lit(2).alias("decided_at"))
    first = last.select("mention_id", F.lit("reviewed_match").alias("link_status"), F.lit(9).cast("long").alias("party_id"), F.lit(1).alias("decided_at"))
    return resolution.apply_reviews(o, last.unionByName(first), "mention_id")


@query(
    """
    SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'observed' WHEN trim(d.lang) <> '' AND d.doc_id % 2 = 0 THEN 'source_list' WHEN d.doc_id % 3 = 0 THEN 'related_record' END AS unit_source,
           CASE WHEN l.quality = 1 THEN 'labelled' WHEN trim(d.lang) <> '' AND d.doc_id % 2 = 0 THEN d.lang WHEN d.doc_id % 3 = 0 THEN d.source END AS unit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def appearance_cascade(t: Tables) -> DataFrame:
    """The first source that knows the unit, with its label."""
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    got = resolution.cascade((F.when(F.col("quality") == 1, "labelled"), "observed"), (F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "source_list"), (F.when(F.col("doc_id") % 3 == 0, F.col("source")), "related_record"))
    return rows.withColumn("c", got).select("doc_id", F.col("c.source").alias("unit_source"), F.col("c.value").alias("unit"))


@query(
    """
    SELECT d.doc_id, CASE WHEN d.doc_id % 4 < 2 THEN coalesce(nullif(CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE d.lang END, ''), d.source) WHEN d.doc_id % 4 = 2 THEN 'related' ELSE d.source END AS unit,
      CASE WHEN d.doc_id % 4 < 2 THEN 0.9 WHEN d.doc_id % 4 = 2 THEN (CASE WHEN d.doc_id % 8 = 2 THEN 0.25 ELSE 0.12 END) ELSE 0.05 END::DOUBLE AS confidence,
      CASE WHEN d.doc_id % 4 < 2 THEN 'observed' WHEN d.doc_id % 4 = 2 THEN 'related_record' ELSE 'source_list' END AS section FROM documents d
    """
)
def fallback_mentions(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("record_id"), "lang", F.col("source").alias("source_unit"))
    m = F.col("record_id") % 4
    own = d.where(m < 2).select("record_id", F.when(m == 0, "").otherwise(F.col("lang")).alias("unit"), F.lit(None).cast("string").alias("party"), F.lit(0.9).alias("confidence"))
    records = d.select("record_id", "source_unit", F.when(m == 2, "related").alias("related_unit"), F.when(F.col("record_id") % 8 == 2, "someone").alias("related_party"))
    return resolution.fill_mentions(own, records).select(F.col("record_id").alias("doc_id"), "unit", "confidence", "section")


@query(
    """
    WITH o AS (SELECT o_orderkey AS record, year(o_orderdate) AS y FROM orders), p AS (SELECT DISTINCT p_brand AS topic, CAST(1992 + (p_size % 8) AS BIGINT) * (p_size % 3 > 0)::INT AS topic_year FROM part)
    SELECT topic, topic_year, count(*) AS records FROM o JOIN p ON topic_year = 0 OR abs(y - topic_year) <= 1 GROUP BY ALL
    """
)
def year_window_topics(t: Tables) -> DataFrame:
    """Topics of a year meet records of that year and its neighbours, topics without a year meet all; counted before the join."""
    years = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    p = t.part.select(F.col("p_brand").alias("topic"), F.when(F.col("p_size") % 3 > 0, 1992 + F.col("p_size") % 8).otherwise(0).cast("long").alias("topic_year")).distinct()
    return links.year_window(years, p, "y", "topic_year").groupBy("topic", "topic_year").agg(F.sum("n").alias("records"))


@query(
    """
    WITH l AS (SELECT l_orderkey AS record, p_brand AS topic, l_returnflag = 'R' AS is_priority,
      CAST(least(0.54 + CASE WHEN l_linenumber = 1 THEN 0.18 ELSE 0 END + least(0.08 * (l_partkey % 4), 0.18) + CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 4 = 0 THEN 0.06 ELSE 0 END
        + CASE l_suppkey % 3 WHEN 0 THEN 0.08 WHEN 1 THEN 0.03 ELSE 0 END + least(0.12 * (l_quantity::INT / 50.0), 0.1), 0.98) AS DOUBLE) AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
    b AS (SELECT record, topic, max(struct_pack(c := round(c, 4), p := is_priority)) AS m FROM l GROUP BY ALL)
    SELECT record, topic, m.c AS confidence, m.p AS is_priority, row_number() OVER (PARTITION BY record ORDER BY m.p DESC, m.c DESC, topic DESC) AS rank FROM b QUALIFY rank <= 6
    """
)
def topic_link_confidence(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    c = topics.link_confidence(F.col("l_linenumber") == 1, F.col("l_partkey") % 4, F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 3, F.col("l_quantity") / 50.0)
    made = rows.select(F.col("l_orderkey").alias("record"), F.col("p_brand").alias("topic"), (F.col("l_returnflag") == "R").alias("is_priority"), F.round(c, 4).alias("confidence"))
    return topics.best_links(made, "record", "topic").select("record", "topic", "confidence", "is_priority", "rank")
