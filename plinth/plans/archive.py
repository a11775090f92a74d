"""The archive of the views, derived from the driver tables, and queries over it.

Each silver table is a projection that Spark and DuckDB read alike, so it is written once; ``sql`` puts the same projections in
front of a query as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import quality, views
from plinth.plans.registry import Tables, query

_ID = "l_orderkey * 100000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_linenumber"
_STATUS = "CASE l_returnflag WHEN 'A' THEN 'auto_matched' WHEN 'R' THEN 'reviewed_match' ELSE 'review_pending' END"

#: table -> [(driver table, expressions, condition)]
PARTS: dict[str, list[tuple[str, list[str], str]]] = {
    "records": [("orders", [
        "o_orderkey AS record_id", "concat('http://r/', CAST(o_orderkey AS STRING)) AS url", "concat(o_orderpriority, ' notice ', CAST(o_custkey % 97 AS STRING)) AS title",
        "CASE o_orderkey % 3 WHEN 0 THEN 'proposal' WHEN 1 THEN 'press' ELSE 'archive' END AS source_type", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('UNIT_', CAST(o_custkey % 25 AS STRING)) END AS source_unit",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS published_at", "concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 10:00:00') AS fetched_at",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Contact: desk' WHEN 1 THEN 'Contact person: Ann Bee, TEL 1' ELSE 'nothing' END AS raw_text", "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS review_status",
    ], "1 = 1")],
    "mentions": [("lineitem", [
        f"{_ID} AS mention_id", "l_orderkey AS record_id", "CASE WHEN l_partkey % 10 > 0 THEN l_partkey % 25 END AS unit_id", "CASE WHEN l_partkey % 10 > 0 THEN concat('Unit ', CAST(l_partkey % 25 AS STRING)) ELSE '' END AS unit_raw",
        "CASE WHEN l_suppkey % 6 = 0 THEN '' WHEN l_suppkey % 2 = 0 THEN concat('Fam', CAST(l_suppkey AS STRING), ' Given') ELSE concat('S', CAST(l_suppkey % 9 AS STRING)) END AS party_raw",
        "CASE WHEN l_suppkey % 6 = 0 THEN 'unknown' WHEN l_suppkey % 2 = 0 THEN 'full_name' ELSE 'surname_only' END AS quality", "CAST(l_discount AS DOUBLE) AS confidence",
        "CASE WHEN l_partkey % 3 = 0 THEN concat('m', CAST(l_partkey AS STRING), '@example.org') ELSE '' END AS email", "CASE WHEN l_partkey % 4 = 0 THEN concat('095-', CAST(l_partkey AS STRING)) ELSE '' END AS phone",
    ], "1 = 1")],
    "mention_links": [("lineitem", [f"{_ID} AS mention_id", "l_suppkey AS party_id", f"{_STATUS} AS link_status", "CAST(l_tax AS DOUBLE) AS confidence"], "l_suppkey % 7 > 0")],
    "parties": [
        ("supplier", ["s_suppkey AS party_id", "s_name AS party_key", "concat('Party ', s_name) AS display_name", "CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS is_verified", "CASE WHEN s_suppkey % 13 = 0 THEN 'note' ELSE '' END AS note"], "1 = 1"),
        ("customer", ["100000000 + c_custkey AS party_id", "c_name AS party_key", "concat('Party ', c_name) AS display_name", "CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS is_verified", "CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'seen' END AS note"], "c_custkey % 3 = 0"),
    ],
    "units": [("nation", ["CAST(n_nationkey AS BIGINT) AS unit_id", "n_name AS name", "concat('REGION_', CAST(n_regionkey AS STRING)) AS top_unit"], "1 = 1"), ("part", ["1000 + p_partkey AS unit_id", "p_name AS name", "p_brand AS top_unit"], "p_partkey % 50 = 0")],
    "slots": [("events", ["event_id AS slot_id", "user_id % 40 AS party_id", "concat('Fam', CAST(user_id % 40 AS STRING)) AS name_norm", "event_id % 25 AS unit_id", "event_type AS title", "CAST(CAST(ts AS DATE) AS STRING) AS active_from", "CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(CAST(CAST(ts AS DATE) + INTERVAL 20 DAY AS DATE) AS STRING) END AS active_to", "CAST(value / 100 AS DOUBLE) AS confidence"], "event_type = 'signup'")],
    "transfers": [("events", ["event_id", "CAST(CAST(ts AS DATE) AS STRING) AS effective", "concat('Fam', CAST(user_id AS STRING)) AS name_norm", "CASE WHEN event_id % 5 > 0 THEN user_id % 25 END AS from_unit_id", "CASE WHEN event_id % 7 > 0 THEN event_id % 25 END AS to_unit_id", "event_type AS title"], "event_type = 'purchase'")],
    "transfer_links": [("events", ["event_id", "user_id AS party_id", "CASE WHEN event_id % 2 = 0 THEN 'auto_matched' ELSE 'review_pending' END AS link_status", "CAST(event_id % 10 AS DOUBLE) / 10 AS confidence"], "event_type = 'purchase' AND event_id % 4 < 3")],
    "record_topics": [("lineitem", ["l_orderkey AS record_id", "concat('topic', CAST(l_partkey % 30 AS STRING)) AS topic", "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_priority", "CAST(l_discount AS DOUBLE) AS confidence"], "1 = 1")],
    "rollups": [("supplier", ["s_suppkey AS party_id", "concat('topic', CAST(s_nationkey AS STRING)) AS topic", "CAST(s_acctbal AS DOUBLE) AS spotlight"], "1 = 1")],
    "notes": [("customer", ["c_custkey AS note_id", "c_custkey % 100 AS party_id", "c_custkey % 500 AS record_id", "c_mktsegment AS title", "c_name AS content", "concat('2024-01-', CAST(10 + c_custkey % 20 AS STRING)) AS created_at"], "c_custkey % 8 = 0")],
}


def silver(t: Tables, name: str) -> DataFrame:
    out = None
    for source, columns, condition in PARTS[name]:
        one = getattr(t, source).where(condition).selectExpr(*columns)
        out = one if out is None else out.unionAll(one)
    return out


def archive(t: Tables) -> views.Archive:
    return views.Archive(**{name: silver(t, name) for name in PARTS})


def sql(*names: str, body: str) -> str:
    """body with the named silver tables as common table expressions."""
    each = [f"{n} AS ({' UNION ALL '.join(f'SELECT {", ".join(c)} FROM {s} WHERE {w}' for s, c, w in PARTS[n])})" for n in names]
    return f"WITH {', '.join(each)}, {_DERIVED} {body}" if _needed(names) else f"WITH {', '.join(each)} {body}"


#: live records, and linked mentions as a set
_DERIVED = """live AS (SELECT *, CASE WHEN published_at <> '' THEN published_at ELSE substr(fetched_at, 1, 10) END AS observed_at FROM records WHERE review_status <> 'rejected'),
linked AS (SELECT DISTINCT party_id, record_id, unit_id, unit_raw FROM mentions JOIN (SELECT mention_id, party_id FROM mention_links WHERE link_status IN ('auto_matched', 'reviewed_match')) USING (mention_id))"""


def _needed(names: tuple[str, ...]) -> bool:
    return {"records", "mentions", "mention_links"} <= set(names)


_BASE = ("records", "mentions", "mention_links")


@query(sql(*_BASE, body="""
    , latest AS (SELECT * FROM live WHERE source_type = 'press' ORDER BY observed_at DESC, record_id DESC LIMIT 100),
    best AS (SELECT record_id, unit_raw, party_raw FROM mentions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN party_raw <> '' THEN 1 ELSE 0 END DESC, confidence DESC, mention_id) = 1)
    SELECT l.record_id, title, observed_at, CASE WHEN trim(unit_raw) <> '' THEN unit_raw WHEN trim(source_unit) <> '' THEN source_unit END AS unit, CASE WHEN trim(unit_raw) <> '' THEN 'observed' WHEN trim(source_unit) <> '' THEN 'source_list' END AS unit_source,
      CASE WHEN trim(party_raw) <> '' THEN party_raw END AS party, CASE WHEN trim(party_raw) <> '' THEN 'observed' END AS party_source FROM latest l LEFT JOIN best b ON l.record_id = b.record_id
"""))  # fmt: skip
def view_records(t: Tables) -> DataFrame:
    return views.record_list(archive(t), 100, "press")


@query(sql(*_BASE, "parties", body="""
    , g AS (SELECT party_id, count(DISTINCT record_id) AS records, array_to_string(list_sort(list(DISTINCT unit_raw)), ',') AS units, max(observed_at) AS last_seen FROM linked JOIN live USING (record_id) GROUP BY party_id)
    SELECT party_id, display_name, records, units, last_seen FROM parties JOIN g USING (party_id) ORDER BY records DESC, last_seen DESC, party_id LIMIT 50
"""))  # fmt: skip
def view_parties(t: Tables) -> DataFrame:
    return views.party_list(archive(t), 50)


@query(sql(*_BASE, "units", body="""
    , g AS (SELECT unit_id, count(DISTINCT record_id) AS records, count(DISTINCT l.party_id) AS parties FROM mentions m LEFT JOIN (SELECT mention_id, party_id FROM mention_links WHERE link_status IN ('auto_matched', 'reviewed_match')) l USING (mention_id) GROUP BY unit_id)
    SELECT u.unit_id, name, top_unit, records, parties FROM units u JOIN g ON u.unit_id = g.unit_id WHERE records > 0 OR parties > 0
"""))  # fmt: skip
def view_units(t: Tables) -> DataFrame:
    return views.unit_list(archive(t))


_CURRENT = """
    moved AS (SELECT party_id, to_unit_id, effective, event_id FROM (SELECT event_id, party_id FROM transfer_links WHERE link_status IN ('auto_matched', 'reviewed_match')) JOIN transfers USING (event_id) WHERE to_unit_id IS NOT NULL),
    bt AS (SELECT party_id, to_unit_id AS t FROM moved QUALIFY row_number() OVER (PARTITION BY party_id ORDER BY effective DESC, event_id DESC) = 1),
    br AS (SELECT party_id, unit_id AS r FROM (SELECT l.party_id, l.unit_id, observed_at, record_id FROM linked l JOIN live USING (record_id) WHERE l.unit_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY party_id ORDER BY observed_at DESC, record_id DESC, unit_id DESC) = 1),
    current_unit AS (SELECT coalesce(bt.party_id, br.party_id) AS party_id, coalesce(t, r) AS unit_id, CASE WHEN t IS NOT NULL THEN 'transfer' ELSE 'record' END AS source FROM bt FULL JOIN br ON bt.party_id = br.party_id)"""


@query(sql(*_BASE, "transfers", "transfer_links", body=f", {_CURRENT} SELECT * FROM current_unit"))
def view_current_units(t: Tables) -> DataFrame:
    return views.current_unit(archive(t))


_ROSTER = """
    , strong AS (SELECT DISTINCT party_id FROM (SELECT party_id FROM mentions JOIN (SELECT mention_id, party_id FROM mention_links WHERE link_status IN ('auto_matched', 'reviewed_match')) USING (mention_id) WHERE quality = 'full_name' UNION ALL SELECT party_id FROM transfer_links WHERE link_status IN ('auto_matched', 'reviewed_match'))),
    people AS (SELECT p.party_id, display_name, c.unit_id, s.party_id IS NOT NULL AS strong FROM parties p LEFT JOIN current_unit c ON p.party_id = c.party_id LEFT JOIN strong s ON p.party_id = s.party_id ORDER BY display_name, p.party_id LIMIT 300),
    active AS (SELECT * FROM slots WHERE active_from <= '2024-01-15' AND CASE WHEN active_to <> '' THEN active_to ELSE '9999-12-31' END >= '2024-01-15' ORDER BY name_norm, slot_id LIMIT 500),
    open_moves AS (SELECT name_norm, to_unit_id FROM (SELECT * FROM transfers WHERE event_id NOT IN (SELECT event_id FROM transfer_links WHERE link_status IN ('auto_matched', 'reviewed_match'))) QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY effective DESC, event_id DESC) = 1),
    loose AS (SELECT party_raw AS name, unit_id, max(confidence) AS confidence FROM mentions WHERE trim(party_raw) <> '' AND mention_id NOT IN (SELECT mention_id FROM mention_links WHERE link_status IN ('auto_matched', 'reviewed_match')) GROUP BY ALL),
    every AS (SELECT CASE WHEN strong THEN 'confirmed' ELSE 'weak' END AS kind, display_name AS name, unit_id, CASE WHEN strong THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence FROM people
      UNION ALL SELECT 'slot', name_norm, unit_id, confidence FROM active UNION ALL (SELECT 'transfer', name_norm, to_unit_id, 0.3::DOUBLE FROM open_moves ORDER BY name_norm LIMIT 500)
      UNION ALL (SELECT 'mention', name, unit_id, confidence FROM loose ORDER BY confidence DESC, name, unit_id NULLS FIRST LIMIT 300)),
    roster AS (SELECT kind, coalesce(top_unit, 'unknown') AS top_unit, e.name, e.unit_id, confidence FROM every e LEFT JOIN units u ON e.unit_id = u.unit_id)"""
_ROSTER_TABLES = (*_BASE, "parties", "units", "slots", "transfers", "transfer_links")


@query(sql(*_ROSTER_TABLES, body=f", {_CURRENT} {_ROSTER} SELECT * FROM roster"))
def view_roster(t: Tables) -> DataFrame:
    return views.roster(archive(t), "2024-01-15")


@query(sql(*_ROSTER_TABLES, body=f""", {_CURRENT} {_ROSTER}, n AS (SELECT *, row_number() OVER (PARTITION BY top_unit ORDER BY list_position(['confirmed', 'weak', 'slot', 'transfer', 'mention'], kind), name) AS n FROM roster)
    SELECT top_unit, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('confirmed', 'weak', 'slot', 'transfer', 'mention'))}, list_distinct_ordered AS names FROM (
      SELECT top_unit, kind, list_transform(list_filter(list_zip(l, range(len(l))), lambda x: list_position(l, x[1]) = x[2] + 1), lambda x: x[1]) AS list_distinct_ordered FROM (
        SELECT top_unit, kind, list(name ORDER BY n) FILTER (n <= 8) OVER (PARTITION BY top_unit) AS l FROM n)) GROUP BY top_unit, list_distinct_ordered
"""))  # fmt: skip
def view_roster_groups(t: Tables) -> DataFrame:
    return views.roster_groups(views.roster(archive(t), "2024-01-15"))


@query(sql(*_BASE, "parties", "record_topics", "notes", body="""
    SELECT 'record' AS part, url AS value FROM records WHERE record_id = 40 UNION ALL SELECT 'mention', CAST(mention_id AS STRING) FROM mentions WHERE record_id = 40
    UNION ALL SELECT 'topic', topic FROM record_topics WHERE record_id = 40 UNION ALL SELECT 'note', CAST(note_id AS STRING) FROM notes WHERE record_id = 40
    UNION ALL SELECT 'party', party_key FROM parties WHERE party_id IN (SELECT party_id FROM linked WHERE record_id = 40)
"""))  # fmt: skip
def view_record_detail(t: Tables) -> DataFrame:
    return _parts(views.record_detail(archive(t), 40), {"record": ("record", "url"), "mentions": ("mention", "mention_id"), "topics": ("topic", "topic"), "notes": ("note", "note_id"), "parties": ("party", "party_key")})


def _parts(frames: dict[str, DataFrame], names: dict[str, tuple[str, str]]) -> DataFrame:
    """(part, value) of a detail's frames."""
    out = None
    for key, (part, column) in names.items():
        one = frames[key].select(F.lit(part).alias("part"), F.col(column).cast("string").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


@query(sql(*_BASE, "units", "parties", "record_topics", "slots", body="""
    , own AS (SELECT * FROM live WHERE record_id IN (SELECT record_id FROM mentions WHERE unit_id = 7))
    SELECT 'unit' AS part, name AS value FROM units WHERE unit_id = 7 UNION ALL SELECT 'record', url FROM own UNION ALL SELECT 'party', party_key FROM parties WHERE party_id IN (SELECT party_id FROM linked WHERE unit_id = 7)
    UNION ALL SELECT 'topic', topic || ':' || n FROM (SELECT topic, count(*) AS n FROM record_topics WHERE record_id IN (SELECT record_id FROM own) GROUP BY topic) UNION ALL SELECT 'slot', CAST(slot_id AS STRING) FROM slots WHERE unit_id = 7
"""))  # fmt: skip
def view_unit_detail(t: Tables) -> DataFrame:
    d = views.unit_detail(archive(t), 7)
    d["topics"] = d["topics"].withColumn("topic", F.concat_ws(":", "topic", F.col("records").cast("string")))
    return _parts(d, {"unit": ("unit", "name"), "records": ("record", "url"), "parties": ("party", "party_key"), "topics": ("topic", "topic"), "slots": ("slot", "slot_id")})


@query(sql(*_BASE, "parties", "transfers", "transfer_links", "rollups", "notes", body="""
    , own AS (SELECT * FROM linked l JOIN live USING (record_id) WHERE party_id = 5)
    SELECT 'party' AS part, party_key AS value FROM parties WHERE party_key = 'Supplier#000000005' UNION ALL SELECT 'record', url FROM own
    UNION ALL SELECT 'unit', unit_raw || ':' || min(observed_at) || ':' || max(observed_at) || ':' || count(DISTINCT record_id) FROM own GROUP BY unit_raw
    UNION ALL SELECT 'transfer', CAST(event_id AS STRING) FROM transfers WHERE event_id IN (SELECT event_id FROM transfer_links WHERE party_id = 5 AND link_status IN ('auto_matched', 'reviewed_match'))
    UNION ALL SELECT 'topic', topic FROM rollups WHERE party_id = 5 UNION ALL SELECT 'note', CAST(note_id AS STRING) FROM notes WHERE party_id = 5
"""))  # fmt: skip
def view_party_detail(t: Tables) -> DataFrame:
    d = views.party_detail(archive(t), "Supplier#000000005")
    d["units"] = d["units"].withColumn("u", F.concat_ws(":", "unit_raw", "first_seen", "last_seen", F.col("records").cast("string")))
    return _parts(d, {"party": ("party", "party_key"), "records": ("record", "url"), "units": ("unit", "u"), "transfers": ("transfer", "event_id"), "topics": ("topic", "topic"), "notes": ("note", "note_id")})


@query(sql("notes", "parties", body="SELECT note_id, party_id, display_name, title, created_at FROM notes JOIN parties USING (party_id)"))
def view_notes(t: Tables) -> DataFrame:
    return views.note_list(archive(t)).select("note_id", "party_id", "display_name", "title", "created_at")


@query(sql("notes", "parties", "records", body="SELECT note_id, n.title, content, created_at, display_name, r.title AS record_title FROM notes n LEFT JOIN parties p ON n.party_id = p.party_id LEFT JOIN records r ON n.record_id = r.record_id WHERE note_id = 16"))
def view_note(t: Tables) -> DataFrame:
    return views.note_detail(archive(t), 16)


@query(sql(*_BASE, body="SELECT record_id, observed_at FROM live WHERE record_id NOT IN (SELECT record_id FROM mentions WHERE trim(party_raw) <> '')"))
def view_records_without_party(t: Tables) -> DataFrame:
    return views.records_without_party(archive(t)).select("record_id", "observed_at")


@query(sql(*_BASE, body="""SELECT cause, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(raw_text, '(Contact person)\\s*:') AND regexp_matches(raw_text, 'TEL') THEN 'explicit_label_not_extracted' WHEN contains(raw_text, 'Contact') THEN 'source_has_department_only'
    ELSE 'no_contact_section_detected' END AS cause FROM live WHERE record_id NOT IN (SELECT record_id FROM mentions WHERE trim(party_raw) <> '')) GROUP BY cause"""))  # fmt: skip
def missing_party_causes(t: Tables) -> DataFrame:
    rows = views.records_without_party(archive(t))
    return rows.groupBy(quality.missing_party_cause(F.col("title"), F.col("raw_text")).alias("cause")).agg(F.count("*").alias("n"))


@query(sql("records", body="SELECT record_id, published_at FROM records WHERE review_status = 'pending' ORDER BY published_at NULLS FIRST, record_id LIMIT 100"))
def review_queue(t: Tables) -> DataFrame:
    return views.pending_reviews(archive(t), 100).select("record_id", "published_at")


@query(sql(*_BASE, body="SELECT mention_id, party_id, observed_at FROM (SELECT * FROM mention_links WHERE link_status = 'review_pending') l JOIN mentions USING (mention_id) JOIN live USING (record_id) ORDER BY observed_at DESC, l.confidence DESC, mention_id LIMIT 100"))
def link_review_queue(t: Tables) -> DataFrame:
    return views.pending_links(archive(t), 100).select("mention_id", "party_id", "observed_at")


@query(sql("parties", "mention_links", "transfer_links", "notes", body="SELECT party_id FROM parties WHERE is_verified = 0 AND trim(note) = '' AND party_id NOT IN (SELECT party_id FROM mention_links) AND party_id NOT IN (SELECT party_id FROM transfer_links) AND party_id NOT IN (SELECT party_id FROM notes)"))
def orphan_party_cleanup(t: Tables) -> DataFrame:
    return views.orphan_parties(archive(t)).select("party_id")


@query(sql("units", "mentions", "slots", "transfers", body="SELECT unit_id FROM units WHERE unit_id NOT IN (SELECT unit_id FROM mentions WHERE unit_id IS NOT NULL) AND unit_id NOT IN (SELECT unit_id FROM slots) AND unit_id NOT IN (SELECT from_unit_id FROM transfers WHERE from_unit_id IS NOT NULL) AND unit_id NOT IN (SELECT to_unit_id FROM transfers WHERE to_unit_id IS NOT NULL)"))
def orphan_unit_cleanup(t: Tables) -> DataFrame:
    return views.orphan_units(archive(t)).select("unit_id")


@query(sql("mentions", "slots", "transfers", "units", body="""
    , a AS (SELECT unit_id AS old, unit_id - 5 AS new FROM units WHERE unit_id BETWEEN 10 AND 24), root AS (SELECT unit_id, CASE WHEN unit_id BETWEEN 10 AND 24 THEN 5 + unit_id % 5 ELSE unit_id END AS r FROM units)
    SELECT 'mention' AS part, m.unit_id, count(*) AS n FROM (SELECT CASE WHEN unit_id BETWEEN 10 AND 24 THEN 5 + unit_id % 5 ELSE unit_id END AS unit_id FROM mentions) m GROUP BY ALL
    UNION ALL SELECT 'unit', unit_id, 1 FROM units WHERE unit_id NOT BETWEEN 10 AND 24
    UNION ALL SELECT 'to', u, count(*) FROM (SELECT CASE WHEN to_unit_id BETWEEN 10 AND 24 THEN 5 + to_unit_id % 5 ELSE to_unit_id END AS u FROM transfers) GROUP BY ALL
""").replace(" , a AS (SELECT unit_id AS old, unit_id - 5 AS new FROM units WHERE unit_id BETWEEN 10 AND 24), root AS", " , root AS"))  # fmt: skip
def merge_units_everywhere(t: Tables) -> DataFrame:
    """Units 10 to 24 merged into the one five below, in chains down to 5 to 9."""
    a = archive(t)
    merged = views.merge_units(a, a.units.where("unit_id between 10 and 24").select(F.col("unit_id").alias("old"), (F.col("unit_id") - 5).alias("new")))
    one = lambda df, part, c: df.groupBy(F.col(c).alias("unit_id")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "unit_id", "n")
    return one(merged.mentions, "mention", "unit_id").unionByName(one(merged.units, "unit", "unit_id")).unionByName(one(merged.transfers, "to", "to_unit_id"))


@query(sql("mention_links", "parties", "notes", "rollups", body="""
    SELECT 'link' AS part, p AS party_id, count(*) AS n FROM (SELECT CASE WHEN party_id % 2 = 1 AND party_id > 1 THEN party_id - 1 ELSE party_id END AS p FROM mention_links) GROUP BY ALL
    UNION ALL SELECT 'party', party_id, 1 FROM parties WHERE NOT (party_id % 2 = 1 AND party_id > 1 AND party_id < 100000000) UNION ALL SELECT 'note', p, count(*) FROM (SELECT CASE WHEN party_id % 2 = 1 AND party_id > 1 THEN party_id - 1 ELSE party_id END AS p FROM notes) GROUP BY ALL
"""))  # fmt: skip
def merge_parties_everywhere(t: Tables) -> DataFrame:
    """Every supplier with an odd id merged into the one before."""
    a = archive(t)
    odd = a.parties.where("party_id % 2 = 1 and party_id > 1 and party_id < 100000000").select(F.col("party_id").alias("old"), (F.col("party_id") - 1).alias("new"))
    known = odd.unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("old"), F.lit(-2).cast("long").alias("new")))
    merged = views.merge_parties(a, known)
    one = lambda df, part: df.groupBy("party_id").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "party_id", "n")
    return one(merged.mention_links, "link").unionByName(one(merged.parties, "party")).unionByName(one(merged.notes, "note"))


@query(sql("transfers", "transfer_links", "records", body="""
    , r AS (SELECT record_id, record_id % 25 AS unit_id, DATE '2024-01-01' + CAST(record_id % 30 AS INTEGER) AS observed FROM records WHERE record_id % 4 = 0),
    t AS (SELECT t.*, l.confidence, CAST(effective AS DATE) AS day FROM transfers t LEFT JOIN transfer_links l USING (event_id)),
    e AS (SELECT to_unit_id AS unit_id, event_id, name_norm, day, confidence, 0.25 AS u, 1 AS m FROM t WHERE to_unit_id IS NOT NULL UNION ALL SELECT from_unit_id, event_id, name_norm, day, confidence, 0.10, 0 FROM t WHERE from_unit_id IS NOT NULL AND from_unit_id IS DISTINCT FROM to_unit_id),
    h AS (SELECT record_id, name_norm, m, abs(date_diff('day', observed, day)) AS days, least(0.99, round(0.25 + CAST(0.35 AS DECIMAL(8,4)) * CAST(coalesce(confidence, 0) AS DECIMAL(8,4)) + u + CASE WHEN abs(date_diff('day', observed, day)) <= 90 THEN 0.25 ELSE 0.15 END, 4)) AS score FROM r JOIN e USING (unit_id)),
    o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY record_id, name_norm ORDER BY score DESC, m DESC, days, name_norm DESC) = 1)
    SELECT record_id, name_norm, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY record_id ORDER BY score DESC, m DESC, days, name_norm DESC) AS INTEGER) AS rank FROM o QUALIFY rank <= 5
"""))  # fmt: skip
def transfer_candidates_top5(t: Tables) -> DataFrame:
    a = archive(t)
    rows = a.records.where("record_id % 4 = 0").select("record_id", (F.col("record_id") % 25).alias("unit_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("record_id") % 30).cast("int")).alias("observed"))
    return views.transfer_candidates(a, rows).select("record_id", "name_norm", "score", "rank")
