"""Registers, inference, scoped relinking, edits and personnel lines over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.operators import directory, extraction, jobs, keyed, links, resolution, slots, views
from plinth.plans.archive import archive, silver, sql
from plinth.plans.fields import _UNITS, _sql_parts, _sql_rank, unit_rows
from plinth.plans.registry import Tables, query

# units

_REFERENCE = ["総務部", "財政課", "観光局", "財政課企画係"]
_RESOLVED = f"""
    {_UNITS}, a(alias) AS (VALUES {', '.join(f"('{x}')" for x in _REFERENCE)}), n AS (SELECT DISTINCT name FROM u WHERE trim(name) <> ''),
    m AS (SELECT name, max_by(alias, (CASE WHEN name = alias THEN 3 WHEN starts_with(name, alias) THEN 2 ELSE 1 END) * 1000 + length(alias)) AS alias FROM n JOIN a ON contains(name, alias) GROUP BY name),
    r AS (SELECT n.name, CASE WHEN alias IS NOT NULL AND (name = alias OR NOT (len({_sql_parts('n.name')}) > len({_sql_parts('alias')}) OR {_sql_rank('n.name')} > {_sql_rank('alias')})) THEN alias END AS alias FROM n LEFT JOIN m USING (name))"""


def seeded(t: Tables) -> tuple[DataFrame, DataFrame]:
    names = t.spark.createDataFrame([(i, n) for i, n in enumerate(_REFERENCE)], "i int, name string")
    return directory.seed_reference(t.spark.createDataFrame([], "unit_id long, name string, name_key string"), names, "name", "i")


@query(f"WITH {_RESOLVED} SELECT name, coalesce(alias, name) AS unit, alias IS NULL AS created FROM r")
def unit_registration(t: Tables) -> DataFrame:
    """Names of units against a reference: those that resolve, and those that make a unit of their own (named by their key)."""
    units, aliases = seeded(t)
    after, _, placed = directory.get_or_create_units(units, aliases, unit_rows(t).select("name").distinct(), "name")
    made = placed.where("unit_id is not null").join(after.select("unit_id", F.col("name").alias("unit"), "name_key"), "unit_id").join(units.select("unit_id", F.lit(True).alias("old")), "unit_id", "left")
    return made.select("name", F.when(F.col("old"), F.col("unit")).otherwise(F.col("name")).alias("unit"), F.col("old").isNull().alias("created"))


@query(f"WITH {_RESOLVED} SELECT count(*) AS rows, count(*) FILTER (WHERE alias IS NOT NULL AND alias <> '{_REFERENCE[1]}') AS changed FROM u LEFT JOIN r USING (name)")
def unit_refresh(t: Tables) -> DataFrame:
    """All rows said to be of one unit, resolved anew."""
    _, aliases = seeded(t)
    one = aliases.where(F.col("alias") == _REFERENCE[1]).select("unit_id")
    return directory.refresh_references(unit_rows(t).crossJoin(F.broadcast(one)), "name", "unit_id", aliases)[1]


@query("SELECT p_name AS alias, max_by(p_brand, p_partkey) AS brand FROM part GROUP BY p_name")
def unit_alias_upserts(t: Tables) -> DataFrame:
    """An alias belongs to the unit that named it last."""
    brands = t.part.select("p_brand").distinct().select(F.col("p_brand").alias("brand"), F.xxhash64("p_brand").alias("unit_id"))
    new = t.part.select(F.col("p_name").alias("alias"), F.xxhash64("p_brand").alias("unit_id"), F.lit("observed").alias("kind"), F.col("p_partkey").alias("o"))
    old = new.where("o % 2 = 0").select("alias", F.lit(0).cast("long").alias("unit_id"), "kind").distinct()
    return directory.upsert_aliases(old, new, "o").join(brands, "unit_id").select("alias", "brand")


# parties

@query("SELECT party_key, display_name, row_number() OVER (PARTITION BY fresh ORDER BY party_key) * fresh::INT AS position FROM (SELECT s_name AS party_key, 'New ' || s_name AS display_name, s_suppkey % 3 > 0 AS fresh FROM supplier)")
def party_registration(t: Tables) -> DataFrame:
    """New keys are numbered after the largest id in the order of their keys; known keys take the new name."""
    s = t.supplier.select(F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("party_key"), F.col("s_name").alias("display_name"))
    old = s.where("party_id % 3 = 0")
    after = directory.upsert_parties(old, s.select("party_key", F.concat(F.lit("New "), "display_name").alias("display_name")))
    top = old.agg(F.max("party_id").alias("top"))
    return after.join(old.select("party_id", F.lit(1).alias("was")), "party_id", "left").crossJoin(F.broadcast(top)).select("party_key", "display_name", F.when(F.col("was").isNull(), F.col("party_id") - F.col("top")).otherwise(0).alias("position"))


@query("SELECT CASE WHEN n = 1 THEN segment ELSE segment || '-' || n END AS party_key, c_name AS display_name FROM (SELECT lower(c_mktsegment) AS segment, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS n FROM customer)")
def distinct_party_keys(t: Tables) -> DataFrame:
    named = t.customer.select(F.lower("c_mktsegment").alias("party_key"), F.col("c_name").alias("display_name"))
    none = t.spark.createDataFrame([], "party_id long, party_key string, display_name string")
    return directory.add_distinct_parties(none, named, ["display_name"]).select("party_key", "display_name")


@query(sql("mentions", body="""
    SELECT party_key, count(*) AS mentions FROM (SELECT substr(sha256(replace(trim(party_raw), ' ', '')), 1, 12) AS party_key FROM mentions WHERE party_raw <> '' AND (quality = 'full_name' OR (quality <> 'surname_only' AND (email <> '' OR phone <> '' OR confidence >= 0.9)))) GROUP BY party_key
"""))  # fmt: skip
def parties_from_mentions(t: Tables) -> DataFrame:
    """Mentions that may make a party, by the party's key."""
    none = t.spark.createDataFrame([], "party_id long, party_key string, display_name string")
    parties, linked = directory.parties_for_mentions(none, silver(t, "mentions"))
    return linked.join(parties, "party_id").groupBy("party_key").agg(F.count("*").alias("mentions"))


@query(sql("slots", body="SELECT slot_id, CASE WHEN slot_id % 2 = 0 THEN 'p' || party_id ELSE name_norm END AS party FROM slots"))
def parties_from_slots(t: Tables) -> DataFrame:
    """Slots without a party get that of their name."""
    s = silver(t, "slots").withColumn("party_id", F.when(F.col("slot_id") % 2 == 0, F.col("party_id")))
    none = t.spark.createDataFrame([], "party_id long, party_key string, display_name string")
    after, placed = directory.parties_for_slots(none, s)
    made = placed.where("slot_id % 2 = 1").join(after, "party_id").select("slot_id", F.col("display_name").alias("party"))
    return placed.where("slot_id % 2 = 0").select("slot_id", F.concat(F.lit("p"), F.col("party_id").cast("string")).alias("party")).unionByName(made)


# inference and candidates

@query("""
    WITH m AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS record_id, 'e:m' || l_partkey AS contact, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey ELSE l_partkey END AS party_id FROM lineitem), k AS (SELECT * FROM m WHERE record_id % 3 > 0), a AS (SELECT DISTINCT record_id, contact FROM m WHERE record_id % 3 < 2)
    SELECT a.record_id, min(k.party_id) AS party_id FROM a JOIN k ON a.contact = k.contact AND a.record_id <> k.record_id GROUP BY a.record_id HAVING min(k.party_id) = max(k.party_id)
""")  # fmt: skip
def contact_inference(t: Tables) -> DataFrame:
    """The one party that other records with a record's contacts name."""
    party = F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey"))
    m = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), party.alias("party_id"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("email"), F.lit("").alias("phone"))
    return resolution.party_by_contact(m.where("record_id % 3 < 2").select("record_id", "email", "phone"), m.where("record_id % 3 > 0"))


_STAYS = "s AS (SELECT event_id % 300 AS unit, 'Fam ' || user_id AS name, ts::DATE AS a, CASE WHEN event_id % 3 > 0 THEN ts::DATE + (event_id % 400)::INT END AS b FROM events WHERE event_type = 'signup'), r AS (SELECT o_orderkey AS record_id, o_custkey % 300 AS unit, DATE '2023-12-20' + (o_orderkey % 500)::INT AS day FROM orders)"


def _stays(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events.where("event_type = 'signup'")
    s = e.select((F.col("event_id") % 300).alias("unit"), F.concat(F.lit("Fam "), F.col("user_id").cast("string")).alias("name"), F.to_date("ts").alias("start"), F.when(F.col("event_id") % 3 > 0, F.date_add("ts", (F.col("event_id") % 400).cast("int"))).alias("end"))
    r = t.orders.select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 300).alias("unit"), F.date_add(F.lit("2023-12-20").cast("date"), (F.col("o_orderkey") % 500).cast("int")).alias("day"))
    return r, s


@query(f"WITH {_STAYS} SELECT record_id, count(*) AS active FROM r JOIN s ON r.unit = s.unit AND a <= day AND (b IS NULL OR b >= day) GROUP BY record_id")
def slots_at_records(t: Tables) -> DataFrame:
    """How many stays of a record's unit hold the record's day."""
    r, s = _stays(t)
    hit = links.active_summary(r, s, ["unit"], "day", "start", "end", {"active": F.count("*")}, {"active": F.sum("active")})
    return hit.groupBy("record_id").agg(F.sum("active").alias("active"))


@query(f"WITH {_STAYS} SELECT record_id, min(name) AS name FROM r JOIN s ON r.unit = s.unit AND a <= day AND (b IS NULL OR b >= day) GROUP BY record_id HAVING min(name) = max(name)")
def slot_inference(t: Tables) -> DataFrame:
    """The one person whose stay in the unit holds the record's day."""
    return resolution.party_by_slot(*_stays(t))


@query("""
    WITH m AS (SELECT c_custkey AS mention_id, 'Fam' || (c_custkey % 30) AS n, c_nationkey AS unit_id FROM customer), p AS (SELECT s_suppkey AS party_id, 'Fam' || (s_suppkey % 90) AS n, s_nationkey AS unit_id, s_suppkey % 7 AS record_count FROM supplier),
    h AS (SELECT mention_id, party_id, m.n = p.n AS exact, m.unit_id = p.unit_id AS same_unit, record_count FROM m JOIN p ON starts_with(p.n, m.n) OR starts_with(m.n, p.n)), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY exact DESC, record_count DESC, party_id) <= 9)
    SELECT mention_id, party_id, exact, same_unit, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY exact DESC, same_unit DESC, record_count DESC, party_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 3
""")  # fmt: skip
def identity_candidates_top3(t: Tables) -> DataFrame:
    name = lambda c, n: F.concat(F.lit("Fam"), (F.col(c) % n).cast("string")).alias("name_norm")
    m = t.customer.select(F.col("c_custkey").alias("mention_id"), name("c_custkey", 30), F.col("c_nationkey").alias("unit_id"))
    p = t.supplier.select(F.col("s_suppkey").alias("party_id"), name("s_suppkey", 90), F.col("s_nationkey").alias("unit_id"), (F.col("s_suppkey") % 7).alias("record_count"))
    return resolution.identity_candidates(m, p, 3)


@query("""
    WITH m AS (SELECT user_id AS name, event_id, year(ts) AS y, event_type AS unit, CASE WHEN value > 20 THEN 'full_name' ELSE 'surname_only' END AS q FROM events), p AS (SELECT *, lag(y) OVER w AS py, lag(unit) OVER w AS pu, lag(q) OVER w AS pq FROM m WINDOW w AS (PARTITION BY name ORDER BY event_id))
    SELECT event_id, coalesce(y = py AND unit <> '' AND pu <> '' AND NOT (contains(unit, pu) OR contains(pu, unit)) AND (q = 'surname_only' OR pq = 'surname_only'), false) AS apart FROM p
""")  # fmt: skip
def distinct_people(t: Tables) -> DataFrame:
    """Whether a mention is of someone else than the one before it of the same name."""
    m = t.events.select(F.col("user_id").alias("name"), "event_id", F.year("ts").alias("year"), F.col("event_type").alias("unit"), F.when(F.col("value") > 20, "full_name").otherwise("surname_only").alias("quality"))
    w = W.partitionBy("name").orderBy("event_id")
    fields = ("name", "year", "unit", "quality")
    return m.select("event_id", resolution.distinct_same_year({c: F.lag(c).over(w) for c in fields}, {c: F.col(c) for c in fields}).alias("apart"))


# links, edits, notes, replacements

@query(sql("mention_links", body="""
    , n AS (SELECT DISTINCT mention_id, party_id + 1 AS party_id FROM mention_links WHERE mention_id % 2 = 0), k AS (SELECT mention_id, party_id, link_status FROM mention_links)
    SELECT 'new' AS part, count(*) AS n FROM n WHERE mention_id NOT IN (SELECT mention_id FROM k WHERE link_status = 'reviewed_match') UNION ALL SELECT 'old', count(*) FROM k WHERE link_status = 'reviewed_match' OR mention_id NOT IN (SELECT mention_id FROM n)
"""))  # fmt: skip
def link_upserts(t: Tables) -> DataFrame:
    """New links replace automatic ones and leave reviewed ones."""
    old = silver(t, "mention_links")
    new = old.where("mention_id % 2 = 0").select("mention_id", (F.col("party_id") + 1).alias("party_id"), F.lit("new").alias("link_status"), F.lit(0.5).alias("confidence")).distinct()
    return resolution.upsert_links(old, new, "mention_id").groupBy(F.when(F.col("link_status") == "new", "new").otherwise("old").alias("part")).agg(F.count("*").alias("n"))


@query("""
    WITH c AS (SELECT event_id, user_id AS name, value AS v FROM events WHERE event_type = 'purchase'), o AS (SELECT event_id, name, 'auto_matched' AS link_status, 1 AS party_id FROM c WHERE event_id % 2 = 0)
    SELECT event_id, CASE WHEN name % 5 = 0 THEN 2 ELSE 1 END AS party_id FROM c WHERE CASE WHEN name % 5 = 0 THEN v > 20 ELSE event_id % 2 = 0 END
""")  # fmt: skip
def scoped_relinking(t: Tables) -> DataFrame:
    """Only the events of every fifth name are decided anew."""
    c = t.events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("name"), "value")
    old = c.where("event_id % 2 = 0").select("event_id", F.lit(1).alias("party_id"), F.lit("auto_matched").alias("link_status"), F.lit(0.9).alias("confidence"))
    flags = {x: F.lit(False) for x in ("name_prefix", "to_exact", "to_overlap", "from_exact", "from_overlap", "broad", "activity")}
    scored = c.select("event_id", "name", F.lit(2).alias("party_id"), F.when(F.col("value") > 20, 0.9).otherwise(0.1).alias("score")).withColumns(flags | {"name_exact": F.lit(False), "display_name": F.col("event_id")})
    names = c.where("name % 5 = 0").select("name").distinct()
    return resolution.relink(old, scored, names, resolution.decide_transfers, "event_id").select("event_id", "party_id")


@query(sql("records", body="SELECT record_id, CASE WHEN record_id % 6 = 0 THEN 'edited' ELSE title END AS title, CASE WHEN record_id % 6 = 0 THEN 'approved' WHEN record_id % 6 = 3 THEN 'rejected' ELSE review_status END AS review_status FROM records"))
def record_edits(t: Tables) -> DataFrame:
    """The newest edit of a record counts, and its null fields keep what was there."""
    r = silver(t, "records").select("record_id", "title", "review_status")
    three = r.where("record_id % 3 = 0").select("record_id")
    edits = three.select("record_id", F.when(F.col("record_id") % 6 == 0, "edited").alias("title"), F.when(F.col("record_id") % 6 == 0, "approved").otherwise("rejected").alias("review_status"), F.lit(2).alias("decided_at"))
    first = three.select("record_id", F.lit("older").alias("title"), F.lit("pending").alias("review_status"), F.lit(1).alias("decided_at"))
    return jobs.edit_records(r, edits.unionByName(first))


@query(sql("notes", body=", m AS (SELECT max(note_id) AS top FROM notes) SELECT note_id, party_id, content FROM notes UNION ALL SELECT top + row_number() OVER (ORDER BY s_suppkey), s_suppkey, s_name FROM supplier, m WHERE s_suppkey % 4 > 0"))
def added_notes(t: Tables) -> DataFrame:
    old = silver(t, "notes")
    new = t.supplier.select(F.col("s_suppkey").alias("party_id"), F.lit(None).cast("long").alias("record_id"), F.lit("t").alias("title"), F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.col("s_name")).alias("content"), F.lit("2025").alias("created_at"))
    return jobs.add_notes(old, new).select("note_id", "party_id", "content")


@query("""
    SELECT 'src:' || (user_id % 20) || ':2024-01-01' AS source_key, event_id::INT AS event_index, 'n' || user_id AS name FROM events WHERE user_id % 20 < 5 AND event_id % 3 > 0 AND event_type = 'signup'
    UNION ALL SELECT 'src:' || (user_id % 20) || ':2024-01-01', event_id::INT, 'old' FROM events WHERE user_id % 20 >= 5 AND event_type = 'signup'
""".replace("'src:'", "'t:src'"))  # fmt: skip
def replaced_events(t: Tables) -> DataFrame:
    """The events of five sources replaced; nameless rows leave a gap, and other sources stay."""
    e = t.events.where("event_type = 'signup'")
    title = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    key = F.concat(F.lit("t:"), title, F.lit(":2024-01-01"))
    old = e.select(key.alias("source_key"), F.col("event_id").cast("int").alias("event_index"), F.lit("old").alias("name"), *[F.lit("").alias(c) for c in ("from_department", "to_department", "to_title", "effective")])
    sources = t.spark.createDataFrame([], "source_key string, source_type string, title string, url string, published_at string, effective_date string")
    rows = e.where("user_id % 20 < 5").select(F.lit("t").alias("source_type"), title.alias("title"), F.lit("").alias("url"), F.lit("2024-01-01").alias("published_at"), F.lit("").alias("effective_date"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("user_id").cast("string"))).alias("person_name"), *[F.lit("").alias(c) for c in ("from_department", "to_department", "to_title")])
    return jobs.replace_events(sources, old, rows)[1].select("source_key", "event_index", "name")


@query("SELECT l_orderkey AS mention_id, l_suppkey AS slot_id, max(l_linenumber) AS score FROM lineitem GROUP BY ALL")
def slot_candidate_upserts(t: Tables) -> DataFrame:
    """One candidate of each mention and slot, that with the largest score."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("slot_id"), F.col("l_linenumber").alias("score"))
    old = rows.where("mention_id % 2 = 0").select("mention_id", "slot_id", F.lit(0).alias("score")).distinct()
    return keyed.merge(old, rows, ["mention_id", "slot_id"], order=["score"])


@query(sql("mentions", body="SELECT record_id, count(*) AS n, max(CASE WHEN record_id % 4 = 0 THEN 'new' ELSE 'old' END) AS part FROM (SELECT record_id FROM mentions WHERE record_id % 4 > 0 UNION ALL SELECT DISTINCT record_id FROM mentions WHERE record_id % 4 = 0) GROUP BY record_id"))
def replaced_mentions(t: Tables) -> DataFrame:
    """Mentions of re-extracted records are replaced, those of the others stay."""
    m = silver(t, "mentions").select("record_id", F.lit("old").alias("part"))
    new = m.where("record_id % 4 = 0").select("record_id", F.lit("new").alias("part")).distinct()
    return jobs.replace_mentions(m, new, "record_id").groupBy("record_id").agg(F.count("*").alias("n"), F.max("part").alias("part"))


# personnel lines and profiles

@query("""
    WITH p AS (SELECT p_partkey, p_partkey % 4 AS f, p_partkey % 3 AS k FROM part)
    SELECT p_partkey, CAST(0 AS INTEGER) AS position, '甲野 一郎' AS name, CASE WHEN f = 3 THEN '' ELSE ['総務部', '観光局', '港センター'][k + 1] END AS to_unit, CASE WHEN f = 3 THEN '' ELSE '主査' END AS to_title, CASE f WHEN 0 THEN '企画課' WHEN 3 THEN ['総務部', '観光局', '港センター'][k + 1] ELSE '' END AS from_unit, CASE f WHEN 0 THEN '課長' WHEN 3 THEN '主査' ELSE '' END AS from_title FROM p
    UNION ALL SELECT p_partkey, 1, '乙野 花', ['総務部', '観光局', '港センター'][k + 1], '技師', '', '' FROM p WHERE f = 0
""")  # fmt: skip
def personnel_lines(t: Tables) -> DataFrame:
    """Lines of composed articles, with brackets, ditto marks and retirements."""
    k, f = F.col("p_partkey") % 3, F.col("p_partkey") % 4
    unit = F.element_at(F.array(F.lit("総務部"), F.lit("観光局"), F.lit("港センター")), (k + 1).cast("int"))
    line = lambda *parts: F.struct(F.lit("line").alias("kind"), F.concat(*parts).alias("text"))
    first = line(unit, F.lit("主査"), F.when(f == 0, "（企画課長）").otherwise(" "), F.lit("甲野 一郎様"))
    more = F.when(f == 0, F.array(first, line(F.lit("同技師 乙野 花"), F.lit("")))).otherwise(F.array(first, line(F.lit("no row"), F.lit(""))))
    rows = t.part.select("p_partkey", F.when(f == 3, "退職者一覧").otherwise("異動").alias("title"), more.alias("lines"))
    return extraction.article_rows(rows, "p_partkey", "title", "lines").select("p_partkey", "position", "name", "to_unit", "to_title", "from_unit", "from_title")


@query(sql("records", "mentions", "mention_links", "units", "parties", body="""
    , k AS (SELECT unit_id, count(DISTINCT record_id) AS records FROM mentions WHERE unit_id IS NOT NULL GROUP BY unit_id),
    w AS (SELECT unit_id, token, sum(n) AS n FROM (SELECT unit_id, unnest(list_distinct(regexp_extract_all(lower(name), '([a-z]{4,})', 1))) AS token, 2 AS n FROM units UNION ALL SELECT m.unit_id, unnest(list_distinct(regexp_extract_all(lower(title), '([a-z]{4,})', 1))), 1 FROM (SELECT DISTINCT unit_id, record_id FROM mentions WHERE unit_id IS NOT NULL) m JOIN live USING (record_id)) GROUP BY ALL),
    t AS (SELECT unit_id, array_to_string(list(token ORDER BY n DESC, length(token) DESC, token DESC)[1:6], '|') AS keywords FROM w GROUP BY unit_id),
    s AS (SELECT unit_id, array_to_string(list(display_name ORDER BY display_name)[1:3], '|') AS people FROM (SELECT DISTINCT unit_id, display_name FROM linked JOIN parties USING (party_id) WHERE unit_id IS NOT NULL) GROUP BY unit_id)
    SELECT u.unit_id, name, records, keywords, coalesce(people, '') AS people FROM units u JOIN k ON u.unit_id = k.unit_id JOIN t ON u.unit_id = t.unit_id LEFT JOIN s ON u.unit_id = s.unit_id
"""))  # fmt: skip
def unit_profiles(t: Tables) -> DataFrame:
    """Units with records: keywords of their names and titles, and the first people."""
    return views.unit_profiles(archive(t)).select("unit_id", "name", "records", F.array_join("keywords", "|").alias("keywords"), F.coalesce(F.array_join("people", "|"), F.lit("")).alias("people"))


@query("""
    WITH r AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), s AS (SELECT user_id, event_type AS unit, ts::DATE AS f FROM r WHERE b IS NULL OR b <> event_type)
    SELECT unit, count(*) AS stays, count(DISTINCT user_id) AS users FROM s WHERE f >= DATE '2024-01-10' GROUP BY unit
""")  # fmt: skip
def stays_by_unit(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("event_type").alias("unit"), "ts", "event_id")
    runs = slots.slots_by_lead(e, "user_id", "unit", "ts", "event_id").where(F.to_date("active_from") >= D.parse_iso(F.lit("2024-01-10")))
    return runs.groupBy("unit").agg(F.count("*").alias("stays"), F.count_distinct("user_id").alias("users"))
