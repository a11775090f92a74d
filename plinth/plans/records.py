"""Records (orders), units (nations in regions) and topics (brands): rollups, latest and top rows, anti joins, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import graph, keyed, quality, topics
from plinth.plans.registry import Tables, query

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def topic_links(t: Tables) -> DataFrame:
    """Party x topic x record rows: the customer of an order and the brands in it."""
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    orders = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("topic_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(t.part.select("p_partkey", F.col("p_brand").alias("topic")), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("party"), "topic", "topic_year", F.col("o_orderkey").alias("record"), F.col("l_suppkey").cast("string").alias("unit"), (F.col("l_returnflag") == "R").cast("int").alias("is_priority"), F.col("l_discount").alias("confidence"), "day")
    )


@query(
    """
    WITH g AS (
      SELECT o_custkey AS party, p_brand AS topic, year(o_orderdate) AS topic_year, count(DISTINCT o_orderkey) AS record_count,
             count(DISTINCT l_suppkey) AS unit_count, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS priority_count,
             avg(l_discount) AS a, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_seen, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_seen
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
    ), s AS (
      SELECT *, record_count + 0.45::DOUBLE * unit_count + 0.8::DOUBLE * a + 0.75::DOUBLE * priority_count AS i,
             least(4.0::DOUBLE, 1.4::DOUBLE * date_diff('day', first_seen::DATE, last_seen::DATE) / 365.0::DOUBLE + CASE WHEN record_count >= 2 THEN 1.0 ELSE 0.0 END) AS c,
             least(4.5::DOUBLE, 1.8::DOUBLE * a + 0.8::DOUBLE * priority_count + 0.25::DOUBLE * record_count) AS v FROM g
    )
    SELECT party, topic, topic_year, record_count, unit_count, priority_count, round(a, 6) AS avg_confidence, first_seen, last_seen,
           round(i, 6) AS involvement_score, round(c, 6) AS continuity_score, round(v, 6) AS visibility_score, round(i + c + v, 6) AS spotlight_score FROM s
    """
)
def party_topic_rollup(t: Tables) -> DataFrame:
    out = topics.party_topic_rollup(topic_links(t), "party", "topic", "topic_year", "record", "unit", "is_priority", "confidence", "day")
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    """
    SELECT o_custkey AS party, o_orderkey AS record FROM orders WHERE o_orderstatus = 'F'
    UNION SELECT o_custkey, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
    """
)
def linked_records_union(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_custkey").alias("party"), F.col("o_orderkey").alias("record"), "o_orderstatus")
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("record"))
    return keyed.linked_pairs([own.where("o_orderstatus = 'F'").select("party", "record"), own.join(returned, "record").select("party", "record")])


@query(
    """
    SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """
)
def latest_record_per_party(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    out = keyed.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")


@query(
    """
    SELECT p_brand AS topic, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY p_brand ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
    FROM lineitem JOIN part ON l_partkey = p_partkey QUALIFY rank <= 3
    """
)
def topk_records_per_topic(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select("p_partkey", F.col("p_brand").alias("topic")), F.col("l_partkey") == F.col("p_partkey")).select("topic", "l_orderkey", "l_linenumber", "l_extendedprice")
    return keyed.top_k(rows, ["topic"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)


@query(
    """
    SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS records, count(DISTINCT o_orderstatus) AS states,
           count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_seen
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= 3
    """
)
def party_record_counts(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(
        F.count_distinct("o_orderkey").alias("records"), F.count_distinct("o_orderstatus").alias("states"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_seen")
    )
    g = g.where("records >= 3")
    return t.customer.select("c_custkey", "c_name").join(g, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "records", "states", "urgent", "last_seen")


@query(
    """
    SELECT n_name AS unit, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey
    GROUP BY n_name HAVING count(DISTINCT s_suppkey) > 0 OR count(DISTINCT c_custkey) > 0
    """
)
def unit_counts_having(t: Tables) -> DataFrame:
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count_distinct("c_custkey").alias("customers"))
    n = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("unit"))
    out = n.join(s, "k", "left").join(c, "k", "left").na.fill(0, ["suppliers", "customers"])
    return out.where("suppliers > 0 or customers > 0").groupBy("unit").agg(F.sum("suppliers").alias("suppliers"), F.sum("customers").alias("customers"))


@query("SELECT r_name AS top_unit, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS units FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def listagg_units(t: Tables) -> DataFrame:
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy(F.col("r_name").alias("top_unit")).agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("units"))


@query(
    """
    SELECT l_orderkey AS record, bool_or(l_returnflag = 'R') AS has_return, bool_and(l_linestatus = 'F') AS all_final, count(*) FILTER (l_discount > 0.05) AS discounted,
           max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS has_large FROM lineitem GROUP BY l_orderkey
    """
)
def conditional_flags(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("record")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("has_return"), F.bool_and(F.col("l_linestatus") == "F").alias("all_final"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.max(F.when(F.col("l_quantity") >= 45, 1).otherwise(0)).alias("has_large")
    )


@query(
    """
    SELECT source, rows, long_texts, labelled, CASE WHEN rows > 0 THEN printf('%.1f%%', 100.0 * long_texts / rows) ELSE '' END AS long_texts_rate,
           CASE WHEN rows > 0 THEN printf('%.1f%%', 100.0 * labelled / rows) ELSE '' END AS labelled_rate, samples FROM (
      SELECT d.source, count(*) AS rows, count(*) FILTER (d.n_chars >= 2000) AS long_texts, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled,
             list_sort(list_distinct(list(d.doc_id)))[1:3] AS samples
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)
    """
)
def funnel_report(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    ranked = keyed.top_k(rows.select("source", "doc_id").distinct(), ["source"], [F.asc("doc_id")], 3)
    samples = ranked.groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("samples"))
    return quality.funnel(rows, "source", {"long_texts": F.col("n_chars") >= 2000, "labelled": F.col("known").isNotNull()}).join(samples, "source")


@query(
    """
    SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderpriority = '4-NOT SPECIFIED' DESC, o_orderdate, o_orderkey) AS place FROM orders
    WHERE o_orderstatus = 'P' QUALIFY place <= 100
    """
)
def pending_queue_order(t: Tables) -> DataFrame:
    """The first 100 of the review queue: a top-k report, so Spark keeps 100 rows per task."""
    order = [F.desc(F.col("o_orderpriority") == "4-NOT SPECIFIED"), F.asc_nulls_first("o_orderdate"), F.asc("o_orderkey")]
    first = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").orderBy(*order).limit(100)
    return first.withColumn("place", F.row_number().over(W.orderBy(*order))).select("o_orderkey", "o_custkey", "place")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unlinked_anti(t: Tables) -> DataFrame:
    return keyed.without_any(t.orders.select("o_orderkey", "o_custkey"), [(t.lineitem, "l_orderkey", "o_orderkey")])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def seen_semi(t: Tables) -> DataFrame:
    seen = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_orderstatus").join(seen, "o_orderkey", "left_semi")


@query(
    """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
    """
)
def orphan_parties(t: Tables) -> DataFrame:
    uses = [(t.orders.where("o_orderstatus = 'P'"), "o_custkey", "c_custkey"), (t.events.where("event_type = 'purchase'"), "user_id", "c_custkey")]
    return keyed.without_any(t.customer.select("c_custkey", "c_name"), uses)


@query(
    """
    SELECT p_partkey, p_type FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)
    """
)
def orphan_topics(t: Tables) -> DataFrame:
    uses = [(t.lineitem.where("l_returnflag = 'R' and l_quantity > 40"), "l_partkey", "p_partkey"), (t.lineitem.where("l_quantity > 49"), "l_partkey", "p_partkey")]
    return keyed.without_any(t.part.select("p_partkey", "p_type"), uses)


@query(
    """
    WITH s AS (SELECT n_name AS unit, s_suppkey AS party, sum(CAST(l_quantity AS BIGINT)) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS gap FROM s WINDOW w AS (PARTITION BY unit ORDER BY score DESC, party))
    SELECT unit, party, CAST(score AS BIGINT) AS score, CAST(gap AS BIGINT) AS gap FROM r WHERE rank = 1
    """
)
def score_gap(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.round("l_quantity").cast("long")).alias("score"))
    rows = by.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("unit"), F.col("s_suppkey").alias("party"), "score")
    return keyed.with_gap(rows, ["unit"], "score", [F.desc("score"), F.asc("party")]).where("rank = 1").select("unit", "party", "score", "gap")


@query(
    """
    SELECT kind, node, weight, CASE kind WHEN 'unit' THEN 16 + least(2.0 * weight, 16) WHEN 'party' THEN 18 + least(2.5 * weight, 20) ELSE 22 + least(3.0 * weight, 24) END::DOUBLE AS size FROM (
      SELECT kind, node, count(*) AS weight FROM (
        SELECT 'unit' AS kind, n_name AS node FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'party', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT 'topic', p_brand FROM part) GROUP BY ALL)
    """
)
def graph_nodes(t: Tables) -> DataFrame:
    units = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("unit").alias("kind"), F.col("n_name").alias("node"))
    parties = t.orders.where("o_orderstatus = 'P'").select(F.lit("party").alias("kind"), F.col("o_custkey").cast("string").alias("node"))
    return graph.nodes([units, parties, t.part.select(F.lit("topic").alias("kind"), F.col("p_brand").alias("node"))])


@query(
    """
    SELECT kind, least(a, b) AS source, greatest(a, b) AS target, count(*) AS weight FROM (
      SELECT 'trade' AS kind, cn.n_name AS a, sn.n_name AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
      UNION ALL SELECT 'member', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL
    """
)
def graph_edges(t: Tables) -> DataFrame:
    name = t.nation.select("n_nationkey", "n_name")
    buyer = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("bn"))
    line = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pair = line.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).select("bn", "s_nationkey")
    b, s = name.withColumnsRenamed({"n_nationkey": "bn", "n_name": "source"}), name.withColumnsRenamed({"n_nationkey": "s_nationkey", "n_name": "target"})
    trade = pair.join(b, "bn").join(s, "s_nationkey").select(F.lit("trade").alias("kind"), "source", "target")
    member = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("member").alias("kind"), F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    return graph.edges([trade, member])


@query(
    """
    SELECT r_name AS cluster, count(DISTINCT n_name) AS units, count(DISTINCT c_custkey) AS parties, count(DISTINCT o_orderkey) AS records
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name
    """
)
def cluster_sizes(t: Tables) -> DataFrame:
    per_party = t.orders.groupBy("o_custkey").agg(F.count("*").alias("records"))
    per_unit = t.customer.select("c_custkey", "c_nationkey").join(per_party, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("parties"), F.sum("records").alias("records"))
    units = t.nation.join(per_unit, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    by = units.groupBy("n_regionkey").agg(F.count("*").alias("units"), F.sum("parties").alias("parties"), F.sum("records").alias("records"))
    return t.region.join(by, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("cluster"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("units", "parties", "records")])


@query(
    """
    WITH l AS (SELECT DISTINCT o_custkey AS party, o_orderkey AS record, l_suppkey AS unit FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    r AS (SELECT x.party, y.party AS other, count(*) AS n FROM (SELECT DISTINCT party, record FROM l) x JOIN (SELECT DISTINCT party, record FROM l) y ON x.record = y.record AND x.party <> y.party GROUP BY ALL),
    u AS (SELECT x.party, y.party AS other, count(*) AS n FROM (SELECT DISTINCT party, unit FROM l) x JOIN (SELECT DISTINCT party, unit FROM l) y ON x.unit = y.unit AND x.party <> y.party GROUP BY ALL),
    b AS (SELECT coalesce(r.party, u.party) AS party, coalesce(r.other, u.other) AS other, coalesce(r.n, 0) AS shared_records, coalesce(u.n, 0) AS shared_units FROM r FULL JOIN u ON r.party = u.party AND r.other = u.other)
    SELECT *, 3 * shared_records + shared_units AS score, row_number() OVER (PARTITION BY party ORDER BY 3 * shared_records + shared_units DESC, shared_records DESC, shared_units DESC, other) AS rank FROM b QUALIFY rank <= 8
    """
)
def related_parties(t: Tables) -> DataFrame:
    """Customers that share orders or suppliers, over every line."""
    links = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.related_parties(links.select(F.col("o_custkey").alias("party"), F.col("o_orderkey").alias("record"), F.col("l_suppkey").alias("unit")), "party", "record", "unit")


@query(
    """
    WITH p AS (SELECT o_custkey AS party, p_brand AS topic, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    r AS (SELECT topic, party, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, party) AS k FROM p),
    a AS (SELECT p_brand AS topic, count(DISTINCT l_orderkey) AS records, count(DISTINCT o_custkey) AS parties FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT a.topic, records, parties, list(party ORDER BY k) AS leaders FROM a JOIN r ON a.topic = r.topic AND k <= 4 GROUP BY ALL
    """
)
def topic_index(t: Tables) -> DataFrame:
    links = topic_links(t)
    each = links.groupBy("topic", "party").agg(F.count("*").alias("n"))
    top = keyed.top_k(each, ["topic"], [F.desc("n"), F.asc("party")], 4).groupBy("topic").agg(keyed.collect_sorted(F.col("party"), F.col("rank")).alias("leaders"))
    return links.groupBy("topic").agg(F.count_distinct("record").alias("records"), F.count_distinct("party").alias("parties")).join(top, "topic")


@query(
    """
    WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS row, CASE WHEN doc_id % 50 = 0 THEN '' ELSE source END AS source_type, CASE WHEN n_chars < 200 THEN '' ELSE lang END AS title,
      CASE WHEN doc_id % 7 = 0 THEN '2024-02-30' WHEN doc_id % 11 = 0 THEN '' ELSE '2024-02-28' END AS day, doc_id % 40 AS k FROM documents)
    SELECT row, 'error' AS level, 'source_type is empty' AS message FROM x WHERE source_type = ''
    UNION ALL SELECT row, 'error', 'title is empty' FROM x WHERE title = ''
    UNION ALL SELECT row, 'error', 'day is not a date' FROM x WHERE day = '2024-02-30'
    UNION ALL SELECT row, 'warning', 'title is unknown' FROM x WHERE title <> '' AND title NOT IN ('en', 'fr')
    UNION ALL SELECT row, 'warning', 'duplicate row' FROM (SELECT row, row_number() OVER (PARTITION BY source_type, title, day, k ORDER BY row) AS n FROM x WHERE source_type <> '' AND title <> '' AND day <> '') WHERE n > 1
    """
)
def csv_validation(t: Tables) -> DataFrame:
    d = t.documents
    rows = d.select(
        F.col("doc_id").cast("string").alias("row"),
        F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("source")).alias("source_type"),
        F.when(F.col("n_chars") < 200, "").otherwise(F.col("lang")).alias("title"),
        F.when(F.col("doc_id") % 7 == 0, "2024-02-30").when(F.col("doc_id") % 11 == 0, "").otherwise("2024-02-28").alias("day"),
        (F.col("doc_id") % 40).cast("string").alias("k"),
    )
    return quality.validate_rows(rows, "row", ["source_type", "title"], ["day"], {"title": ["en", "fr"]}, ["source_type", "title", "day", "k"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-06-17')")
def expired_filter(t: Tables) -> DataFrame:
    """Open records whose date is before the as-of day are dropped."""
    asof = F.lit("1995-06-17").cast("date")
    return t.orders.where(~((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < asof))).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    """
    WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders), n AS (SELECT o_orderkey AS id, 'new' AS status FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 100 = 0)
    SELECT n.id, coalesce(o.status, n.status) AS status FROM n LEFT JOIN o ON n.id = o.id UNION ALL SELECT id, status FROM o WHERE id NOT IN (SELECT id FROM n)
    """
)
def record_upsert(t: Tables) -> DataFrame:
    """Upsert by key that keeps the review status of known records."""
    old = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    ids = old.select("id")
    new = ids.where("id % 3 = 0").unionAll(ids.where("id % 100 = 0").select((-F.col("id")).alias("id"))).withColumn("status", F.lit("new"))
    return keyed.merge(old, new, ["id"], ["status"])


@query("SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 0 ELSE CAST(regexp_replace(CAST(c_custkey AS VARCHAR), '0+$', '') AS BIGINT) END AS party FROM customer")
def merged_parties(t: Tables) -> DataFrame:
    """Parties after a merge of every tenth into another: an alias map whose chains (100 to 10 to 1) are followed to their end."""
    c = t.customer.select("c_custkey", F.col("c_custkey").alias("party"))
    aliases = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old"), F.expr("c_custkey div 10").alias("new"))
    return keyed.apply_alias(c, aliases, "party")


@query(
    """
    SELECT n_name AS unit, list(token ORDER BY weight DESC, length(token) DESC, token DESC)[1:6] AS keywords FROM (
      SELECT n_name, token, sum(w) AS weight FROM (
        SELECT n_name, lower(r_name) AS token, 2 AS w FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_name, lower(c_mktsegment), 1 FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY ALL) GROUP BY n_name
    """
)
def profile_keywords(t: Tables) -> DataFrame:
    root = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("unit"), F.lower("r_name").alias("token"), F.lit(2).alias("w"))
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("unit"), F.lower("c_mktsegment").alias("token")).agg(F.count("*").alias("w"))
    sums = root.unionByName(own).groupBy("unit", "token").agg(F.sum("w").alias("weight"))
    top = keyed.top_k(sums, ["unit"], [F.desc("weight"), F.desc(F.length("token")), F.desc("token")], 6)
    return top.groupBy("unit").agg(keyed.collect_sorted(F.col("token"), F.col("rank")).alias("keywords"))


@query(
    """
    WITH s AS (SELECT c_nationkey, c_mktsegment AS theme, count(*) AS n FROM customer GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, theme) - 1 AS i FROM s),
    c AS (SELECT c_nationkey, count(*) AS records FROM customer GROUP BY 1)
    SELECT r_name AS top_unit, theme, CAST(sum(greatest(1, 5 - i) + greatest(records, 1)) AS BIGINT) AS weight FROM r JOIN c USING (c_nationkey) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL
    """
)
def rank_weighted_themes(t: Tables) -> DataFrame:
    s = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("theme")).agg(F.count("*").alias("n"))
    w = W.partitionBy("c_nationkey")
    r = s.withColumns({"i": F.row_number().over(w.orderBy(F.desc("n"), "theme")) - 1, "records": F.sum("n").over(w)})
    rows = r.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("top_unit"), "theme").agg(F.sum(F.greatest(F.lit(1), 5 - F.col("i")) + F.greatest("records", F.lit(1))).alias("weight"))


@query("SELECT c_custkey, c_name, substr(sha256(c_name), 1, 12) AS party_key FROM customer")
def party_key_sha(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", T.party_key(F.col("c_name")).alias("party_key"))
