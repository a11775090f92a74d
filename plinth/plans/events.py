"""Transfers and slots: events of users are moves between units, a slot is a stay in one unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.operators import graph, keyed, links, slots
from plinth.plans.registry import Tables, query

_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_RUNS = """
    WITH r AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
    s AS (SELECT user_id, event_type AS unit, ts AS active_from, event_id, b AS previous_unit FROM r WHERE b IS NULL OR b <> event_type),
    slots AS (SELECT user_id, unit, active_from, lead(active_from) OVER w AS active_to, previous_unit, lead(unit) OVER w AS next_unit FROM s WINDOW w AS (PARTITION BY user_id ORDER BY active_from, event_id))
"""


def runs(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("event_type").alias("unit"), "ts", "event_id")
    return slots.slots_by_lead(e, "user_id", "unit", "ts", "event_id")


def _stamp(c: str) -> F.Column:
    return F.date_format(c, _TEXT).alias(c)


@query(_RUNS + "SELECT user_id, unit, strftime(active_from, '%Y-%m-%d %H:%M:%S.%f') AS active_from, strftime(active_to, '%Y-%m-%d %H:%M:%S.%f') AS active_to FROM slots")
def slots_from_events(t: Tables) -> DataFrame:
    return runs(t).select("user_id", "unit", _stamp("active_from"), _stamp("active_to"))


@query(_RUNS + "SELECT user_id, unit, previous_unit, next_unit, strftime(active_from, '%Y-%m-%d %H:%M:%S.%f') AS active_from FROM slots WHERE previous_unit IS NOT NULL AND next_unit IS NOT NULL")
def slot_prev_next(t: Tables) -> DataFrame:
    return runs(t).where("previous_unit is not null and next_unit is not null").select("user_id", "unit", "previous_unit", "next_unit", _stamp("active_from"))


@query(_RUNS + "SELECT user_id, unit FROM slots WHERE active_from <= TIMESTAMP '2024-01-15' AND (active_to IS NULL OR active_to > TIMESTAMP '2024-01-15')")
def active_slots_asof(t: Tables) -> DataFrame:
    day = F.lit("2024-01-15").cast("timestamp")
    return runs(t).where((F.col("active_from") <= day) & (F.col("active_to").isNull() | (F.col("active_to") > day))).select("user_id", "unit")


@query(
    """
    SELECT s.event_id AS purchase, e.event_id AS error, date_diff('day', s.ts::DATE, e.ts::DATE) AS gap_days FROM events s JOIN events e
    ON s.user_id = e.user_id AND s.event_type = 'purchase' AND e.event_type = 'error' AND abs(date_diff('day', s.ts::DATE, e.ts::DATE)) <= 2
    """
)
def near_window_transfers(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.to_date("ts").alias("day"), "event_type")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("day").alias("a"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), F.col("day").alias("b"))
    return links.near_days(a, b, ["user_id"], "a", "b", 2).select("purchase", "error", F.col("gap_days").cast("long").alias("gap_days"))


@query(
    """
    SELECT user_id, list(event_type ORDER BY first) AS chain, CAST(count(*) AS BIGINT) AS units FROM (
      SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id
    """
)
def movement_chain(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(keyed.collect_sorted(F.col("event_type"), F.col("first")).alias("chain"), F.count("*").alias("units"))


@query(_RUNS + "SELECT unit AS from_unit, next_unit AS to_unit, count(*) AS moves, count(DISTINCT user_id) AS parties FROM slots WHERE next_unit IS NOT NULL GROUP BY ALL")
def transfer_flows(t: Tables) -> DataFrame:
    moves = runs(t).where("next_unit is not null").select(F.col("unit").alias("from_unit"), F.col("next_unit").alias("to_unit"), "user_id")
    return graph.flows(moves, "from_unit", "to_unit", "user_id")


@query(
    """
    WITH d AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT a.event_type AS left_value, b.event_type AS right_value, count(*) AS shared FROM d a JOIN d b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL
    """
)
def continuity_pairs(t: Tables) -> DataFrame:
    return graph.co_pairs(t.events, "user_id", "event_type")


@query(
    """
    SELECT user_id, event_id, event_type, total FROM (
      SELECT user_id, event_id, event_type, ts, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
    """
)
def latest_with_total(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("b"), F.count("*").alias("total"))
    return g.select("user_id", "b.event_id", "b.event_type", "total")


@query(
    """
    SELECT user_id, event_id, CAST(round(epoch(ts - lag(ts) OVER w) / 3600) AS BIGINT) AS gap_hours FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    QUALIFY lag(ts) OVER w IS NOT NULL
    """
)
def previous_event_gap(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 3.6e9
    return t.events.withColumn("gap_hours", F.round(gap).cast("long")).where("gap_hours is not null").select("user_id", "event_id", "gap_hours")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(t: Tables) -> DataFrame:
    """The batch form of the streaming windowed counts."""
    from plinth.streaming.jobs import windowed_counts as job

    return job(t.events, "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def slot_events(t: Tables) -> DataFrame:
    """Each user's events as transfers from the unit before."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(
        F.col("user_id").cast("string").alias("party"), F.date_format("ts", "yyyy-MM-dd").alias("effective"), "event_id", F.coalesce(F.lag("event_type").over(w), F.lit("")).alias("from_unit"), F.col("event_type").alias("to_unit"), F.lit("").alias("title"), F.lit(True).alias("full_name"), F.lit(None).cast("double").alias("confidence")
    )


@query(
    """
    WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), event_id) AS b FROM events),
    s AS (SELECT user_id, event_type, ts, event_id, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), event_id) AS g FROM e),
    r AS (SELECT user_id, g, any_value(event_type) AS unit, min(strftime(ts, '%Y-%m-%d')) AS f, count(*) AS events FROM s GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS party, CAST(g - 1 AS INTEGER) AS slot, unit, f AS active_from,
           coalesce(strftime(lead(f) OVER w::DATE - 1, '%Y-%m-%d'), '') AS active_to, CASE WHEN g > 1 THEN CAST(g - 2 AS INTEGER) END AS previous_slot,
           CASE WHEN lead(f) OVER w IS NOT NULL THEN CAST(g AS INTEGER) END AS next_slot, CAST(events AS INTEGER) AS events
    FROM r WINDOW w AS (PARTITION BY user_id ORDER BY g)
    """.replace("lead(f) OVER w::DATE - 1", "(lead(f) OVER w)::DATE - 1")
)
def slots_fold(t: Tables) -> DataFrame:
    """The full state machine; on this table each event ends the stay before, so SQL can say the same."""
    return slots.build_slots(slot_events(t)).select("party", "slot", "unit", "active_from", "active_to", "previous_slot", "next_slot", "events")


@query()
def timeline_recommendation(t: Tables) -> DataFrame:
    """Viterbi assignment: mentions are error events of a user, candidates that user's stays around the day."""
    stays = slots.build_slots(slot_events(t)).where("unit <> 'error'").select(
        F.col("party").alias("name"), F.col("slot").cast("long").alias("slot_id"), F.col("unit").alias("slot_unit"), "active_from", F.to_date("active_from").alias("day"), F.col("party").cast("long").alias("party_id")
    )
    mention = t.events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("mention_id"), F.to_date("ts").alias("observed"), F.lit("error").alias("unit"), (F.col("value") > 20).alias("surname_only"))
    near = links.near_days(mention, stays, ["name"], "observed", "day", 1).withColumn("score", F.when(F.col("gap_days") == 0, 0.74).otherwise(0.60))
    return slots.recommend_timeline(near)


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, list_sort(list_distinct([event_type, lower(event_type), 'k']))::VARCHAR[] AS tags FROM events")
def json_keywords(t: Tables) -> DataFrame:
    """Values of packed JSON, and keywords that survive a round trip through a JSON list."""
    from plinth.functions import text as T

    packed = T.keywords_to_json(F.array("event_type", F.lower("event_type"), F.lit("k")))
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sort_array(T.keywords_from_json(packed)).alias("tags"))


@query(
    """
    WITH d AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS published, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fetched FROM events),
    o AS (SELECT *, CASE WHEN published <> '' THEN published ELSE substr(fetched, 1, 10) END AS seen FROM d)
    SELECT event_id, seen, strftime(seen::DATE - 1, '%Y-%m-%d') AS before, CAST(year(seen::DATE) AS INTEGER) AS year, CAST(abs(date_diff('day', seen::DATE, DATE '2024-01-15')) AS BIGINT) AS away FROM o
    """
)
def observed_dates(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("published"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("fetched"))
    seen = D.observed_at(F.col("published"), F.col("fetched"))
    return e.withColumn("seen", seen).select("event_id", "seen", D.day_before(F.col("seen")).alias("before"), D.year_of(F.col("seen")).cast("int").alias("year"), D.days_between(D.parse_iso(F.col("seen")), F.lit("2024-01-15").cast("date")).cast("long").alias("away"))
