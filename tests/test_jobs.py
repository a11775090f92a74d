"""Jobs end to end on invented pages and files."""

import datetime as dt

from pyspark.sql import functions as F

from plinth.operators import jobs

RECORDS = "url string, title string, summary string, budget string, deadline string, review_status string"


def test_ingest(spark):
    page = lambda body: f"<article><h1>港の公募</h1><p>{body}</p></article>"
    pages = spark.createDataFrame(
        [("u1", "総務", 1, "総務課", "proposal", page("この公募は港を元気にするための企画を求めます<br>予定価格 1,200万円<br>提出期限 令和8年3月27日"), "2026-01-01"), ("u1", "総務部財政課", 2, "財政課", "proposal", page("この公募は港を元気にするための企画を求めます<br>予定価格 1,200万円<br>提出期限 令和8年3月27日"), "2026-01-01"), ("u2", "x", 3, "", "proposal", page("提出締切 令和2年1月1日"), "2026-01-01"), ("u3", "x", 4, "", "press", page("済"), "2026-01-01")],
        "url string, label string, ordinal int, source_unit string, source_type string, html string, fetched_at string",
    )
    old = spark.createDataFrame([("u1", "old", "", "", "", "approved"), ("u9", "nine", "", "", "", "pending")], RECORDS)
    log = spark.createDataFrame([("u3",)], "url string")
    records, seen = jobs.ingest(pages, old, log, F.lit(dt.date(2026, 1, 1)), ["締切"], r"令和\d+年\d+月\d+日", "予定価格")
    got = {r.url: r for r in records.collect()}
    assert set(got) == {"u1", "u9"} and sorted(r.url for r in seen.collect()) == ["u1", "u2"]
    assert (got["u1"].title, got["u1"].budget, got["u1"].deadline, got["u1"].review_status) == ("港の公募", "12000000円", "2026-03-27", "approved")
    assert got["u1"].summary == "この公募は港を元気にするための企画を求めます"


def test_mentions_windows(spark):
    rec = spark.createDataFrame([(1, "観光課 担当: 甲野、乙野"), (2, "以上"), (3, "財政課 担当: 丙野")], "id int, text string")
    new = jobs.mentions_of(rec, "id", "text", F.lit(1), F.lit(2))
    assert sorted((r.id, r.mention_index, r.party) for r in new.collect()) == [(1, 0, "甲野"), (1, 1, "乙野")]
    old = jobs.mentions_of(rec, "id", "text").withColumn("party", F.lit("old"))
    assert sorted((r.id, r.party) for r in jobs.replace_mentions(old, new, "id").collect()) == [(1, "乙野"), (1, "甲野"), (3, "old")]


def test_transfers_and_topics(spark):
    cols = "source_type string, title string, url string, published_at string, effective_date string, person_name string, from_department string, to_department string, to_title string, position int"
    rows = spark.createDataFrame([("press", "t", "", "2025-03-01", "2025-04-01", "甲野 一郎", "A課", "B課", "", 1), ("press", "t", "", "2025-03-01", "2025-04-01", "", "A課", "B課", "", 2), ("press", "t", "", "2026-03-01", "2026-04-01", "甲野 一郎", "B課", "C課", "", 3)], cols)
    events, made = jobs.transfers_to_slots(rows)
    assert sorted(r.event_id for r in events.collect()) == [1, 3]
    assert sorted((r.unit, r.active_to) for r in made.collect()) == [("B課", "2026-03-31"), ("C課", "")]
    src = spark.createDataFrame([("official", "t", "", "2025-02-01", "港 づくり|道|港づくり")], "source_type string, title string, url string, published_at string, topic_names string")
    got = [(r.topic, r.year, round(r.weight, 2), round(r.confidence, 2)) for r in jobs.declared_topics(src).collect()]
    assert got == [("港づくり", 2025, 0.92, 0.95), ("道", 2025, 0.84, 0.9), ("港づくり", 2025, 0.76, 0.85)]
