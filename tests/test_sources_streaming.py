"""Files and streams."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plinth.sources import files
from plinth.streaming import jobs


def test_csv_dimension(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("﻿url,department_name,source_type\nu1,General,proposal\nu1,Other,proposal\nu2,総務課,press_release\n", encoding="utf-8")
    got = files.list_sources(spark, str(p), ["proposal", "press_release"], ["General"]).orderBy("url").collect()
    assert [(r.url, r.department_name, r.link_match_mode) for r in got] == [("u1", "General", "strict"), ("u2", "総務課", "broad")]
    with pytest.raises(ValueError, match="missing columns: nope"):
        files.read_csv(spark, str(p), ["nope"])
    with pytest.raises(PySparkException):
        files.list_sources(spark, str(p), ["proposal"], []).collect()


def test_transfer_folder_and_export(spark, tmp_path):
    head = ",".join(files.TRANSFER_COLUMNS[:11])
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(head + "\npress,t,,2024-01-01,,甲野 一郎,A課,B課,,,\n")
    (folder / "transfer_template.csv").write_text(head + "\n")
    df = files.transfer_files(spark, str(folder))
    assert df.select(files.source_key("source_type", "title", "url", "published_at", "effective_date")).first()[0] == "press:t:2024-01-01"
    out = tmp_path / "out"
    files.export_by(df, ["to_department"], str(out))
    assert [x.name for x in out.iterdir() if x.is_dir()] == ["by_to_department=B課"]
    files.write_report(df, str(tmp_path / "r"), 1)
    files.append_log(df.withColumn("url", F.lit("u")), str(tmp_path / "log"))
    links = spark.createDataFrame([("u",), ("v",)], "url string")
    assert [r.url for r in files.unseen(links, spark.read.parquet(str(tmp_path / "log"))).collect()] == ["v"]


def run(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    e = spark.sql("SELECT * FROM VALUES (1L, 'a', TIMESTAMP'2024-01-01 00:01:00', 1.0D), (1L, 'b', TIMESTAMP'2024-01-01 00:02:00', 2.0D), (1L, 'b', TIMESTAMP'2024-01-01 00:03:00', 3.0D), (2L, 'a', TIMESTAMP'2024-01-01 05:00:00', 4.0D), (1L, 'c', TIMESTAMP'2024-01-01 06:00:00', 4.0D) AS t(user_id, event_type, ts, value)")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    run(jobs.stream_slots(s), "slots")
    assert sorted((r.party, r.number, r.unit) for r in spark.table("slots").collect()) == [(1, 0, "a"), (1, 1, "b")]
    run(jobs.windowed_counts(s, "ts", "event_type", "value"), "counts")
    assert ("b", 2) in {(r.event_type, r.n) for r in spark.table("counts").collect()}
    run(jobs.first_seen(s.select("event_type", "ts"), "ts", "event_type"), "firsts")
    assert sorted(r.event_type for r in spark.table("firsts").collect()) == ["a", "b", "c"]
    sink = jobs.upsert_sink(str(tmp_path / "t"), ["id"], ["status"])
    sink(spark.createDataFrame([(1, "approved")], "id int, status string"), 0)
    sink(spark.createDataFrame([(1, "pending"), (2, "pending")], "id int, status string"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [(1, "approved"), (2, "pending")]


def test_upserts_after_a_gap(spark, tmp_path):
    """Batch numbers may be skipped, a batch may be replayed, and of two rows of one key one counts."""
    sink = jobs.upsert_sink(str(tmp_path / "t"), ["id"])
    one = lambda *rows: spark.createDataFrame(list(rows), "id int, n int")
    sink(one((1, 1), (1, 2)), 0)
    sink(one((2, 5)), 3)
    sink(one((2, 6)), 3)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / "v3")).collect())) == [(1, 2), (2, 6)]
