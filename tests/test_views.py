"""Views over a small invented archive."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plinth.operators import views as V


@pytest.fixture(scope="module")
def archive(spark):
    f = spark.createDataFrame
    return V.Archive(
        records=f([(1, "u1", "One", "proposal", "S1", "2024-01-02", "2024-01-05", "t", "approved"), (2, "u2", "Two", "press", "S2", "", "2024-03-01 10:00", "t", "pending"), (3, "u3", "Three", "press", "", "2024-05-01", "", "t", "rejected"), (4, "u4", "Four", "press", "S4", "2024-02-01", "", "t", "pending")], "record_id int, url string, title string, source_type string, source_unit string, published_at string, fetched_at string, raw_text string, review_status string"),
        mentions=f([(10, 1, 100, "A課", "甲野 一郎", "full_name", 0.9, "", ""), (11, 2, 100, "A課", "乙野", "surname_only", 0.7, "", ""), (12, 2, 101, "B課", "", "unknown", 0.5, "", ""), (13, 3, 101, "B課", "丙野", "surname_only", 0.5, "", "")], "mention_id int, record_id int, unit_id int, unit_raw string, party_raw string, quality string, confidence double, email string, phone string"),
        mention_links=f([(10, 1000, "auto_matched", 0.95), (11, 1001, "review_pending", 0.6)], "mention_id int, party_id int, link_status string, confidence double"),
        parties=f([(1000, "k0", "甲野 一郎", 0, ""), (1001, "k1", "乙野", 0, ""), (1002, "k2", "丁野", 0, ""), (1003, "k3", "戊野", 0, "note")], "party_id int, party_key string, display_name string, is_verified int, note string"),
        units=f([(100, "A課", "T1"), (101, "B課", "T1"), (102, "C課", "T2"), (103, "D課", "T2")], "unit_id int, name string, top_unit string"),
        slots=f([(1, 1000, "甲野一郎", 100, "", "2024-01-01", "", 0.8), (2, 1000, "甲野一郎", 101, "", "2020-01-01", "2023-12-31", 0.8)], "slot_id int, party_id int, name_norm string, unit_id int, title string, active_from string, active_to string, confidence double"),
        transfers=f([(7, "2024-04-01", "甲野一郎", 100, 102, ""), (8, "2024-04-01", "己野", 101, 100, "")], "event_id int, effective string, name_norm string, from_unit_id int, to_unit_id int, title string"),
        transfer_links=f([(7, 1000, "auto_matched", 0.9)], "event_id int, party_id int, link_status string, confidence double"),
        record_topics=f([(1, "港", 1, 0.9), (2, "港", 0, 0.5)], "record_id int, topic string, is_priority int, confidence double"),
        rollups=f([(1000, "港", 3.0)], "party_id int, topic string, spotlight double"),
        notes=f([(1, 1000, 1, "n", "c", "2024-01-01")], "note_id int, party_id int, record_id int, title string, content string, created_at string"),
    )


def ids(df, c):
    return [r[c] for r in df.collect()]


def test_lists(archive):
    got = {r.record_id: (r.unit, r.unit_source, r.party) for r in V.record_list(archive).collect()}
    assert got == {1: ("A課", "observed", "甲野 一郎"), 2: ("A課", "observed", "乙野"), 4: ("S4", "source_list", None)}
    assert ids(V.record_list(archive, 1), "record_id") == [2]
    assert [(r.party_id, r.records, r.units) for r in V.party_list(archive).collect()] == [(1000, 1, "A課")]
    assert sorted(ids(V.unit_list(archive), "unit_id")) == [100, 101]
    assert ids(V.note_list(archive), "note_id") == [1]


def test_queues(archive):
    assert ids(V.pending_reviews(archive), "record_id") == [2, 4]
    assert ids(V.pending_links(archive), "mention_id") == [11]
    assert ids(V.records_without_party(archive), "record_id") == [4]
    assert ids(V.orphan_parties(archive), "party_id") == [1002]
    assert ids(V.orphan_units(archive), "unit_id") == [103]


def test_roster(archive):
    rows = V.roster(archive, "2024-06-01")
    got = {(r.kind, r.name, r.unit_id, r.top_unit) for r in rows.collect()}
    assert ("confirmed", "甲野 一郎", 102, "T2") in got and ("weak", "丁野", None, "unknown") in got
    assert ("slot", "甲野一郎", 100, "T1") in got and ("transfer", "己野", 100, "T1") in got and ("mention", "丙野", 101, "T1") in got
    groups = {r.top_unit: r for r in V.roster_groups(rows).collect()}
    assert groups["T2"].confirmed == 1 and groups["T2"].names == ["甲野 一郎"]


def test_details_and_merges(archive):
    p = V.party_detail(archive, "k0")
    assert ids(p["records"], "record_id") == [1] and ids(p["transfers"], "event_id") == [7] and ids(p["notes"], "note_id") == [1]
    assert ids(V.record_detail(archive, 1)["parties"], "party_id") == [1000]
    assert ids(V.unit_detail(archive, 100)["topics"], "topic") == ["港"]
    aliases = archive.parties.where("party_id = 1001").select(F.col("party_id").alias("old"), F.lit(1000).alias("new"))
    merged = V.merge_parties(archive, aliases)
    assert 1001 not in ids(merged.parties, "party_id") and set(ids(merged.mention_links, "party_id")) == {1000}
    u = archive.units.where("unit_id = 102").select(F.col("unit_id").alias("old"), F.lit(100).alias("new"))
    assert set(ids(V.merge_units(archive, u).transfers, "to_unit_id")) == {100}


def test_transfer_candidates(spark, archive):
    rows = spark.createDataFrame([(4, 100, dt.date(2024, 5, 1))], "record_id int, unit_id int, observed date")
    got = [(r.name_norm, r.score, r.days) for r in V.transfer_candidates(archive, rows).orderBy("rank").collect()]
    assert got == [("甲野一郎", 0.915, 30), ("己野", 0.75, 30)]
