"""Operators on literal frames: the scenarios of the fixtures catalogue with invented names."""

import datetime as dt
import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import extraction, keyed, links, quality, resolution, slots, topics


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_slot_chain_closes_the_day_before():
    fold = slots.SlotFold()
    fold.step("2025-04-01", "A課", "B課", "", None)
    fold.step("2026-04-01", "B課", "C課", "", None)
    first, second = fold.slots
    assert (first.unit, first.start, first.end, first.next) == ("B課", "2025-04-01", "2026-03-31", 1)
    assert (second.unit, second.end, second.previous, second.confidence) == ("C課", "", 0, 0.82)


def test_slot_fold_edges():
    fold = slots.SlotFold(full_name=False)
    fold.step("", "", "B課", "主任", None)
    fold.step("2025-04-01", "B課", "B課", "", 0.9)
    assert len(fold.slots) == 1 and fold.slots[0].confidence == 0.9 and fold.slots[0].title == "主任"
    fold.step("2026-04-01", "B課", "", "", None)
    assert fold.open == [] and fold.slots[0].end == "2026-03-31"
    fold.step("soon", "", "C課", "", None)
    fold.step("later", "C課", "D課", "", None)
    assert fold.slots[1].end == "later"


def test_build_slots_frame(spark):
    e = spark.createDataFrame([("p", "2025-04-01", 1, "A", "B", "", True, None), ("p", "2026-04-01", 2, "B", "C", "", True, 0.95), ("q", None, 3, "", "X", "", False, None)], "party string, effective string, event_id long, from_unit string, to_unit string, title string, full_name boolean, confidence double")
    got = rows(slots.build_slots(e), "party", "unit", "active_from", "active_to", "confidence")
    assert got == [("p", "B", "2025-04-01", "2026-03-31", 0.82), ("p", "C", "2026-04-01", "", 0.95), ("q", "X", "", "", 0.68)]
    assert slots.build_slots(e.limit(0)).count() == 0


def test_timeline_prefers_continuity():
    day = dt.date(2026, 4, 1)
    state = lambda i, s: {"slot": i, "party": i, "unit": f"u{i}", "score": s}
    steps = [{"date": day + dt.timedelta(days=10 * n), "unit": "", "surname_only": True, "states": [state(1, a), state(2, b)]} for n, (a, b) in enumerate([(0.75, 0.60), (0.70, 0.74)])]
    assert [s["slot"] for s in slots.viterbi(steps)] == [1, 1]
    assert slots.viterbi([]) == []
    assert slots.viterbi([{"date": None, "unit": "", "surname_only": False, "states": []}]) == [None]


def test_decisions(spark):
    schema = "mention_id long, party_id long, score double, contact boolean, record_count int, quality string, source_confidence double"
    data = [(1, 10, 0.92, False, 1, "full_name", 0.5), (2, 10, 0.85, True, 1, "surname_only", 0.5), (3, 10, 0.5, False, 1, "unknown", 0.7), (4, 10, 0.9, True, 1, "full_name", 0.5), (4, 11, 0.7, False, 1, "full_name", 0.5), (5, 10, 0.5, False, 1, "full_name", 0.5), (5, 11, 0.45, False, 1, "full_name", 0.5), (6, None, 0.0, False, 0, "full_name", 0.5), (7, None, 0.0, False, 0, "surname_only", 0.9)]
    got = {r.mention_id: (r.party_id, r.link_status, r.confidence, r.matched_by) for r in resolution.decide_mentions(spark.createDataFrame(data, schema)).collect()}
    assert got[1] == (10, "auto_matched", 0.92, "full_name_exact")
    assert got[2] == (10, "auto_matched", 0.85, "same_name_contact_exact")
    assert got[3] == (10, "review_pending", 0.7, "same_name_only")
    assert got[4] == (10, "review_pending", 0.9, "contact_best_of_same_name")
    assert got[5] == (None, "review_pending", 0.5, "multiple_same_name")
    assert got[6] == (None, "auto_matched", 0.9, "new_full_name")
    assert got[7] == (None, "review_pending", 0.55, "same_name")


def test_reviews_win(spark):
    auto = spark.createDataFrame([(1, "auto_matched", 5), (2, "auto_matched", 6)], "m long, link_status string, party long")
    reviews = spark.createDataFrame([(1, "reviewed_match", 9, 1), (1, "reviewed_distinct", None, 2), (3, "reviewed_match", 7, 1)], "m long, link_status string, party long, decided_at int")
    assert sorted(map(str, rows(resolution.apply_reviews(auto, reviews, "m")))) == sorted(map(str, [(1, "reviewed_distinct", None), (2, "auto_matched", 6), (3, "reviewed_match", 7)]))


def test_merge_and_alias(spark):
    old = spark.createDataFrame([(1, "approved", "a"), (2, "pending", "b")], "id int, status string, title string")
    new = spark.createDataFrame([(1, "pending", "A"), (3, "pending", "C")], "id int, status string, title string")
    assert rows(keyed.merge(old, new, ["id"], ["status"])) == [(1, "approved", "A"), (2, "pending", "b"), (3, "pending", "C")]
    a = spark.createDataFrame([(1, 2), (2, 3)], "old int, new int")
    assert rows(keyed.apply_alias(spark.createDataFrame([(1,), (5,)], "p int"), a, "p")) == [(3,), (5,)]
    assert rows(keyed.distinct_key(spark.createDataFrame([("k", 1), ("k", 2), ("z", 3)], "k string, n int"), "k", ["n"], "key"), "key") == [("k",), ("k-2",), ("z",)]


def test_alias_chains_and_cycles(spark):
    """A chain of any length ends at its last value, a cycle and what leads to it at the cycle's least value."""
    chain = [(i, i + 1) for i in range(1, 41)]
    a = spark.createDataFrame([*chain, (60, 62), (62, 61), (61, 60), (59, 62), (70, 70)], "old int, new int")
    got = dict(rows(keyed.alias_roots(a)))
    assert got == {i: 41 for i in range(1, 41)} | {62: 60, 61: 60, 59: 60}
    assert rows(keyed.apply_alias(spark.createDataFrame([(3,), (70,), (None,)], "p int").na.drop(), a, "p")) == [(41,), (70,)]
    assert keyed.alias_roots(a.limit(0)).count() == 0


def test_merge_takes_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, title string, n int")
    new = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (2, "c", 1), (2, "c", 1)], "id int, title string, n int")
    assert rows(keyed.merge(old, new, ["id"], order=["n"])) == [(1, "b", 2), (2, "c", 1)]


def test_contained_phrases(spark):
    texts = spark.createDataFrame([(1, "abc foo bar foobar"), (2, "nothing"), (3, None)], "d int, t string")
    phrases = ["foo", "c foo", "foo b", "bc foo b", "foo bar f", "bar bar", "x", " ", "", None]
    p = spark.createDataFrame(list(enumerate(phrases)), "i int, p string")
    want = [(d, i) for d, t in [(1, "abc foo bar foobar"), (2, "nothing")] for i, x in enumerate(phrases) if x and x in t]
    assert rows(links.contained_phrases(texts, p, "d", "t", "i", "p")) == want
    assert {i for _, i in want} >= {0, 1, 2, 3, 4}


def test_contained_names(spark):
    names = ["総務部財政課", "財政", "課", "ab", "部"]
    aliases = ["財政課", "財", "総務部財政課", "xaby", "z", ""]
    n, a = spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in aliases], "a string")
    assert rows(links.contained_names(n, a, "n", "a")) == sorted((x, y) for x in names for y in aliases if y and (x in y or y in x))


def test_active_at(spark):
    day = lambda y, m, d: dt.date(y, m, d)
    r = spark.createDataFrame([(1, "k", day(2020, 5, 1)), (2, "k", day(2023, 1, 1)), (3, "z", day(2020, 5, 1))], "i int, k string, day date")
    s = spark.createDataFrame([("k", "open", None, None), ("k", "to", None, day(2020, 5, 1)), ("k", "from", day(2020, 5, 2), None), ("k", "in", day(2019, 1, 1), day(2021, 1, 1)), ("y", "other", None, None)], "k string, s string, a date, b date")
    got = rows(links.active_at(r, s, ["k"], "day", "a", "b").select("i", "s"))
    assert got == [(1, "in"), (1, "open"), (1, "to"), (2, "from"), (2, "open")]


def test_slots_without_the_fold(spark):
    """Parties whose events follow each other need no state machine, and both ways give the same."""
    import random

    r, made = random.Random(5), []
    for p in range(60):
        unit = ""
        for e in range(r.randint(1, 7)):
            to = r.choice(["甲課", "乙課", "甲課係", "丙部", ""] if p % 2 else ["甲課", "乙課", "丙部"])
            made.append((f"p{p}", r.choice(["2024-01-%02d" % r.randint(1, 28), "", None]), e, unit if r.random() < 0.9 else r.choice(["丙部", ""]), to, r.choice(["", "t1", None]), p % 3 > 0, r.choice([None, 0.5, 0.9])))
            unit = to
    df = spark.createDataFrame(made, "party string, effective string, event_id int, from_unit string, to_unit string, title string, full_name boolean, confidence double")
    assert rows(slots.build_slots(df).select(*[c.split()[0] for c in slots.SLOT_SCHEMA.split(", ")]), "party", "slot", "unit", "title", "active_from", "active_to", "confidence", "previous_slot", "next_slot", "events") == rows(slots._folded(df), "party", "slot", "unit", "title", "active_from", "active_to", "confidence", "previous_slot", "next_slot", "events")


def test_unique_match_needs_one_target(spark):
    df = spark.createDataFrame([("u", 1), ("u", 1), ("v", 1), ("v", 2), ("w", None)], "k string, t int")
    assert rows(keyed.only_match(df, ["k"], "t")) == [("u", 1)]


def test_latest_and_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert rows(keyed.latest_per_key(df, ["k"], ["n"])) == [("a", 2, "y"), ("b", 1, "z")]
    assert rows(keyed.top_k(df, ["k"], [F.desc("n")], 1), "k", "v") == [("a", "y"), ("b", "z")]
    assert keyed.top_k(df.limit(0), ["k"], [F.desc("n")], 1).count() == 0


def test_links(spark):
    a = spark.createDataFrame([("山田",), ("佐藤花",), ("100%",)], "a string")
    b = spark.createDataFrame([("山田太郎",), ("佐藤",), ("100%x",), ("1000",)], "b string")
    assert rows(links.prefix_pairs(a, b, "a", "b", 2)) == [("100%", "100%x"), ("佐藤花", "佐藤"), ("山田", "山田太郎")]
    l = spark.createDataFrame([("k", dt.date(2024, 1, 1))], "k string, a date")
    r = spark.createDataFrame([("k", dt.date(2024, 1, 31)), ("k", dt.date(2024, 2, 1)), ("k", dt.date(2023, 12, 2))], "k string, b date")
    assert [x.gap_days for x in links.near_days(l, r, ["k"], "a", "b", 30).orderBy("b").collect()] == [-30, 30]
    t = spark.createDataFrame([(1, "abcdefghijkl"), (2, "abcdefghijkl"), (3, "xabcdefghijkl"), (4, "short"), (5, "")], "i int, k string")
    assert rows(links.related_title_pairs(t, "i", "k")) == [(1, 2, "same"), (1, 3, "near")]


def test_topics_skip_contained_tokens(spark):
    df = spark.createDataFrame([(1, "harbour harbourside market", "market lights")], "id int, title string, summary string")
    got = topics.ranked_candidates(topics.weighted_tokens(df, "id", {"title": 5, "summary": 3}), "id").first().candidates
    assert [(c.token, c.score) for c in got] == [("market", 8), ("harbourside", 5), ("lights", 3)]


def test_extraction(spark):
    html = "<html><body><nav>n</nav><article><h1>T <b>x</b></h1><p>one</p><script>no</script><a href='/a.pdf'>PDF &amp; more</a><a href=\"b.html\">B</a></article><time datetime='2024-05-06T01'></body>"
    p = spark.createDataFrame([(1, "http://h.example/d/e.html", html), (2, "http://h.example/", None)], "id int, url string, html string")
    r = extraction.page_records(p, "id", "url", "html").orderBy("id").collect()
    assert (r[0].title, r[0].published_at, r[0].raw_text) == ("T x", "2024-05-06", "T\nx\none\nPDF & more\nB")
    l = extraction.html_links(p, "id", "html")
    assert rows(l, "position", "href", "label") == [(0, "/a.pdf", "PDF &amp; more"), (1, "b.html", "B")]
    assert extraction.attachments(l, "id", ".pdf").first().urls == ["/a.pdf"]
    u = p.limit(1).select(extraction.absolute_url(F.col("url"), F.lit("/x")).alias("a"), extraction.absolute_url(F.col("url"), F.lit("b")).alias("b"), extraction.absolute_url(F.col("url"), F.lit("mailto:q")).alias("c")).first()
    assert tuple(u) == ("http://h.example/x", "http://h.example/d/b", "mailto:q")


def test_zip_entries(spark):
    data = BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.pdf", b"one")
        z.writestr("b.txt", b"two")
    df = spark.createDataFrame([("x.zip", bytearray(data.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    assert [(r.path, r.name, bytes(r.content)) for r in extraction.zip_entries(df).collect()] == [("x.zip", "a.pdf", b"one")]


def test_validation_and_causes(spark):
    df = spark.createDataFrame([("1", "", "2024-02-30"), ("2", "x", ""), ("3", "x", "2024-02-29"), ("4", "x", "2024-02-29")], "row string, name string, day string")
    got = rows(quality.validate_rows(df, "row", ["name"], ["day"], {"name": ["x"]}, ["name", "day"]))
    assert got == [("1", "error", "day is not a date"), ("1", "error", "name is empty"), ("4", "warning", "duplicate row")]
    assert quality.validate_rows(df.limit(0), "row", ["name"], ["day"], {}, ["name"]).count() == 0
    texts = spark.createDataFrame([("t", "担当者: 甲\n電話 1"), ("t", "問合せ先\n総務課"), ("選定結果", ""), ("t", "")], "title string, text string")
    assert [r.x for r in texts.select(quality.missing_party_cause(F.col("title"), F.col("text")).alias("x")).collect()] == ["explicit_label_not_extracted", "source_has_department_only", "result_page", "no_contact_section_detected"]


def test_cascade_and_fallback(spark):
    df = spark.createDataFrame([("", " ", "r")], "a string, b string, c string")
    got = df.select(resolution.cascade((F.col("a"), "observed"), (F.col("b"), "source"), (F.col("c"), "related")).alias("x")).first().x
    assert (got.value, got.source) == ("r", "related")
    assert df.select(T.blank(F.col("b")).alias("x")).first().x is True


def test_transfer_decisions(spark):
    schema = "event_id int, party_id int, score double, name_exact boolean, name_prefix boolean, to_exact boolean, to_overlap boolean, from_exact boolean, from_overlap boolean, broad boolean, activity boolean, display_name string"
    f = (True, False, False, False, False, False, False, False, "n")
    data = [(1, 1, 0.9, *f), (1, 2, 0.5, *f), (2, 1, 0.9, *f), (2, 2, 0.85, *f), (3, 1, 0.5, *f), (4, 1, 0.0, *f)]
    got = {r.event_id: r.link_status for r in resolution.decide_transfers(spark.createDataFrame(data, schema)).collect()}
    assert got == {1: "auto_matched", 2: "review_pending"}


def test_outline_links_and_units():
    html = "<h2>総務部</h2><ul><li><a href='/a'>総務<b>課</b></a></li><li><a href='/b'>財政課</a></li></ul><h2>出納局</h2><h3>x</h3><h2>観光部</h2><a href='/c'>観光課</a>"
    assert [(r["top_unit"], r["child_name"]) for r in extraction.two_level_units(html)] == [("総務部", "総務課"), ("総務部", "財政課"), ("出納局", ""), ("観光部", "観光課")]
    assert extraction.links_under(html, "総務", "観光") == [("/a", "総務課"), ("/b", "財政課")]
    assert extraction.links_under(html, "none", "観光") == [("/c", "観光課")]
    assert extraction.two_level_units("") == []
