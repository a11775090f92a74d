"""Personnel lines, PDF texts, crawls and registers; all names are invented."""

import zipfile
import zlib
from io import BytesIO

from pyspark.sql import functions as F

from plinth.functions import assignments as A
from plinth.functions.pdf import pdf_text
from plinth.operators import directory, extraction, jobs, quality, resolution, topics
from plinth.sources import files


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def brief(r):
    return (r["to_unit"], r["to_title"], r["from_unit"], r["from_title"], r["name"])


def test_lines_with_ditto_marks():
    lines = [("heading", "部長級"), ("line", "政策部部長（総務副部長）甲野 一郎"), ("line", "同政策統括監（県土整備部長）乙野 二郎"), ("line", "同（港市）丙野 三郎"), ("line", "人事異動 一覧"), ("line", "同さがしものディレクター(政策企画主幹)丁野 花")]
    got = A.parse_article(lines, "異動")
    assert [brief(r) for r in got] == [
        ("政策部", "部長", "総務部", "副部長", "甲野 一郎"),
        ("政策部", "政策統括監", "県土整備部", "部長", "乙野 二郎"),
        ("政策部", "政策統括監", "港市", "", "丙野 三郎"),
        ("政策部", "さがしものディレクター", "", "政策企画主幹", "丁野 花"),
    ]
    assert {r["section"] for r in got} == {"部長級"}
    assert A.parse_article([("line", "同課 甲野 一郎")], "")[0]["to_unit"] == "課"


def test_schools_retirements_and_parts():
    got = A.parse_article([("line", "松の原学園主任児童支援専門員(こども家庭主任主査)戊野 考"), ("line", "同主査(産技学院技師)己野 人")], "異動")
    assert [brief(r)[:2] for r in got] == [("松の原学園", "主任児童支援専門員"), ("松の原学園", "主査")]
    assert got[0]["from_title"].endswith("主任主査") and brief(got[1])[2:4] == ("産技学院", "技師")
    gone = A.parse_article([("line", "総務部財政課長 甲野 一郎")], "退職者")
    assert brief(gone[0])[:4] == ("", "", "総務部財政課", "課長")
    assert A.assignment_parts("甲課(乙課)") == ("甲課", "乙課") and A.assignment_parts("甲課") == ("甲課", "")
    assert A.implied_unit("副部長") == "部" and A.implied_unit("理事") == "" and A.is_unit_name("甲課") and not A.is_unit_name("甲課長")
    assert A.last_unit_end("甲課乙") == 2 and A.last_unit_end("甲課") == -1 and A.last_unit_end("甲部乙課丙") == 4
    assert A.unit_and_title("") == ("", "") and A.unit_and_title("甲課＝兼務") == ("甲課", "兼務")


def test_article_rows(spark):
    lines = [{"kind": "line", "text": "総務部長(企画課長)甲野 一郎"}, {"kind": "line", "text": "no row"}]
    df = spark.createDataFrame([("f", "u1", "4月1日付異動", "2025-03-20", "", lines), ("f", "u2", "異動", "2025-03-21", "発令 令和7年4月2日", None)], "feature string, article_url string, title string, published_at string, body string, lines array<struct<kind:string,text:string>>")
    got = extraction.rows_of_year(df.select("feature", "article_url"), df.drop("feature"))
    assert rows(got, "article_url", "effective_date", "name", "to_unit", "from_unit") == [("u1", "2025-04-01", "甲野 一郎", "総務部", "企画課")]
    dates = df.select(extraction.effective_date(F.col("title"), F.col("body"), F.col("published_at")).alias("d"))
    assert rows(dates) == [("2025-04-01",), ("2025-04-02",)]


def pdf(*lines, flate=True):
    body = "BT /F1 12 Tf " + " T* ".join(f"({x}) Tj" for x in lines) + " ET"
    raw = zlib.compress(body.encode("latin-1")) if flate else body.encode("latin-1")
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(raw)).encode() + (b" /Filter /FlateDecode" if flate else b"") + b" >>\nstream\n" + raw + b"\nendstream\nendobj\n%%EOF"


def test_pdf_texts(spark):
    assert pdf_text(pdf("One \\(1\\)", "Two")) == "One (1)\nTwo" == pdf_text(pdf("One \\(1\\)", "Two", flate=False))
    mapped = b"%PDF-1.4\n<< >>\nstream\nbegincmap 1 beginbfchar <0001> <6E2F> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange\nendstream\n<< >>\nstream\nBT [<0001> -20 <00020003>] TJ ET\nendstream"
    assert pdf_text(mapped) == "\u6e2fAB"
    assert pdf_text(None) == pdf_text(b"") == pdf_text(b"no pdf") == pdf_text(b"%PDF-1.4 /Encrypt") == ""
    box = BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("b.pdf", pdf("second"))
        z.writestr("a.PDF", pdf("first"))
        z.writestr("c.txt", "no")
    files_ = spark.createDataFrame([("x.zip", box.getvalue()), ("bad.zip", b"broken")], "path string, content binary")
    assert rows(extraction.zip_texts(files_)) == [("x.zip", "first\n---\nsecond")]
    records = spark.createDataFrame([(1, "body"), (2, "other")], "record_id int, raw_text string")
    links = spark.createDataFrame([(1, 0, "b.pdf"), (1, 1, "x.zip"), (1, 2, "b.pdf"), (1, 3, "page")], "record_id int, position int, href string")
    texts = extraction.zip_texts(files_).toDF("url", "text").unionByName(spark.createDataFrame([("b.pdf", "notice")], "url string, text string"))
    got = {r.record_id: (r.pdf_urls, r.zip_urls, r.raw_text) for r in extraction.with_attachments(records, links, texts, "record_id").collect()}
    assert got == {1: (["b.pdf"], ["x.zip"], "body\nnotice\nfirst\n---\nsecond"), 2: ([], [], "other")}


def test_crawl():
    pages = {
        "http://h/list": '<a href="/kiji1">Call one</a><a href="x/kiji2">Call two</a><a href="/kiji3"></a><a href="/other">Call</a><a rel="next" href="/list?pg=2">next</a>',
        "http://h/list?pg=2": '<a href="/kiji1">again</a><a href="/kiji4">Call four</a><a rel="next" href="/list?pg=3">n</a>',
        "http://h/list?pg=3": '<a href="/kiji4">Call four</a>',
    }
    asked = []
    got = extraction.crawl_links(lambda u: asked.append(u) or pages[u], "http://h/list", ["Call"], most=9)
    assert [x["url"] for x in got] == ["http://h/kiji1", "http://h/x/kiji2", "http://h/kiji4"] and got[0]["label"] == "Call one"
    assert len(asked) == 3 and len(extraction.crawl_links(pages.__getitem__, "http://h/list", [], most=1)) == 2


def test_units_register(spark):
    names = spark.createDataFrame([(1, "総務部"), (2, "総務 部"), (3, "財政課"), (4, " ")], "n int, name string")
    none = spark.createDataFrame([], "unit_id long, name string, name_key string")
    units, aliases = directory.seed_reference(none, names, "name", "n")
    assert rows(units, "unit_id", "name") == [(1, "総務部"), (2, "財政課")]
    seen = spark.createDataFrame([(1, "財政課"), (2, "財政課企画係"), (3, "新設室"), (4, None), (5, "財政課企画係")], "i int, unit string")
    after, known, placed = directory.get_or_create_units(units, aliases, seen, "unit")
    ids = {r.name: r.unit_id for r in after.collect()}
    assert set(ids) == {"総務部", "財政課", "新設室", "財政課企画係"} and len(set(ids.values())) == 4
    assert rows(placed, "i", "unit_id") == [(1, ids["財政課"]), (2, ids["財政課企画係"]), (3, ids["新設室"]), (4, None), (5, ids["財政課企画係"])]
    moved = directory.upsert_aliases(known, spark.createDataFrame([("財政課", 9, "manual", 1)], "alias string, unit_id long, kind string, o int"), "o")
    assert {r.alias: r.unit_id for r in moved.collect()}["財政課"] == 9
    old = placed.withColumn("unit_id", F.lit(1).cast("long"))
    new, counts = directory.refresh_references(old, "unit", "unit_id", known)
    assert tuple(counts.first()) == (5, 4) and new.count() == 5
    tree = spark.createDataFrame([(0, "総務部", "財政課", "11", "12"), (1, "総務部", "", "1", "2")], "ordinal int, top_unit string, child_name string, tel string, fax string")
    got = directory.unit_contacts(spark.createDataFrame([("財政課企画係",), ("総務部長室",), ("none",)], "name string"), "name", tree)
    assert rows(got) == [("none", "", "", "", ""), ("総務部長室", "総務部", "", "", ""), ("財政課企画係", "総務部", "財政課", "11", "12")]


def test_parties_register(spark):
    old = spark.createDataFrame([(4, "k", "Old"), (7, "k-2", "Other")], "party_id long, party_key string, display_name string")
    new = spark.createDataFrame([("k", "New"), ("a", "A"), ("", "none")], "party_key string, display_name string")
    assert rows(directory.upsert_parties(old, new)) == [(4, "k", "New"), (7, "k-2", "Other"), (8, "a", "A")]
    again = directory.add_distinct_parties(old, spark.createDataFrame([("k", "x"), ("k", "y"), ("z", "z")], "party_key string, display_name string"), ["display_name"])
    assert [r.party_key for r in again.orderBy("party_id").collect()] == ["k", "k-2", "k-3", "k-4", "z"]
    m = spark.createDataFrame([(1, "甲野 一郎", "full_name", "", "", 0.1), (2, "乙野", "surname_only", "a@b.jp", "", 0.9), (3, "丙野花", "unknown", "", "1", 0.1), (4, "", "unknown", "", "", 1.0)], "mention_id int, party_raw string, quality string, email string, phone string, confidence double")
    none = old.limit(0)
    parties, linked = directory.parties_for_mentions(none, m)
    assert [r.mention_id for r in linked.orderBy("mention_id").collect()] == [1, 3] and parties.count() == 2
    slots = spark.createDataFrame([(1, 5, "x"), (2, None, "甲野 一郎"), (3, None, "新野")], "slot_id int, party_id long, name_norm string")
    more, placed = directory.parties_for_slots(parties, slots)
    assert more.count() == 3 and placed.where("party_id is null").count() == 0 and {r.slot_id: r.party_id for r in placed.collect()}[1] == 5


def test_inference(spark):
    known = spark.createDataFrame([(1, 10, "a@b", ""), (2, 11, "", "99"), (3, 12, "", "99"), (4, 13, "c@d", "")], "record_id int, party_id int, email string, phone string")
    asked = spark.createDataFrame([(7, "a@b", ""), (8, "", "99"), (9, "a@b", "99"), (4, "c@d", ""), (6, None, None)], "record_id int, email string, phone string")
    assert rows(resolution.party_by_contact(asked, known)) == [(7, 10)]
    slots = spark.createDataFrame([("u", "甲 一", None, None), ("u", "乙", None, None), ("v", "丙 三", "2020-01-01", "2020-12-31"), ("v", "丁 四", "2020-06-01", None)], "unit string, name string, start string, end string").withColumns({c: F.to_date(c) for c in ("start", "end")})
    r = spark.createDataFrame([(1, "u", "2024-01-01"), (2, "v", "2020-02-01"), (3, "v", "2020-07-01"), (4, "v", "2021-01-01")], "record_id int, unit string, day string").withColumn("day", F.to_date("day"))
    assert rows(resolution.party_by_slot(r, slots)) == [(1, "甲 一"), (2, "丙 三"), (4, "丁 四")]
    c = resolution.identity_candidates(spark.createDataFrame([(1, "甲野", 5)], "mention_id int, name_norm string, unit_id int"), spark.createDataFrame([(1, "甲野", 6, 1), (2, "甲野花", 5, 9), (3, "甲野", 5, 1), (4, "乙野", 5, 1)], "party_id int, name_norm string, unit_id int, record_count int"))
    assert [(r.party_id, r["rank"]) for r in c.orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3)]


def test_relink_only_the_affected(spark):
    links = spark.createDataFrame([(1, 5, "auto_matched", 0.9), (2, 6, "reviewed_match", 1.0), (3, 7, "auto_matched", 0.9)], "event_id int, party_id int, link_status string, confidence double")
    flags = {c: False for c in ("name_prefix", "to_exact", "to_overlap", "from_exact", "from_overlap", "broad", "activity")}
    scored = spark.createDataFrame([(1, 8, 0.95, "a"), (2, 8, 0.95, "a"), (3, 8, 0.95, "b"), (4, 8, 0.95, "a")], "event_id int, party_id int, score double, name string").withColumns({k: F.lit(v) for k, v in flags.items()} | {"name_exact": F.lit(True), "display_name": F.col("name")})
    got = resolution.relink(links, scored, spark.createDataFrame([("a",)], "name string"), resolution.decide_transfers, "event_id")
    assert rows(got, "event_id", "party_id", "link_status") == [(1, 8, "auto_matched"), (2, 6, "reviewed_match"), (3, 7, "auto_matched"), (4, 8, "auto_matched")]


def test_jobs(spark):
    sources = spark.createDataFrame([], "source_key string, source_type string, title string, url string, published_at string, effective_date string")
    events = spark.createDataFrame([], "source_key string, event_index int, name string, from_department string, to_department string, to_title string, effective string")
    file = spark.createDataFrame([("t", "T", "", "2025-01-01", "", 0, "甲野 一郎", "a", "b", ""), ("t", "T", "", "2025-01-01", "", 1, "", "a", "b", ""), ("t", "T", "", "2025-01-01", "", 2, "乙野", "a", "b", "")], "source_type string, title string, url string, published_at string, effective_date string, position int, person_name string, from_department string, to_department string, to_title string")
    s, e = jobs.replace_events(sources, events, file)
    assert s.count() == 1 and rows(e, "event_index", "name") == [(0, "甲野一郎"), (2, "乙野")]
    s, e = jobs.replace_events(s, e, file.where("position = 2"))
    assert s.count() == 1 and rows(e, "event_index", "name") == [(2, "乙野")]
    records = spark.createDataFrame([(1, "a", "pending"), (2, "b", "pending")], "record_id int, title string, review_status string")
    edits = spark.createDataFrame([(1, "x", "pending", 1), (1, None, "approved", 2)], "record_id int, title string, review_status string, decided_at int")
    assert rows(jobs.edit_records(records, edits)) == [(1, "a", "approved"), (2, "b", "pending")]
    notes = spark.createDataFrame([(3, 1, 1, "t", "c", "2024")], "note_id long, party_id int, record_id int, title string, content string, created_at string")
    more = spark.createDataFrame([(2, None, "u", "d", "2025"), (2, None, "u", " ", "2025")], "party_id int, record_id int, title string, content string, created_at string")
    assert rows(jobs.add_notes(notes, more), "note_id", "title") == [(3, "t"), (4, "u")]
    one = spark.createDataFrame([("", "u", None, "", "http://r")], "a string, b string, c string, d string, e string").select(jobs.notification(*[F.col(c) for c in "abcde"]).alias("m"))
    assert one.first().m == "(no title)\nunit: u\nparty: not stated\ndeadline: none\nhttp://r"
    assert jobs.notify(one, "m", lambda text: None) == 1


def test_topic_registers(spark):
    old = spark.createDataFrame([("k", "n", 2024, "declared", "kept", 0.5)], "topic_key string, name string, year int, origin string, description string, weight double")
    new = spark.createDataFrame([("k", "n", 2024, "declared", "new", 0.9), ("z", "z", 0, "declared", "d", 0.1)], old.schema)
    assert rows(topics.upsert_topics(old, new), "topic_key", "description", "weight") == [("k", "kept", 0.9), ("z", "d", 0.1)]
    src = spark.createDataFrame([("s", "t", "old")], "source_key string, title string, summary string")
    assert rows(topics.upsert_sources(src, spark.createDataFrame([("s", "u", ""), ("r", "v", "w")], src.schema), "title")) == [("r", "v", "w"), ("s", "u", "old")]
    ev = spark.createDataFrame([("s", "a", 1.0), ("r", "b", 1.0)], "source_key string, topic_key string, confidence double")
    assert rows(topics.replace_source_topics(ev, spark.createDataFrame([("s", "c", 0.5)], ev.schema))) == [("r", "b", 1.0), ("s", "c", 0.5)]
    d, i = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "source_key string, position int, topic string"), spark.createDataFrame([("s", "x", 5), ("r", "y", 5), ("r", "zz", 5)], "source_key string, topic string, score int")
    assert [(r.source_key, r.topic, round(r.weight, 2)) for r in topics.source_candidates(d, i, 1).orderBy("source_key").collect()] == [("r", "zz", 0.4), ("s", "a", 0.92)]
    recs = spark.createDataFrame([(1, "Harbour plan", "the green port grows", 2024), (2, "Other", "nothing here", 2020)], "id int, title string, body string, y int")
    decl = spark.createDataFrame([("green port", 2023, 0.9), ("nothing", 2024, 0.9), ("here", 0, 0.5)], "topic string, topic_year int, weight double")
    got = topics.rebuild(recs, decl, "id", {"title": 5}, "body", "y")
    assert {(r.id, r.topic) for r in got.where("is_priority").collect()} == {(1, "green port"), (2, "here")}


def test_paths_and_reports(spark, tmp_path, monkeypatch):
    seed, run = tmp_path / "seed.csv", tmp_path / "run" / "x.csv"
    seed.write_text("a")
    assert files.runtime_path("PLINTH_X", str(run), str(seed)) == str(run) and run.read_text() == "a"
    monkeypatch.setenv("PLINTH_X", "/elsewhere")
    assert files.runtime_path("PLINTH_X", str(run), str(seed)) == "/elsewhere"
    assert files.bootstrap(str(tmp_path / "run"), {"x.csv": str(seed), "y.csv": str(seed)}) == {"copied": 1, "kept": 1}
    tree = tmp_path / "h.csv"
    tree.write_text("top_unit,top_url,child_name,child_url\n総務 部,/a,財政課,b\n ,x,y,z\n")
    assert [(r.top_key, r.top_url, r.child_url) for r in files.read_hierarchy(spark, str(tree), "http://h/d/").collect()] == [("総務部", "http://h/a", "http://h/d/b")]
    assert {k: d.count() for k, d in files.empty_archive(spark).items()} == dict.fromkeys(files.ARCHIVE_SCHEMAS, 0)
    m = spark.createDataFrame([(1, "u", "p", "full_name", 0.9, "", "")], "record_id int, unit_raw string, party_raw string, quality string, confidence double, email string, phone string")
    a = spark.createDataFrame([(1, "u", "q", "", ""), (2, "u", "", "", "1"), (3, "u", "甲 乙", "", ""), (4, "u", None, None, None), (5, "", "", "", "")], "record_id int, unit_raw string, party_raw string, email string, phone string")
    assert rows(files.backfill(m, a), "record_id", "confidence") == [(1, 0.9), (2, 0.9), (3, 0.7), (4, 0.5), (5, 0.0)]
    got = quality.summary_lines(spark.createDataFrame([("a", 5, 1), ("b", 7, 0), ("c", 1, 1)], "s string, n int, m int"), "s", "n", "m", 2)
    assert [tuple(r) for r in got.collect()] == [("all", 1, "n", 13), ("all", 2, "m", 2), ("most rows", 1, "b", 7), ("most rows", 2, "a", 5), ("most missing", 1, "a", 1), ("most missing", 2, "c", 1)]


def test_numbers_of_many_parts(spark):
    """Ids follow the keys without a gap when Spark merges small parts: each scan must put a row in the same range."""
    many = 20000
    new = spark.range(many, numPartitions=7).select(F.format_string("k%06d", F.col("id") * 7919 % many).alias("party_key"), F.concat(*[F.sha2((F.col("id") * 9 + i).cast("string"), 512) for i in range(4)]).alias("display_name"))
    old = spark.createDataFrame([(5, "a", "A")], "party_id long, party_key string, display_name string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        got = sorted((r.party_id, r.party_key) for r in directory.numbered(new, old, "party_id", ["party_key"]).collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == [(6 + i, f"k{i:06d}") for i in range(many)]
