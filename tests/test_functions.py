"""Column and text functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import scores
from plinth.functions import text as T
from plinth.functions import units as U


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, value", [("二十三", 23), ("百", 100), ("千二百", 1200), ("三万", 30000), ("万", 10000), ("一億二千万", 120_000_000), ("12", 12), ("3十", 30), ("", None), ("東", None)])
def test_numerals(text, value):
    assert T.numeral_value(text) == value


def test_numerals_only_before_counters():
    assert T.normalize("令和八年三月二十七日") == "令和8年3月27日"
    assert T.normalize("一ノ瀬 一") == "一ノ瀬 一"
    assert T.normalize("ＡＢＣ　１２  x\n\n\ny ") == "ABC 12 x\ny"
    assert T.normalize("令和元年") == "令和1年"
    assert T.normalize(None) is None


def test_normalize_column(spark):
    rows = spark.createDataFrame([("〆切 三日",), (None,), ("",)], "t string")
    assert [r.x for r in rows.select(T.normalize_text("t").alias("x")).collect()] == ["締切 3日", None, ""]


def test_dates(spark):
    df = spark.createDataFrame([("令和8年3月27日",), ("平成30年1月2日",), ("2026年4月1日",), ("2026/31/10",), ("3月2日",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(D.iso_text(D.parse_text_date(F.col("t"), 2026)).alias("x")).collect()]
    assert got == ["2026-03-27", "2018-01-02", "2026-04-01", "", "2026-03-02", "", ""]
    assert str(one(spark, D.parse_iso(F.col("a")), a="2024-03-05T01:02:03")) == "2024-03-05"
    assert str(one(spark, D.parse_iso(F.col("a")), a="on 2024/3/5.")) == "2024-03-05"
    assert one(spark, D.parse_iso(F.col("a")), a="2024-02-30") is None
    assert one(spark, D.day_before(F.col("a")), a="2026-04-01") == "2026-03-31"
    assert one(spark, D.day_before(F.col("a")), a="soon") == "soon"
    assert one(spark, D.year_of(F.col("a")), a="in 2031 or so") == 2031
    assert one(spark, D.strict_or_blank(F.col("a")), a="2024-02-30") is False
    assert one(spark, D.active_on(F.lit("2024-05-01"), F.col("a"), F.col("b")), a="", b="2024-05-01") is True


def test_names_and_contacts(spark):
    assert one(spark, T.name_quality(F.col("a")), a="山田 花子") == "full_name"
    assert one(spark, T.name_quality(F.col("a")), a="山田") == "surname_only"
    assert one(spark, T.name_quality(F.col("a")), a="") == "unknown"
    assert one(spark, T.party_key(F.col("a")), a="山田 花子様") == one(spark, T.party_key(F.col("a")), a="山田花子")
    assert one(spark, T.party_key(F.col("a")), a="") == ""
    assert one(spark, T.phone_key(F.col("a")), a="95-212-3456") == "0952123456"
    assert one(spark, T.email_key(F.col("a")), a=" A@B.jp ") == "a@b.jp"
    assert one(spark, T.split_names(F.col("a")), a="甲、乙, 甲／丙") == ["甲", "乙", "丙"]
    assert one(spark, T.partial_name_match(F.col("a"), F.col("b")), a="山田", b="山田花") is True
    assert one(spark, T.partial_name_match(F.col("a"), F.col("b")), a="山", b="山田") is False
    assert one(spark, T.strip_wrapping_brackets(F.col("a")), a="((内))") == "内"
    assert one(spark, T.strip_wrapping_brackets(F.col("a")), a="(1) x)") == "(1) x)"
    assert one(spark, T.keywords_from_json(F.col("a")), a="no list") == []
    assert one(spark, T.valid_topic(F.col("a"), ["結果"]), a="観光結果") is False


def test_fields(spark):
    text = "目的\n町を元気にする\n人を呼ぶ\n2 日程\n提出締切\nなし\n令和8年3月27日 17時"
    assert one(spark, T.deadline(F.col("a"), ["締切"], r"令和\d+年\d+月\d+日"), a=text) == "令和8年3月27日"
    assert one(spark, T.deadline(F.col("a"), ["none"], r"\d+"), a=text) == ""
    assert one(spark, T.section_after(F.col("a"), "^目的$", r"^[2-9]\s"), a=text) == "町を元気にする 人を呼ぶ"
    assert one(spark, T.budget_amount(F.col("a"), "上限額|予定価格"), a="上限額は 1,200 万円") == "1200万円"
    assert one(spark, T.budget_amount(F.col("a"), "上限額"), a="金 500円也") == "500円"
    assert one(spark, T.budget_amount(F.col("a"), "上限額"), a="x") == ""
    assert one(spark, T.summary_line(F.col("a"), F.lit("Title here long")), a="Title here long\nshort\nA line that tells something") == "A line that tells something"
    assert one(spark, T.related_titles(F.col("a"), F.col("b")), a="abcdefghij", b="xabcdefghijk") is True
    assert one(spark, T.related_titles(F.col("a"), F.col("b")), a="", b="") is False


def test_units(spark):
    assert one(spark, U.unit_parts(F.col("a")), a="総務部 広報課企画係") == ["総務部", "広報課", "企画係"]
    assert one(spark, U.match_key(F.col("a")), a="総務部　広報課") == "総務部広報課"
    assert one(spark, U.display_name(F.col("a")), a="総務部広報課企画係") == "広報課 企画係"
    assert one(spark, U.specificity_rank(F.col("a")), a="広報課企画係") == 6
    assert one(spark, U.overlap(F.col("a"), F.col("b")), a="広報課", b="総務部広報課") is True
    assert one(spark, U.overlap(F.col("a"), F.col("b")), a="", b="総務部") is False
    assert one(spark, U.preserve_specific(F.col("a"), F.col("b")), a="総務部広報課", b="総務部") is True
    assert one(spark, U.reference_score(F.col("a"), F.col("b")), a="総務部広報課", b="総務部").kind == 2
    assert one(spark, U.theme_overlap(F.array(F.lit("観光")), F.array(F.lit("観光"), F.lit("道路")))) is True


def test_score_terms_and_rounding(spark):
    flags = {n: F.lit(n in ("name", "contact", "unit_exact")) for n in "name display contact unit_exact unit_overlap top_unit unit_theme unit_theme_conflict record_theme record_theme_conflict topic topic_conflict recent_topic priority_topic transfer_to transfer_from recent_transfer activity surname_only".split()}
    assert one(spark, scores.identity_score(flags, F.lit(1))) == 0.95
    assert one(spark, scores.identity_score(flags, F.lit(9))) == 0.98
    assert one(spark, scores.reasons(scores.identity_terms(flags))) == ["same_name", "contact", "unit_exact"]
    assert one(spark, scores.total([scores.Term("a", 0.125, F.lit(True))], 0.0)) == 0.12
    names = "name_exact name_prefix unit_exact unit_overlap unit_theme record_theme topic recent_topic priority_topic active soon just_ended linked surname_only bridge topic_conflict root_conflict".split()
    none = {n: F.lit(n == "unit_exact") for n in names}
    assert one(spark, scores.slot_score(none, F.lit(1.0))) == 0.0
