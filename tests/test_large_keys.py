"""Keys that very many rows share: results against brute force, and plans that make no pairs of such rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from plinth.operators import keyed, links, resolution
from plinth.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_within_intervals(spark):
    r = random.Random(3)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [(i, r.randrange(3), day(r.randrange(40)) if i else None) for i in range(120)]
    stays = [(i, r.randrange(3), day(r.randrange(-9, 45)) if i % 7 else None, day(r.randrange(-9, 60)) if i % 5 else None) for i in range(150)]
    a, b = spark.createDataFrame(rows, "i int, k int, d date"), spark.createDataFrame(stays, "n int, k int, s date, e date")
    got = links.active_summary(a, b, ["k"], "d", "s", "e", {"n": F.count("*"), "low": F.min("n")}, {"n": F.sum("n"), "low": F.min("low")})
    want = []
    for i, k, d in rows:
        hit = [n for n, q, s, e in stays if d and k == q and (s is None or s <= d) and (e is None or e >= d)]
        want += [(i, len(hit), min(hit))] if hit else []
    assert sorted(tuple(x) for x in got.select("i", "n", "low").collect()) == want


def test_candidates_once_for_a_name(spark):
    m = spark.createDataFrame([(i, "Fam", i % 3) for i in range(40)] + [(3, "Famous", 1)], "mention_id int, name_norm string, unit_id int")
    ps = [(i, "Fam" if i % 2 else "Famo", i % 3, i % 7) for i in range(60)]
    got = resolution.identity_candidates(m, spark.createDataFrame(ps, "party_id int, name_norm string, unit_id int, record_count int"), 2)
    for unit in range(3):
        nine = sorted(ps, key=lambda p: (p[1] != "Fam", -p[3], p[0]))[:6]
        best = [p[0] for p in sorted(nine, key=lambda p: (p[1] != "Fam", p[2] != unit, -p[3], p[0]))[:2]]
        assert [r.party_id for r in got.where(f"mention_id = {6 + unit}").orderBy("rank").collect()] == best
    assert "WindowGroupLimit [name_norm" in plan(got)


def test_uses_count_once(spark):
    out = keyed.without_any(spark.range(30).toDF("u"), [(spark.range(5000).select((F.col("id") % 20).alias("x")), "x", "u")])
    assert sorted(r.u for r in out.collect()) == list(range(20, 30))
    assert "HashAggregate(keys=[u" in plan(out)


def test_summary_of_empty_texts(spark, tmp_path):
    rows = [(1, ""), (2, " \n\t\n"), (3, "Title\n\nA line that tells something"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["summary_line"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, ""), (2, ""), (3, "A line that tells something"), (4, "")]
