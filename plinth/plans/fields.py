"""Scalar functions over the driver tables: dates, units, names and fields of texts that are composed from keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import scores
from plinth.functions import text as T
from plinth.functions import units as U
from plinth.operators import quality, resolution, slots, topics
from plinth.plans.parties import _SLOT_FLAGS, _sql_flags, evidence
from plinth.plans.registry import Tables, query

_YMD = "coalesce(strftime(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', {}, m, d) AS DATE), '%Y-%m-%d'), '')"


@query(f"WITH c AS (SELECT c_custkey, c_custkey % 5 AS f, c_custkey % 6 + 1 AS y, c_custkey % 14 AS m, c_custkey % 33 AS d FROM customer) SELECT c_custkey, {_YMD.format('CASE f WHEN 0 THEN 2018 + y WHEN 1 THEN 2008 + y WHEN 4 THEN 2024 ELSE 2018 + y END')} AS day FROM c")
def text_dates(t: Tables) -> DataFrame:
    """Era, western, slashed and yearless dates, some of days that do not exist."""
    k = F.col("c_custkey")
    y, m, d = k % 6 + 1, (k % 14).cast("string"), (k % 33).cast("string")
    rest = F.concat(F.lit("年"), m, F.lit("月 "), d, F.lit("日付"))
    forms = [F.concat(F.lit("令和"), y.cast("string"), rest), F.concat(F.lit("平成 "), (y + 20).cast("string"), rest), F.concat((2018 + y).cast("string"), rest), F.concat((2018 + y).cast("string"), F.lit("/"), m, F.lit("/"), d), F.concat(m, F.lit("月"), d, F.lit("日"))]
    text = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    return t.customer.select("c_custkey", D.iso_text(D.parse_text_date(text, 2024)).alias("day"))


@query("""
    WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y/%m/%d') ELSE '' END AS p, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, ts FROM events)
    SELECT event_id, strftime(coalesce(try_cast(replace(p, '/', '-') AS DATE), ts::DATE), '%Y-%m-%d') AS day, year(coalesce(try_cast(replace(p, '/', '-') AS DATE), ts::DATE)) = 2024 AS same_year, event_id % 4 IN (1, 3) AS strict FROM e
""")  # fmt: skip
def row_dates(t: Tables) -> DataFrame:
    """The publication date if it is one, else the day of fetching; whether the year is 2024 and the text a strict date or blank."""
    n = F.col("event_id") % 4
    p = F.when(n == 0, "2024-02-30").when(n == 1, F.date_format("ts", "yyyy-MM-dd")).when(n == 2, F.date_format("ts", "yyyy/MM/dd")).otherwise("")
    day = F.coalesce(D.parse_iso(p), D.parse_iso(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return t.events.select("event_id", D.iso_text(day).alias("day"), D.same_year(day, F.lit("2024-07-01").cast("date")).alias("same_year"), D.strict_or_blank(p).alias("strict"))


# unit names

_A, _B, _C = ["総務部", "観光局", ""], ["財政課", "振興室 ", "一般"], ["企画係", "第二班", ""]
_SUFFIX = "(?:" + "|".join(sorted(U.SUFFIXES, key=len, reverse=True)) + ")"


def unit_rows(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.floor(k / by) % 3 + 1).cast("int"))
    return t.part.select("p_partkey", F.concat(pick(_A, 1), pick(_B, 3), pick(_C, 9)).alias("name"))


def _pick(words: list[str], by: int) -> str:
    return f"[{', '.join(repr(w) for w in words)}][(p_partkey // {by}) % 3 + 1]"


_UNITS = f"u AS (SELECT p_partkey, {_pick(_A, 1)} || {_pick(_B, 3)} || {_pick(_C, 9)} AS name FROM part)"


def _sql_parts(c: str) -> str:
    found = rf"regexp_extract_all({c}, '([^\s　]+?{_SUFFIX})', 1)"
    return f"CASE WHEN len({found}) > 0 THEN {found} WHEN trim({c}) = '' THEN []::VARCHAR[] ELSE [trim({c})] END"


def _sql_rank(c: str) -> str:
    ends = " ".join(f"WHEN ends_with({c}, '{s}') THEN {r}" for s, r in sorted(U.RANKS.items(), key=lambda x: -len(x[0])))
    return f"CASE {ends} ELSE greatest(0, {', '.join(f'CASE WHEN contains({c}, {s!r}) THEN {r} ELSE 0 END' for s, r in U.RANKS.items())}) END"


@query(f"""
    WITH {_UNITS}, p AS (SELECT *, {_sql_parts('name')} AS parts, {_sql_rank('name')} AS rank FROM u), s AS (SELECT *, CASE WHEN len(parts) > 2 THEN parts[-2:] ELSE parts END AS semantic FROM p)
    SELECT p_partkey, array_to_string(parts, '|') AS parts, array_to_string(semantic, ' ') AS display, array_to_string(parts, '') AS key, rank,
      len(parts) > 1 OR rank > 2 AS says_more, name <> '' AND (contains(name, '総務部') OR contains('総務部', name)) AS overlaps FROM s
""")  # fmt: skip
def unit_names(t: Tables) -> DataFrame:
    """Segments, display form, matching key and specificity of unit names, and how they stand to one unit."""
    n = F.col("name")
    return unit_rows(t).select("p_partkey", F.array_join(U.unit_parts(n), "|").alias("parts"), U.display_name(n).alias("display"), U.match_key(n).alias("key"), U.specificity_rank(n).alias("rank"), U.preserve_specific(n, F.lit("総務部")).alias("says_more"), U.overlap(n, F.lit("総務部")).alias("overlaps"))


@query(f"""
    WITH {_UNITS}, p AS (SELECT p_partkey, {_sql_parts('name')} AS parts FROM u), l AS (SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat(parts, list_transform(parts, lambda x: regexp_replace(x, '{_SUFFIX}$', ''))), lambda x: length(x) >= 2))) AS tokens FROM p)
    SELECT p_partkey, array_to_string(tokens, '|') AS tokens, len(list_filter(tokens, lambda a: a IN ('財政', '観光局長') OR (length(a) >= 3 AND (contains('財政', a) OR contains('観光局長', a))) OR contains(a, '観光局長'))) > 0 AS related FROM l
""")  # fmt: skip
def unit_themes(t: Tables) -> DataFrame:
    tokens = U.theme_tokens(F.col("name"))
    return unit_rows(t).select("p_partkey", F.array_join(F.sort_array(tokens), "|").alias("tokens"), U.theme_overlap(tokens, F.array(F.lit("財政"), F.lit("観光局長"))).alias("related"))


@query(r"""
    WITH c AS (SELECT c_custkey, ' Fam' || c_custkey % 50 || ' Given' || CASE c_custkey % 3 WHEN 0 THEN ' 様' WHEN 1 THEN '氏' ELSE '' END AS raw, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '0' END || (100000000 + c_custkey * 7919) AS digits FROM customer)
    SELECT c_custkey, 'Fam' || c_custkey % 50 || 'Given' AS name_key, CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END || digits AS phone,
      CASE c_custkey % 2 WHEN 0 THEN '夏祭り' || c_custkey ELSE '夏祭り' END AS title_key, CASE c_custkey % 4 WHEN 0 THEN '港|道路|橋' WHEN 1 THEN '港' WHEN 2 THEN '' ELSE '橋|港 町' END AS topics,
      c_custkey % 3 = 0 AS valid, CASE c_custkey % 3 WHEN 0 THEN '内側' WHEN 1 THEN '(1) 内側)' ELSE '内(側' END AS peeled FROM c
""")  # fmt: skip
def name_fields(t: Tables) -> DataFrame:
    """Keys of names, phones and titles, packed topic names, valid topics, peeled brackets."""
    k = F.col("c_custkey")
    text = lambda *options: F.element_at(F.array(*map(F.lit, options)), (k % len(options) + 1).cast("int"))
    raw = F.concat(F.lit(" Fam"), (k % 50).cast("string"), F.lit(" Given"), text(" 様", "氏", ""))
    phone = F.concat(text("", "0"), F.lit("("), (100000000 + k * 7919).cast("string"), F.lit(") "))
    title = F.concat(F.lit("【案内】夏祭り"), F.when(k % 2 == 0, k.cast("string")).otherwise(""), F.lit(" の募集・(第2回)"))
    valid = T.valid_topic(text("港の計画", "plain ascii", "の計画"), deny_prefixes=["の"])
    return t.customer.select(
        "c_custkey", T.name_key(raw).alias("name_key"), T.phone_key(phone).alias("phone"), T.pairing_key(title, ["の募集"]).alias("title_key"), F.array_join(T.split_topics(text("港、道路/港|橋", "港", " ,| ", "橋／ 港 町,橋")), "|").alias("topics"), valid.alias("valid"), T.strip_wrapping_brackets(text("【((（内側）))】", "(1) 内側)", "[内(側]")).alias("peeled")
    )


@query("""
    WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS f, 1 + p_partkey % 12 AS m, 1 + p_partkey % 28 AS d FROM part)
    SELECT k AS p_partkey, CASE f WHEN 0 THEN (k * 1000) || '円' WHEN 1 THEN k || '万円' WHEN 2 THEN (k + 5) || '円' ELSE '' END AS budget, CASE WHEN f < 3 THEN '2024年' || m || '月' || d || '日' ELSE '' END AS deadline,
      CASE WHEN f <> 1 THEN '地域の振興 ' || k || ' 二行目' ELSE '' END AS purpose, CASE f WHEN 0 THEN '2024-01-09' WHEN 1 THEN format('2024-{:02d}-{:02d}', m, d) WHEN 2 THEN format('2024-{:02d}-{:02d}', m, d) ELSE '' END AS published FROM p
""")  # fmt: skip
def text_fields(t: Tables) -> DataFrame:
    """Budget, deadline, purpose and publication date of composed texts."""
    k = F.col("p_partkey")
    s, f = (lambda c: c.cast("string")), k % 4
    day = F.concat(F.lit("2024年"), s(1 + k % 12), F.lit("月"), s(1 + k % 28), F.lit("日"))
    budget = F.when(f == 0, F.concat(F.lit("予算額 上限 "), s(k * 1000), F.lit(" 円"))).when(f == 1, F.concat(F.lit("金 "), s(k), F.lit("万円"))).when(f == 2, F.concat(s(k + 5), F.lit("円（消費税込み）"))).otherwise("予算は未定")
    purpose = F.concat_ws("\n", F.when(f != 1, "目的").otherwise("趣旨"), F.concat(F.lit("地域の振興 "), s(k)), F.lit("二行目"), F.lit("対象"), F.lit("だれでも"))
    text = F.concat_ws("\n", F.when(f == 1, F.lit("更新日")).otherwise("表題"), F.when(f.isin(1, 2), day).otherwise("本文"), budget, purpose, F.when(f < 3, "提出締切").otherwise("以上"), F.when(f < 3, day))
    pattern = r"\d{4}年\d{1,2}月\d{1,2}日"
    made, text = t.part.select("p_partkey", text.alias("text")), F.col("text")  # composed once, not in each field
    return made.select(
        "p_partkey", T.budget_amount(text, "予算額|上限額").alias("budget"), T.deadline(text, ["提出締切"], pattern).alias("deadline"), T.section_after(text, "^目的$", "^対象$").alias("purpose"),
        D.published_at(text, F.when(f == 0, "2024-01-09").otherwise("")).alias("published"),
    )


@query("""
    WITH e AS (SELECT user_id, event_type AS topic, year(ts + INTERVAL (event_id % 4 * 366) DAY) AS y FROM events), m AS (SELECT user_id, topic, list_sort(list(DISTINCT y)) AS years FROM e GROUP BY ALL)
    SELECT user_id, topic, array_to_string(years, ',') AS years, len(list_filter(years, lambda x: abs(x - 2026) <= 1)) > 0 AS recent FROM m
""")  # fmt: skip
def topic_years(t: Tables) -> DataFrame:
    """In which years a topic occurs with a user, and whether that is within a year of 2026."""
    e = t.events.select("user_id", F.col("event_type").alias("topic"), F.year(F.date_add("ts", (F.col("event_id") % 4 * 366).cast("int"))).alias("y"))
    m = topics.year_map(e, "user_id", "topic", "y")
    near = topics.recent_topic_match(F.array("topic"), F.lit(2026), F.create_map("topic", "years"))
    return m.withColumn("recent", near).withColumn("years", F.array_join("years", ","))


@query("""
    SELECT p_partkey, 'declared:' || 2020 + p_size % 5 || ':' || replace(p_name, ' ', '') AS key, CASE WHEN p_partkey % 2 = 0 THEN 'small|' || p_brand ELSE p_brand END AS shared,
      list_sort(list_distinct(list_filter(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' '), ['extra', lower(p_name)]), lambda x: length(x) >= 4))) AS tokens FROM part
""".replace("'declared:' || 2020 + p_size % 5 || ':'", "'declared:' || (2020 + p_size % 5) || ':'"))  # fmt: skip
def topic_names(t: Tables) -> DataFrame:
    """Keys, shared names and tokens of topics."""
    field = F.concat(F.when(F.col("p_partkey") % 2 == 0, "small|other|").otherwise("other|"), "p_brand")
    tokens = topics.topic_tokens(F.col("p_name"), F.col("p_type"), F.array(F.lit("Extra"), F.lit("no"), "p_name"))
    return t.part.select("p_partkey", topics.topic_key(F.col("p_name"), 2020 + F.col("p_size") % 5, F.lit("declared")).alias("key"), F.array_join(topics.shared_topics(field, F.array(F.lit("small"), "p_brand")), "|").alias("shared"), F.sort_array(tokens).alias("tokens"))


@query("""
    WITH m AS (SELECT l_suppkey, l_returnflag, l_discount, l_orderkey % 2 AS named, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 4 ELSE 2 END AS s FROM lineitem)
    SELECT l_suppkey, max(s) AS status, count(*) FILTER (WHERE l_returnflag = 'A' OR l_discount >= 0.05) AS viable FROM m GROUP BY l_suppkey
""")  # fmt: skip
def link_ranks(t: Tables) -> DataFrame:
    """The best link of each party, and how many of its mentions may stand in a roster."""
    status = F.when(F.col("l_returnflag") == "A", "auto_matched").when(F.col("l_returnflag") == "R", "reviewed_match").otherwise("review_pending")
    rank = resolution.link_rank(status, F.col("l_orderkey") % 2 == 1, F.col("l_discount"))
    good = quality.viable_roster_mention(F.when(F.col("l_returnflag") == "A", "full_name").otherwise("unknown"), F.lit(0.8), F.lit(False), F.when(F.col("l_discount") >= 0.05, "note").otherwise(" "), F.lit(1))
    return t.lineitem.groupBy("l_suppkey").agg(F.max(rank).alias("r"), F.count_if(good).alias("viable")).select("l_suppkey", F.col("r.status").alias("status"), "viable")


@query(f"""
    WITH e AS ({_sql_flags(_SLOT_FLAGS)}), f AS (SELECT unnest([CASE WHEN name_exact THEN 'same_name' WHEN name_prefix THEN 'name_prefix' END, CASE WHEN active THEN 'active' WHEN soon THEN 'soon' WHEN just_ended THEN 'just_ended' END, CASE WHEN surname_only AND NOT (unit_exact OR unit_overlap) THEN 'surname_without_unit' END]) AS label FROM e)
    SELECT label, count(*) AS n FROM f WHERE label IS NOT NULL GROUP BY label
""")  # fmt: skip
def slot_reasons(t: Tables) -> DataFrame:
    """How often each of some reasons for a slot counts."""
    why = scores.reasons(scores.slot_terms({n: F.col(n) for n in _SLOT_FLAGS}))
    some = ("same_name", "name_prefix", "active", "soon", "just_ended", "surname_without_unit")
    return evidence(t, _SLOT_FLAGS).select(F.explode(why).alias("label")).where(F.col("label").isin(*some)).groupBy("label").agg(F.count("*").alias("n"))


@query("""
    WITH r AS (SELECT user_id, event_type, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), c AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM r WHERE b IS NULL OR b <> event_type GROUP BY user_id),
    u AS (SELECT user_id, list_reverse(l) AS back FROM c), d AS (SELECT user_id, list_filter(list_zip(back, range(len(back))), lambda x: list_position(back, x[1]) = x[2] + 1) AS z FROM u)
    SELECT user_id, z[1][1] AS current, array_to_string(list_transform(z[2:4], lambda x: x[1]), ',') AS previous, len(z) AS units FROM d
""")  # fmt: skip
def movement_summaries(t: Tables) -> DataFrame:
    """The current unit, the three before it and how many there were."""
    return slots.movement_summary(t.events, "user_id", "event_type", ["event_id"]).select("user_id", "current", F.array_join("previous", ",").alias("previous"), F.col("units").cast("long").alias("units"))


@query("""
    WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS title, c_mktsegment AS unit, CASE WHEN c_custkey % 3 = 0 THEN 'P' || c_custkey ELSE '' END AS party FROM customer)
    SELECT c_custkey, CASE WHEN title = '' THEN '(no title)' ELSE title END || chr(10) || 'unit: ' || unit || chr(10) || 'party: ' || CASE WHEN party = '' THEN 'not stated' ELSE party END || chr(10) || 'deadline: none' || chr(10) || 'http://r/' || c_custkey AS message FROM c
""")  # fmt: skip
def notification_texts(t: Tables) -> DataFrame:
    from plinth.operators.jobs import notification

    k = F.col("c_custkey")
    message = notification(F.when(k % 5 == 0, "").otherwise(F.col("c_name")), F.col("c_mktsegment"), F.when(k % 3 == 0, F.concat(F.lit("P"), k.cast("string"))).otherwise(""), F.lit(None).cast("string"), F.concat(F.lit("http://r/"), k.cast("string")))
    return t.customer.select("c_custkey", message.alias("message"))


@query("""
    WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS m FROM documents GROUP BY source)
    SELECT 'all' AS part, 1 AS rank, 'n' AS key, sum(n)::BIGINT AS n FROM s UNION ALL SELECT 'all', 2, 'm', sum(m)::BIGINT FROM s
    UNION ALL (SELECT 'most rows', row_number() OVER (ORDER BY n DESC, source) AS r, source, n FROM s QUALIFY r <= 10) UNION ALL (SELECT 'most missing', row_number() OVER (ORDER BY m DESC, source) AS r, source, m FROM s QUALIFY r <= 10)
""")  # fmt: skip
def source_summary(t: Tables) -> DataFrame:
    s = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 3 == 0).alias("m"))
    return quality.summary_lines(s, "source", "n", "m")


@query(f"""
    WITH {_UNITS} SELECT p_partkey, contains(replace(name, ' ', ''), '観光局') OR contains(replace(name, ' ', ''), '企画係') OR contains(replace(name, ' ', ''), '振興室企画') AS known FROM u
""")  # fmt: skip
def known_units(t: Tables) -> DataFrame:
    """Texts that hold a known unit, blanks aside."""
    labels = U.known_labels(["観光局", "企画係", "振興室 企画", " ", "全般"], general=["全般"])
    return unit_rows(t).select("p_partkey", U.contains_known(F.col("name"), labels).alias("known"))


@query("""
    SELECT c_custkey, c_custkey % 5 IN (0, 3) AS status, c_custkey % 4 = 0 AS roster FROM customer
""")  # fmt: skip
def title_and_roster_rules(t: Tables) -> DataFrame:
    """Titles that report a result, and names that may stand in a roster."""
    k = F.col("c_custkey")
    text = lambda *options: F.element_at(F.array(*map(F.lit, options)), (k % len(options) + 1).cast("int"))
    return t.customer.select("c_custkey", T.status_like(text("審査結果について", "募集", "案内", "質問への回答", "入札")).alias("status"), T.roster_name(text("甲野 一郎", "総務課長", "ABC", "乙印")).alias("roster"))
