"""Documents and pages: extraction, normalization, pairing and topics of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions import units as U
from plinth.operators import extraction, keyed, links, quality, topics
from plinth.plans.registry import SQL, Tables, query

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def titled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"), "text")


@query(rf"SELECT doc_id, lower(trim(regexp_extract(text, '{_EMAIL}'))) AS email, regexp_extract(text, '[0-9]{{2,4}}-[0-9]{{2,4}}-[0-9]{{3,4}}') AS phone FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def contact_extract(t: Tables) -> DataFrame:
    d = t.documents.where(F.col("text").rlike(_EMAIL))
    return d.select("doc_id", T.email_key(T.first_email(F.col("text"))).alias("email"), T.first_phone(F.col("text")).alias("phone"))


@query(rf"WITH e AS (SELECT doc_id, lang || split_part(lower(regexp_extract(text, '{_EMAIL}')), '@', 2) AS contact FROM documents WHERE regexp_matches(text, '{_EMAIL}')) SELECT doc_id, contact, min(doc_id) OVER (PARTITION BY contact) AS first_id, count(*) OVER (PARTITION BY contact) AS members FROM e")
def shared_contacts(t: Tables) -> DataFrame:
    """Documents of one language with one mail domain, as classes."""
    domain = F.element_at(F.split(T.email_key(T.first_email(F.col("text"))), "@"), 2)
    e = t.documents.where(F.col("text").rlike(_EMAIL)).select("doc_id", F.concat("lang", domain).alias("contact"))
    return links.contact_classes(e, "doc_id", "contact").select("doc_id", "contact", "first_id", "members")


@query(
    """
    WITH a AS (SELECT c_custkey, substr(c_name, 16) AS tail, CAST(floor(c_acctbal) AS BIGINT)::VARCHAR AS balance FROM customer),
    b AS (SELECT s_suppkey, substr(s_name, 16) AS tail, CAST(floor(s_acctbal) AS BIGINT)::VARCHAR AS balance FROM supplier)
    SELECT DISTINCT c_custkey, s_suppkey FROM a JOIN b ON a.tail = b.tail OR a.balance = b.balance
    """
)
def contact_or_join(t: Tables) -> DataFrame:
    """Two ways to share a contact, each an equality join."""
    a = t.customer.select("c_custkey", F.substring("c_name", 16, 99).alias("ct"), F.floor("c_acctbal").cast("string").alias("cb"))
    b = t.supplier.select("s_suppkey", F.substring("s_name", 16, 99).alias("st"), F.floor("s_acctbal").cast("string").alias("sb"))
    return links.contact_pairs(a, b, [("ct", "st"), ("cb", "sb")], ("c_custkey", "s_suppkey"))


@query(
    """
    WITH k AS (SELECT user_id, CAST(json_extract(props, '$.k') AS VARCHAR) || event_type || strftime(ts, '%d') AS contact FROM events)
    SELECT contact, min(user_id) AS user_id FROM k GROUP BY contact HAVING count(DISTINCT user_id) = 1
    """
)
def unique_contact_match(t: Tables) -> DataFrame:
    k = t.events.select("user_id", F.concat(F.get_json_object("props", "$.k"), "event_type", F.date_format("ts", "dd")).alias("contact"))
    return keyed.only_match(k, ["contact"], "user_id")


@query("WITH b AS (SELECT DISTINCT p_brand AS n FROM part) SELECT a.n AS short, b.n AS long FROM b a JOIN b ON starts_with(b.n, a.n) AND a.n <> b.n")
def prefix_candidates(t: Tables) -> DataFrame:
    a, b = t.part.select(F.col("p_brand").alias("a")).distinct(), t.part.select(F.col("p_brand").alias("b")).distinct()
    pairs = links.prefix_pairs(a, b, "a", "b", 2).where(T.partial_name_match(F.col("a"), F.col("b")) & (F.length("a") < F.length("b")))
    return pairs.select(F.col("a").alias("short"), F.col("b").alias("long")).distinct()


@query(
    r"""
    WITH k AS (SELECT doc_id, regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z]+', '', 'g') AS k FROM documents), r AS (SELECT k, min(doc_id) AS rep FROM k WHERE k <> '' GROUP BY k)
    SELECT rep AS a, doc_id AS b, 'same' AS kind FROM k JOIN r USING (k) WHERE doc_id <> rep
    UNION ALL SELECT least(x.rep, y.rep), greatest(x.rep, y.rep), 'near' FROM r x JOIN r y ON length(x.k) < length(y.k) AND length(x.k) >= 10 AND length(x.k) >= 0.75 * length(y.k) AND contains(y.k, x.k)
    """
)
def fuzzy_title_pairs(t: Tables) -> DataFrame:
    keys = titled(t).select("doc_id", F.regexp_replace(F.lower("title"), "[^a-z]+", "").alias("k"))
    return links.related_title_pairs(keys, "doc_id", "k")


_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1))"


@query(
    f"""
    WITH a(alias) AS (VALUES ('example.com'), ('example.net'), ('blog.'), ('www.'), ('spam-farm.example.org'), ('example.org')), h AS (SELECT page_id, {_HOST} AS host FROM pages)
    SELECT page_id, host, max_by(alias, (CASE WHEN host = alias THEN 3 WHEN starts_with(host, alias) THEN 2 ELSE 1 END) * 1000 + length(alias)) AS alias
    FROM h LEFT JOIN a ON contains(host, alias) GROUP BY ALL
    """
)
def alias_specificity_match(t: Tables) -> DataFrame:
    """Best reference alias of a name: equal, then at the start, then inside, then the longest."""
    aliases = t.spark.createDataFrame([(a,) for a in ("example.com", "example.net", "blog.", "www.", "spam-farm.example.org", "example.org")], "alias string")
    rows = t.pages.select("page_id", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1)).alias("host"))
    return links.best_reference(rows, aliases, "host", "alias", U.reference_score(F.col("host"), F.col("alias")), [F.col("alias")]).select("page_id", "host", "alias")


@query(
    f"""
    WITH h(top_unit, child) AS (VALUES ('example.com', 'blog.'), ('example.com', 'www.'), ('example.net', 'm.'), ('example.org', 'blog.')), p AS (SELECT page_id, {_HOST} AS host FROM pages),
    s AS (SELECT host, top_unit, CASE WHEN starts_with(host, child) AND contains(host, top_unit) THEN 100 + length(child) WHEN contains(host, top_unit) THEN 10 + length(top_unit) END AS score, child FROM (SELECT DISTINCT host FROM p) JOIN h ON contains(host, top_unit))
    SELECT page_id, coalesce(m.top_unit, 'unknown') AS top_unit, CASE WHEN m.score >= 100 THEN m.child ELSE '' END AS child FROM p LEFT JOIN (
      SELECT host, arg_max(top_unit, score * 1000 - ascii(child)) AS top_unit, max(score) AS score, arg_max(child, score * 1000 - ascii(child)) AS child FROM s WHERE score IS NOT NULL GROUP BY host) m ON p.host = m.host
    """
)
def hierarchy_match(t: Tables) -> DataFrame:
    """Two-level hierarchy by contained names: a child scores 100 and its length, a top unit 10 and its length."""
    h = t.spark.createDataFrame([("example.com", "blog."), ("example.com", "www."), ("example.net", "m."), ("example.org", "blog.")], "top_unit string, child string")
    rows = t.pages.select("page_id", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1)).alias("host"))
    score = F.when(F.col("host").startswith(F.col("child")), 100 + F.length("child")).otherwise(10 + F.length("top_unit"))
    best = links.best_reference(rows, h.withColumn("s", F.lit(0)), "host", "top_unit", score, [-F.ascii("child")])
    hit = F.col("host").startswith(F.col("child"))
    return best.select("page_id", F.coalesce("top_unit", F.lit("unknown")).alias("top_unit"), F.when(hit, F.col("child")).otherwise("").alias("child"))


@query(
    r"""
    WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents)
    SELECT cause, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, 'Licensed under') THEN 'license' WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'contact_block'
      WHEN regexp_matches(title, '\|') THEN 'table' WHEN length(text) < 300 THEN 'short' ELSE 'no_contact_section_detected' END AS cause FROM t) GROUP BY cause
    """
)
def cause_buckets(t: Tables) -> DataFrame:
    rules = [("license", F.col("text").contains("Licensed under")), ("contact_block", F.col("text").rlike(_EMAIL)), ("table", F.col("title").contains("|")), ("short", F.length("text") < 300)]
    return titled(t).groupBy(quality.first_rule(rules, "no_contact_section_detected").alias("cause")).agg(F.count("*").alias("n"))


@query(
    r"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\f\r]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents)
    SELECT doc_id, CASE WHEN length(s) > 220 THEN rtrim(s[1:220]) || '...' ELSE s END AS summary FROM (SELECT doc_id, coalesce(list_filter(lines, lambda x: length(x) >= 12 AND x <> lines[1])[1], lines[1], '') AS s FROM l)
    """
)
def summary_line(t: Tables) -> DataFrame:
    return titled(t).select("doc_id", T.summary_line(F.col("text"), F.get(F.filter(F.transform(T.lines_of(F.col("text")), T.squeeze), lambda x: x != ""), F.lit(0))).alias("summary"))


@query(
    r"""
    WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS l FROM pages), x AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS position FROM a)
    SELECT page_id, CAST(position AS INTEGER) AS position, regexp_extract(a, '(?i)\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS href,
           trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)<a\b[^>]*>(.*?)</a>', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g')) AS label FROM x
    WHERE regexp_extract(a, '(?i)\bhref\s*=\s*["'']([^"'']*)["'']', 1) <> ''
    """
)
def html_links(t: Tables) -> DataFrame:
    return extraction.html_links(t.pages, "page_id", "html")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g')) AS title FROM pages")
def html_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", extraction.html_title(F.col("html"), F.col("url")).alias("title"))


@query()
def page_records(t: Tables) -> DataFrame:
    """Title, date and main text of pages through an HTML parser."""
    return extraction.page_records(t.pages, "page_id", "url", "html")


@query()
def text_normalize(t: Tables) -> DataFrame:
    """NFKC and numerals, for which SQL has no function."""
    return t.documents.select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("sha"))


@query(
    """
    SELECT conv_id, turn, split_part(text, ' ', 1) AS name, CASE WHEN trim(text) = '' THEN 'unknown' WHEN conv_id % 3 = 0 THEN (CASE WHEN contains(trim(text), ' ') THEN 'full_name' WHEN length(trim(text)) <= 2 THEN 'surname_only' ELSE 'unknown' END)
      WHEN length(split_part(text, ' ', 1)) = 0 THEN 'unknown' WHEN length(split_part(text, ' ', 1)) <= 2 THEN 'surname_only' ELSE 'unknown' END AS quality FROM conversations
    """
)
def person_quality(t: Tables) -> DataFrame:
    first = F.element_at(F.split("text", " "), 1)
    return t.conversations.select("conv_id", "turn", first.alias("name"), T.name_quality(F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(first)).alias("quality"))


@query(
    r"""
    WITH l AS (SELECT page_id AS ordinal, regexp_replace(url, '[?#].*$', '') AS address, split_part(regexp_extract(url, '://([^/?#]+)', 1), '.', 1) AS label FROM pages)
    SELECT address, arg_max(label, length(label) * 1000000 - ordinal) AS label, arg_max(ordinal, length(label) * 1000000 - ordinal) AS ordinal FROM l GROUP BY address
    """
)
def latest_link_choice(t: Tables) -> DataFrame:
    rows = t.pages.select(F.col("page_id").alias("ordinal"), F.regexp_replace("url", "[?#].*$", "").alias("address"), F.element_at(F.split(F.regexp_extract("url", "://([^/?#]+)", 1), r"\."), 1).alias("label"))
    return extraction.choose_link(rows, "address", "label", "ordinal")


@query(
    """
    SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)
    """
)
def declared_topic_links(t: Tables) -> DataFrame:
    """Declared phrases contained in texts, by blocks of their words."""
    phrases = t.benchmark.select("item_id", F.col("text").alias("phrase"))
    return links.contained_phrases(t.documents.select("doc_id", "text"), phrases, "doc_id", "text", "item_id", "phrase")


@query()
def topic_candidates(t: Tables) -> DataFrame:
    """Ranked, mutually exclusive tokens of title and summary; the greedy choice has no SQL form."""
    d = titled(t).select("doc_id", "title", T.summary_line(F.col("text"), F.col("title")).alias("summary"))
    scored = topics.weighted_tokens(d, "doc_id", {"title": 5, "summary": 3})
    return topics.ranked_candidates(scored, "doc_id").select("doc_id", F.transform("candidates", lambda x: x["token"]).alias("tokens"))


@query("SELECT page_id, regexp_replace(url, 'page=[0-9]+', 'page={pg}') AS template FROM pages WHERE regexp_matches(url, '[?&]page=[0-9]+')")
def pager_templates(t: Tables) -> DataFrame:
    renamed = F.regexp_replace("url", r"([?&])page=", "$1pg=")
    return t.pages.select("page_id", F.replace(extraction.pager_template(renamed), F.lit("pg={pg}"), F.lit("page={pg}")).alias("template")).where("template is not null")


@query("SELECT doc_id, regexp_extract(text, '([0-9][0-9,]{5,})', 1) AS amount FROM documents WHERE regexp_matches(text, '[0-9][0-9,]{5,}')")
def amount_extract(t: Tables) -> DataFrame:
    d = t.documents.where(F.col("text").rlike("[0-9][0-9,]{5,}"))
    return d.select("doc_id", F.regexp_extract("text", "([0-9][0-9,]{5,})", 1).alias("amount"))


@query(f"WITH h AS ({SQL['html_links']}) SELECT page_id, count(*) AS links, count(*) FILTER (WHERE contains(label, 'a') OR contains(label, 'er')) AS matched FROM h GROUP BY page_id")
def matched_links(t: Tables) -> DataFrame:
    """Links of each page and how many have a keyword in their label: the diagnosis of a source's coverage."""
    found = extraction.match_links(extraction.html_links(t.pages, "page_id", "html"), ["a", "er"])
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if("matched").alias("matched"))


@query(f"""
    WITH h AS ({SQL['html_links']}), p AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS root, regexp_extract(url, '^([^?#]*/)', 1) AS folder, regexp_extract(url, '^([a-zA-Z]+:)', 1) AS scheme FROM pages)
    SELECT page_id, position, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN root || href ELSE folder || href END AS address FROM h JOIN p USING (page_id)
""")  # fmt: skip
def absolute_links(t: Tables) -> DataFrame:
    found = extraction.html_links(t.pages, "page_id", "html", ["url"])
    return found.select("page_id", "position", extraction.absolute_url(F.col("url"), F.col("href")).alias("address"))


@query(f"WITH h AS ({SQL['html_links']}) SELECT page_id, array_to_string(list(href ORDER BY first), '|') AS urls FROM (SELECT page_id, href, min(position) AS first FROM h WHERE ends_with(lower(href), 'e') GROUP BY ALL) GROUP BY page_id")
def attachment_links(t: Tables) -> DataFrame:
    """Distinct addresses of one ending, in order."""
    found = extraction.attachments(extraction.html_links(t.pages, "page_id", "html"), "page_id", "e")
    return found.select("page_id", F.array_join("urls", "|").alias("urls"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '2024-01-' || (10 + page_id % 20) WHEN 1 THEN '2023-05-' || (10 + page_id % 20) ELSE '' END AS day FROM pages")
def html_dates(t: Tables) -> DataFrame:
    """Dates of pages that got a time element or a meta element."""
    day = F.concat(F.lit("-"), (10 + F.col("page_id") % 20).cast("string"))
    time, meta = F.concat(F.lit("<p><time class='x' datetime=\"2024-01"), day, F.lit("T10:00\">")), F.concat(F.lit("<meta property='article:published_time' content='2023-05"), day, F.lit("T00:00'>"))
    own = F.when(F.col("page_id") % 3 == 0, F.concat(meta, time)).when(F.col("page_id") % 3 == 1, meta).otherwise("")
    return t.pages.select("page_id", extraction.html_published(F.concat(own, F.col("html"))).alias("day"))


_KANJI = "一二三四五六七八九"


@query(f"""
    WITH k AS (SELECT p_partkey, p_partkey % 9 + 1 AS h, p_partkey % 8 + 2 AS t, p_partkey % 7 + 1 AS u, string_split('{_KANJI}', '') AS d FROM part)
    SELECT p_partkey, h * 10000 + t * 100 + u AS value, '締切 ' || (h * 100 + t * 10 + u) || '円 ' || u || ' AB' AS text FROM k
""")  # fmt: skip
def numerals(t: Tables) -> DataFrame:
    """Numerals as numbers, and normalized texts with full-width figures and numerals before counters."""
    k = F.col("p_partkey")
    digit = lambda c: F.substring(F.lit(_KANJI), c.cast("int"), 1)
    h, te, u = k % 9 + 1, k % 8 + 2, k % 7 + 1
    text = F.concat(F.lit("締め切り　"), digit(h), F.lit("百"), digit(te), F.lit("十"), digit(u), F.lit("円  "), F.translate(u.cast("string"), "123456789", "１２３４５６７８９"), F.lit(" ＡＢ "))
    return t.part.select("p_partkey", T.numeral_to_long(F.concat(digit(h), F.lit("万"), digit(te), F.lit("百"), digit(u))).alias("value"), T.normalize_text(text).alias("text"))


@query("SELECT c_custkey, array_to_string(list_distinct_ordered, ',') AS sample FROM (SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN ['building', c_name, 'x'] ELSE [lower(c_mktsegment), c_name, 'building'] END[1:2] AS list_distinct_ordered FROM customer)")
def ordered_samples(t: Tables) -> DataFrame:
    """The first two distinct values of several lists."""
    return t.customer.select("c_custkey", F.array_join(keyed.ordered_sample(F.array(F.lower("c_mktsegment")), F.array(F.lower("c_mktsegment"), "c_name"), F.array(F.lit("building"), F.lit("x")), k=2), ",").alias("sample"))
