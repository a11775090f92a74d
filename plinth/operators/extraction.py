"""Records from pages: titles, main text, links, attachments, contacts; semi-structured rows with carried state."""

from __future__ import annotations

import re
import zipfile
from html.parser import HTMLParser
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from plinth.functions.assignments import Words, parse_article
from plinth.functions.pdf import pdf_text

_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"


def strip_tags(c: Column) -> Column:
    """Text between tags with white space squeezed; scripts and styles go."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute."""
    return F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def html_links(pages: DataFrame, id_col: str, html: str, keep: list[str] = ()) -> DataFrame:
    """(id, position, href, label) of the anchors with an address, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(1)).alias("tag"), F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(2)).alias("body"))
    rows = pages.select(id_col, *keep, F.posexplode(pairs).alias("position", "a"))
    return rows.select(id_col, *keep, "position", attribute(F.col("a.tag"), "href").alias("href"), strip_tags(F.col("a.body")).alias("label")).where("href <> ''")


def html_title(html: Column, fallback: Column) -> Column:
    """First h1, else the fallback."""
    t = strip_tags(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    return F.when(t != "", t).otherwise(fallback)


def html_published(html: Column) -> Column:
    """Date of the first time element or published_time meta."""
    time = F.substring(F.regexp_extract(html, r"(?is)<time\b[^>]*datetime\s*=\s*[\"'](\d{4}-\d{2}-\d{2})", 1), 1, 10)
    meta = F.regexp_extract(html, r"(?is)published_time[\"'][^>]*content\s*=\s*[\"'](\d{4}-\d{2}-\d{2})", 1)
    return F.when(time != "", time).otherwise(meta)


def attachments(links: DataFrame, id_col: str, suffix: str) -> DataFrame:
    """(id, urls): distinct addresses that end in the suffix, in order."""
    own = links.where(F.lower("href").endswith(suffix))
    return own.groupBy(id_col).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "href"))), lambda x: x["href"])).alias("urls"))


def absolute_url(base: Column, href: Column) -> Column:
    """href on the base's scheme and host; absolute addresses stay."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([^?#]*/)", 1)
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def match_links(links: DataFrame, keywords: list[str]) -> DataFrame:
    """links with ``matched``: any keyword in the label, or no keywords at all."""
    hit = F.lit(not keywords)
    for k in keywords:
        hit = hit | F.col("label").contains(k)
    return links.withColumn("matched", hit)


def pager_template(url: Column) -> Column:
    """The page number of an address replaced by {pg}; null without one."""
    return F.when(url.rlike(r"[?&]pg=\d+"), F.regexp_replace(url, r"pg=\d+", "pg={pg}"))


def choose_link(df: DataFrame, url: str, label: str, ordinal: str) -> DataFrame:
    """One row per address: the longest source label, the first on ties."""
    rest = [c for c in df.columns if c != url]
    return df.groupBy(url).agg(F.max_by(F.struct(*rest), F.struct(F.length(label), -F.col(ordinal))).alias("b")).select(url, *[F.col(f"b.{c}").alias(c) for c in rest])


class _MainText(HTMLParser):
    """Text of the first of some root elements, a line per text node; the whole document without one."""

    VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "col"}

    def __init__(self, roots: list[tuple[str, str]]):
        super().__init__(convert_charrefs=True)
        self.roots, self.depth, self.inside, self.skip = roots, 0, {}, 0
        self.lines: dict[int, list[str]] = {}
        self.all: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.VOID:
            return
        self.depth += 1
        self.skip += tag in ("script", "style")
        for i, (name, id_) in enumerate(self.roots):
            if i not in self.lines and (not name or tag == name) and (not id_ or dict(attrs).get("id") == id_):
                self.inside[i] = self.depth
                self.lines[i] = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.VOID:
            return
        self.inside = {i: d for i, d in self.inside.items() if d != self.depth}
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data: str) -> None:
        text = re.sub(r"\s+", " ", data).strip()
        if text and not self.skip:
            self.all.append(text)
            for i in self.inside:
                self.lines[i].append(text)


# Root elements of a page's content, best first, as (element, id).
CONTENT_ROOTS = [("article", ""), ("", "tmp_contents"), ("main", ""), ("", "main"), ("body", "")]


def main_text_of(html: str | None, roots: list[tuple[str, str]] = CONTENT_ROOTS) -> str | None:
    if html is None:
        return None
    p = _MainText(roots)
    p.feed(html)
    for i in range(len(roots)):
        if i in p.lines:
            return "\n".join(p.lines[i])
    return "\n".join(p.all)


@F.pandas_udf(T_.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """pandas: text of the content root, a line per text node; a parser has no built-in form."""
    return pages.map(main_text_of, na_action="ignore")


def page_records(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """(id, url, title, published_at, raw_text) of pages."""
    return pages.select(id_col, url, html_title(F.col(html), F.col(url)).alias("title"), html_published(F.col(html)).alias("published_at"), main_text(F.col(html)).alias("raw_text"))


def zip_entries(files: DataFrame, path: str = "path", content: str = "content", suffix: str = ".pdf") -> DataFrame:
    """(path, name, content) of the entries of ZIP files whose name ends in the suffix; unreadable files give none."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, data in zip(batch[path], batch[content]):
                try:
                    with zipfile.ZipFile(BytesIO(data)) as z:
                        rows += [(p, n, z.read(n)) for n in z.namelist() if n.lower().endswith(suffix)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return files.select(path, content).mapInPandas(run, "path string, name string, content binary")


def pdf_texts(files: DataFrame, path: str = "path", content: str = "content", *keep: str) -> DataFrame:
    """(path, keep..., text) of PDF files; '' for what cannot be read. Parsing has no built-in form, so batches go through Arrow."""
    kinds = dict(files.dtypes)

    def run(batches):
        for batch in batches:
            yield batch[[path, *keep]].assign(text=[pdf_text(x) for x in batch[content]])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (path, *keep))
    return files.select(path, *keep, content).mapInPandas(run, f"{schema}, text string")


def zip_texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, text): the texts of a ZIP's PDF entries in the order of their names, parted by lines of three dashes."""
    texts = pdf_texts(zip_entries(files, path, content), path, "content", "name").where("text <> ''")
    own = texts.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("t"))
    return own.select(path, F.array_join(F.transform("t", lambda x: x["text"]), "\n---\n").alias("text"))


def with_attachments(records: DataFrame, links: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """records (id, raw_text) with pdf_urls, zip_urls (distinct, in order) and the texts (url, text) of both after their own."""
    pdf, archives = (attachments(links, id_col, x).withColumnRenamed("urls", f"{x[1:]}_urls") for x in (".pdf", ".zip"))
    out = records.join(pdf, id_col, "left").join(archives, id_col, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("pdf_urls", "zip_urls")})
    each = out.select(id_col, F.posexplode(F.concat("pdf_urls", "zip_urls")).alias("n", "url")).join(texts.where("text <> ''"), "url")
    added = each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))
    out = out.join(added.select(id_col, F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("__more")), id_col, "left")
    return out.withColumn("raw_text", F.concat_ws("\n", "raw_text", "__more")).drop("__more")


def crawl_links(fetch, address: str, keywords: list[str], marker: str = "kiji", most: int = 1) -> list[dict[str, str]]:
    """Links of a list page and the pages its pager leads to: those with ``marker`` in the address and a text that has a keyword
    (any text without keywords), absolute, the first of each address. It stops when a page adds nothing.

    ``fetch`` gives the HTML of an address; the loop belongs to the crawler and runs where it runs.
    """
    from urllib.parse import urljoin

    found: dict[str, dict[str, str]] = {}
    at, seen = address, set()
    for _ in range(most):
        if not at or at in seen:
            break
        seen.add(at)
        html, before = fetch(at), len(found)
        for kind, value, text in outline(html):
            if kind == "link" and marker in value and text and (not keywords or any(k in text for k in keywords)):
                found.setdefault(urljoin(at, value), {"url": urljoin(at, value), "label": text, "list_url": address})
        after = re.search(r"(?is)<(?:a|link)\b(?=[^>]*\brel\s*=\s*[\"']?next)[^>]*\bhref\s*=\s*[\"']([^\"']+)", html)
        if len(found) == before or not after:
            break
        at = urljoin(at, after[1])
    return list(found.values())


def effective_date(title: Column, body: Column, published: Column) -> Column:
    """The first date of the title, else of the body, else the publication date, as text; a date without a year takes that of publication."""
    from plinth.functions import dates as D

    year = D.year_of(published)
    of = lambda c: F.when(c.rlike(r"\d{1,4}年\s*\d{1,2}月\s*\d{1,2}日|\d{1,2}月\s*\d{1,2}日|\d{4}[/-]\d{1,2}[/-]\d{1,2}"), D.iso_text(D.parse_text_date(c, F.when(year > 0, year))))
    return F.coalesce(F.when(of(title) != "", of(title)), F.when(of(body) != "", of(body)), published)


def article_rows(articles: DataFrame, id_col: str, title: str, lines: str, words: Words = Words()) -> DataFrame:
    """(id, position, section, name, to_unit, to_title, from_unit, from_title, evidence) by a fold over each article's own lines
    (array of struct(kind, text)); lines that are no rows give none."""
    columns = ["section", "name", "to_unit", "to_title", "from_unit", "from_title", "evidence"]

    def run(batches):
        for batch in batches:
            rows = []
            for i, about, own in zip(batch[id_col], batch[title], batch[lines]):
                parsed = parse_article([(x["kind"], x["text"]) for x in (own if own is not None else [])], about or "", words)
                rows += [(i, n, *(r[c] for c in columns)) for n, r in enumerate(parsed)]
            yield pd.DataFrame(rows, columns=[id_col, "position", *columns])

    kind = dict(articles.dtypes)[id_col]
    return articles.select(id_col, title, lines).mapInPandas(run, f"`{id_col}` {kind}, position int, " + ", ".join(f"{c} string" for c in columns))


def rows_of_year(features: DataFrame, articles: DataFrame, words: Words = Words()) -> DataFrame:
    """Transfer rows of features (feature, article_url) and their articles (article_url, title, published_at, body, lines)."""
    one = features.select("feature", "article_url").distinct().join(articles, "article_url")
    dated = one.withColumn("effective_date", effective_date(F.col("title"), F.col("body"), F.col("published_at")))
    return dated.select("feature", "article_url", "title", "published_at", "effective_date").join(article_rows(dated, "article_url", "title", "lines", words), "article_url")


class _Outline(HTMLParser):
    """Headings and links of a page in order, as (kind, level or address, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, str, str]] = []
        self.open: list[list] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if re.fullmatch("h[1-6]", tag):
            self.open.append([tag, "heading", tag[1], ""])
        elif tag == "a":
            self.open.append([tag, "link", dict(attrs).get("href") or "", ""])

    def handle_data(self, data: str) -> None:
        for o in self.open:
            o[3] += data

    def handle_endtag(self, tag: str) -> None:
        for o in [o for o in self.open if o[0] == tag]:
            self.open.remove(o)
            self.items.append((o[1], o[2], re.sub(r"\s+", " ", o[3]).strip()))


def outline(html: str) -> list[tuple[str, str, str]]:
    p = _Outline()
    p.feed(html)
    return p.items


def links_under(html: str, heading: str, label: str) -> list[tuple[str, str]]:
    """(address, text) of the links after a heading that matches, until the next that does not; without any, of those whose text matches ``label``."""
    found, inside = [], False
    items = outline(html)
    for kind, value, text in items:
        if kind == "heading":
            inside = re.search(heading, text) is not None
        elif inside and value and text:
            found.append((value, text))
    if not found:
        found = [(v, t) for kind, v, t in items if kind == "link" and v and re.search(label, t)]
    return list(dict.fromkeys(found))


def two_level_units(html: str, level: str = "2") -> list[dict[str, str]]:
    """(top_unit, child_name, child_url) rows: links under each heading of a level; a heading without links gives one row."""
    out: list[dict[str, str]] = []
    top, children = "", 0
    for kind, value, text in [*outline(html), ("heading", level, "")]:
        if kind == "heading" and value == level:
            if top and not children:
                out.append({"top_unit": top, "child_name": "", "child_url": ""})
            top, children = text, 0
        elif kind == "link" and top and text:
            out.append({"top_unit": top, "child_name": text, "child_url": value})
            children += 1
    return out
