"""Text normalization and name functions.

Column functions unless the docstring says pandas: Unicode normalization and numeral replacement have no built-in form.
All treat null as missing and return null for it, unless stated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T_

# Numerals and the units that multiply them.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
LARGE_UNITS = {"万": 10_000, "億": 100_000_000, "兆": 1_000_000_000_000}
# Spellings that normalization unifies, in order, and the counters before which numerals are replaced.
SYNONYMS = [("〆切", "締切"), ("締め切り", "締切"), ("しめきり", "締切"), ("提出期限", "提出締切"), ("参加期限", "参加申込締切"), ("〆", "締"), ("令和元年", "令和1年"), ("平成元年", "平成1年")]
COUNTERS = "年 月 日 時 分 秒 円 千円 万円 億円 件 人 回 部 社 校 丁目 番 番地 号 年度 %".split()
# Honorifics and the characters that join names.
HONORIFICS = ["氏", "様", "さん"]
NAME_SEPARATORS = "、,，/／"

_NUMERAL = re.compile("[" + "".join([*DIGITS, *SMALL_UNITS, *LARGE_UNITS]) + r"\d]+(?=\s*(?:" + "|".join(COUNTERS) + "))")
_RUN = re.compile(f"([{''.join(DIGITS)}\\d]*)([{''.join(SMALL_UNITS)}]?)")


def _digits(run: str) -> int:
    """A spelled digit starts a number anew, figures extend it."""
    tail = re.search(f"[{''.join(DIGITS)}]?\\d*$", run).group() if run else ""
    return int("".join(str(DIGITS.get(c, c)) for c in tail) or 0)


def _section(text: str) -> int:
    """Value below the large units; a small unit without a number counts once."""
    return sum((max(_digits(n), 1) if not n or _digits(n) == 0 else _digits(n)) * SMALL_UNITS[u] if u else _digits(n) for n, u in _RUN.findall(text))


def numeral_value(text: str) -> int | None:
    """Whole number of a numeral; None if it holds anything else or nothing."""
    if not text or re.sub(f"[{''.join([*DIGITS, *SMALL_UNITS, *LARGE_UNITS])}\\d]", "", text):
        return None
    total, rest = 0, text
    while m := re.search(f"[{''.join(LARGE_UNITS)}]", rest):
        head, rest = rest[: m.start()], rest[m.end() :]
        value = _section(head)
        total += (value or 1) * LARGE_UNITS[m.group()]
    return total + _section(rest)


def replace_numerals(text: str) -> str:
    """Numerals before a counter as figures."""
    return _NUMERAL.sub(lambda m: str(numeral_value(m.group())), text)


def normalize(text: str | None) -> str | None:
    """NFKC, unified spellings, figures, single blanks and line ends, stripped."""
    if text is None:
        return None
    text = reduce(lambda t, pair: t.replace(*pair), SYNONYMS, unicodedata.normalize("NFKC", text))
    return re.sub(r"\n+", "\n", re.sub(r"[ \t]+", " ", replace_numerals(text))).strip()


@F.pandas_udf(T_.StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """pandas: ``normalize`` of each text."""
    return texts.map(normalize, na_action="ignore")


@F.pandas_udf(T_.LongType())
def numeral_to_long(texts: pd.Series) -> pd.Series:
    """pandas: ``numeral_value`` of each text."""
    return texts.map(numeral_value, na_action="ignore").astype("Int64")


def blank(c: Column) -> Column:
    """Null, empty or only blanks."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def null_if_blank(c: Column) -> Column:
    return F.when(~blank(c), c)


def squeeze(c: Column) -> Column:
    """White space runs as single blanks, stripped."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def compact(c: Column) -> Column:
    """Without blanks."""
    return F.regexp_replace(c, r"[\s　]+", "")


def name_key(c: Column) -> Column:
    """Name without honorific and blanks."""
    return compact(F.regexp_replace(F.trim(c), r"[\s　]*(?:" + "|".join(HONORIFICS) + ")$", ""))


def party_key(c: Column) -> Column:
    """First 12 hexadecimal digits of SHA-256 of the name key; empty for an empty name."""
    key = F.coalesce(name_key(c), F.lit(""))
    return F.when(key == "", "").otherwise(F.substring(F.sha2(key, 256), 1, 12))


def name_quality(c: Column) -> Column:
    """full_name with a blank inside, surname_only up to two characters, else unknown."""
    n = F.trim(F.coalesce(c, F.lit("")))
    return F.when(n == "", "unknown").when(n.contains(" "), "full_name").when(F.char_length(n) <= 2, "surname_only").otherwise("unknown")


def partial_name_match(left: Column, right: Column, least: int = 2) -> Column:
    """One is a strict beginning of the other and has ``least`` characters."""
    longer, shorter = F.when(F.length(left) >= F.length(right), left).otherwise(right), F.when(F.length(left) >= F.length(right), right).otherwise(left)
    return (left != right) & (F.length(shorter) >= least) & longer.startswith(shorter)


def split_names(c: Column, separators: str = NAME_SEPARATORS) -> Column:
    """Distinct non-blank parts in order."""
    parts = F.transform(F.split(c, f"[{re.escape(separators)}]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def split_topics(c: Column) -> Column:
    """Topic names of a packed field in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[|,、/／\n]+"), lambda x: F.trim(x)), lambda x: x != ""))


def email_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def phone_key(c: Column) -> Column:
    """Digits, with a leading 0 put before nine or ten that have none."""
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    return F.when(F.length(d).between(9, 10) & ~d.startswith("0"), F.concat(F.lit("0"), d)).otherwise(d)


def first_email(c: Column) -> Column:
    return F.regexp_extract(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)


def first_phone(c: Column) -> Column:
    return F.regexp_extract(c, r"[0-9]{2,4}-[0-9]{2,4}-[0-9]{3,4}", 0)


def pairing_key(title: Column, phrases: list[str], tails: list[str] = ()) -> Column:
    """Title without bracketed parts, the phrases (in order), the tail patterns, punctuation and blanks."""
    out = F.regexp_replace(title, r"[(（【\[][^)）】\]]*[)）】\]]", "")
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(""))
    for t in tails:
        out = F.regexp_replace(out, t, "")
    return F.regexp_replace(out, r"[\s　・,.、。:：!！?？'\"「」『』-]+", "")


def related_titles(left: Column, right: Column, least: int = 10, ratio: float = 0.75) -> Column:
    """Equal keys, or the shorter (``least`` characters or more) inside the longer with a length ratio of ``ratio`` or more."""
    longer, shorter = F.when(F.length(left) >= F.length(right), left).otherwise(right), F.when(F.length(left) >= F.length(right), right).otherwise(left)
    return (left != "") & (right != "") & ((left == right) | ((F.length(shorter) >= least) & longer.contains(shorter) & (F.length(shorter) >= ratio * F.length(longer))))


def keywords_to_json(c: Column) -> Column:
    """Distinct non-blank values in order as a JSON list."""
    return F.to_json(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")))


def keywords_from_json(c: Column) -> Column:
    """Strings of a JSON list; an empty list where it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def valid_topic(c: Column, deny_tokens: list[str] = (), deny_prefixes: list[str] = (), deny_suffixes: list[str] = (), least: int = 2, most: int = 14) -> Column:
    """Length within bounds, no denied part, not plain ASCII."""
    ok = F.length(c).between(least, most) & ~c.rlike(r"^[\x00-\x7F]*$")
    for t in deny_tokens:
        ok &= ~c.contains(t)
    for t in deny_prefixes:
        ok &= ~c.startswith(t)
    for t in deny_suffixes:
        ok &= ~c.endswith(t)
    return ok


@F.pandas_udf(T_.StringType())
def strip_wrapping_brackets(texts: pd.Series) -> pd.Series:
    """pandas: matching outer brackets peeled, however many; a numbered head such as (1) stays."""

    def peel(t: str) -> str:
        pairs, t = {"(": ")", "（": "）", "[": "]", "【": "】"}, t.strip()
        while len(t) > 1 and pairs.get(t[0]) == t[-1] and not re.match(r"[（(【\[]\d+[)）】\]]", t):
            t = t[1:-1].strip()
        return t

    return texts.map(peel, na_action="ignore")


def summary_line(text: Column, title: Column, least: int = 12, most: int = 220, metadata: str = r"(?i)^(updated|published|contact|tel|fax)\b") -> Column:
    """First line of ``least`` characters that is neither the title nor metadata, cut to ``most``; else the first line.

    Lines and title are worked out once for a text: the inner functions see them as variables.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeeze), lambda x: x != "")

    def pick(s: Column) -> Column:
        good = F.filter(s["lines"], lambda x: (F.length(x) >= least) & ~x.eqNullSafe(s["title"]) & ~x.rlike(metadata))
        return F.coalesce(F.get(good, F.lit(0)), F.get(s["lines"], F.lit(0)), F.lit(""))

    cut = lambda x: F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most)), F.lit("..."))).otherwise(x)
    once = F.transform(F.array(F.struct(lines.alias("lines"), squeeze(title).alias("title"))), pick)
    return F.get(F.transform(once, cut), F.lit(0))


def budget_amount(text: Column, labels: str, units: str = "円|千円|万円|億円") -> Column:
    """Amount and unit after a label, else after 金, else before a tax note; commas dropped, empty if none."""
    forms = [rf"(?:{labels}).{{0,40}}?([0-9,]+)\s*({units})", rf"金\s*([0-9,]+)\s*({units})", rf"([0-9,]+)\s*({units})\s*[(（]消費税"]
    found = [F.when(text.rlike(p), F.concat(F.replace(F.regexp_extract(text, p, 1), F.lit(","), F.lit("")), F.regexp_extract(text, p, 2))) for p in forms]
    return F.coalesce(*found, F.lit(""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once: inner functions would work a plain column out anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def deadline(text: Column, keywords: list[str], date_pattern: str, ahead: int = 7) -> Column:
    """First date in the first line with a keyword that has one in it or in the ``ahead`` lines after it; empty if none."""
    word = "|".join(re.escape(k) for k in keywords)

    def first(lines: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.when(F.element_at(lines, i).rlike(word), F.regexp_extract(F.array_join(F.slice(lines, i, F.lit(ahead + 1)), "\n"), date_pattern, 0)))
        return F.coalesce(F.get(F.filter(blocks, lambda x: x.isNotNull() & (x != "")), F.lit(0)), F.lit(""))

    return once(lines_of(text), first)


def section_after(text: Column, heading: str, stop: str, most: int = 7) -> Column:
    """Up to ``most`` non-blank lines after the first heading line, before the first stop line, joined by blanks."""

    def section(rest: Column) -> Column:
        end = F.coalesce(F.array_position(F.transform(rest, lambda x, i: x.rlike(stop) & (i > 0)), True), F.lit(0)).cast("int")
        return F.array_join(F.slice(F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest), 1, most), " ")

    def after(lines: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(heading)), True), F.lit(0)).cast("int")
        rest = F.filter(F.slice(lines, at + 1, F.size(lines)), lambda x: (x != "") & ~x.rlike(heading))
        return F.when(at > 0, once(rest, section)).otherwise("")

    return once(F.transform(lines_of(text), lambda x: F.trim(x)), after)


# What titles that report on an earlier record contain; words that stand where a name should, and ends of titles.
STATUS_TOKENS = ["審査結果", "結果", "質問", "回答", "最優秀提案事業者", "決定"]
NO_ROSTER_NAMES = ["署名", "主事", "主任", "長", "あて", "印", "A印"]
ROSTER_TITLE_ENDS = ["主事", "主任", "係長", "課長", "部長", "局長", "技師", "担当"]


def status_like(title: Column) -> Column:
    """Whether a title reports on an earlier record, such as a result or an answer."""
    return F.coalesce(title, F.lit("")).rlike("|".join(map(re.escape, STATUS_TOKENS)))


def roster_name(name: Column) -> Column:
    """Whether a name may stand in a roster: name characters only, neither letters alone, nor a stamp, nor a short title."""
    n = F.coalesce(name_key(name), F.lit(""))
    size = F.char_length(n)
    title = n.rlike(f"(?:{'|'.join(ROSTER_TITLE_ENDS)})$") & (size <= 4)
    shaped = n.rlike("^[㐀-鿿豈-﫿々ぁ-んァ-ヶーA-Za-z]{1,12}$") & ~n.rlike("^[A-Za-z]+$")
    return shaped & ~n.isin(NO_ROSTER_NAMES) & ~(n.endswith("印") & (size <= 3)) & ~title
