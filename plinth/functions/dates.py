"""Dates that are kept as text: parsing, event time, differences. All tolerant: what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First year of an era minus one.
ERAS = {"令和": 2018, "平成": 1988}
ISO_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd"]
OPEN_START, OPEN_END = "0000-01-01", "9999-12-31"


def make_date(year: Column, month: Column, day: Column) -> Column:
    """Null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def parse_iso(c: Column) -> Column:
    """The first 19 characters by four formats, else the first yyyy-m-d or yyyy/m/d inside."""
    head = F.substring(F.trim(c), 1, 19)
    p = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    loose = F.when(c.rlike(p), make_date(*[F.regexp_extract(c, p, i) for i in (1, 2, 3)]))
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)).cast("date") for f in ISO_FORMATS], loose)


def parse_text_date(c: Column, default_year: Column | int | None = None) -> Column:
    """Era, western and slashed dates, then month and day of ``default_year``, in normalized text."""
    t = F.regexp_replace(c, r"\s+", "")

    def found(pattern: str, base: int = 0) -> Column:
        return F.when(t.rlike(pattern), make_date(F.regexp_extract(t, pattern, 1).cast("int") + base, F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3)))

    forms = [(rf"{era}(\d{{1,4}})年(\d{{1,4}})月(\d{{1,4}})日", base) for era, base in ERAS.items()]
    forms += [(r"(\d{4})年(\d{1,4})月(\d{1,4})日", 0), (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", 0)]
    # the first form that occurs decides, also where its date does not exist
    out = F.lit(None).cast("date")
    if default_year is not None:
        p = r"(\d{1,2})月(\d{1,2})日"
        year = F.lit(default_year) if isinstance(default_year, int) else default_year
        out = F.when(t.rlike(p), make_date(year, F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)))
    for p, base in reversed(forms):
        out = F.when(t.rlike(p), found(p, base)).otherwise(out)
    return out


def iso_text(c: Column) -> Column:
    """yyyy-MM-dd, empty for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def observed_at(published: Column, fetched: Column) -> Column:
    """Event time: the publication date, else the day of fetching."""
    return F.coalesce(F.when(published != "", published), F.substring(fetched, 1, 10))


def days_between(left: Column, right: Column) -> Column:
    return F.abs(F.datediff(left, right))


def same_year(left: Column, right: Column) -> Column:
    return F.coalesce(F.year(left) == F.year(right), F.lit(False))


def day_before(c: Column) -> Column:
    """The day before as text; text that is no date stays."""
    return F.coalesce(F.date_format(F.date_sub(parse_iso(c), 1), "yyyy-MM-dd"), c)


def year_of(c: Column) -> Column:
    """Year of the date, else the first 20xx inside, else 0."""
    loose = F.regexp_extract(F.coalesce(c, F.lit("")), r"20\d\d", 0)
    return F.coalesce(F.year(parse_iso(c)), F.when(loose != "", loose.cast("int")), F.lit(0))


def strict_or_blank(c: Column) -> Column:
    """Empty, or an existing day as yyyy-MM-dd."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t == "") | (t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull())


def active_on(day: Column, start: Column, end: Column) -> Column:
    """Whether a text interval with open ends holds the day."""
    low = F.coalesce(F.when(start != "", start), F.lit(OPEN_START))
    high = F.coalesce(F.when(end != "", end), F.lit(OPEN_END))
    return (low <= day) & (day <= high)


def published_at(text: Column, html_date: Column, label: str = r"(?:更新日|公開日|掲載日|Updated|Published)", pattern: str = r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[/-]\d{1,2}[/-]\d{1,2}") -> Column:
    """The page's own date, else the first date in a labelled line of the first 20 or the two lines after it, else the first date in
    the first 12 lines; as text, empty if there is none."""
    from plinth.functions.text import once

    def near(ls: Column) -> Column:
        at = lambda i: F.when(F.element_at(ls, i).rlike(label), F.regexp_extract(F.array_join(F.slice(ls, i, F.lit(3)), "\n"), pattern, 0))
        return F.get(F.filter(F.transform(F.sequence(F.lit(1), F.size(ls)), at), lambda x: x.isNotNull() & (x != "")), F.lit(0))

    found = lambda ls: F.coalesce(near(ls), F.regexp_extract(F.array_join(F.slice(ls, 1, 12), "\n"), pattern, 0))
    own = F.when(F.coalesce(F.trim(html_date), F.lit("")) != "", html_date)
    return F.coalesce(own, once(once(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), found), lambda d: iso_text(parse_text_date(d))))
