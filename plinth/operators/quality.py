"""Validation and diagnostics: row issues, cause buckets, funnels per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import text as T


def validate_rows(df: DataFrame, row: str, required: list[str], date_columns: list[str], allowed: dict[str, list[str]], unique: list[str]) -> DataFrame:
    """(row, level, message): empty required fields and bad dates are errors, unknown values and later duplicates warnings.

    A row is a duplicate only if all ``unique`` fields are set.
    """
    issue = lambda level, text: F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))
    checks = [F.when(T.blank(F.col(c)), issue("error", f"{c} is empty")) for c in required]
    checks += [F.when(~D.strict_or_blank(F.col(c)), issue("error", f"{c} is not a date")) for c in date_columns]
    checks += [F.when(~T.blank(F.col(c)) & ~F.col(c).isin(values), issue("warning", f"{c} is unknown")) for c, values in allowed.items()]
    found = df.select(row, F.explode(F.array_compact(F.array(*checks))).alias("i")).select(row, "i.level", "i.message")
    full = df.where(~_any([T.blank(F.col(c)) for c in unique]))
    again = full.withColumn("__n", F.row_number().over(W.partitionBy(*unique).orderBy(row))).where("__n > 1").select(row, F.lit("warning").alias("level"), F.lit("duplicate row").alias("message"))
    return found.unionByName(again)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first rule that holds."""
    out = None
    for name, condition in rules:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def near_lines(text: Column, first: str, then: str, ahead: int) -> Column:
    """Whether a line that matches ``first`` has one that matches ``then`` in itself or the ``ahead`` lines after it."""
    lines = T.lines_of(text)
    return F.exists(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(first) & F.exists(F.slice(lines, i, F.lit(ahead + 1)), lambda x: x.rlike(then)))


# Labels and contact marks by which a missing party is explained.
PERSON_LABEL = r"(?:担当者|氏名|連絡担当者|Contact person)\s*[:：]"
INLINE_NAME = r"(?:担当|Contact)\s*[:：]?\s*\S+ \S+"
CONTACT_MARK = r"(?:電話|TEL|Tel|E-mail|メール|@)"
CONTACT_BLOCK = r"(?:問合せ先|問い合わせ先|連絡先|Contact)"
NAME_SHAPE = r"[\p{Lu}][\p{Ll}]+ [\p{Lu}][\p{Ll}]+|[\p{IsHan}]{1,4} [\p{IsHan}]{1,4}"
RESULT_TITLE = r"(?:結果|決定|選定|result)"


def missing_party_cause(title: Column, text: Column) -> Column:
    """Cause bucket of a record without a party, first rule wins."""
    return first_rule(
        [
            ("explicit_label_not_extracted", near_lines(text, PERSON_LABEL, CONTACT_MARK, 4)),
            ("inline_name_not_extracted", near_lines(text, INLINE_NAME, CONTACT_MARK, 3)),
            ("contact_block_with_name", near_lines(text, CONTACT_BLOCK, NAME_SHAPE, 5)),
            ("source_has_department_only", text.rlike(CONTACT_BLOCK)),
            ("result_page", title.rlike(RESULT_TITLE)),
        ],
        "no_contact_section_detected",
    )


def funnel(df: DataFrame, key: str, flags: dict[str, Column], sample: Column | None = None, k: int = 3) -> DataFrame:
    """Per key: rows, rows per flag, the share of each flag in rows, and up to k sorted samples."""
    aggs = [F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()]]
    if sample is not None:
        aggs.append(F.slice(F.sort_array(F.collect_set(sample)), 1, k).alias("samples"))
    out = df.groupBy(key).agg(*aggs)
    return out.withColumns({f"{n}_rate": ratio(F.col(n), F.col("rows")) for n in flags})


def ratio(part: Column, whole: Column) -> Column:
    """One-digit percentage, empty without a whole."""
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole)).otherwise("")


def summary_lines(rows: DataFrame, key: str, total: str, missing: str, k: int = 10) -> DataFrame:
    """(part, rank, key, n) of per-source counts: the sums over all sources, then the ``k`` sources with most rows and those with
    most missing ones."""
    sums = rows.agg(F.sum(total).alias(total), F.sum(missing).alias(missing))
    parts = sums.select(F.explode(F.array(*[F.struct(F.lit("all").alias("part"), F.lit(i + 1).alias("rank"), F.lit(c).alias("key"), F.col(c).cast("long").alias("n")) for i, c in enumerate((total, missing))])).alias("x")).select("x.*")
    for part, column in (("most rows", total), ("most missing", missing)):
        top = rows.select(key, column).orderBy(F.desc(column), F.asc(key)).limit(k)
        ranked = top.groupBy().agg(F.slice(F.sort_array(F.collect_list(F.struct(F.negative(F.col(column)).alias("m"), F.col(key).cast("string").alias("key")))), 1, k).alias("a"))  # k rows
        parts = parts.unionAll(ranked.select(F.lit(part).alias("part"), F.posexplode("a").alias("i", "r")).select("part", (F.col("i") + 1).alias("rank"), "r.key", (-F.col("r.m")).cast("long").alias("n")))
    return parts


def viable_roster_mention(quality: Column, confidence: Column, contact: Column, note: Column, mentions: Column) -> Column:
    """Whether a mention without a party may stand in a roster: a note of its source, a contact, a full name, two mentions, or a
    confidence of 0.9."""
    return ~T.blank(note) | contact | (quality == "full_name") | (mentions >= 2) | (confidence >= 0.9)
