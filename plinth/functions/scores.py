"""Explainable additive scores. Every term is a condition with a weight, so the same list gives the score and its reasons.

Weights are decimals and the result is rounded half-even to two digits, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """A weight that counts where the condition holds; terms of one ``group`` are alternatives, the first that holds counts."""

    label: str
    weight: float
    when: Column
    group: str | None = None


def _decimal(x: float) -> Column:
    return F.lit(f"{x:.6f}").cast("decimal(18,6)")


def _cases(terms: list[Term]) -> list[Column]:
    """One column per group: (weight, label) of the term that counts."""
    groups: dict[str, list[Term]] = {}
    for i, t in enumerate(terms):
        groups.setdefault(t.group or f"#{i}", []).append(t)
    out = []
    for own in groups.values():
        case = None
        for t in own:
            value = F.struct(_decimal(t.weight).alias("w"), F.lit(t.label).alias("l"))
            hit = F.coalesce(t.when, F.lit(False))
            case = F.when(hit, value) if case is None else case.when(hit, value)
        out.append(case)
    return out


def total(terms: list[Term], base: float = 0.0, extra: Column | None = None, low: float | None = None, high: float | None = None, digits: int | None = 2) -> Column:
    """Sum of base, terms and an extra column, clamped and rounded half-even."""
    out = _decimal(base)
    for c in _cases(terms):
        out = out + F.coalesce(c["w"], _decimal(0))
    if extra is not None:
        out = out + F.coalesce(extra.cast("decimal(18,6)"), _decimal(0))
    if low is not None:
        out = F.greatest(out, _decimal(low))
    if high is not None:
        out = F.least(out, _decimal(high))
    return (F.bround(out, digits) if digits is not None else out).cast("double")


def reasons(terms: list[Term]) -> Column:
    """Labels of the terms that counted, in order."""
    return F.filter(F.array(*[c["l"] for c in _cases(terms)]), lambda x: x.isNotNull())


def identity_terms(f: dict[str, Column]) -> list[Term]:
    """Mention to party. ``f`` maps the evidence names to boolean columns (fixed values: the weights)."""
    weak = f["surname_only"]
    return [
        Term("same_name", 0.35, f["name"]),
        Term("same_display", 0.05, f["display"]),
        Term("contact", 0.25, f["contact"]),
        Term("unit_exact", 0.15, f["unit_exact"], "unit"),
        Term("unit_overlap", 0.08, f["unit_overlap"], "unit"),
        Term("top_unit", 0.03, f["top_unit"], "unit"),
        Term("unit_theme", 0.08, f["unit_theme"], "unit_theme"),
        Term("unit_theme_conflict", -0.22, f["unit_theme_conflict"] & weak, "unit_theme"),
        Term("unit_theme_conflict", -0.10, f["unit_theme_conflict"] & ~f["top_unit"], "unit_theme"),
        Term("record_theme", 0.07, f["record_theme"], "record_theme"),
        Term("record_theme_conflict", -0.12, f["record_theme_conflict"] & weak, "record_theme"),
        Term("topic", 0.12, f["topic"], "topic"),
        Term("topic_conflict", -0.18, f["topic_conflict"] & weak, "topic"),
        Term("topic_conflict", -0.08, f["topic_conflict"], "topic"),
        Term("recent_topic", 0.08, f["recent_topic"]),
        Term("priority_topic", 0.05, f["priority_topic"]),
        Term("transfer_to", 0.20, f["transfer_to"], "transfer"),
        Term("transfer_from_only", -0.15, f["transfer_from"], "transfer"),
        Term("recent_transfer", 0.15, f["transfer_to"] & f["recent_transfer"]),
        Term("activity", 0.10, f["activity"]),
    ]


def identity_score(f: dict[str, Column], records: Column) -> Column:
    """Base .20, the terms, and .02 for each of four or fewer records from the second on; at most .98, not clamped below."""
    more = F.when(records >= 2, F.least(records * F.lit("0.02").cast("decimal(4,2)"), F.lit("0.08").cast("decimal(4,2)")))
    return total(identity_terms(f), 0.20, more, high=0.98)


def slot_terms(f: dict[str, Column]) -> list[Term]:
    """Mention to slot (fixed values: the weights)."""
    weak, bridge = f["surname_only"], f["bridge"]
    no_unit = ~(f["unit_exact"] | f["unit_overlap"])
    no_time = ~(f["active"] | f["soon"] | f["just_ended"])
    return [
        Term("same_name", 0.38, f["name_exact"], "name"),
        Term("name_prefix", 0.18, f["name_prefix"], "name"),
        Term("unit_exact", 0.28, f["unit_exact"], "unit"),
        Term("unit_overlap", 0.18, f["unit_overlap"], "unit"),
        Term("unit_theme", 0.08, f["unit_theme"], "unit"),
        Term("record_theme", 0.06, f["record_theme"], "unit"),
        Term("topic", 0.13, f["topic"]),
        Term("recent_topic", 0.08, f["recent_topic"]),
        Term("priority_topic", 0.04, f["priority_topic"]),
        Term("active", 0.24, f["active"], "time"),
        Term("soon", 0.14, f["soon"], "time"),
        Term("just_ended", 0.10, f["just_ended"], "time"),
        Term("linked", 0.05, f["linked"]),
        Term("surname_without_unit", -0.12, weak & no_unit),
        Term("surname_without_time", -0.08, weak & no_time),
        Term("bridge_without_theme", -0.18, bridge & no_unit & ~f["unit_theme"] & ~f["record_theme"]),
        Term("bridge_topic_conflict", -0.16, bridge & f["topic_conflict"]),
        Term("bridge_root_conflict", -0.12, bridge & f["root_conflict"]),
    ]


def slot_score(f: dict[str, Column], source_confidence: Column) -> Column:
    """Base .05, the terms, and up to .05 for the source; 0 without a name relation, within [0, .99]."""
    extra = F.least(source_confidence.cast("decimal(18,6)") * F.lit("0.05").cast("decimal(4,2)"), F.lit("0.05").cast("decimal(4,2)"))
    return F.when(F.coalesce(f["name_exact"] | f["name_prefix"], F.lit(False)), total(slot_terms(f), 0.05, extra, 0.0, 0.99)).otherwise(0.0)


def transfer_terms(f: dict[str, Column]) -> list[Term]:
    """Transfer event to party (fixed values: the weights)."""
    return [
        Term("same_name", 0.45, f["name_exact"], "name"),
        Term("name_prefix", 0.12, f["name_prefix"], "name"),
        Term("other_name", -0.50, F.lit(True), "name"),
        Term("to_unit", 0.20, f["to_exact"], "to"),
        Term("to_overlap", 0.12, f["to_overlap"], "to"),
        Term("to_root", 0.05, f["to_root"], "to"),
        Term("from_unit", 0.15, f["from_exact"], "from"),
        Term("from_overlap", 0.10, f["from_overlap"], "from"),
        Term("from_root", 0.04, f["from_root"], "from"),
        Term("activity", 0.10, f["activity"]),
        Term("prefix_without_unit", -0.10, f["name_prefix"] & ~(f["to_exact"] | f["to_overlap"] | f["from_exact"] | f["from_overlap"])),
    ]


def transfer_score(f: dict[str, Column], records: Column) -> Column:
    """Base .10 and the terms and .02 a record up to .08, within [0, .98]."""
    more = F.when(records >= 2, F.least(records * F.lit("0.02").cast("decimal(4,2)"), F.lit("0.08").cast("decimal(4,2)")))
    return total(transfer_terms(f), 0.10, more, 0.0, 0.98)


def rollup_scores(records: Column, units: Column, priority: Column, avg: Column, span_years: Column) -> dict[str, Column]:
    """Involvement, continuity, visibility and spotlight of a (party, topic, year)."""
    involvement = records + 0.45 * units + 0.8 * avg + 0.75 * priority
    continuity = F.least(F.lit(4.0), 1.4 * span_years + F.when(records >= 2, 1.0).otherwise(0.0))
    visibility = F.least(F.lit(4.5), 1.8 * avg + 0.8 * priority + 0.25 * records)
    return {"involvement": involvement, "continuity": continuity, "visibility": visibility, "spotlight": involvement + continuity + visibility}
