"""Organizational units: segmentation, matching keys, specificity. Suffix lists are parameters with the domain's values as defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffixes, and how specific a unit with a suffix is.
SUFFIXES = ["課", "部", "局", "室", "センター", "所", "班", "係", "チーム", "事務局", "担当", "グループ", "学科", "事業所"]
RANKS = {"部": 2, "局": 2, "課": 4, "室": 4, "センター": 4, "所": 3, "係": 6, "班": 6, "チーム": 6, "グループ": 6, "担当": 7}


def unit_parts(c: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """Segments that end in a suffix, in order; the whole name where there is none."""
    s = "|".join(sorted(map(re.escape, suffixes), key=len, reverse=True))
    parts = F.filter(F.regexp_extract_all(c, F.lit(rf"([^\s　]+?(?:{s}))"), F.lit(1)), lambda x: x != "")
    whole = F.filter(F.array(F.trim(c)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def semantic_parts(parts: Column) -> Column:
    """The last two segments."""
    return F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts)


def match_key(c: Column, suffixes: list[str] = SUFFIXES) -> Column:
    return F.array_join(unit_parts(c, suffixes), "")


def display_name(c: Column, suffixes: list[str] = SUFFIXES) -> Column:
    return F.array_join(semantic_parts(unit_parts(c, suffixes)), " ")


def overlap(left: Column, right: Column) -> Column:
    """Equal, or one holds the other; blanks match nothing."""
    return F.coalesce((left != "") & (right != "") & (left.contains(right) | right.contains(left)), F.lit(False))


def specificity_rank(c: Column, ranks: dict[str, int] = RANKS) -> Column:
    """Rank of the suffix that ends the name, longest suffix first; else the largest rank inside; else 0."""
    out = F.greatest(F.lit(0), *[F.when(c.contains(s), r).otherwise(0) for s, r in ranks.items()])
    for s, r in sorted(ranks.items(), key=lambda x: len(x[0])):
        out = F.when(c.endswith(s), r).otherwise(out)
    return out


def preserve_specific(candidate: Column, matched: Column, ranks: dict[str, int] = RANKS) -> Column:
    """Whether a candidate says more than what it matched: more segments or a higher rank."""
    return (F.size(unit_parts(candidate)) > F.size(unit_parts(matched))) | (specificity_rank(candidate, ranks) > specificity_rank(matched, ranks))


def reference_score(candidate: Column, alias: Column) -> Column:
    """struct(kind, length): 3 equal, 2 alias at the start, 1 alias inside; null if the alias is blank or absent."""
    kind = F.when(candidate == alias, 3).when(candidate.startswith(alias), 2).when(candidate.contains(alias), 1)
    return F.when((alias != "") & kind.isNotNull(), F.struct(kind.alias("kind"), F.length(alias).alias("size")))


def theme_tokens(c: Column, least: int = 2, deny: list[str] = (), suffixes: list[str] = SUFFIXES) -> Column:
    """Segments with and without their suffix, ``least`` characters or more, not denied."""
    s = "|".join(sorted(map(re.escape, suffixes), key=len, reverse=True))
    parts = unit_parts(c, suffixes)
    both = F.array_union(parts, F.transform(parts, lambda x: F.regexp_replace(x, f"(?:{s})$", "")))
    return F.filter(both, lambda x: (F.length(x) >= least) & ~x.isin(list(deny) or [""]))


def theme_overlap(left: Column, right: Column, least: int = 3) -> Column:
    """A common token, or one inside the other with ``least`` characters."""
    inside = F.exists(left, lambda a: F.exists(right, lambda b: ((F.length(a) >= least) & b.contains(a)) | ((F.length(b) >= least) & a.contains(b))))
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False)) | F.coalesce(inside, F.lit(False))


def known_labels(names: list[str], general: list[str] = ()) -> list[str]:
    """Known units without blanks, the longest first; blank names and general labels are left out."""
    bare = {"".join(n.split()) for n in names if n.strip() and n.strip() not in general}
    return sorted(bare, key=lambda x: (-len(x), x))


def contains_known(c: Column, labels: list[str]) -> Column:
    """Whether a text without its blanks holds one of ``known_labels``."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s　]+", "")
    return F.exists(F.array(*map(F.lit, labels)), lambda x: bare.contains(x)) if labels else F.lit(False)
