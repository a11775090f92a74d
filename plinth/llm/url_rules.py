"""URL filters: host and path rules, indexed by their rarest literal token. DataFrame functions only.

A rule (host, path, action) compiles to one regular expression for the host and one for the path. Each rule stands in the
index under one of its literal tokens only, the one that the fewest rules have; a url fetches the rules that stand under
its own tokens, and only those run their expressions. The longest rule (host and path together) that fits decides; of
equally long ones the one whose text, then whose action, comes last in the alphabet, so block goes before allow.

Defined cases: a url that is null or has no ``://`` has empty host and path and fits no rule; hosts and paths may hold any
character, line breaks too; very long urls count whole; repeated rows give repeated results; an empty table gives an empty
result; other columns stay as they are, but input columns named like an output (host, path, rule, verdict) are replaced,
and helper columns have names that do not clash. Without a fitting rule the verdict is ``default``.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (host, path, action)
Rule = tuple[str, str, str]
#: Beyond this many rules the index is a table that is joined, no longer a literal in the plan.
INLINE_RULES = 100
_P = "__plinth_url_"


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def index_rules(rules: list[Rule]) -> list[dict]:
    """One entry per rule with its index token, expression and length; rules without a token stand under ''."""
    seen = Counter(t for host, path, _ in rules for t in set(tokens_of(host) + _whole_tokens(path)))
    out = []
    for host, path, action in rules:
        own = sorted(set(tokens_of(host) + _whole_tokens(path)), key=lambda t: (seen[t], -len(t), t))
        out.append({"token": own[0] if own else "", "rule": host + path, "size": len(host + path), "action": action, "host": rf"(?s)\A(?:.*\.)?{_quoted(host.lower())}\z", "path": rf"\A{_quoted(path)}"})
    return out


def _quoted(text: str) -> str:
    """A Java expression for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _whole_tokens(path: str) -> list[str]:
    """Tokens of a path prefix that any url with that prefix has as whole tokens: the last may go on."""
    parts = re.split(r"[^a-z0-9]+", path.lower())
    return [t for t in parts[:-1] if t]


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """pages plus host, path, rule (null if none fits) and verdict.

    Up to ``inline`` rules the index is a literal map from token to rules and the job is one projection without a shuffle.
    A larger index is a table that the tokens of the distinct (host, path) pairs are joined with, and which Spark broadcasts
    while it is small; the best rule of a pair then comes back to all its rows.
    """
    index = index_rules(rules)
    clash = {"host", "path", "rule", "verdict"} & set(pages.columns) - {url_col}
    base = pages.drop(*clash).withColumns({f"{_P}host": host_of(F.col(url_col)), f"{_P}path": path_of(F.col(url_col))})
    host, path = F.col(f"{_P}host"), F.col(f"{_P}path")
    url_tokens = F.array_distinct(F.concat(F.split(F.lower(F.concat(host, F.lit(" "), path)), r"[^a-z0-9]+"), F.array(F.lit(""))))
    kept = [c for c in pages.columns if c not in clash | {"host", "path", "rule", "verdict"}]
    best = F.col(f"{_P}best")
    out = [*kept, host.alias("host"), path.alias("path"), best["rule"].alias("rule"), F.coalesce(best["action"], F.lit(default)).alias("verdict")]
    if len(index) <= inline:
        groups: dict[str, list[Column]] = {}
        for e in index:
            groups.setdefault(e["token"], []).append(F.struct(*[F.lit(e[n]).alias(n) for n in _FIELDS]))
        if not groups:
            return base.withColumn(f"{_P}best", F.lit(None).cast("struct<rule: string, action: string>")).select(*out)
        found = F.create_map(*[x for t, own in groups.items() for x in (F.lit(t), F.array(*own))])
        fetched = F.flatten(F.filter(F.transform(url_tokens, lambda t: F.try_element_at(found, t)), lambda x: x.isNotNull()))
        fits = F.filter(fetched, lambda x: F.rlike(path, x["path"]) & F.rlike(host, x["host"]))
        return base.withColumn(f"{_P}best", F.array_max(fits)).select(*out)
    table = _table(pages.sparkSession, index)
    distinct = base.select(host, path).distinct().withColumn("token", F.explode(url_tokens))
    hits = distinct.join(table, "token").where(F.rlike(path, F.col("path")) & F.rlike(host, F.col("host")))
    top = hits.groupBy(host, path).agg(F.max(F.struct("size", "rule", "action")).alias(f"{_P}best"))
    return base.join(top, [f"{_P}host", f"{_P}path"], "left").select(*out)


#: What an entry has besides its token, in the order that decides between rules.
_FIELDS = ("size", "rule", "action", "host", "path")


def _table(spark: SparkSession, index: list[dict]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "size" else T.StringType()) for n in ("token", *_FIELDS)])
    return spark.createDataFrame([tuple(e[f.name] for f in schema) for e in index], schema)
