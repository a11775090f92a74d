"""CSV dimensions and facts in, reports out, processed logs, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a transfer file and of a topic file, the required ones first.
TRANSFER_COLUMNS = ["source_type", "title", "url", "published_at", "effective_date", "person_name", "from_department", "to_department", "from_title", "to_title", "evidence_snippet", "publisher", "raw_text"]
TOPIC_COLUMNS = ["source_type", "title", "url", "published_at", "summary", "raw_text", "topic_names"]
SOURCE_COLUMNS = ["url", "department_name", "source_type"]
HIERARCHY_COLUMNS = ["top_unit", "top_url", "child_name", "child_url", "tel", "fax"]


def read_csv(spark: SparkSession, path: str | list[str], required: list[str], columns: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """All-text CSV by header name; a byte order mark is dropped, a missing required column fails."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in (columns or df.columns)])


def first_by_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key in file order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(ordinal))).where("__n = 1").drop("__n")


def list_sources(spark: SparkSession, path: str, types: list[str], general: list[str]) -> DataFrame:
    """Sources with a match mode: strict for general labels, broad for specific ones; unknown types fail when read."""
    df = read_csv(spark, path, SOURCE_COLUMNS, SOURCE_COLUMNS).withColumn("ordinal", F.monotonically_increasing_id())
    checked = df.withColumn("source_type", F.when(F.col("source_type").isin(types), F.col("source_type")).otherwise(F.raise_error(F.concat(F.lit("unknown source type: "), "source_type"))))
    return first_by_key(checked, ["url", "source_type"], "ordinal").withColumn("link_match_mode", F.when(F.col("department_name").isin(general), "strict").otherwise("broad"))


def transfer_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all transfer files of a folder with their file name; templates and the index are left out."""
    df = read_csv(spark, folder, TRANSFER_COLUMNS[:11], pattern="*.csv").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.where(~F.col("file").isin("transfer_template.csv", "source_index.csv"))


def source_key(source_type: str, title: str, url: str, published: str, effective: str | None = None):
    """type:address-or-title:date"""
    day = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in (effective, published) if c], F.lit(""))
    return F.concat_ws(":", F.col(source_type), F.when(F.col(url) != "", F.col(url)).otherwise(F.col(title)), day)


def unseen(links: DataFrame, log: DataFrame, url: str = "url") -> DataFrame:
    """Links whose address is not in the processed log."""
    return links.join(log.select(url).distinct(), url, "left_anti")


def append_log(urls: DataFrame, path: str) -> None:
    urls.select("url").distinct().write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def export_by(df: DataFrame, keys: list[str], path: str) -> None:
    """One folder of CSV files per key; characters that are awkward in paths become _. Rows meet by key first, so no task writes to many folders."""
    safe = df.withColumns({f"by_{k}": F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("none")), r'[\\/:*?"<>|\s]+', "_") for k in keys})
    safe.repartition(*[f"by_{k}" for k in keys]).write.mode("overwrite").partitionBy(*[f"by_{k}" for k in keys]).option("header", True).csv(path)


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Attachments that a crawler has landed, as (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "url source_type title source_list_url source_unit summary purpose budget application_deadline submission_deadline published_at raw_text fetched_at review_status".split()] + [T.StructField("pdf_urls", T.ArrayType(T.StringType())), T.StructField("zip_urls", T.ArrayType(T.StringType()))])


def runtime_path(env: str, runtime: str, bundled: str) -> str:
    """The path that the environment names, else the runtime copy, which is made from the bundled file where there is none yet."""
    import os
    import shutil
    from pathlib import Path

    named = os.environ.get(env, "").strip()
    if named:
        return named
    if not Path(runtime).exists() and Path(bundled).exists():
        Path(runtime).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(bundled, runtime)
    return runtime if Path(runtime).exists() else bundled


def bootstrap(folder: str, seeds: dict[str, str], force: bool = False) -> dict[str, int]:
    """Seed files copied into a runtime folder, {name: path}; existing ones stay unless forced. Counts of copied and kept."""
    import shutil
    from pathlib import Path

    out = {"copied": 0, "kept": 0}
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, path in seeds.items():
        target = Path(folder) / name
        fresh = force or not target.exists()
        if fresh:
            shutil.copy2(path, target)
        out["copied" if fresh else "kept"] += 1
    return out


def read_hierarchy(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Units in two levels: rows without a top unit are left out, addresses are absolute, with the keys that names are matched by."""
    from plinth.functions import text as N
    from plinth.operators.extraction import absolute_url

    df = read_csv(spark, path, HIERARCHY_COLUMNS[:2], HIERARCHY_COLUMNS).where(F.trim("top_unit") != "")
    for c in ("top_url", "child_url"):
        df = df.withColumn(c, F.when(F.col(c) == "", "").otherwise(absolute_url(F.lit(base), F.col(c))) if base else F.col(c))
    return df.withColumns({"top_key": N.compact(F.col("top_unit")), "child_key": N.compact(F.col("child_name"))})


#: Tables of an archive and their columns; ``empty_archive`` makes them without rows.
ARCHIVE_SCHEMAS = {
    "records": "record_id long, url string, title string, source_type string, source_unit string, published_at string, fetched_at string, raw_text string, review_status string",
    "mentions": "mention_id long, record_id long, unit_id long, unit_raw string, party_raw string, quality string, confidence double, email string, phone string",
    "mention_links": "mention_id long, party_id long, link_status string, confidence double",
    "parties": "party_id long, party_key string, display_name string, is_verified int, note string",
    "units": "unit_id long, name string, top_unit string",
    "slots": "slot_id long, party_id long, name_norm string, unit_id long, title string, active_from string, active_to string, confidence double",
    "transfers": "event_id long, effective string, name_norm string, from_unit_id long, to_unit_id long, title string",
    "transfer_links": "event_id long, party_id long, link_status string, confidence double",
    "record_topics": "record_id long, topic string, is_priority int, confidence double",
    "rollups": "party_id long, topic string, spotlight double",
    "notes": "note_id long, party_id long, record_id long, title string, content string, created_at string",
}


def empty_archive(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in ARCHIVE_SCHEMAS.items()}


def backfill(mentions: DataFrame, appearances: DataFrame) -> DataFrame:
    """mentions and a row for every appearance (record_id, unit_raw, party_raw, email, phone) of records without any: quality from
    the name, and a confidence of 0.9 with a contact, 0.7 with a name, 0.5 with a unit, else 0 (fixed values)."""
    from plinth.functions import text as N

    none = appearances.join(mentions.select("record_id").distinct(), "record_id", "left_anti")
    contact = ~N.blank(F.col("email")) | ~N.blank(F.col("phone"))
    confidence = F.when(contact, 0.9).when(~N.blank(F.col("party_raw")), 0.7).when(~N.blank(F.col("unit_raw")), 0.5).otherwise(0.0)
    new = none.select("record_id", "unit_raw", "party_raw", N.name_quality(F.col("party_raw")).alias("quality"), confidence.alias("confidence"), "email", "phone")
    return mentions.select(*new.columns).unionByName(new)


def source_urls(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """The distinct non-blank addresses of a source index."""
    df = read_csv(spark, path, [column])
    return df.where(F.trim(column) != "").select(F.trim(column).alias("url")).distinct()
