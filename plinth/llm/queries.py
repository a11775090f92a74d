"""Queries over the driver's tables, one per training-data operator, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import audio, bpe, embedding_dedup, ngram_lm, packing, sharding, simhash, suffix_dedup, toxicity, url_rules
from plinth.llm.common import Scratch
from plinth.session import table

#: The vocabulary of op7, read where the driver runs.
TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The rules of op8 (fixed values).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup.near_duplicates(vectors)


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = audio.tensor_digest(audio.audio_features(audio.store_audio(docs)))
    active = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"])
    return got.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "digest", F.size("segments").cast("string"), F.format_number(active, 3)).alias("feature"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels, names = toxicity.chain_labels(table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels, names))
    return scored.select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.BigramModel.fit(docs).score(docs)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, k=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = suffix_dedup.cut_repeats(docs)
    left = F.length("kept").cast("long")
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(tokenizer)
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, raw="raw")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Arrivals that op10 deals the documents into.
ARRIVALS = 12


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, Scratch(spark, "shards").path())
    store.append(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)).cast("int"), ARRIVALS)
    store.compact(vacuum=True)
    return store.read().select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_audio_features": op2_audio_features,
        "op3_toxicity": op3_toxicity,
        "op4_ngram_lm": op4_ngram_lm,
        "op5_simhash": op5_simhash,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_url_rules": op8_url_rules,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
    }


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
), r(h, p, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id
"""


OP10_SQL = """
SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_url_rules": OP8_SQL, "op10_sharding": OP10_SQL}
