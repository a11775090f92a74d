"""The registered queries: names, columns, SQL and the pipeline's stages on the smallest tables."""

import collections
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from plinth.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")
COLUMNS = {
    "op1_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op2_audio_features": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4_ngram_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op7_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_url_rules": {"page_id", "host", "path", "rule", "verdict"},
}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    rows = df.collect()
    assert rows
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        found = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert collections.Counter(tuple(r[n] for n in names) for r in rows) == collections.Counter(found.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, DATA)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < seen.count() <= docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, DATA)
    assert packed.count() == seen.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "packing"]
