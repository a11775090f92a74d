"""The corpus pipeline on a small folder of tables against brute force, row by row."""

import collections
import random

import numpy as np

import corpus_pipeline
from plinth.llm import packing, toxicity
from tests.llm.test_ops import brute_cut
from tests.llm.test_similar import brute


def tables(spark, folder):
    r = random.Random(21)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    text = lambda n: [r.choice(plain) for _ in range(n)]
    passage, rows, labels = " ".join(text(70)), [], []
    for i in range(0, 300, 5):
        w = text(r.randint(60, 160))
        near = list(w)
        near[len(w) // 2] = "changed"
        toxic = text(40) + ["vile", "rotten", "nasty"] * 3
        r.shuffle(toxic)
        rows += [(i, " ".join(w)), (i + 1, " ".join(near)), (i + 2, " ".join(w)), (i + 3, " ".join(toxic)), (i + 4, " ".join(text(30)) + " " + passage + " " + " ".join(text(30)))]
        labels += [(i, 1, 0), (i + 3, 1, 1), (i + 4, i % 2, 0)]
    rows += [(None, "a text without an id " * 3), (400, None), (401, ""), (402, rows[0][1]), (402, "another text of the same id")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_rows_of_the_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = toxicity.fit(docs, *toxicity.chain_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    verdict = {(x.doc_id, x.text): x.rejected for x in toxicity.score(docs, chain).collect()}
    rejected = {i for (i, _), bad in verdict.items() if bad}
    assert rejected == {i + 3 for i in range(0, 300, 5)}
    kept = [x for x in rows if not verdict[x]]
    # one row of each group of similar texts: the component of its place in the list
    at = brute([(n, t) for n, (_, t) in enumerate(kept)])
    groups = collections.defaultdict(list)
    for n, (i, _) in enumerate(kept):
        groups[at[n]].append((i is None, i or 0, n))
    one = [kept[min(g)[2]] for g in groups.values()]
    assert len(one) < len(kept)
    left = brute_cut(one)
    assert any(len(k) < n for _, n, k, _ in left)
    tokens = [(i, len(k.decode("utf-8", "ignore").split()) + 1) for i, _, k, _ in left]
    n, c = np.unique([t for _, t in tokens], return_counts=True)
    edges = packing.optimal_boundaries(n, c, packing.BUCKETS)
    want = collections.Counter((i, t, int(edges[np.searchsorted(edges, t)])) for i, t in tokens)
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((x.doc_id, x.n_tokens, x.bucket_len) for x in got) == want
    for stage in corpus_pipeline.STAGES[:-1]:
        assert stage[1](spark, docs.limit(0), folder).columns == docs.columns
