"""Each operator against brute force, and the edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import json
import math
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from plinth.llm import audio, bpe, embedding_dedup, ngram_lm, packing, sharding, simhash, suffix_dedup, toxicity, url_rules
from plinth.llm.common import Scratch, connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.choice([3, 40, 300]))) for _ in range(24)]
    out = [*base, base[1], base[1], base[2].replace("a", "a ", 1), "", None, "   \t\n", "A\x0bB", "x" * 5000, "ab" * 900, "é" * 400]
    out += [base[5][:50] + PASSAGE + base[6][:70], PASSAGE + base[7], "I'm  here\u00a0now 123 \u4f60\u597d\U0001f600!!"]
    return [(i if i != 20 else None, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts()]
    rows.append(rows[3])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)] + [(500, i) for i in range(501, 560)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), Scratch(spark, "test"))
    want = {x: find(x) for p in pairs for x in p if p[0] != p[1]}
    assert {r.node: r.component for r in got.collect()} == want


# 1 embeddings


def test_embeddings(spark):
    g = np.random.default_rng(0)
    near = g.normal(size=(1, 16)) + 0.05 * g.normal(size=(60, 16))
    far = g.normal(size=(60, 16))
    x = np.concatenate([near, far, near[:1], near[:1] * 2, near[:1] * 0.5]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2, "clash") for i, v in enumerate(x)]
    rows += [(200, None, 1, ""), (201, [0.0] * 16, 1, ""), (202, [float("nan")] * 16, 1, ""), (203, [1.0, None] + [0.0] * 14, 1, ""), (204, rows[0][1], None, ""), (205, [1.0], 1, ""), (206, [2.0], 1, ""), (207, [], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, _, _ in rows if v and i not in (201, 202, 203, 204)}
    label = {i: lab for i, _, lab, _ in rows}
    link = {a: {b for b in unit if b != a and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93} for a in unit}
    for kw in ({"recall": 1.0}, {"recall": 1.0, "block": 7, "visitors": 5, "codes": 4}):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, **kw).collect()}
        assert len(got) == len(rows)
        for i in label:
            want, seen = {i}, [i]
            while seen:
                seen = [b for a in seen for b in link.get(a, ()) if b not in want]
                want |= set(seen)
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(link.get(i, ())), min(want), i == min(want)), i
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id = 200")).first().component_id == 200


def test_multi_sequence_is_in_order():
    a, b = np.array([[0.0, 0.3, 0.1]]), np.array([[0.2, 0.0]])
    row, i, j = embedding_dedup.multi_sequence(a, b, 0.35)
    assert list(zip(i, j)) == [(0, 1), (2, 1), (0, 0), (1, 1), (2, 0)] and set(row) == {0}


def test_index_recall(spark):
    g = np.random.default_rng(1)
    base = g.normal(size=(150, 32))
    x = np.concatenate([base, base + 0.06 * g.normal(size=base.shape)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.93
    got = sum(r.n_links for r in embedding_dedup.near_duplicates(df).collect())
    assert 0.9 * (s.sum() - len(x)) <= got <= s.sum() - len(x)


# 2 audio


def test_audio(spark, docs, empty):
    stored = audio.store_audio(docs.withColumn("media", F.lit("clash")).withColumn("tensors", F.lit(1)))
    got = audio.audio_features(stored).collect()
    assert len(got) == docs.count()
    want = collections.defaultdict(list)
    for i, t in texts():
        raw = (t or "").encode()
        want[i].append(raw + b" " * ((-len(raw)) % 192 if raw else 192))
    seen = {}
    for r in got:
        payload = bytes(r.payload)
        assert payload in want[r.doc_id] and len(payload) % 192 == 0
        assert bytes(r.media)[44:] == payload and audio.read_wav(bytes(r.media))[0] == audio.RATE
        t = audio.read_tensors(bytes(r.tensors))
        assert t.schema.field("values").type.shape == [audio.FRAMES, audio.MELS] and t.num_rows >= 1
        assert np.allclose(np.diff(t["start_s"].to_numpy()), audio.FRAMES * audio.HOP / 6000) and t["start_s"][0].as_py() == 0
        assert seen.setdefault(payload, (r.tensors, r.segments)) == (r.tensors, r.segments)
    assert audio.audio_features(audio.store_audio(empty)).count() == 0
    digests = {bytes(r.media): r.digest for r in audio.tensor_digest(audio.audio_features(stored)).collect()}
    assert len(set(digests.values())) >= 0.9 * len(digests)
    none = audio.tensor_digest(audio.audio_features(spark.createDataFrame([(1, None)], "doc_id int, media binary"))).first()
    assert none.payload is None and none.segments is None and none.digest is None


@pytest.mark.parametrize("up, down", [(audio.UP, audio.DOWN), (1, 2), (3, 2), (2, 3), (5, 7)])
def test_resampling_against_the_dense_filter(up, down):
    """Zeros between the inputs, the whole filter at every place, then every down-th output: each phase gives the same."""
    x = np.random.default_rng(3).normal(size=1000).astype(np.float32)
    phases = audio.resampling_filter(up, down)
    taps = phases.shape[1]
    whole = phases.T.ravel()
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    full = np.convolve(spread, whole)
    n = -(-len(x) * up // down)
    want = [full[k] if 0 <= (k := m * down + (taps - 1 - taps // 2) * up) < len(full) else 0.0 for m in range(n)]
    got = audio.resample(x, up, down)
    assert phases.shape[0] == up and len({m * down % up for m in range(n)}) == up
    assert len(got) == n and np.abs(got - want).max() < 1e-4
    assert np.allclose(audio.resample(x, up, down, 101, 333), got[101:333], atol=1e-6)


def test_filterbank_and_energy():
    """The log-mel of a few frames by the plain formulas, and blocks of frames against the whole recording."""
    samples = np.random.default_rng(4).integers(0, 256, 60_000).astype(np.uint8)
    rate = audio.RATE * audio.UP / audio.DOWN
    y = audio.resample((samples.astype(np.float32) - 128) / 128).astype(np.float64)
    whole, spans = audio.features_of(samples)
    flat = whole.reshape(-1, audio.MELS)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    energies = []
    for frame in range(audio.frame_count(len(y))):
        part = np.zeros(audio.WINDOW)
        own = y[frame * audio.HOP : frame * audio.HOP + audio.WINDOW]
        part[: len(own)] = own
        part *= 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / (audio.WINDOW - 1))
        energies.append(10 * math.log10(max((part**2).sum() / audio.WINDOW, 1e-8)))
        if frame % 50:
            continue
        for m in range(audio.MELS):
            total = 0.0
            for k in range(audio.WINDOW // 2 + 1):
                f = k * rate / audio.WINDOW
                weight = max(0.0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1])))
                if weight:
                    total += weight * abs((part * np.exp(-2j * np.pi * k * np.arange(audio.WINDOW) / audio.WINDOW)).sum()) ** 2 / audio.WINDOW
            assert abs(flat[frame, m] - 10 * math.log10(max(total, 1e-8))) < 0.05
    assert (flat[len(energies) :] == audio.FLOOR_DB).all()
    assert spans.tolist() == audio.hysteresis(np.array(energies)).tolist()
    for block in (1, 7, 100):
        cut, own = audio.features_of(samples, block)
        assert np.abs(cut - whole).max() < 0.02 and own.tolist() == spans.tolist()


def test_segments():
    e = np.array([-30, -20, -10, -20, -30, -20, -30, -17, -17], float)
    assert audio.hysteresis(e, -12, -25).tolist() == [[1, 4]]
    assert audio.hysteresis(e, -18, -25).tolist() == [[1, 4], [7, 9]]


# 3 toxicity


def test_toxicity(spark, empty):
    r = random.Random(5)
    plain, bad = [f"word{chr(97 + i)}" for i in range(26)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(900):
        toxic, low = r.random() < 0.2, r.random() < 0.3
        words = [r.choice(plain) for _ in range(30)] + [r.choice(bad) for _ in range(2)] * toxic + ["junk"] * low
        r.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 0, toxic))
        if i % 2:
            labels.append((i, int(not low), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, p_toxic string, rejected int, truth boolean")
    lab, names = toxicity.chain_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    chain = toxicity.fit(df, lab, names)
    got = [(x.truth, x.rejected) for x in toxicity.score(df.where("doc_id % 2 = 0"), chain).collect()]
    assert sum(a == b for a, b in got) >= 0.98 * len(got)
    assert chain.links[1].weights is not None and len(chain.links[1].weights) == int(chain.links[1].feature.max()) + 1 + 1 + 1
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "vile " * 30000, "x")], "doc_id long, text string, rejected string")
    out = toxicity.score(odd, chain).collect()
    assert len(out) == 4 and [x.rejected for x in out if x.doc_id == 2] == [True]
    assert toxicity.score(odd, chain, drop=True).columns == odd.columns
    assert toxicity.score(empty, chain).count() == 0
    none = toxicity.fit(df, lab.limit(0), names)
    assert {x.rejected for x in toxicity.score(odd, none).collect()} == {False}
    one = toxicity.fit(df, lab.where("toxic = 0"), names)
    assert one.links[1].constant == 0.0


def test_chain_is_a_plain_fit(spark):
    """Each link of the chain against a dense logistic regression on the same features, with its own out-of-fold inputs."""
    r = random.Random(11)
    rows, labels = [], []
    for i in range(500):
        a, b = r.random() < 0.4, r.random() < 0.3
        own = [r.choice("pq") * 4 for _ in range(4)] + ["low"] * (r.random() < (0.8 if a else 0.2)) + ["vile"] * (r.random() < (0.7 if b else 0.1)) + ["rude"] * (r.random() < (0.6 if b or a else 0.2))
        rows.append((i, " ".join(own)))
        labels.append((i, None if i % 9 == 0 else int(a), None if i % 7 == 0 else int(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, a int, b int"), ["a", "b"])
    ids = spark.createDataFrame([(i,) for i in range(500)], "id long")
    fold = {x.id: x.f for x in ids.select("id", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("f")).collect()}

    def bucket(w):
        return int(toxicity.word_buckets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])

    def dense(x, y, steps=50):
        """Newton's method on the whole matrix."""
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        w, ridge = np.zeros(x.shape[1]), np.diag([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-6])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x) + ridge, x.T @ (p - y) + ridge @ w)
        return w

    vocabulary = sorted({w for _, t in rows for w in t.split()})
    has = np.array([[w in t.split() for w in vocabulary] for _, t in rows], float)

    def telling(mask, y):
        """The features by the z-score of their log-odds, worked out from the rows."""
        out = []
        for k in range(len(vocabulary)):
            a, b = (has[mask, k] * y[mask]).sum(), (has[mask, k] * (1 - y[mask])).sum()
            n1, n0 = y[mask].sum(), (1 - y[mask]).sum()
            z = abs(math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if z >= toxicity.LEAST_Z:
                out.append(k)
        return out

    before = np.zeros((500, 0))
    folds = np.array([fold[i] for i in range(500)])
    for c in range(2):
        y = np.array([np.nan if x[c + 1] is None else x[c + 1] for x in labels], float)
        known = ~np.isnan(y)
        own = telling(known, y)
        w = dense(np.concatenate([has[known][:, own], before[known]], axis=1), y[known])
        link = chain.links[c]
        assert sorted(np.flatnonzero(link.feature >= 0)) == sorted(bucket(vocabulary[k]) for k in own)
        got = [link.weights[link.feature[bucket(vocabulary[k])]] for k in own]
        assert np.abs(np.concatenate([got, link.weights[len(own) :]]) - w).max() < 0.02
        held = np.zeros(500)
        for k in range(toxicity.FOLDS):
            inside = known & (folds != k)
            part = telling(inside, y)
            v = dense(np.concatenate([has[inside][:, part], before[inside]], axis=1), y[inside])
            score = np.concatenate([has[:, part], before, np.ones((500, 1))], axis=1) @ v
            held = np.where(folds == k, 1 / (1 + np.exp(-score)), held)
        held = np.clip(held, 1e-4, 1 - 1e-4)
        before = np.concatenate([before, np.log(held / (1 - held))[:, None]], axis=1)


# 4 language model


def dict_score(texts, learn, hot):
    """The documented formula from dictionaries; texts and learn are lists of tokens with an end."""
    c = collections.Counter(w for x in learn for w in x)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for x in learn for p in zip([0, *x], x))
    history = collections.Counter()
    for (a, _), m in pairs.items():
        history[a] += m
    follow = collections.Counter(a for a, _ in pairs)
    level = lambda m: ngram_lm.VALUES[ngram_lm.levels_of(np.array([m]))[0]] if m else 0.0
    out = []
    for x in texts:
        total = 0.0
        for a, b in zip([0, *x], x):
            p1 = (c[b] + 1) / (n + v + 1)
            exact = a in (0, None) or a in hot
            m, t = (history[a], follow[a]) if exact else (level(history[a]), level(follow[a]))
            q = level(pairs[a, b])
            total += math.log10((q + t * p1) / (max(m, q) + t) if m else p1)
        out.append(total)
    return out


def test_language_model(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    token = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learn = [token(t) for i, t in rows if not out(i)]
    every = collections.Counter(w for _, t in rows for w in token(t))
    c = collections.Counter(w for x in learn for w in x)
    n, v = sum(c.values()), len(c)
    for kw, hot in (({}, every), ({"hot": 20, "segment_keys": 150}, None), ({"hot": 20, "segment_keys": 150, "shard_mb": 0}, None)):
        hot = hot if hot is not None else {w for w, m in every.items() if m * 20 >= sum(every.values())}
        want = collections.Counter()
        for (i, t), s in zip(rows, dict_score([token(t) for _, t in rows], learn, hot)):
            want[(i, out(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t)), 4), round(s, 3))] += 1
        model = ngram_lm.BigramModel.fit(docs.withColumn("h", F.lit(1)), bits=96, **kw)
        got = model.score(docs.repartition(3)).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 3)) for r in got) == want
    assert ngram_lm.BigramModel.fit(empty).score(empty).count() == 0
    assert ngram_lm.BigramModel.fit(empty).score(docs).count() == len(rows)
    assert ngram_lm.BigramModel.fit(empty, shard_mb=0).score(docs).count() == len(rows)


def test_language_model_leaves_no_shuffle_files(spark, docs, monkeypatch):
    """A filter that is not broadcast: waves give the scores of the broadcast one, and their files on disk go with them."""
    monkeypatch.setattr(ngram_lm, "WAVE_TOKENS", 10_000, raising=False)
    r = np.random.default_rng(4)
    many = spark.createDataFrame([(1000 + i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 300) % 5000)) for i in range(150)], docs.select("doc_id", "text").schema)
    many = docs.select("doc_id", "text").unionAll(many).unionAll(many.where("doc_id < 1003"))
    tokens = sum(len((x.text or "").encode().split()) + 1 for x in many.collect())

    def on_disk():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    kw, got = {"hot": 20, "segment_keys": 100, "bits": 96}, []
    for shard_mb in (96, 0):
        model = ngram_lm.BigramModel.fit(many, shard_mb=shard_mb, **kw)
        before = on_disk()
        scored = model.score(many, part_bytes=3000)
        got.append(collections.Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4), round(x.score, 3)) for x in scored.toLocalIterator()))
    assert got[0] == got[1] and got[0].total() == many.count()
    until = time.monotonic() + 20
    while (left := (on_disk() - before) / tokens) > 4 and time.monotonic() < until:  # files go in the background
        time.sleep(0.5)
    assert left <= 4


def test_language_model_asks_once():
    """What a slice asks for does not grow with the number of segments and parts, and repeated bigrams are asked for once."""
    r = np.random.default_rng(5)
    text = " ".join(f"w{x}" for x in r.integers(0, 20_000, 40_000))
    ids = pa.array(range(4), pa.int64())
    batch = pa.record_batch([ids, pa.array([text, text, None, "w1 w2"]), pa.array([False] * 4), ids], names=["doc_id", "text", ngram_lm._HELD, ngram_lm._ROW])
    hot = {"keys": np.array([ngram_lm.START]), "train": np.array([4]), "followers": np.array([2]), "bigrams": np.zeros(0, np.uint64), "levels": np.zeros(0, np.int64)}
    every = [[*(t or "").split(), None] for t in batch["text"].to_pylist()]
    distinct, sizes = [len({p for x in every for p in zip([0, *x], x)}), len({w for x in every for w in x})], []
    for n in (1, 300):
        (got,) = ngram_lm._ask("doc_id", "text", n, ngram_lm._Sender(n, hot, 80_000, 20_000))(iter([batch]))
        kinds = got["kind"].to_pylist()
        asked = [sum(len(x) for k, x in zip(kinds, got["asked"].to_pylist()) if k == kind) // 8 for kind in (ngram_lm._GRAMS, ngram_lm._RARE)]
        assert asked == distinct
        assert got["ids"].to_pylist() == [ids.to_pylist()] + [[]] * (len(kinds) - 1)
        sizes.append(got.nbytes)
    assert sizes[1] < 1.1 * sizes[0]


def test_filter_counts_are_close():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    counts = np.maximum(1, r.geometric(0.1, len(keys)))
    bits, _, _, _ = ngram_lm.build_segment(keys, counts, np.zeros(0, np.uint64))
    shard = ngram_lm.Shard(0, np.zeros(1, np.int64), np.array([len(bits) * 8]), bits.tobytes())
    found = shard.levels(np.zeros(len(keys), np.int64), keys)
    assert (found >= ngram_lm.levels_of(counts)).all() and (found == ngram_lm.levels_of(counts)).mean() > 0.93
    absent = shard.levels(np.zeros(2000, np.int64), r.integers(0, 2**63, 2000).astype(np.uint64))
    assert (absent > 0).mean() < 0.06


# 5 simhash


@pytest.mark.parametrize("distance, bucket", [(2, 64), (2, 1), (3, 1)])
def test_simhash_links(spark, distance, bucket):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {0, 1, 3}
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = scratch.write(simhash.link_fingerprints(df, scratch, distance, bucket))
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= distance * (1 if bucket > 1 else 1) or bucket == 1 for e in edges.collect())
    part = {e.node % 2**64: e.component for e in connected_components(edges, scratch).collect()}
    groups = collections.defaultdict(set)
    for f in fps:
        groups[part.get(f, ("alone", f))].add(find(f))
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len({find(f) for f in fps})


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()
    assert len(got) == docs.count()

    def reference(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    want = collections.Counter((i, reference(t)) for i, t in [*texts(), texts()[3]])
    assert collections.Counter((r.doc_id, r.fp % 2**64) for r in got) == want
    blank = [r.component_id for r in got if r.fp == 0]
    assert len(blank) == 3 and len(set(blank)) == 1 and blank[0] == min(r.doc_id for r in got if r.fp == 0)
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_documents(spark, docs, empty):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        near, far = list(w), list(w)
        for j in (20, 150, 290):
            near[j] = word()
        for j in range(0, 300, 8):
            far[j] = word()
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(far)), (300 + i, " ".join(w).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kw in ({}, {"block_rows": 2, "hot_times": 2}):
        got = {x.doc_id: x.component_id for x in simhash.similar_documents(df, **kw).collect()}
        assert all(got[i] == i and got[300 + i] == i and got[200 + i] == 200 + i for i in range(40))
        assert sum(got[100 + i] == i for i in range(40)) >= 38
    assert simhash.similar_documents(empty).count() == 0
    assert simhash.similar_documents(docs).count() == docs.count()


# 6 suffix arrays


def brute_cut(rows, length=100):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s : s + length], (i, s)) != (i, s):
                gone[s] += 1
                gone[s + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        out.append((i, len(b), np.frombuffer(b, np.uint8)[~mask].tobytes(), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())))
    return out


@pytest.mark.parametrize("cap", [2000, 1])
def test_suffix_cut(spark, docs, cap):
    got = suffix_dedup.cut_repeats(docs.withColumn("spans", F.lit("clash")), cap=cap).collect()
    want = brute_cut([*texts(), texts()[3]])
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == collections.Counter(want)


def test_suffix_edges(spark, empty):
    assert suffix_dedup.cut_repeats(empty).count() == 0
    df = spark.createDataFrame([(1, "é" * 80), (2, "x" + "é" * 80), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(df, as_text=True).collect()}
    assert out[3] is None and set(out[1]) == {"é"} and out[2].startswith("x")


def test_transform_merge_matches_sorting():
    r = random.Random(9)
    rows = ["".join(r.choice("ab") for _ in range(r.randint(1, 30))).encode() for _ in range(40)]
    for size in (40, 200, 10_000):
        interval, row, place = suffix_dedup.repeated_windows(rows, 8, shard_bytes=size)
        got = collections.defaultdict(list)
        for i, a, b in zip(interval, row, place):
            got[i].append(rows[a][b : b + 8])
        assert all(len(set(x)) == 1 for x in got.values())
        want = collections.Counter(x[i : i + 8] for x in rows for i in range(len(x) - 7))
        assert {x[0]: len(x) for x in got.values()} == {k: n for k, n in want.items() if n > 1}
    for step in (1, 2, 4):
        shards = [suffix_dedup.shard_transform(rows[:20], step), suffix_dedup.shard_transform(rows[20:], step)]
        order, lcp = suffix_dedup.merge_transforms(shards, 12, step)
        n = len(shards[0][0])
        suffix = [rows[shards[0][0][k]][shards[0][1][k] :] if k < n else rows[20 + shards[1][0][k - n]][shards[1][1][k - n] :] for k in order]
        assert [s[:12] for s in suffix] == sorted(s[:12] for s in suffix)
        common = [len(os.path.commonprefix([a, b])) for a, b in zip(suffix, suffix[1:])]
        assert [min(c, 12) // step * step for c in common] == lcp[1:].tolist()


# 7 BPE


def test_bpe(spark, docs, empty):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), ranks, public_tokenizers.PATTERN), ranks, raw="raw").collect()
    want = collections.Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in [*texts(), texts()[3]])
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(bytes(r.raw) == np.array(r.ids, "<u4").tobytes() for r in got)
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_is_bounded():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    e = bpe.Encoder(ranks, public_tokenizers.PATTERN, size=3)
    text = "some words that are more than three of them"
    assert e.encode(text) == bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(text) and len(e.cache) <= 3


def test_bpe_trees_side_by_side():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(6)
    forest = bpe.Forest(ranks)
    for width in (8, 16, 64):
        pieces = [bytes(r.choice(b"etaoin \xc3\xa9\xff\x00zq") for _ in range(r.randint(1, width))) for _ in range(400)] + [b"aaaaaaaa", b"ab" * (width // 2)]
        want = [bpe.merge(p, ranks) for p in pieces]
        got = [np.frombuffer(x, "<u4").tolist() for x in forest.merge(pieces, width)]
        assert all(g == w for g, w, p in zip(got, want, pieces) if p not in ranks)


def test_bpe_without_a_byte():
    """A byte that has no rank cannot be encoded, whichever way its match is merged."""
    ranks = {b"a": 0, b"b": 1, b"ab": 2}
    for encode in (lambda p: bpe.merge(p, ranks), lambda p: bpe.Forest(ranks).merge([p, b"ab"], 8)):
        with pytest.raises(KeyError):
            encode(b"abx")


# 8 urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


@pytest.mark.parametrize("inline", [500, 0])
def test_url_rules(spark, inline):
    urls = ["http://a.example.com/en/x?q#f", "https://WWW.Example.com/en/", "https://www.example.com/EN/", "x://example.com", "http://example.com/", "http://notexample.com/en/", "http://net/es/1", "ftp://a.net/fr/", "no scheme", "", None, "http://h.com?x=http://b", "http://a://b/c", "http://\u00e9.com/en/", "http://a\nb.example.com/en/x", "http://example.com\n/en/", "http://example.com/en/\nx", "http://x." + "a" * 9000 + ".com/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")

    def reference(u):
        rest = (u or "").split("://", 1)
        if len(rest) < 2:
            return "", "", None, "allow"
        cut = min((rest[1].find(c) for c in "/?#" if c in rest[1]), default=len(rest[1]))
        host = "".join(c.lower() if c.isascii() else c for c in rest[1][:cut])
        path = rest[1][cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, RULES, inline=inline).collect()}
    assert got == {i: reference(u) for i, u in enumerate([*urls, urls[0]])}
    assert url_rules.judge_urls(df.limit(0), RULES, inline=inline).count() == 0


@pytest.mark.parametrize("inline", [500, 0])
def test_odd_rules(spark, inline):
    """Rules with marks of the expression language, without tokens, and equal rules: block goes first."""
    rules = [("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("b.com", "/(\\E.*", "block"), ("", "/", "allow"), ("c.com", "/p", "block")]
    urls = ["http://a.com/x1", "http://b.com/(\\E.*z", "http://b.com/zzz", "http://.com/", "http://c.com/p9", "http://cc.com/p"]
    df = spark.createDataFrame([(u, "r") for u in urls], "url string, rule string")
    got = [(r.rule, r.verdict) for r in url_rules.judge_urls(df, rules, default="none", inline=inline).orderBy(F.expr("array_position(array(" + ",".join("'" + u.replace("\\", "\\\\") + "'" for u in urls) + "), url)")).collect()]
    assert got == [("a.com/x", "block"), ("b.com/(\\E.*", "block"), (None, "none"), (None, "none"), ("c.com/p", "block"), (None, "none")]
    assert url_rules.judge_urls(df, [], inline=inline).columns == ["url", "host", "path", "rule", "verdict"]


def test_rules_stand_under_their_rarest_token():
    index = {e["rule"]: e["token"] for e in url_rules.index_rules(RULES)}
    assert index["www.example.com/en/"] == "www" and index["net/es/"] in ("net", "es")


# 9 packing


def test_boundaries_are_optimal():
    from itertools import combinations

    r = random.Random(4)
    for _ in range(20):
        n = r.randint(1, 8)
        lengths = np.array(sorted(r.sample(range(1, 50), n)))
        counts = np.array([r.randint(1, 9) for _ in range(n)])
        cost = lambda edges: sum(c * min(e for e in edges if e >= x) for x, c in zip(lengths, counts))
        for k in (1, 2, 3):
            best = min(cost([*e, lengths[-1]]) for m in range(k) for e in combinations(lengths[:-1], m))
            got = packing.optimal_boundaries(lengths, counts, k)
            assert len(got) <= k and cost(got) == best


def test_boundaries_of_many_lengths():
    """Against the plain program over all lengths."""
    r = np.random.default_rng(7)
    lengths = np.unique(np.concatenate([r.integers(1, 3000, 500), r.integers(3000, 40_000, 200)]))
    counts = r.integers(1, 1000, len(lengths)) * r.integers(1, 3, len(lengths)) ** 8
    below = np.concatenate([[0], np.cumsum(counts)])
    best = lengths * below[1:]
    for k in range(2, 9):
        best = np.array([min([best[j], *(best[:j] + (below[j + 1] - below[1 : j + 1]) * lengths[j])]) for j in range(len(lengths))])
        edges = packing.optimal_boundaries(lengths, counts, k)
        assert len(edges) <= k and (counts * edges[np.searchsorted(edges, lengths)]).sum() == best[-1]


def test_packing(spark, docs, empty):
    got = packing.pack(docs.withColumn("bucket", F.lit("clash")), buckets=4, budget=700).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len((t or "").encode().split()) + 1) for i, t in [*texts(), texts()[3]])
    assert all(r.n_tokens <= r.bucket_len for r in got) and len({r.bucket for r in got}) <= 4
    batches = collections.defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), own in batches.items():
        room = max(1, 700 // own[0].bucket_len)
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
        if (bucket, batch + 1) in batches:
            assert len(own) == room
    assert packing.pack(empty).count() == 0
    alike = spark.createDataFrame([(None, "a b")] * 500, "doc_id long, text string")
    assert sorted((r.batch, r.slot) for r in packing.pack(alike, budget=30).collect()) == [(i // 10, i % 10) for i in range(500)]


# 10 sharding


def test_shards(spark, docs, empty, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=3, target_bytes=1 << 20)
    assert store.manifest()[0] == 0
    odd = docs.withColumn("extra", F.lit("x"))
    store.append(odd, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)).cast("int"), 5)
    assert store.versions() == [1, 2, 3, 4, 5] and store.read(2).count() < store.read().count()
    first = [r.path for r in store.manifest(5)[1]]
    store.compact(vacuum=False)
    version, runs, _ = store.manifest()
    assert version > 5 and len(runs) < 3 and not {r.path for r in runs} & set(first)
    key = lambda df: collections.Counter(map(tuple, df.collect()))
    assert key(store.read()) == key(odd) == key(store.read(5))
    store.append(odd.limit(0))
    assert key(store.read()) == key(odd)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(version, [], None)
    assert json.loads((tmp_path / "s/manifests" / f"v{version:08d}.json").read_text())["version"] == version
    store.vacuum()
    assert key(store.read()) == key(odd) and not any(os.path.exists(p.removeprefix("file:")) for p in first)
    none = sharding.ShardStore(spark, str(tmp_path / "e"))
    none.append(empty)
    assert none.read().count() == 0


def test_shards_lose_no_row(spark, tmp_path):
    """Arrivals out of range, new columns and long texts."""
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2)
    df = spark.createDataFrame([(i, "x" * 300_000 if i == 2 else None) for i in range(6)], "a int, t string")
    arrival = F.when(F.col("a") < 4, F.col("a")).when(F.col("a") == 4, F.lit(None))
    store.append(df, F.when(F.col("a") == 5, F.lit(-3)).otherwise(arrival).cast("int"), 3)
    assert store.versions() == [1, 2, 3] and store.read(2).count() == 2
    store.append(spark.createDataFrame([(7, 1.5)], "a int, extra double"))
    store.compact(vacuum=True)
    got = {(r.a, len(r.t or ""), r.extra) for r in store.read().collect()}
    assert got == {(i, 300_000 if i == 2 else 0, None) for i in range(6)} | {(7, 0, 1.5)}
    with pytest.raises(ValueError, match="column a"):
        store.append(spark.createDataFrame([("7",)], "a string"))


def test_racing_writers(spark, tmp_path):
    """Of writers that commit the same version one wins, and its manifest stays."""
    from concurrent.futures import ThreadPoolExecutor

    stores = [sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(8)]

    def commit(i: int) -> bool:
        try:
            stores[i].commit(1, [sharding.Run(f"r{i}", "p", 1, 1, [])], None)
            return True
        except RuntimeError:
            return False

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(commit, range(8)))
    assert sum(won) == 1 and stores[0].manifest()[1][0].name == f"r{won.index(True)}"
