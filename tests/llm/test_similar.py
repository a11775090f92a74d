"""similar_documents against exact Jaccard components on small fixtures."""

import random

import numpy as np
import pytest

from plinth.llm import simhash

WORD = "abcdefgh"


def brute(rows, k=5, limit=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def words(r, n):
    return ["".join(r.choice(WORD) for _ in range(6)) for _ in range(n)]


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {x.doc_id: x.component_id for x in simhash.similar_documents(df, **kw).collect()}


def test_repeated_line_is_no_link(spark):
    """Texts that share one line many times have like fingerprints but unlike sets."""
    r = random.Random(1)
    line = words(r, 10)
    rows = [(i, " ".join(line * 200 + words(r, 400))) for i in range(6)]
    want = brute(rows)
    assert want == {i: i for i in range(6)}
    assert found(spark, rows) == want


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20, "hot_times": 10}])
def test_crowded_keys(spark, sizes):
    """Texts of one template share their keys; pairs that are near each other but not near an anchor are still joined."""
    r = random.Random(2)
    template = words(r, 300)
    rows = []
    for i in range(150):
        w = template[:250] + words(r, 80)
        near = list(w)
        near[300:306] = words(r, 6)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
    want = brute(rows)
    assert len(set(want.values())) == 150
    assert found(spark, rows, **sizes) == want


def test_every_pair_at_the_threshold(spark):
    """Pairs from 0.7 to 0.9, as many on either side of 0.8."""
    r = random.Random(3)
    rows = []
    for i in range(300):
        w = words(r, r.randint(60, 200))
        near = list(w)
        for _ in range(max(1, round(len(w) * r.uniform(0.012, 0.032)))):
            near[r.randrange(len(w))] = words(r, 1)[0]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
    want = brute(rows)
    assert 50 < sum(want[2 * i + 1] == 2 * i for i in range(300)) < 250
    assert found(spark, rows) == want


def test_decided_by_row(spark):
    """Repeated ids and rows: one row of each group stays, and a different text of the same id too."""
    t, u = " ".join(words(random.Random(4), 80)), " ".join(words(random.Random(5), 80))
    rows = [(1, t, "x"), (5, t, "x"), (5, u, "x"), (1, t, "x"), (None, t, "x"), (7, None, "x"), (8, "", "x"), (9, " ", "x"), (None, "a b", "x"), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.drop_similar(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, t, "x"), (5, u, "x"), (7, None, "x"), (None, "a b", "x")], key=str)
    assert simhash.drop_similar(df.limit(0)).count() == 0


def test_sketches_lose_no_pair():
    """Every set with a similar partner passes, whatever the sizes; most others do not."""
    g = np.random.default_rng(6)
    sets = []
    for n in (1, 3, 40, 400, 511, 520, 5000):
        for _ in range(6):
            s = np.unique(g.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            sets += [s, np.unique(np.concatenate([s[len(s) // 12 :], g.integers(0, 2**63, n // 12).astype(np.uint64)]))]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    sketches = [np.frombuffer(simhash._sketch(s), np.uint8) for s in sets]
    both = simhash.common_elements(sets)
    hit = both * 5 >= (n[:, None] + n[None, :] - both) * 4
    np.fill_diagonal(hit, False)
    assert hit.any(1).sum() > 20
    assert (simhash.possible_partners(n, sketches, 4, 5) >= hit.any(1)).all()
    blocks = np.arange(len(sets)) % 2
    assert (simhash.possible_partners(n, sketches, 4, 5, blocks) >= (hit & (blocks[:, None] != blocks[None, :])).any(1)).all()
    alone = [np.unique(g.integers(0, 2**63, 600).astype(np.uint64) * np.uint64(2)) for _ in range(30)]
    alone.sort(key=len)
    assert not simhash.possible_partners(np.array([len(s) for s in alone]), [np.frombuffer(simhash._sketch(s), np.uint8) for s in alone], 4, 5).any()


def test_common_elements():
    g = np.random.default_rng(1)
    sets = [np.unique(g.integers(0, 90, g.integers(0, 60)).astype(np.uint64)) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for dense in (1, 5, 32):
        assert simhash.common_elements(sets, dense, 7).tolist() == want
