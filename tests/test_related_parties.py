"""related_parties against brute force on the smallest tables."""

import collections
from pathlib import Path

import pytest

from plinth.plans import catalog
from plinth.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")


def test_all_lines_count(spark):
    party = {r.o_orderkey: r.o_custkey for r in table(spark, DATA, "orders").select("o_orderkey", "o_custkey").collect()}
    by = {"record": collections.defaultdict(set), "unit": collections.defaultdict(set)}
    for r in table(spark, DATA, "lineitem").select("l_orderkey", "l_suppkey").collect():
        if r.l_orderkey in party:
            by["record"][r.l_orderkey].add(party[r.l_orderkey])
            by["unit"][r.l_suppkey].add(party[r.l_orderkey])
    n = {k: collections.Counter((p, q) for ps in groups.values() for p in ps for q in ps if p != q) for k, groups in by.items()}
    each = collections.defaultdict(list)
    for p, q in n["record"].keys() | n["unit"].keys():
        records, units = n["record"][p, q], n["unit"][p, q]
        each[p].append((-(3 * records + units), -records, -units, q))
    want = {(p, q, -r, -u, -s, k) for p, rows in each.items() for k, (s, r, u, q) in enumerate(sorted(rows)[:8], 1)}
    rows = catalog.queries()["related_parties"](spark, DATA).collect()
    assert {(r.party, r.other, r.shared_records, r.shared_units, r.score, r["rank"]) for r in rows} == want
    assert len(rows) == len(want) > 0
