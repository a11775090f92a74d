"""Plans of queries whose intermediate rows once grew faster than their tables: what must be in them, and what must not."""

import re
from pathlib import Path

import pytest

from plinth.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")


@pytest.mark.parametrize(
    "name, has, has_not",
    [
        ("transfer_candidates_top5", r"WindowGroupLimit \[unit_id", None),
        ("contact_or_join", None, r"Aggregate\(keys=\[c_custkey#\d+L, s_suppkey"),
        ("declared_topic_links", None, r"array_distinct\(concat\("),
        ("fuzzy_title_pairs", r"explode\(array_distinct\(transform\(.*xxhash64", None),
        ("party_topic_rollup", None, r"\bExpand\b"),
        ("timeline_recommendation", r"MapInArrow", None),
        ("text_fields", r"split\(text#", r"split\((coalesce\()?concat_ws"),
    ],
)
def test_plan(spark, name, has, has_not):
    text = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert has is None or re.search(has, text)
    assert has_not is None or not re.search(has_not, text)
