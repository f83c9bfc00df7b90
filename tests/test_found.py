"""The pN_found queries of the general problems against plain versions, over the whole tables."""

import pytest

from spanlight.plans import core_queries
from tests import brute

COLUMNS = {
    "p1": ["src_table", "record_id", "ref_field", "target_id", "reason", "period"],
    "p2": ["entity_kind", "entity", "start_us", "end_us", "n_events"],
    "p3": ["src_table", "parent_key", "field_path", "ordinal", "val"],
    "p4": ["entity_type", "entity_value", "kind", "start_s", "end_s"],
    "p5": ["src_table", "record_key", "outcome", "instant_us"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found(spark, sf, name):
    df = core_queries.queries()[f"{name}_found"](spark, sf)
    assert df.columns == COLUMNS[name]
    got = [tuple(r) for r in df.collect()]
    want = getattr(brute, name)(sf)
    assert len(got) == len(set(got))
    extra, lost = set(got) - want, want - set(got)
    assert not extra and not lost, (len(want), len(extra), len(lost), sorted(extra, key=str)[:5], sorted(lost, key=str)[:5])
