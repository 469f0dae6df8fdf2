"""The mixture: feasible windows, deviation below one block, whole results."""

from collections import Counter

import pytest

from pressgauge.llm import pfair


def rows_of(spark, sizes, extra=()):
    rows = [(k * 1000 + i, s, "t") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, source string, slot string")


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.07, "c": 0.03}, None])
def test_deviation_is_below_one_block(spark, weights):
    sizes = {"a": 300, "b": 200, "c": 130}
    found = pfair.mix(rows_of(spark, sizes), weights, block=1, cycle=20).collect()
    assert sorted(r.position for r in found) == list(range(630))
    assert all(r.release <= r.slot < r.deadline for r in found)
    per_cycle = Counter(r.source for r in found if r.cycle == 0)
    order = [r.source for r in sorted(found, key=lambda r: r.position) if r.cycle == 0]
    seen, slots = Counter(), sum(per_cycle.values())
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * p / slots) < 1 for x, p in per_cycle.items())


def test_blocks_stay_together(spark):
    found = sorted(pfair.mix(rows_of(spark, {"a": 100, "b": 37}), {"a": 2, "b": 1}, block=10, cycle=3).collect(), key=lambda r: r.position)
    runs = [k for i, k in enumerate((r.source, r.block) for r in found) if i == 0 or k != (found[i - 1].source, found[i - 1].block)]
    assert len(runs) == len(set(runs)) == 14


def test_sources_leave_when_they_are_done(spark):
    found = sorted(pfair.mix(rows_of(spark, {"a": 50, "b": 4}), {"a": 1, "b": 1}, block=1, cycle=2).collect(), key=lambda r: r.position)
    assert [r.source for r in found[:8]].count("b") == 4 and {r.source for r in found[8:]} == {"a"}


def test_odd_rows(spark):
    extra = [(None, None, "t"), (None, "a", "t"), (5, "", "t"), (5, "", "t"), (6, None, "t")]
    docs = rows_of(spark, {"a": 10}, extra)
    found = pfair.mix(docs, block=2, cycle=7).collect()
    assert sorted(r.position for r in found) == list(range(15))
    assert Counter(r.source for r in found) == {"a": 11, "": 2, None: 2}
    ordered = pfair.in_mixed_order(docs, block=2, cycle=7)
    assert ordered.columns == docs.columns and ordered.count() == 15


def test_empty_table(spark):
    docs = rows_of(spark, {"a": 1}).limit(0)
    assert pfair.mix(docs).count() == 0
    assert pfair.in_mixed_order(docs).count() == 0
