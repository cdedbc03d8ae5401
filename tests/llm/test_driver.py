"""What the driver holds, and how much is made of large groups."""

import random

import numpy as np
import pytest

from pagewright.llm import components, near_dedup, secret_scan


def executions(spark):
    """The executions that the driver keeps, once all are listed."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore()


def listed(spark):
    found = executions(spark).executionsList()
    return [found.apply(i) for i in range(found.size())]


def least_reachable(edges):
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


@pytest.mark.parametrize("merged", ["true", "false"])
def test_components_across_partitions(spark, monkeypatch, merged):
    """A path and random edges; where one task has all edges, it leaves nothing to the rounds."""
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(1000, 1060)] + [(k, k) for k in (1, 5)] + [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)]
    if merged == "true":
        monkeypatch.setattr(components, "_large_star", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    try:
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = least_reachable([e for e in edges if e[0] != e[1]])
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_group_parts_meet_in_their_nearest_pair():
    """Two parts of a group of near copies are tried with one pair, the first and the last, not with all 400."""
    root, wide = np.repeat([0, 20], 20), [np.full(4, 1 << k, np.uint64) for k in range(40)]
    wide[39] = wide[0].copy()
    given = np.arange(40), np.full(40, 300), root, wide
    assert near_dedup.pairs_of(*given, nearest=True) == [(0, 39)]
    every = near_dedup.pairs_of(*given)
    assert sorted(every) == [(i, j) for i in range(20) for j in range(20, 40)]


def test_forest_keeps_no_plan(spark):
    """The findings' expressions are planned once, and of the fit only the forest's numbers stay."""
    secret_scan._default.cache_clear()
    before = {e.executionId() for e in listed(spark)}
    model = secret_scan.default_model(spark)
    own = [e for e in listed(spark) if e.executionId() not in before]
    assert own and sum(len(e.physicalPlanDescription()) > 100_000 for e in own) <= 1
    assert all(isinstance(x, (int, float)) for part in model[:-1] for x in part)
    assert secret_scan.probability(model, "f") == secret_scan.probability(secret_scan.Forest(*model), "f")
