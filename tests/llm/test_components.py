"""Components by one task and by rounds are the same; few links take few jobs."""

import random

import pytest

from revquarry.llm import components


@pytest.mark.parametrize("together", [0, 10_000])
def test_both_ways(spark, monkeypatch, together):
    monkeypatch.setattr(components, "TOGETHER", together)
    rng = random.Random(7)
    links = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(100)] + [(9, 9), (-5000, 5000), (5000, -5000)]
    least = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.id, r.component) for r in got) == sorted(least.items())


def test_few_links_take_few_jobs(spark):
    links = spark.range(2000).selectExpr("id as a", "id + 1 as b")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert {r.component for r in components.components(links).collect()} == {0}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
