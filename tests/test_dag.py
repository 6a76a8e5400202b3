"""Walks in a worker's memory and walks by joins give the same rows; brute force gives the right ones."""

import random

import pytest

from revquarry.operators import dag


def history(seed=5, n=120):
    """Commits 0 to n - 1, each with up to three earlier ones as parents; some roots."""
    rng = random.Random(seed)
    return {k: rng.sample(range(max(0, k - 9), k), min(k, rng.choice((0, 1, 1, 1, 2, 2, 3)))) for k in range(n)}


def edges_of(spark, parents):
    return spark.createDataFrame([(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)], "child long, parent long, parent_no int")


def breadth_first(parents, start, closed=(), first_only=False):
    level, seen, out = [start] if start not in closed else [], {start, *closed}, []
    depth = 0
    while level:
        out += [(x, depth) for x in level]
        further = []
        for x in level:
            for y in parents[x][:1] if first_only else parents[x]:
                if y not in seen:
                    seen.add(y)
                    further.append(y)
        level, depth = further, depth + 1
    return out


@pytest.fixture(params=["in memory", "by joins"])
def way(request, monkeypatch):
    if request.param == "by joins":
        monkeypatch.setattr(dag, "GRAPH_EDGES", 0)
        monkeypatch.setattr(dag, "COMPACTED_EVERY", 3)


def test_logs_equal_brute_force(spark, way):
    parents = history()
    edges, tips = edges_of(spark, parents), [119, 90, 0]
    starts = spark.createDataFrame([(k, k) for k in tips], "start long, oid long")
    times = spark.createDataFrame([(k, k) for k in parents], "oid long, time long")
    stops = spark.createDataFrame([(k, k // 2) for k in tips], "start long, oid long")
    seen = lambda df: sorted((r.start, r.seq, r.oid, r.level) for r in df.collect())
    want = lambda of: sorted((k, i + 1, x, d) for k in tips for i, (x, d) in enumerate(of(k)))
    assert seen(dag.log(edges, starts)) == want(lambda k: breadth_first(parents, k))
    assert seen(dag.log(edges, starts, first_parent=True)) == want(lambda k: breadth_first(parents, k, first_only=True))
    behind = lambda k: {x for x, _ in breadth_first(parents, k // 2)}
    assert seen(dag.log(edges, starts, stops=stops)) == want(lambda k: breadth_first(parents, k, behind(k)))
    assert seen(dag.log(edges, starts, stops=stops, prune=True)) == want(lambda k: breadth_first(parents, k, {k // 2}))
    young = {k for k in parents if k < 60}
    oldest_first = {k: sorted(ps) for k, ps in parents.items()}
    assert seen(dag.log(edges, starts, times=times, since=60, prune=True)) == want(lambda k: breadth_first(oldest_first, k, young))
    kept = {(k, x) for k in tips for x, _ in breadth_first(oldest_first, k) if x >= 60}
    assert {(r.start, r.oid) for r in dag.log(edges, starts, times=times, since=60).collect()} == kept
    assert seen(dag.log(edges, starts, topological=True)) == want(lambda k: breadth_first(parents, k)[::-1])


def test_merge_bases_equal_brute_force(spark, way):
    parents = history(9)
    rng = random.Random(2)
    pairs = [(i, rng.randrange(120), rng.randrange(120)) for i in range(60)] + [(60, 7, 7), (61, 500, 500), (62, 500, 3)]
    reach = lambda k: {x for x, _ in breadth_first(parents, k)} if k in parents else {k}
    want = set()
    for i, a, b in pairs:
        both = reach(a) & reach(b)
        want |= {(i, x) for x in both if not any(x in reach(y) - {y} for y in both)}
    found = dag.merge_bases(edges_of(spark, parents), spark.createDataFrame(pairs, "pair long, a long, b long"))
    assert {(r.pair, r.oid) for r in found.collect()} == want


def test_nothing_to_walk(spark, way):
    edges = edges_of(spark, {1: [0]}).limit(0)
    starts = spark.createDataFrame([("a", 5)], "start string, oid long")
    assert [tuple(r) for r in dag.log(edges, starts).select("start", "oid", "level", "seq").collect()] == [("a", 5, 0, 1)]
    assert dag.log(edges, starts.limit(0)).count() == 0
    assert dag.log(edges, starts, stops=starts).count() == 0


@pytest.mark.parametrize("n", [100_000])
def test_a_long_chain(spark, n):
    edges = spark.range(1, n).selectExpr("lpad(id, 40, '0') as child", "lpad(id - 1, 40, '0') as parent", "0 as parent_no")
    starts = spark.range(1).selectExpr("'HEAD' as start", f"lpad({n - 1}, 40, '0') as oid")
    last = dag.log(edges, starts, first_parent=True).filter("level = seq - 1").agg({"seq": "max", "oid": "min", "level": "count"}).first()
    assert (last["max(seq)"], last["min(oid)"], last["count(level)"]) == (n, "0" * 40, n)


def test_a_long_chain_by_doubling(spark, monkeypatch):
    monkeypatch.setattr(dag, "GRAPH_EDGES", 0)
    test_a_long_chain(spark, 5000)
