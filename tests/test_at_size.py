"""What differs from the SQL, or doesn't fit, only on larger or odder tables than the smallest."""

import pytest
from test_catalogue import norm


@pytest.fixture
def against_sql(spark, tmp_path):
    """Both answers to a query over tables given as rows."""

    def run(name: str, **tables):
        import duckdb

        from revquarry.plans import catalogue, repositories  # noqa: F401

        con = duckdb.connect()
        con.sql("SET TimeZone='UTC'")
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"create view {table} as from '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        return norm(got), norm(want)

    return run


def test_text_flag_counts_characters(against_sql):
    texts = ["é" * 600 + "LICENSE", "é" * 1017 + "license", "é" * 1018 + "license", "a LİCENSE", "licens", None, ""]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(texts)]
    got, want = against_sql("index_text_flag", documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == want and len(got) == 3


@pytest.mark.parametrize("name", ["training_data_outcomes", "training_data_lines"])
def test_training_data_of_more_than_a_year(against_sql, name):
    rows = [(0, turn, "user", f"text {turn // 2}") for turn in (0, 1, 2, 3, 40_000_000, 40_000_001, 40_000_002)]
    got, want = against_sql(name, conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert got == want


def test_similar_meets_blocks_by_matrices(spark):
    """Copies, ties, odd lengths and components, over several blocks; no pair is scored row by row."""
    import math
    import random

    from pyspark.sql import functions as F

    from revquarry.operators import search

    rng = random.Random(3)
    some = [[rng.choice((-1.0, 0.5, 2.0)) for _ in range(4)] for _ in range(30)]
    rows = [(i, some[rng.randrange(30)]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [1e200, 1.0, 1.0, 1.0]), (304, [math.nan, 1.0, 1.0, 1.0]), (305, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.filter("vec_id % 25 = 0 or vec_id > 300")

    def plainly(k):
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        x = v.select(F.col("vec_id"), F.col("embedding").alias("v"), norm("embedding").alias("n")).filter("n > 0")
        y = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), norm("embedding").alias("m")).filter("m > 0")
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        found: dict = {}
        for r in x.join(y, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot / (F.col("n") * F.col("m")), 9).alias("c")).collect():
            found.setdefault(r.query_id, []).append((1 if r.c is None else 0, -math.inf if r.c is not None and math.isnan(r.c) else -(r.c or 0.0), r.vec_id))
        return sorted((q, i + 1, x[2]) for q, xs in found.items() for i, x in enumerate(sorted(xs)[:k]))

    got = search.similar(v, asked, 7, block_queries=5, block_vectors=64)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == plainly(7)
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().toString()) and "CoGroup" in plan


@pytest.mark.parametrize("arrays", [0, 10_000])
def test_ancestors_and_merge_bases_of_larger_graphs(spark, monkeypatch, arrays):
    """By arrays, and by joins beyond those, as brute force has them; starts without edges, repeated, null and with several commits."""
    import random

    from revquarry.operators import dag
    from test_dag import breadth_first, edges_of, history

    monkeypatch.setattr(dag, "GRAPH_EDGES", 10)
    monkeypatch.setattr(dag, "ARRAY_EDGES", arrays)
    monkeypatch.setattr(dag, "WALKED_TOGETHER", 7)
    rng, parents = random.Random(4), history(11)
    edges, rows = edges_of(spark, parents), [(k, k) for k in range(0, 120, 3)] + [(1, 5), (1, 90), (2, 777), *[(1, 90)] * (arrays > 0)]
    reach = lambda k: {x for x, _ in breadth_first(parents, k)} if k in parents else {k}
    got = dag.ancestors(edges, spark.createDataFrame(rows, "start long, oid long"))
    assert sorted((r.start, r.oid) for r in got.collect()) == sorted({(s, x) for s, o in rows for x in reach(o)})
    assert arrays == 0 or "MapInArrow" in got._jdf.queryExecution().toString()
    pairs = [(f"p{i}", rng.randrange(120), rng.randrange(120)) for i in range(60)] + [("q", 7, 7), ("r", 500, 500), ("s", 500, 3), ("t", None, 3)]
    want = set()
    for i, a, b in pairs:
        both = reach(a) & reach(b) if a is not None else set()
        want |= {(i, x) for x in both if not any(x in reach(y) - {y} for y in both)}
    best = dag.merge_bases(edges, spark.createDataFrame(pairs, "pair string, a long, b long"))
    assert sorted((r.pair, r.oid) for r in best.collect()) == sorted(want)
    assert (dag._arrays(edges) is not None) == (arrays > 0)


@pytest.mark.parametrize("arrays", [0, 10_000])
def test_commit_graph_by_parts(spark, monkeypatch, tmp_path, arrays):
    """As git has it, written and read: merges of many, lists of edges over several parts, chains, equal to one task's rows."""
    from revquarry.operators import dag
    from revquarry.sources import export, formats, repository
    from test_repo import commit, git

    git(tmp_path, "init", "-q")
    oids = [commit(tmp_path, "one", a_txt="1")]
    tree = git(tmp_path, "rev-parse", "HEAD^{tree}")
    for k, parents in enumerate([[0], [0], [0], [], [1, 2], [1, 2, 3, 4], [6, 5, 4, 3, 2, 1, 0], [7], [8], [9, 7, 3], [10, 0, 4, 6]]):
        oids.append(git(tmp_path, "commit-tree", tree, *[x for p in parents for x in ("-p", oids[p])], "-m", f"c{k}"))
    rows = [(o, tree, git(tmp_path, "log", "-1", "--format=%P", o).split(), int(git(tmp_path, "log", "-1", "--format=%ct", o))) for o in oids]
    monkeypatch.setattr(repository, "GRAPH_WHOLE", 3)
    monkeypatch.setattr(repository, "GRAPH_PART", 3)
    monkeypatch.setattr(dag, "ARRAY_EDGES", arrays)
    monkeypatch.setattr(dag, "COMPACTED_EVERY", 2)
    at = tmp_path / ".git/objects/info/commit-graph"
    export.commit_graph(spark.createDataFrame(rows, "oid string, tree string, parents array<string>, commit_time long"), str(tmp_path / ".git"))
    assert at.read_bytes()[-20:] == formats.hashlib.sha1(at.read_bytes()[:-20]).digest()
    git(tmp_path, "commit-graph", "verify")
    plain = formats.write_commit_graph([dict(zip(("oid", "tree", "parents", "commit_time"), r, strict=True)) for r in rows])
    assert at.read_bytes() == plain
    listed = lambda: sorted(tuple(r) for r in repository.commit_graph(spark, str(tmp_path / ".git")).select("oid", "tree", "parents", "commit_time", "generation").collect())
    assert listed() == sorted((*r.values(),) for r in formats.commit_graph(plain))
    generations = {r[0]: r[4] for r in listed()}
    at.unlink()
    for upto in (5, 8, 12):
        git(tmp_path, "commit-graph", "write", "--stdin-commits", "--split=no-merge", data="\n".join(oids[:upto]).encode())
    assert len((tmp_path / ".git/objects/info/commit-graphs/commit-graph-chain").read_text().split()) == 3
    assert listed() == sorted((*r, generations[r[0]]) for r in rows)


def test_commit_graph_refuses_what_it_cannot_hold(spark, monkeypatch, tmp_path):
    from revquarry.operators import dag
    from revquarry.sources import export, repository

    monkeypatch.setattr(repository, "GRAPH_WHOLE", 1)
    monkeypatch.setattr(repository, "GRAPH_PART", 1)
    oid = lambda k: f"{k:040x}"

    def write(*rows):
        export.commit_graph(spark.createDataFrame([(oid(k), oid(0), [oid(p) for p in parents], time) for k, parents, time in rows], "oid string, tree string, parents array<string>, commit_time long"), str(tmp_path))

    for time in (1 << 34, -1, None):
        with pytest.raises(ValueError, match="34 bits"):
            write((1, [], 5), (2, [1], time))
    with pytest.raises(Exception, match="not among the commits"):
        write((1, [], 5), (2, [3], 5))
    for arrays in (0, 10):
        monkeypatch.setattr(dag, "ARRAY_EDGES", arrays)
        with pytest.raises(Exception, match="their own ancestors"):
            write((1, [2], 5), (2, [1], 5), (3, [], 5))
    write((1, [], (1 << 34) - 1), (2, [], 0))
    assert {r.oid: (r.parents, r.commit_time, r.generation) for r in repository.commit_graph(spark, str(tmp_path)).collect()} == {oid(1): ([], (1 << 34) - 1, 1), oid(2): ([], 0, 1)}


def test_generations_of_long_and_wide_graphs(spark):
    import numpy as np

    from revquarry.operators import dag

    child = np.concatenate([np.arange(1, 5000), np.arange(5000, 9000), [9000]])
    parent = np.concatenate([np.arange(4999), np.arange(5000, 9000) % 7, [8999]])
    child, parent = np.append(child, np.full(4000, 9001)), np.append(parent, np.arange(5000, 9000))
    got = dag._generations(parent << 32 | child, 9002)
    assert got[:5000].tolist() == list(range(1, 5001)) and got[5000:9000].tolist() == [x % 7 + 2 for x in range(5000, 9000)]
    assert got[9000] == 8999 % 7 + 3 and got[9001] == 9


@pytest.mark.parametrize("whole", [10, 1000])
def test_commit_graph_rows_stay_off_the_driver(against_sql, spark, monkeypatch, whole):
    """Beyond a bound commits are not collected."""
    from revquarry.sources import repository

    monkeypatch.setattr(repository, "GRAPH_WHOLE", whole, raising=False)
    monkeypatch.setattr(repository, "GRAPH_PART", 10, raising=False)
    sizes, kind = [], type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (sizes.append(len(out := collect(self))), out)[1])
    keys = [*range(-3, 400), 1 << 33, 5, 7, None]
    got, want = against_sql("commit_graph_rows", orders=([(k,) for k in keys], "o_orderkey long"))
    assert got == want and len(got) == 400
    assert whole > len(got) or sum(n >= len(got) for n in sizes) <= 1  # the test's own
