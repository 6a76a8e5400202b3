import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from revquarry.llm import components, maxscore, neardup, ngramjoin


def groups_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    want = groups_of(500, links)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {i: want[i] for i in {x for l in links if l[0] != l[1] for x in l}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Exact top-k


def brute_top(rows, queries, k):
    out = []
    for q, w in queries:
        scored = sorted(((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in rows if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "spread", "shard"), [(8, 3, 40), (16, 50, 64), (5, 1, 7), (64, 300, 500)])
def test_max_score_equals_brute_force(spark, dims, spread, shard):
    rng = np.random.default_rng(dims)
    vectors = np.rint(rng.standard_normal((300, dims)) * spread).astype(int)
    vectors[::7] = np.abs(vectors[::7]) * (rng.random((len(vectors[::7]), dims)) < 0.2) * 5  # sparse and strong: lists decide
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = maxscore.top_k(df, df.filter("vec_id % 10 = 0"), 10, shard_vectors=shard).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, rows[::10], 10)


def test_essential_lists_prune():
    """With one strong dimension most vectors are on no essential list, and the result is still exact."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (2000, 6))
    vectors[:100, 0] = rng.integers(500, 900, 100)
    shard = maxscore.Shard(np.arange(2000), vectors)
    w = np.array([9, 1, -1, 1, 0, 2])
    ids, scores, _ = shard.best(5, w, 10)
    assert shard.scored < 400
    assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == sorted((-int(v @ w), i) for i, v in enumerate(vectors) if i != 5)[:10]


def test_the_threshold_rises_while_lists_are_traversed():
    """The first list alone sets a threshold that leaves many lists essential; what it finds next makes them non-essential."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-20, 21, (4000, 12))
    vectors[7], vectors[8] = [60] * 12, [59] * 12
    shard = maxscore.Shard(np.arange(4000), vectors)
    w = np.arange(12, 0, -1)
    ids, scores, _ = shard.best(0, w, 2)
    assert ids.tolist() == [7, 8] and scores.tolist() == [60 * 78, 59 * 78]
    few = shard.scored
    shard.best(0, w, 100)
    assert few < shard.scored


def test_max_score_copies(spark):
    rows = [(1, [3, 4])] * 5 + [(2, [3, 4])] * 3 + [(3, [1, 0])] + [(4, [0, 1])] * 40
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = maxscore.top_k(df, df.filter("vec_id in (1, 3)"), 6, shard_vectors=2).collect()
    assert sorted(map(tuple, got)) == sorted({*brute_top(rows, [(1, [3, 4]), (3, [1, 0])], 6)})


def test_max_score_edges(spark):
    rows = [(1, [0.5, float("nan")]), (2, None), (None, [0.1, 0.2]), (3, [0.1, None]), (4, [0.5, -0.25]), (5, [0.5, -0.25]), (6, [-0.001, 0.0]), (6, [0.25, 0.0]), (7, [float("inf"), 0.0]), (8, [])]
    df = maxscore.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {(r.vec_id, tuple(r.v)) for r in df.collect()} == {(4, (512, -256)), (5, (512, -256)), (6, (-2, 0)), (6, (256, 0)), (8, ())}
    got = maxscore.top_k(df, df.filter("vec_id = 4"), 10).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 5, 327680), (2, 6, 131072), (3, 8, 0), (4, 6, -1024)]
    assert maxscore.top_k(df.limit(0), df, 10).count() == 0


# Vectors


def test_lattice_points():
    around = neardup.neighbours()
    assert len(around) == 240 and np.allclose((around**2).sum(axis=1), 2)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8)) * 3
    own = neardup.nearest_e8(x)
    twice = np.rint(2 * own).astype(int)
    assert (np.ptp(twice % 2, axis=1) == 0).all() and (own.sum(axis=1) % 2 == 0).all()
    d = ((x - own) ** 2).sum(axis=1)
    assert all((((x[i] - own[i] - around) ** 2).sum(axis=1) >= d[i] - 1e-9).all() for i in range(500))


def brute_vectors(vectors):
    unit = np.array(vectors, dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    links = [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j]
    return close.sum(axis=1), groups_of(len(vectors), links), len(links)


@pytest.mark.parametrize("tile", [neardup.TILE, 16])
def test_near_duplicate_vectors(spark, tile):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 32))
    copies = [base[0] + rng.standard_normal(32) * 0.05 for _ in range(90)] + [base[1] * s for s in (1, 1, 1, 2)] + [base[k] + rng.standard_normal(32) * 0.12 for k in range(2, 40) for _ in range(2)]
    vectors = [x.tolist() for x in [*base, *copies]]
    n, component, links = brute_vectors(vectors)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = sorted(neardup.near_duplicates(df, tile=tile).collect())
    assert sum(r.n_links for r in got) >= 0.98 * 2 * links
    assert all(r.n_links <= n[r.vec_id] for r in got)
    assert sum(r.component_id == component[r.vec_id] for r in got) >= 0.98 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_of_borderline_pairs():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (1000, 10**6, 10**9):
        scale, tables = neardup.plan(n, 64)
        if n < 10**9:
            x, y = neardup.cells(a, tables, scale=scale), neardup.cells(b, tables, scale=scale)
            met = (x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)
            assert met.any(axis=1).mean() > 0.99


def test_cells_get_finer_with_the_number_of_vectors():
    """Comparisons with unrelated vectors grow more slowly than the table; the model of how many there are holds."""
    plans = [neardup.plan(n, 64) for n in (10**4, 10**6, 10**8, 10**10)]
    assert [s for s, _ in plans] == sorted(s for s, _ in plans) and plans[0][0] < plans[-1][0]
    met = [tables * n * 17 / (4 * np.pi * s * s) ** 4 for n, (s, tables) in zip((10**4, 10**6, 10**8, 10**10), plans, strict=True)]
    assert all(b < 60 * a for a, b in itertools.pairwise(met[1:]))
    rng = np.random.default_rng(4)
    a, b = (rng.standard_normal((20_000, 64)) for _ in range(2))
    x, y = (neardup.cells(v / np.linalg.norm(v, axis=1, keepdims=True), 4, scale=0.8) for v in (a, b))
    seen = ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).mean()
    assert 0.5 < seen / (17 / (4 * np.pi * 0.64) ** 4) < 1.5


@pytest.mark.parametrize(("p_left_in_p", "p_left_in_q"), [*itertools.product((True, False), repeat=2)])
def test_a_pair_that_probes_each_other_counts_once(p_left_in_p, p_left_in_q):
    """Its members lie in the home cells of both, in any order of rows or tiles in either."""
    near = next(k for k, x in enumerate(neardup.AROUND) if x[0] == 1)
    back = next(k for k, x in enumerate(neardup.AROUND) if (x == -neardup.AROUND[near]).all())
    own = np.array([[[0] * 8], [(2 * neardup.AROUND[near]).tolist()]], dtype="<i2")
    marks = [own[k].tobytes() + bytes([p]) for k, p in enumerate((near, back))]
    (p, q), (q_, p_) = neardup.codes(own, np.array([[[near]], [[back]]], dtype=np.uint8))[:, 0].tolist()
    assert (p, q) == (p_, q_)
    unit, tile = np.array([[1.0, 0.0], [1.0, 0.0]]), neardup.Tile(0.95, 1, 1)
    for a, b, tiles in ((0, 0, [0, 0]), (0, 1, [0, 1])):
        met = 0
        for cell, p_left in ((p, p_left_in_p), (q, p_left_in_q)):
            order = [0, 1] if p_left else [1, 0]
            met += len(tile.links(0, cell, a, b, np.array(tiles), unit[order], [marks[k] for k in order])[0])
        assert met == 1


def test_links_in_cells_of_unequal_tile_counts(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((8, 16))
    vectors = [(base[k % 8] + rng.standard_normal(16) * 0.15).tolist() for k in range(160)]
    n, component, links = brute_vectors(vectors)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    got = sorted(neardup.near_duplicates(df, tables=12, probes=24, tile=3).collect())
    assert links and [r.n_links for r in got] == n.tolist()
    assert [r.component_id for r in got] == component


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, float("nan")]), (6, [1.0, None]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, []), (9, [1e30, 1e25]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (None, 0, None, False), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 1, False), (10, 0, 10, True)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


# Shingles


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_join(rows):
    sets = [brute_shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    roots = groups_of(len(rows), links)
    ids = {}
    for (doc_id, _), r in zip(rows, roots, strict=True):
        if doc_id is not None:
            ids[r] = min(ids.get(r, doc_id), doc_id)
    return sorted(((d, len(s), ids.get(r)) for (d, _), s, r in zip(rows, sets, roots, strict=True)), key=str)


def shingle_rows(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    licence = " ".join(f"licence{i}" for i in range(14))
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(30)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))])
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        out.append((i, " ".join(words) + (f"\n{licence}" if rng.random() < 0.4 else "")))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [ngramjoin.BLOCK_BYTES, 4000])
def test_join_equals_brute_force(spark, seed, block):
    rows = shingle_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngramjoin.join_groups(df, block_bytes=block, fragment_bytes=5000, least_fragments=5).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


def test_a_chain_and_a_crowd(spark):
    """Documents that only a chain of links connects, and many near copies with edits in different places."""
    words = [f"c{i}" for i in range(200)]
    chain = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(30)]
    rng = random.Random(8)
    crowd = []
    for i in range(120):
        w = [f"k{j}" for j in range(80)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"edit{rng.randrange(1000)}"
        crowd.append((100 + i, " ".join(w)))
    rows = chain + crowd
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngramjoin.join_groups(df, least_fragments=3).collect()), key=str) == brute_join(rows)


def test_members_of_lists_whose_leader_links_with_none(spark):
    """A leads every list, but is too long to link with the others, which link in two pairs."""
    p, q = [f"p{i}" for i in range(94)], [f"q{i}" for i in range(94)]
    own = lambda name: [f"{name}{i}" for i in range(10)]
    rows = [(k, " ".join(w)) for k, w in enumerate([p + q, p + own("b"), p + own("c"), q + own("d"), q + own("e")])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_join(rows)
    assert [c for _, _, c in want] == [0, 1, 1, 3, 3]
    assert sorted(map(tuple, ngramjoin.join_groups(df).collect()), key=str) == want


def test_a_crowd_just_under_the_threshold(spark):
    """Every pair of the crowd shares shingles of its prefix but none links; each has one link outside, some to each other's."""
    rng = random.Random(17)
    shared = [f"s{j}" for j in range(120)]
    rows = []
    for i in range(40):
        own = shared + [f"own{i}_{j}" for j in range(20)]
        rows.append((2 * i, " ".join(own)))
        if i % 3:
            rows.append((2 * i + 1, " ".join([*own[:-1], f"other{rng.randrange(9)}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_join(rows)
    assert len({c for _, _, c in want}) == 40
    assert sorted(map(tuple, ngramjoin.join_groups(df, least_fragments=3).collect()), key=str) == want


def test_one_of_each_leaves_other_columns(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(5, same, 1, 2, 3, 4), (5, same, 9, 9, 9, 9), (6, "b", 0, 0, 0, 0)], "doc_id long, text string, uid int, _uid int, root int, h int")
    for rows in (df, df.limit(1)):
        kept = ngramjoin.one_of_each(rows)
        assert kept.columns == df.columns
    assert sorted(tuple(r)[::5] for r in ngramjoin.one_of_each(df).collect()) in ([(5, 4), (6, 0)], [(5, 9), (6, 0)])
    assert ngramjoin.one_of_each(df.limit(0)).count() == 0


def test_shingle_edges(spark):
    same = "one two three four five six"
    rows = [(1, same), (2, same.upper()), (3, "one two"), (4, " one\ttwo\v"), (5, ""), (6, None), (7, " \n"), (8, "É one"), (9, "é one"), (None, same), (1, same), (10, "one two")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    assert sorted(map(tuple, ngramjoin.join_groups(df).collect()), key=str) == brute_join(rows)
    assert ngramjoin.join_groups(df.limit(0)).count() == 0
    kept = ngramjoin.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 5, 6, 7, 8, 9, 10], key=str)
    unique = df.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in ngramjoin.one_of_each(unique).collect()) == [1, 3, 5, 6, 7, 8, 9, 10]


def test_one_of_each_with_a_single_null_id(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(1, same), (None, same), (2, "one two")], "doc_id long, text string")
    assert sorted((r.doc_id for r in ngramjoin.one_of_each(df).collect()), key=str) == [1, 2]
    alone = df.filter("doc_id is null or doc_id = 2")
    assert sorted((r.doc_id for r in ngramjoin.one_of_each(alone).collect()), key=str) == [2, None]


def test_hashes():
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    for x in (h, h[:1], h[:3], np.arange(7, dtype=np.uint64)):
        assert (ngramjoin.unpack_hashes(ngramjoin.pack_hashes(x)) == x).all()
    hashes = ngramjoin._Hashes()
    assert len(ngramjoin.shingle_set("a b c d e a b c d e", hashes)) == 5
    assert hashes[b"a"] == xxhash.xxh3_64_intdigest(b"a")
