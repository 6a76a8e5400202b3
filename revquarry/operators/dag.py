"""The commit graph: logs, ancestors, merge bases and revisions, over ``edges(child, parent, parent_no)``.

``parent_no`` counts from 0. A graph of at most GRAPH_EDGES edges, as nearly every repository's is, is numbered once and
sent to all workers, where each starting point is walked by itself, in memory. Larger ones are walked for all starting
points together: chains of first parents by pointer doubling, everything else by level, one join a level. Ancestors and
merge bases, which need no order, are found up to ARRAY_EDGES edges by arrays where ids are integers: one task numbers
the graph and writes it to the shared folder, and every worker reads it and walks thousands of starting points at once.
All ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, LongType, StructType

from ..session import discard, new_folder, partitions, rows_in, ship_package, written

#: Edges that are broadcast at most, counted before; about 100 MB of 40-digit ids in a worker.
GRAPH_EDGES = 1_000_000
#: Edges that a worker holds as arrays at most: 4 bytes an edge and 12 a commit; the task that numbers them takes 50 an edge.
ARRAY_EDGES = 16_000_000
#: Starting points that are walked at once there.
WALKED_TOGETHER = 4096
#: Levels after which the visited rows are written together.
COMPACTED_EVERY = 16


def edges_of(commits: DataFrame) -> DataFrame:
    """``child, parent, parent_no`` from commits' ordered ``parents``."""
    return commits.select(F.col("oid").alias("child"), F.posexplode("parents").alias("parent_no", "parent")).select("child", "parent", "parent_no")


class Graph:
    """Commits by number, each with its parents in order."""

    def __init__(self, edges: pd.DataFrame):
        edges = edges.sort_values("parent_no", kind="stable")
        codes, self.ids = pd.factorize(np.concatenate([edges["child"].to_numpy(), edges["parent"].to_numpy()]))
        child, parent = codes[: len(edges)], codes[len(edges) :]
        order = np.argsort(child, kind="stable")
        self.parents = parent[order]
        self.starts = np.searchsorted(child[order], np.arange(len(self.ids) + 1))

    @cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        """Where each commit's parents start, and the parents; made once in a worker, where lists are read faster than arrays."""
        return self.starts.tolist(), self.parents.tolist()

    def above(self, commits: Iterable[int]) -> Iterator[int]:
        starts, parents = self.lists
        for x in commits:
            yield from parents[starts[x] : starts[x + 1]]

    def lookup(self) -> Callable[[Iterable], list[int]]:
        """From ids to numbers; -1 for commits without edges."""
        index = pd.Index(self.ids)
        return lambda ids: index.get_indexer(pd.Index([*ids])).tolist() if len(index) else [-1 for _ in ids]

    def levels(self, sources: Iterable[int], closed: set[int] | frozenset = frozenset()) -> Iterator[list[int]]:
        """Commits by distance, each level in order of discovery; nothing in ``closed`` is entered."""
        level = [x for x in dict.fromkeys(sources) if x not in closed]
        seen = {*closed, *level}
        starts, parents = self.lists
        while level:
            yield level
            further = []
            for x in level:
                for y in parents[starts[x] : starts[x + 1]]:
                    if y not in seen:
                        seen.add(y)
                        further.append(y)
            level = further

    def reach(self, sources: Iterable[int]) -> set[int]:
        return {x for level in self.levels(sources) for x in level}


def _graph(edges: DataFrame) -> Broadcast | None:
    """The graph for all workers, if it is small enough."""
    spark = edges.sparkSession
    edges = written(edges.select("child", "parent", "parent_no"), "edges")
    if rows_in(edges) > GRAPH_EDGES:
        return None
    ship_package(spark)
    return spark.sparkContext.broadcast(Graph(edges.toPandas()))


def _by_start(rows: DataFrame, **more: DataFrame) -> DataFrame:
    """A row per start with its commits in ``oids``; ``more`` adds other lists of commits by start."""
    out = rows.groupBy("start").agg(F.collect_list("oid").alias("oids"))
    for name, x in more.items():
        out = out.join(x.groupBy("start").agg(F.collect_list("oid").alias(name)), "start", "left")
    return out


def _walked(graph: Broadcast, starts: DataFrame, stops: DataFrame | None, stop_only_there: bool, ends: set) -> DataFrame:
    """``start, oid, level, seq`` (the place in its level), each start in one worker's memory."""
    bounded = stops is not None
    lists = _by_start(starts, closed=stops) if bounded else _by_start(starts)
    types = dict(zip(lists.columns, lists.schema, strict=True))
    schema = StructType().add("start", types["start"].dataType).add("oid", types["oids"].dataType.elementType).add("level", IntegerType()).add("seq", LongType())

    def run(batches):
        g = graph.value
        numbers, ids = g.lookup(), g.ids
        barred = {*numbers(ends)} - {-1}
        for batch in batches:
            kinds = [batch.schema.field("start").type, batch.schema.field("oids").type.value_type, pa.int32(), pa.int64()]
            rows: list[list] = [[], [], [], []]

            def add(start, oids: list, level: int) -> None:
                n = len(oids)
                for column, values in zip(rows, ([start] * n, oids, [level] * n, range(1, n + 1)), strict=True):  # noqa: B023
                    column.extend(values)

            def taken() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["start", "oid", "level", "seq"])  # noqa: B023
                for column in rows:  # noqa: B023
                    column.clear()
                return out

            closed_lists = batch["closed"].to_pylist() if bounded else [None] * len(batch)
            for start, oids, closed in zip(batch["start"].to_pylist(), batch["oids"].to_pylist(), closed_lists, strict=True):
                closed = closed or []
                around = {*numbers(closed)} - {-1}
                around = (around if stop_only_there else g.reach(around)) | barred
                levels = g.levels((k for k in numbers(oids) if k >= 0), around)
                lone = [x for x, k in zip(oids, numbers(oids), strict=True) if k < 0 and x not in closed and x not in ends]
                add(start, [*ids[next(levels, [])].tolist(), *lone], 0)
                for level, members in enumerate(levels, 1):
                    add(start, ids[members].tolist(), level)
                    if len(rows[0]) >= 10_000:
                        yield taken()
            yield taken()

    return lists.repartition(partitions(lists.sparkSession), "start").mapInArrow(run, schema)


def _chains(edges: DataFrame, starts: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As :func:`_walked`, along first parents: what is cut ends its chain."""
    whole = written(first_parent_chain(edges, starts), "chain")
    lost = whole.join(cut(whole.select("start", "oid")), ["start", "oid"], "left_anti").groupBy("start").agg(F.min("depth").alias("_end"))
    kept = whole.join(lost, "start", "left").filter("_end is null or depth < _end")
    return kept.select("start", "oid", F.col("depth").cast("int").alias("level"), F.lit(1).cast("long").alias("seq"))


def _by_level(edges: DataFrame, starts: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As :func:`_walked`, one join per level for all starts together; the driver holds no ids."""
    first = starts.select("start", "oid", F.lit(0).alias("level"), F.lit(1).cast("long").alias("seq"))
    frontier = written(cut(first), "frontier")
    whole, parts, level = None, [frontier], 0
    order = Window.partitionBy("start").orderBy("from_seq", "parent_no")
    union = lambda: reduce(DataFrame.unionByName, [*([] if whole is None else [whole]), *parts])
    while rows_in(frontier):
        level += 1
        found = frontier.select("start", F.col("oid").alias("child"), F.col("seq").alias("from_seq")).join(edges, "child")
        found = found.groupBy("start", F.col("parent").alias("oid")).agg(F.min(F.struct("from_seq", "parent_no")).alias("by"))
        found = cut(found.join(union().select("start", "oid"), ["start", "oid"], "left_anti"))
        numbered = found.select("start", "oid", F.lit(level).alias("level"), F.col("by.from_seq").alias("from_seq"), F.col("by.parent_no").alias("parent_no")).withColumn("seq", F.row_number().over(order).cast("long"))
        frontier = written(numbered.select("start", "oid", "level", "seq"), "frontier")
        parts.append(frontier)
        if len(parts) > COMPACTED_EVERY:
            # The frontier's own file stays: the next level still reads it.
            merged = written(union(), "visited")
            for x in [*([] if whole is None else [whole]), *parts[:-1]]:
                discard(x)
            whole, parts = merged, []
    return union()


class Arrays:
    """Commits with integers as ids, by number, as arrays in files that all workers read."""

    #: What this worker has read, by folder: the last only.
    read: dict[str, Arrays] = {}

    def __init__(self, ids: np.ndarray, starts: np.ndarray, parents: np.ndarray):
        self.ids, self.starts, self.parents = ids, starts, parents

    @staticmethod
    def at(folder: str) -> Arrays:
        if folder not in Arrays.read:
            Arrays.read.clear()
            store, root = pyarrow.fs.FileSystem.from_uri(folder)
            parts = []
            for name, kind in (("ids", np.int64), ("starts", np.int32), ("parents", np.int32)):
                with store.open_input_file(f"{root}/{name}") as f:
                    parts.append(np.frombuffer(f.read_buffer(), dtype=kind))
            Arrays.read[folder] = Arrays(*parts)
        return Arrays.read[folder]

    @staticmethod
    def write(folder: str, child: np.ndarray, parent: np.ndarray) -> None:
        ids = np.unique(np.concatenate([child, parent]))
        number = lambda x: np.searchsorted(ids, x).astype(np.int32)
        parent, child = number(parent), number(child)
        order = np.argsort(child, kind="stable")
        starts = np.searchsorted(child[order], np.arange(len(ids) + 1, dtype=np.int32)).astype(np.int32)
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for name, x in (("ids", ids), ("starts", starts), ("parents", parent[order])):
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(np.ascontiguousarray(x).data)

    def numbers(self, oids: np.ndarray) -> np.ndarray:
        """-1 for commits without edges."""
        if not len(self.ids):
            return np.full(len(oids), -1)
        at = np.minimum(np.searchsorted(self.ids, oids), len(self.ids) - 1)
        return np.where(self.ids[at] == oids, at, -1)

    def above(self, keys: np.ndarray) -> np.ndarray:
        """The parents' keys; a key is a starting point's place times the number of commits, and the commit's number."""
        place, node = np.divmod(keys, len(self.ids))
        first = self.starts[node].astype(np.int64)
        n = self.starts[node + 1] - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(place * len(self.ids), n) + self.parents[at]

    def reach(self, keys: np.ndarray) -> np.ndarray:
        """Keys of all that the starting points reach, themselves included, ascending."""
        level = seen = _distinct(keys)
        while len(level):
            level = _without(_distinct(self.above(level)), seen)
            seen = np.concatenate([seen, level])
            seen.sort(kind="stable")  # two ascending runs
        return seen


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _without(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of ascending keys those that aren't among other ascending ones."""
    if not len(others):
        return keys
    at = np.minimum(np.searchsorted(others, keys), len(others) - 1)
    return keys[others[at] != keys]


def _arrays(edges: DataFrame) -> str | None:
    """The folder of the graph's arrays, if its ids are integers and it is small enough, but not for :func:`_graph`."""
    if not all(isinstance(edges.schema[c].dataType, IntegralType) for c in ("child", "parent")):
        return None
    spark = edges.sparkSession
    edges = written(edges.select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent")).filter("child is not null and parent is not null"), "edges")
    if not GRAPH_EDGES < rows_in(edges) <= ARRAY_EDGES:
        discard(edges)
        return None
    ship_package(spark)
    folder = new_folder(spark, "graph")

    def run(batches):
        sides = [(batch["child"].to_numpy(), batch["parent"].to_numpy()) for batch in batches if len(batch)]
        child, parent = (np.concatenate(x) for x in zip(*sides, strict=True))
        sides.clear()
        Arrays.write(folder, child, parent)
        yield pa.RecordBatch.from_arrays([pa.array([len(child)])], names=["n"])

    edges.coalesce(1).mapInArrow(run, "n long").collect()
    discard(edges)
    return folder


def _whole(oids: pa.Array) -> np.ndarray:
    """Ids as numbers; what is null has no meaning."""
    return pc.fill_null(oids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def _reached(folder: str, starts: DataFrame) -> DataFrame:
    """``start, oid``: what each start reaches, itself included."""
    lists = _by_start(starts.select("start", "oid"))
    kind = lists.schema["oids"].dataType.elementType
    schema = StructType().add("start", lists.schema["start"].dataType).add("oid", kind)

    def run(batches):
        g = Arrays.at(folder)
        n = max(1, len(g.ids))
        for batch in (x.slice(i, WALKED_TOGETHER) for x in batches for i in range(0, len(x), WALKED_TOGETHER)):
            oids, start = pc.list_flatten(batch["oids"]), batch["start"]
            of = pc.list_parent_indices(batch["oids"]).to_numpy().astype(np.int64)
            code = g.numbers(_whole(oids))
            known = (code >= 0) & oids.is_valid().to_numpy(zero_copy_only=False)
            place, node = np.divmod(g.reach(of[known] * n + code[known]), n)
            kinds = [start.type, oids.type]
            if not known.all():
                alone = pa.RecordBatch.from_arrays([start.take(pa.array(of[~known])), oids.filter(pa.array(~known))], names=["start", "oid"])
                yield from pa.Table.from_batches([alone]).group_by(["start", "oid"]).aggregate([]).to_batches()
            yield pa.RecordBatch.from_arrays([start.take(pa.array(place)), pa.array(g.ids[node]).cast(kinds[1])], names=["start", "oid"])

    return lists.repartition(partitions(lists.sparkSession), "start").mapInArrow(run, schema)


def _best(folder: str, pairs: DataFrame) -> DataFrame:
    """As :func:`_common`: what both reach, less the parents of that."""
    pairs = pairs.select("pair", "a", "b")
    schema = StructType().add("pair", pairs.schema["pair"].dataType).add("oid", pairs.schema["a"].dataType)

    def run(batches):
        g = Arrays.at(folder)
        n = max(1, len(g.ids))
        for batch in (x.slice(i, WALKED_TOGETHER) for x in batches for i in range(0, len(x), WALKED_TOGETHER)):
            pair, a, b = batch["pair"], batch["a"], batch["b"]
            valid = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
            x, y = _whole(a), _whole(b)
            i, j = g.numbers(x), g.numbers(y)
            place = np.arange(len(batch), dtype=np.int64) * n
            known = valid & (i >= 0) & (j >= 0)
            both = np.concatenate([g.reach(place[known] + i[known]), g.reach(place[known] + j[known])])
            both.sort(kind="stable")
            both = both[1:][both[1:] == both[:-1]]
            at, node = np.divmod(_without(both, _distinct(g.above(both))), n)
            alone = np.flatnonzero(valid & ~known & (x == y))
            rows, oids = np.concatenate([at, alone]), np.concatenate([g.ids[node], x[alone]])
            yield pa.RecordBatch.from_arrays([pair.take(pa.array(rows)), pa.array(oids).cast(a.type)], names=["pair", "oid"])

    return pairs.repartition(partitions(pairs.sparkSession), "pair").mapInArrow(run, schema)


def log(edges: DataFrame, starts: DataFrame, first_parent: bool = False, times: DataFrame | None = None, stops: DataFrame | None = None, since=None, until=None, prune: bool = False, topological: bool = False) -> DataFrame:
    """``start, oid, level, seq`` of what each start reaches, itself included, in breadth-first order of discovery.

    ``starts``: ``start, oid``. ``first_parent`` follows only the first parents. With ``times`` (``oid, time``) the
    parents of a commit are visited oldest first; ``since`` and ``until`` then leave out commits by time, and with
    ``prune`` what lies behind those too. ``stops`` (``start, oid``) leaves out all that these reach; with ``prune``
    only the walk ends there. ``topological`` reverses each start's order.
    """
    if first_parent:
        edges = edges.filter("parent_no = 0")
    if times is not None and not first_parent:
        known = edges.join(times.select(F.col("oid").alias("parent"), "time"), "parent", "left")
        rank = F.row_number().over(Window.partitionBy("child").orderBy("time", "parent_no")) - 1
        edges = known.withColumn("parent_no", rank).select("child", "parent", "parent_no")
    outside = None
    if times is not None and (since is not None or until is not None):
        bad = F.lit(False)
        if since is not None:
            bad = bad | (F.col("time") < since)
        if until is not None:
            bad = bad | (F.col("time") > until)
        outside = times.filter(bad).select("oid")
    starts = starts.select("start", "oid")
    barred = written(outside.distinct(), "outside") if outside is not None and prune else None
    graph = _graph(edges) if barred is None or rows_in(barred) <= GRAPH_EDGES else None
    if graph is not None:
        ends = {r["oid"] for r in barred.collect()} if barred is not None else set()  # at most GRAPH_EDGES
        visited = written(_walked(graph, starts, stops, prune, ends), "walked")
    else:
        closed = stops if stops is None or prune else log(edges, stops.select("start", "oid"), first_parent=first_parent)

        def cut(x: DataFrame) -> DataFrame:
            if closed is not None:
                x = x.join(closed.select("start", "oid").distinct(), ["start", "oid"], "left_anti")
            return x if barred is None else x.join(barred, "oid", "left_anti")

        visited = (_chains if first_parent else _by_level)(edges, starts, cut)
    if outside is not None and not prune:
        visited = visited.join(outside, "oid", "left_anti")
        whole = Window.partitionBy("start").orderBy(*([F.desc("level"), F.desc("seq")] if topological else ["level", "seq"]))
        return visited.select("start", "oid", "level", F.row_number().over(whole).cast("long").alias("seq"))
    # A commit's place is its place on its level after all of the levels before (or, reversed, from the end): a row a level tells.
    sizes = visited.groupBy("start", "level").agg(F.count(F.lit(1)).alias("n"))
    through = F.sum("n").over(Window.partitionBy("start").orderBy("level"))
    places = sizes.select("start", "level", (through - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("start")).alias("total"))
    seq = F.col("before") + F.col("seq")
    return visited.join(places, ["start", "level"]).select("start", "oid", "level", (F.col("total") + 1 - seq if topological else seq).alias("seq"))


def first_parent_chain(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, oid, depth`` along first parents, by pointer doubling: as many joins as the longest chain has binary digits."""
    hop = written(edges.filter("parent_no = 0").select("child", "parent"), "hop")
    reached = written(starts.select("start", "oid", F.lit(0).cast("long").alias("depth")), "chain")
    step = 1
    while True:
        further = reached.join(hop.withColumnRenamed("child", "oid"), "oid").select("start", F.col("parent").alias("oid"), (F.col("depth") + step).alias("depth"))
        more = written(further, "chain")
        if not rows_in(more):
            return reached
        reached = reached.unionByName(more)
        # All chains of up to 2 * step - 1 hops are there; now hops of twice the length.
        nxt = written(hop.join(hop.select(F.col("child").alias("parent"), F.col("parent").alias("beyond")), "parent").select("child", F.col("beyond").alias("parent")), "hop")
        discard(hop)
        hop, step = nxt, step * 2


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, oid``: everything reachable, the start itself included."""
    folder = _arrays(edges) if isinstance(starts.schema["oid"].dataType, IntegralType) else None
    if folder is not None:
        return _reached(folder, starts)
    return log(edges, starts).select("start", "oid")


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, oid``: the best common ancestors of each pair's ``a`` and ``b``: common, and not reachable from another common one.

    Criss-cross histories have several; :func:`merge_base` picks one.
    """
    folder = _arrays(edges) if all(isinstance(pairs.schema[c].dataType, IntegralType) for c in ("a", "b")) else None
    if folder is not None:
        return _best(folder, pairs)
    graph = _graph(edges)
    if graph is not None:
        return _common(graph, pairs)
    sides = pairs.select(F.col("a").alias("oid")).unionByName(pairs.select(F.col("b").alias("oid"))).distinct()
    reach = written(ancestors(edges, sides.select(F.col("oid").alias("start"), "oid")), "reach")
    of = lambda c: pairs.select("pair", F.col(c).alias("start")).join(reach, "start").select("pair", "oid")
    both = written(of("a").join(of("b"), ["pair", "oid"]), "common")
    # A common ancestor's parents are common too: those are not best, nor is anything behind them.
    worse = both.join(edges.select(F.col("child").alias("oid"), "parent"), "oid").select("pair", F.col("parent").alias("oid"))
    return both.join(worse.distinct(), ["pair", "oid"], "left_anti")


def _common(graph: Broadcast, pairs: DataFrame) -> DataFrame:
    """Walk from ``a`` to all it reaches, then from ``b`` only as far as what ``a`` reaches: the best lie on that border."""
    pairs = pairs.select("pair", "a", "b")
    schema = StructType().add("pair", pairs.schema["pair"].dataType).add("oid", pairs.schema["a"].dataType)

    def run(batches):
        g = graph.value
        numbers, ids = g.lookup(), g.ids
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            out: list = [[], []]
            for pair, x, y, i, j in zip(batch["pair"].to_pylist(), a, b, numbers(a), numbers(b), strict=True):
                best = [x] if x == y and x is not None else []
                if i >= 0 and j >= 0:
                    of_a = g.reach([i])
                    of_b = {j} if j in of_a else {k for level in g.levels([j], of_a) for k in level}
                    border = {j} if j in of_a else {k for k in g.above(of_b) if k in of_a}
                    # Of those on the border, what another one reaches isn't best.
                    behind = g.reach(g.above(border)) if len(border) > 1 else set()
                    best = ids[sorted(border - behind)].tolist()
                out[0] += [pair] * len(best)
                out[1] += best
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("pair").type), pa.array(out[1], batch.schema.field("a").type)], names=["pair", "oid"])

    return pairs.repartition(partitions(pairs.sparkSession), "pair").mapInArrow(run, schema)


def merge_base(edges: DataFrame, pairs: DataFrame, times: DataFrame) -> DataFrame:
    """One per pair: the newest, ties to the smaller id; pairs without a common ancestor give no row."""
    best = merge_bases(edges, pairs).join(times.select("oid", "time"), "oid", "left")
    newest = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("time"), "oid"))
    return best.withColumn("_k", newest).filter("_k = 1").select("pair", "oid")


def path_log(walk: DataFrame, files: DataFrame) -> DataFrame:
    """Commits of a walk (``start, oid, seq``) that changed a path, per ``start`` and path: of each run of equal content along the walk the newest.

    ``files``: ``oid, path, blob`` of every commit in the walk. A path's history ends where it is missing.
    """
    w = Window.partitionBy("start", "path").orderBy("seq")
    seen = walk.join(files, "oid").withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("seq").over(w)).withColumn("_before", F.lag("blob").over(w))
    unbroken = F.col("seq") - F.col("_first") + 1 == F.col("_n")
    return seen.filter(unbroken & ~F.col("blob").eqNullSafe(F.col("_before"))).select("start", "path", "seq", "oid", "blob")


_REVISION = re.compile(r"[~^]\d*")


def parse_revision(text: str) -> tuple[str, list[tuple[str, int]]]:
    """``HEAD~2^2`` as its base and steps; a step without number means 1."""
    at = min((i for i in (text.find("~"), text.find("^")) if i >= 0), default=len(text))
    base, rest = text[:at], text[at:]
    steps = [(m[0], int(m[1:] or 1)) for m in _REVISION.findall(rest)]
    if not base or "".join(_REVISION.findall(rest)) != rest:
        raise ValueError(f"not a revision: {text}")
    return base, steps


def follow(edges: DataFrame, at: DataFrame, steps: list[tuple[str, int]]) -> DataFrame:
    """Apply steps to ``start, oid``: ``~n`` n first parents up, ``^n`` the n-th parent, ``^0`` itself. Rows without such a parent drop out."""
    for op, n in steps:
        hops = [0] * n if op == "~" else [n - 1] * (n > 0)
        for no in hops:
            at = at.join(edges.filter(F.col("parent_no") == no).select(F.col("child").alias("oid"), "parent"), "oid").select("start", F.col("parent").alias("oid"))
    return at


def generations(links: DataFrame, n: int) -> DataFrame:
    """``commit, generation`` of the commits 0 to ``n`` - 1 from ``child, parent``: 1 at the roots, else one above the highest of the parents.

    Up to ARRAY_EDGES commits and links by one task's arrays, beyond that one join a level.
    """
    spark, size = links.sparkSession, rows_in(links)
    links = links.select("child", "parent")
    if max(n, size) > ARRAY_EDGES:
        return _generations_by_level(written(links, "links"), n)
    if not size:
        return spark.range(n).select(F.col("id").alias("commit"), F.lit(1).cast("long").alias("generation"))
    ship_package(spark)

    def packed(batches) -> np.ndarray:
        out, at = np.empty(size, np.int64), 0
        for batch in batches:
            out[at : at + len(batch)] = batch["parent"].to_numpy() << 32 | batch["child"].to_numpy()
            at += len(batch)
        return out[:at]

    def run(batches):
        found = _generations(packed(batches), n)
        for i in range(0, n, 100_000):
            part = found[i : i + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part)], names=["commit", "generation"])

    return written(links.coalesce(1).mapInArrow(run, "commit long, generation long"), "generations")


def _generations(links: np.ndarray, n: int) -> np.ndarray:
    """As :func:`generations`, by number, from links with the parent in the higher 32 bits; they are overwritten."""
    links.sort()
    starts = np.searchsorted(links, np.arange(n + 1, dtype=np.int64) << 32)
    links &= 0xFFFFFFFF
    below = links.astype(np.int32)
    del links
    waiting = np.bincount(below, minlength=n).astype(np.int32)
    out = np.zeros(n, np.int32)
    # Long chains have levels of a few commits: those go through Python's own numbers, which are faster there.
    one_below, one_start, one_waiting, one_out = (memoryview(x) for x in (below, starts, waiting, out))
    level, number, done = np.flatnonzero(waiting == 0), 0, 0
    while len(level):
        number, done = number + 1, done + len(level)
        if len(level) > 64:
            level = np.asarray(level)
            out[level] = number
            first = starts[level]
            size = starts[level + 1] - first
            reached, times = np.unique(below[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())], return_counts=True)
            waiting[reached] -= times.astype(np.int32)
            level = reached[waiting[reached] == 0]
        else:
            further = []
            for x in level if isinstance(level, list) else level.tolist():
                one_out[x] = number
                for i in range(one_start[x], one_start[x + 1]):
                    y = one_below[i]
                    one_waiting[y] -= 1
                    if not one_waiting[y]:
                        further.append(y)
            level = further
    if done < n:
        raise ValueError("commits are their own ancestors")
    return out


def _generations_by_level(left: DataFrame, n: int) -> DataFrame:
    spark = left.sparkSession
    level, whole = 1, None
    known = written(spark.range(n).select(F.col("id").alias("commit")).join(left.select(F.col("child").alias("commit")), "commit", "left_anti").withColumn("generation", F.lit(1).cast("long")), "level")
    parts = [known]
    union = lambda: reduce(DataFrame.unionByName, [*([] if whole is None else [whole]), *parts])
    while rows_in(left):
        level += 1
        rest = written(left.join(known.select(F.col("commit").alias("parent")), "parent", "left_anti").select("child", "parent"), "links")
        free = left.select(F.col("child").alias("commit")).distinct().join(rest.select(F.col("child").alias("commit")), "commit", "left_anti")
        known = written(free.withColumn("generation", F.lit(level).cast("long")), "level")
        if rows_in(rest) == rows_in(left):
            raise ValueError("commits are their own ancestors")
        discard(left)
        left = rest
        parts.append(known)
        if len(parts) > COMPACTED_EVERY:
            # The last level's own file stays: the next one still reads it.
            merged = written(union(), "generations")
            for x in [*([] if whole is None else [whole]), *parts[:-1]]:
                discard(x)
            whole, parts = merged, []
    return union()
