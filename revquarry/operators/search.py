"""Secondary indexes over contents: rows that a provider derives from a blob, kept by content address.

An index is a table ``oid, ...``. A provider is a function from a DataFrame of blobs (``oid, path, data, text``) to
such rows: built-in expressions where they suffice, or ``mapInPandas`` through :func:`python_provider`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import rows_in, ship_package, written

Provider = Callable[[DataFrame], DataFrame]


def python_provider(rows: Callable[[str, bytes], Iterable[dict]], schema: str) -> Provider:
    """A provider from a Python function of path and data that yields rows; ``schema`` is theirs, without ``oid``."""

    def provide(blobs: DataFrame) -> DataFrame:
        ship_package(blobs.sparkSession)

        def run(batches):
            for batch in batches:
                out = [{"oid": oid} | row for oid, path, data in zip(batch["oid"], batch["path"], batch["data"], strict=True) for row in rows(path, bytes(data))]
                if out:
                    yield pd.DataFrame(out)

        return blobs.select("oid", "path", F.col("data").cast("binary").alias("data")).mapInPandas(run, f"oid string, {schema}")

    return provide


def json_provider(path_pattern: str, wanted: dict[str, str], **fields: str) -> Provider:
    """JSON files at matching paths whose properties have the wanted values; ``fields`` are JSON paths to keep."""

    def provide(blobs: DataFrame) -> DataFrame:
        hit = F.col("path").rlike(path_pattern)
        for path, value in wanted.items():
            hit = hit & (F.get_json_object("text", path) == value)
        return blobs.filter(hit).select("oid", *(F.get_json_object("text", path).alias(name) for name, path in fields.items()))

    return provide


def text_provider(path_pattern: str, text: str, first: int = 1024, characters: bool = False) -> Provider:
    """Files at matching paths with ``text``, in either case, among the first bytes, or the first characters."""
    if characters:
        # The one letter whose lower form is two characters to Spark counts as the plain one.
        lower = lambda c: F.lower(F.translate(c, "\u0130", "i"))
        head, wanted = lower(F.substring("text", 1, first)), lower(F.lit(text))
    else:
        # Bytes as characters of one byte each: a cut may fall inside a character.
        raw = lambda c: F.encode(F.lower(c), "utf-8")
        head, wanted = F.decode(F.substring(raw(F.col("text")), 1, first), "iso-8859-1"), F.decode(raw(F.lit(text)), "iso-8859-1")
    return lambda blobs: blobs.filter(F.col("path").rlike(path_pattern) & F.contains(head, wanted)).select("oid")


def not_indexed(blobs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Blobs whose content no earlier run has seen; of equal contents one, at its first path."""
    first = blobs.groupBy("oid").agg(F.min("path").alias("path"))
    return blobs.join(first, ["oid", "path"], "left_semi").dropDuplicates(["oid", "path"]).join(indexed.select("oid"), "oid", "left_anti")


def extended(existing: DataFrame, new: DataFrame, keys: Iterable[str] = ("oid",)) -> DataFrame:
    """Existing rows and those new ones whose key isn't there yet: nothing is updated."""
    keys = list(keys)
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def ensure_index(blobs: DataFrame, indexed: DataFrame, index: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """The index and the set of seen contents after taking in ``blobs``: the same as from scratch, at the cost of what is new."""
    new = not_indexed(blobs, indexed)
    return extended(index, provider(new)), indexed.select("oid").unionByName(new.select("oid"))


def search(index: DataFrame, commit_files: DataFrame, condition: Column | str) -> DataFrame:
    """``commit, path, oid`` and the index's columns, for every path of a commit whose content satisfies the condition.

    One plan: the condition reaches the index's files, the semi-join keeps what the commits hold.
    """
    hits = index.filter(condition)
    return commit_files.select("commit", "path", "oid").join(hits, "oid")


#: What is added to a cosine's rounding and the error of a sum in another order, to be on the safe side; norms whose squares neither vanish nor overflow.
MARGIN, NORMS = 1e-8, (1e-140, 1e140)


def _nearest(q: np.ndarray, m: np.ndarray, v: np.ndarray, n: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Which pairs (a row a query) can be among a query's k nearest, by a product of matrices."""
    with np.errstate(all="ignore"):
        s = (q / m[:, None]) @ (v / n[:, None]).T
    sound = [(x > NORMS[0]) & (x < NORMS[1]) for x in (m, n)]
    odd = ~(sound[0][:, None] & sound[1][None, :] & np.isfinite(s))
    s[odd | own] = -np.inf
    least = np.partition(s, -k, axis=1)[:, -k, None] if len(v) > k else -np.inf
    return (odd | (s >= least - MARGIN)) & ~own


def _scored(k: int, slice_queries: int = 256) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one part of the vectors and one of the queries, the pairs that can be among the k nearest, with their cosines.

    The product of matrices only chooses; the cosines are summed in the vectors' order. Of equal cosines the k smallest
    ids stay, so copies don't add up. Vectors of another length than the query's have none.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])

    def rows(x: pa.Table, ids: str, vectors: str, norms: str):
        x = x.combine_chunks()
        lengths = pc.list_value_length(x[vectors]).to_numpy()
        for size in np.unique(lengths):
            of = x.filter(pa.array(lengths == size)).combine_chunks()
            flat = pc.list_flatten(of[vectors]).to_numpy()
            yield size, of[ids].to_numpy(), flat.reshape(-1, size), of[norms].to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for size, vec_id, v, n in rows(left, "vec_id", "v", "n") if len(left) and len(right) else ():
            for other, query_id, q, m in rows(right, "query_id", "q", "m"):
                for i in range(0, len(query_id), slice_queries):
                    asked, own = query_id[i : i + slice_queries], query_id[i : i + slice_queries, None] == vec_id[None, :]
                    near = _nearest(q[i : i + slice_queries], m[i : i + slice_queries], v, n, own, k) if size == other else ~own
                    x, y = np.nonzero(near)
                    dot = np.zeros(len(x))
                    with np.errstate(all="ignore"):
                        for j in range(size if size == other else 0):
                            dot += v[y, j] * q[i + x, j]
                        cosine = dot / (n[y] * m[i + x])
                    key = np.where(np.isnan(cosine), np.inf, cosine)
                    order = np.lexsort((vec_id[y], key, x))
                    x, y, key, cosine = x[order], y[order], key[order], cosine[order]
                    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (key[1:] != key[:-1])])) if len(x) else np.empty(0, dtype=np.int64)
                    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
                    x, y, cosine = x[place < k], y[place < k], cosine[place < k]
                    cosines = pa.array(cosine) if size == other else pa.nulls(len(x), pa.float64())
                    out.append(pa.Table.from_arrays([pa.array(asked[x]), pa.array(vec_id[y]), cosines], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10, block_queries: int = 2048, block_vectors: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, cosine`` of the k nearest vectors other than the query itself, exactly.

    A stated set of queries meets all vectors, block by block of both. Null and zero vectors take no part.
    """
    ship_package(vectors.sparkSession)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    wide = lambda df, i, v, n: written(df.select(F.col("vec_id").cast("long").alias(i), F.transform("embedding", lambda x: x.cast("double")).alias(v)).filter(F.col(i).isNotNull() & F.col(v).isNotNull()).withColumn(n, norm(F.col(v))).filter(F.col(n) > 0), "vectors")
    asked, every = wide(queries, "query_id", "q", "m"), wide(vectors, "vec_id", "v", "n")
    blocks = lambda df, size: max(1, -(-rows_in(df) // size))
    of_q, of_v = blocks(asked, block_queries), blocks(every, block_vectors)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = every.withColumn("part", own("vec_id", of_v)).withColumn("block", all_(of_q)).groupBy("block", "part")
    right = asked.withColumn("block", own("query_id", of_q)).withColumn("part", all_(of_v)).groupBy("block", "part")
    scored = left.cogroup(right).applyInArrow(_scored(k), "query_id long, vec_id long, cosine double").withColumn("cosine", F.round("cosine", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
