"""A uniform random shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Each source partition is permuted locally. How many of its rows go to each shard is drawn from the exact
(multivariate hypergeometric) law that a uniform permutation of all rows would give, so the sizes of the shards come
out as wanted; the partition's first rows go to shard 0, the next to shard 1, and so on. After the exchange each
shard is permuted again. Data moves by DataFrame operations only; the matrix has a row per source partition and is
drawn on the driver from the partitions' row counts.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a shard that are ordered together, about.
ROWS_TOGETHER = 4096
#: Sources whose part of the matrix is written at once.
SOURCES_TOGETHER = 4096
#: Bytes up to which the matrix is broadcast; beyond, it is joined by shuffle.
MATRIX_BROADCAST = 32_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows out of ``good + bad`` are good, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = right = mode
    u = rng.random() - up
    # Rounding may leave mass over; once both tails are too thin to count there is nothing more to find.
    while u >= 0 and (up and right < high or down and left > low):
        if up and right < high:
            up *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right, u = right + 1, u - up
            if u < 0:
                return right
        if down and left > low:
            down *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left, u = left - 1, u - down
            if u < 0:
                return left
    return mode


def communication_matrix(rows: list[int], shards: int, rng: random.Random) -> Iterator[list[int]]:
    """Counts from each source to each shard, source by source: row sums ``rows``, column sums at most one apart."""
    total = sum(rows)
    open_ = [total // shards + (s < total % shards) for s in range(shards)]
    for n in rows:
        counts, rest, left = [], sum(open_), n
        for s in range(shards):
            rest -= open_[s]
            k = hypergeometric(rng, open_[s], rest, left)
            counts.append(k)
            left -= k
        open_ = [a - b for a, b in zip(open_, counts, strict=True)]
        yield counts


def _bounds(spark: SparkSession, sources: list[tuple[int, int]], shards: int, rng: random.Random, src: str, ends: str) -> DataFrame:
    """The matrix as a written table: for each source, how many of its rows go to each shard or one before it."""
    path = common.new_folder(spark, "matrix")
    matrix = communication_matrix([n for _, n in sources], shards, rng)
    kind = f"array<struct<`{src}`:long,`{ends}`:array<long>>>"
    for at in range(0, max(1, len(sources)), SOURCES_TOGETHER):
        some = [{src: k, ends: [*accumulate(row)]} for (k, _), row in zip(sources[at : at + SOURCES_TOGETHER], matrix, strict=False)]
        spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(some)), kind))).write.mode("append").parquet(path)
    return spark.read.schema(f"`{src}` long, `{ends}` array<long>").parquet(path)


def shuffle(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); sizes at most one apart.

    Every row goes to one shard, whatever is in it: nulls, empty texts, repeated rows. Input columns named ``shard``
    or ``slot`` are replaced, all others stay. The same input partitions and seed give the same result. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    # Columns of our own, by names that no input column has.
    taken = [*docs.columns, "shard", "slot"]
    key, place, src, at, ends, part, n, before, rank = (common.free_name(c, taken) for c in ("key", "place", "src", "at", "ends", "part", "n", "before", "rank"))
    # Locally permuted, and written: which partition a row is of, and its place there, can't change from here on.
    local = docs.select(*names, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias(key)).sortWithinPartitions(key).drop(key)
    kept = common.written(local.select(*names, F.monotonically_increasing_id().alias(place)), "shuffle")
    kept = kept.withColumn(src, F.shiftright(place, 33)).withColumn(at, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    # A number for each source partition.
    sources = sorted((r[src], r[n]) for r in kept.groupBy(src).agg(F.count(F.lit(1)).alias(n)).collect())
    total = sum(k for _, k in sources)
    bounds = _bounds(spark, sources, shards, random.Random(seed), src, ends)
    if len(sources) * shards * 8 <= MATRIX_BROADCAST:
        bounds = F.broadcast(bounds)
    bits = max(0, math.ceil(math.log2(max(1, total / shards / ROWS_TOGETHER))))
    dealt = kept.join(bounds, src).withColumn("shard", F.size(F.filter(ends, lambda x: x <= F.col(at)))).withColumn(key, F.xxhash64(F.lit(seed + 1), place))
    dealt = dealt.withColumn(part, F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long"))
    # Second permutation: by a random key; its leading bits part each shard, and the parts before a row's own are counted.
    sizes = dealt.groupBy("shard", part).agg(F.count(F.lit(1)).alias(n))
    offsets = sizes.select("shard", part, (F.sum(n).over(Window.partitionBy("shard").orderBy(part)) - F.col(n)).alias(before))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("shard", part).orderBy(key, place)))
    return ranked.join(offsets, ["shard", part]).select(*names, "shard", (F.col(before) + F.col(rank) - 1).cast("long").alias("slot"))
