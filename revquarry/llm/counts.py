"""Token counts from distinct pre-tokens: count each one's pieces once, join to document frequencies, sum.

Documents are read in blocks. A block keeps, for each document, which of the block's distinct pre-tokens it holds and
how often, as compact arrays; the block's distinct pre-tokens go out as rows. Over all blocks each distinct pre-token
is counted once, joined back to the blocks that hold it, and every block sums frequency times pieces per document.
No token ids are ever made for a text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import word_pieces

#: Characters of text in a block: bounds a task's memory, and how often a common pre-token is shuffled.
BLOCK_CHARS = 24_000_000
#: Distinct pre-tokens leave a block in rows of so many.
WORDS_A_ROW = 4096

BLOCK_DDL = "block long, doc_id long, n_bytes long, special long, places binary, times binary, first long, words array<string>"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("special", pa.int64()), ("places", pa.binary()), ("times", pa.binary()), ("first", pa.int64()), ("words", pa.list_(pa.string()))])


def packed(numbers: np.ndarray, kind) -> bytes:
    """Non-negative numbers in the small unsigned ``kind``; its greatest value stands for a number kept in 8 bytes behind them."""
    most = np.iinfo(kind).max
    large = numbers >= most
    return len(numbers).to_bytes(4, "little") + np.where(large, most, numbers).astype(kind).tobytes() + numbers[large].astype("<u8").tobytes()


def unpacked(raw: bytes, kind) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, dtype=kind, count=n, offset=4).astype(np.int64)
    large = out == np.iinfo(kind).max
    out[large] = np.frombuffer(raw, dtype="<u8", offset=4 + n * np.dtype(kind).itemsize).astype(np.int64)
    return out


def _frequencies(docs: DataFrame, path: str, block_chars: int) -> DataFrame:
    def run(batches):
        pieces = word_pieces(path)
        block = TaskContext.get().partitionId() << 33
        place: dict[str, int] = {}
        rows: list = []
        chars = 0

        def flush():
            nonlocal block, chars
            words = list(place)
            for i in range(0, len(words), WORDS_A_ROW):
                rows.append((block, None, None, None, None, None, i, words[i : i + WORDS_A_ROW]))
            out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)
            place.clear()
            rows.clear()
            block, chars = block + 1, 0
            return out.to_batches(max_chunksize=2048)

        for batch in common.slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words, special = pieces.words(text)
                seen = Counter(words)
                for w in seen:
                    if w not in place:
                        place[w] = len(place)
                places = np.fromiter(map(place.__getitem__, seen), dtype=np.int64, count=len(seen))
                times = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
                order = np.argsort(places)
                rows.append((block, doc_id, len(text.encode()), special, packed(np.diff(places[order], prepend=0), np.uint16), packed(times[order], np.uint8), None, None))
                chars += len(text)
                if chars >= block_chars:
                    yield from flush()
        if rows:
            yield from flush()

    return docs.mapInArrow(run, BLOCK_DDL)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, as the .json vocabulary at ``path`` counts it.

    A null text counts as empty (0 bytes, 0 tokens). Special strings inside a text are one token each. Repeated rows
    and null ids each give a row; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = common.written(_frequencies(docs, path, block_chars), "frequencies")
    in_blocks = blocks.filter(F.col("words").isNotNull()).select("block", "first", F.posexplode("words").alias("pos", "word")).select("block", (F.col("first") + F.col("pos")).cast("int").alias("place"), "word")

    def pieces_of(batches):
        # Equal words follow each other: each is counted where it first comes.
        pieces = word_pieces(path)
        last, n_last = None, 0
        for batch in batches:
            words = batch["word"].to_pylist()
            new = [w for w in dict.fromkeys(words) if w != last]
            n = dict(zip(new, pieces.counts(new), strict=True))
            if words[0] == last:
                n[last] = n_last
            yield pa.RecordBatch.from_arrays([batch["block"], batch["place"], pa.array(map(n.__getitem__, words), pa.int32())], names=["of_block", "place", "n"])
            last, n_last = words[-1], n[words[-1]]

    # One shuffle brings a pre-token's blocks together: it is counted once, and the count goes back to each of them.
    known = in_blocks.repartition(common.default_parallelism(spark), "word").sortWithinPartitions("word").mapInArrow(pieces_of, "of_block long, place int, n int")
    frequencies = blocks.filter(F.col("places").isNotNull()).select("block", "doc_id", "n_bytes", "special", "places", "times")

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(right), dtype=np.int64)
        n[right["place"].to_numpy()] = right["n"].to_numpy()
        sums = []
        for places, times, special in zip(left["places"], left["times"], left["special"], strict=True):
            sums.append(int(n[np.cumsum(unpacked(places, np.uint16))] @ unpacked(times, np.uint8)) + int(special))
        return pd.DataFrame({"doc_id": left["doc_id"].astype("Int64"), "n_bytes": left["n_bytes"].astype("int64"), "n_tokens": np.array(sums, dtype=np.int64)})

    summed = frequencies.groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(total, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
