"""Byte-level BPE over whole texts by overlapping chunks, and its inverse.

Texts of up to ``chunk_chars`` code points are one chunk. Longer ones are cut into chunks that overlap their
successor by ``overlap`` code points; all chunks of all documents are pre-tokenised in parallel, each from its own
first character. A pre-token depends only on the text from its start on, so where the pre-token boundaries of a chunk
and of its successor meet inside the overlap, both go on alike from there: the text is cut into pieces at the first
such boundary. Where they never meet (a run without boundaries, or one whose boundaries depend on where it began, longer
than the overlap) the chunks are joined and pre-tokenised as one, until all neighbours meet. Only boundaries take part
in that; the pieces are then encoded in parallel, and a document's ids are put together from its pieces' ids. Decoding
concatenates the tokens' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import rows_in
from . import common
from .tokens import pattern_of, rank_encoder

CHUNK_CHARS = 16_384
OVERLAP = 256
#: A boundary this close to a cut may depend on characters beyond it: the longest fixed alternative has three.
MARGIN = 4
#: Bytes of pieces' places up to which they are broadcast to the chunks; beyond, both are shuffled.
PIECES_BROADCAST = 16_000_000


def boundaries(text: str, pattern: str, start: int, end: int) -> list[int]:
    """Ends of pre-tokens in [start, end] at which the text can be cut: not after white space, whose split looks ahead."""
    return [e for m in pattern_of(pattern).finditer(text) if start <= (e := m.end()) <= end and not text[e - 1].isspace()]


class Digest:
    """Running digests of a document's ids and of the bytes that they decode to."""

    def __init__(self, table):
        self.table = table
        self.n, self.ids, self.raw = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update((b"," if self.n else b"") + str(ids)[1:-1].replace(" ", "").encode())
            self.raw.update(decode(ids, self.table))
            self.n += len(ids)

    def row(self, doc_id):
        return doc_id, self.n, self.ids.hexdigest(), self.raw.hexdigest()


class Ids:
    """The ids themselves."""

    def __init__(self, table):
        self.ids = []

    def add(self, ids: list[int]) -> None:
        self.ids += ids

    def row(self, doc_id):
        return doc_id, len(self.ids), self.ids


def decode(ids, table) -> bytes:
    return b"".join(map(table.__getitem__, ids))


SCHEMAS = {
    Digest: ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])),
    Ids: ("doc_id long, n_tokens long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])),
}


def table_of(rows: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema).to_batches()


CHUNKS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("chunk_no", pa.int64()), ("text", pa.string())])
CHUNKS_DDL = "uid long, doc_id long, chunk_no long, text string"
MARKED = CHUNKS.append(pa.field("head", pa.list_(pa.int64()))).append(pa.field("tail", pa.list_(pa.int64())))


def _marked(docs: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Chunks with the boundaries near their two ends, as places in the document's text."""
    spark = docs.sparkSession

    def cut(batches):
        uid = TaskContext.get().partitionId() << 33
        for batch in common.slices(batches, 16):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n = -(-len(text) // chunk_chars)
                for first in range(0, n, 256):  # a very long text leaves in several batches
                    yield from table_of([(uid, doc_id, k, text[k * chunk_chars : (k + 1) * chunk_chars + overlap]) for k in range(first, min(n, first + 256))], CHUNKS)
                uid += 1

    def mark(batches):
        for batch in common.slices(batches):
            heads, tails = [], []
            for k, text in zip(batch["chunk_no"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found, at = boundaries(text, pattern, 1, len(text) - MARGIN), k * chunk_chars
                heads.append([at + b for b in found if b <= overlap])
                tails.append([at + b for b in found if b >= chunk_chars])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], schema=MARKED)

    dealt = docs.mapInArrow(cut, CHUNKS_DDL).repartition(common.default_parallelism(spark), "uid", "chunk_no")
    return common.written(dealt.mapInArrow(mark, f"{CHUNKS_DDL}, head array<long>, tail array<long>"), "chunks")


def _runs(chunks: DataFrame, of: DataFrame) -> DataFrame:
    """``of`` (``uid, chunk_no, first``) with the chunks' texts, each run of one ``first`` in order in one partition."""
    texts = chunks.select("uid", "doc_id", "chunk_no", "text").join(of, ["uid", "chunk_no"])
    return texts.repartition(common.default_parallelism(chunks.sparkSession), "uid", "first").sortWithinPartitions("uid", "first", "chunk_no")


def _whole(batches, columns: list[str], chunk_chars: int) -> Iterator[tuple[dict, str]]:
    """Each run's last row and its text, the last chunk's overlap included."""
    held, last = [], None
    for batch in common.slices(batches):
        for row in batch.select(columns).to_pylist():
            if last is not None and (row["uid"], row["first"]) != (last["uid"], last["first"]):
                yield last, "".join([*held, last["text"]])
                held, last = [], None
            if last is not None:
                held.append(last["text"][:chunk_chars])
            last = row
    if last is not None:
        yield last, "".join([*held, last["text"]])


def _met(chunks: DataFrame, pattern: str, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    """Runs of chunks that all meet their neighbours: ``uid, first, begin, end`` of each run's piece, and each chunk's run.

    Most chunks are a run each. Those that don't meet are joined with the one before and marked anew as one.
    """
    of = chunks.select("uid", "chunk_no", F.col("chunk_no").alias("first"))
    runs = chunks.select("uid", F.col("chunk_no").alias("first"), "head", "tail")
    in_order = Window.partitionBy("uid").orderBy("first")
    schema = pa.schema([("uid", pa.int64()), ("first", pa.int64()), ("tail", pa.list_(pa.int64()))])

    def mark(batches):
        for row, text in _whole(batches, ["uid", "first", "chunk_no", "text"], chunk_chars):
            at, after = row["first"] * chunk_chars, (row["chunk_no"] + 1) * chunk_chars
            tail = [at + b for b in boundaries(text, pattern, after - at, len(text) - MARGIN)]
            yield pa.RecordBatch.from_arrays([pa.array([row["uid"]]), pa.array([row["first"]]), pa.array([tail], pa.list_(pa.int64()))], schema=schema)

    while True:
        meet = F.array_min(F.array_intersect(F.lag("tail").over(in_order), "head"))
        met = common.written(runs.withColumn("begin", F.when(F.col("first") == 0, F.lit(0).cast("long")).otherwise(meet)), "met")
        if not met.filter("begin is null").limit(1).count():
            return met.select("uid", "first", "begin", F.lead("begin").over(in_order).alias("end")), of
        starts = met.withColumn("start", F.last(F.when(F.col("begin").isNotNull(), F.col("first")), ignorenulls=True).over(in_order))
        starts = common.written(starts.select("uid", "first", "start", "head", "tail"), "starts")
        joined = common.written(starts.groupBy("uid", "start").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("uid", F.col("start").alias("first")), "joined")
        of = common.written(of.join(starts.select("uid", "first", "start"), ["uid", "first"]).select("uid", "chunk_no", F.col("start").alias("first")), "of")
        tails = _runs(chunks, of.join(joined, ["uid", "first"], "left_semi")).mapInArrow(mark, "uid long, first long, tail array<long>")
        kept = starts.filter("first = start").select("uid", "first", "head", "tail")
        runs = kept.join(joined, ["uid", "first"], "left_anti").unionByName(kept.drop("tail").join(tails, ["uid", "first"]).select("uid", "first", "head", "tail"))


def _encode(docs: DataFrame, path: str, pattern: str, chunk_chars: int, overlap: int, sink) -> DataFrame:
    if overlap <= 2 * MARGIN or chunk_chars <= 2 * overlap:
        raise ValueError("chunks must be more than twice as long as their overlap, and that longer than the margin")
    spark = docs.sparkSession
    common.ship_package(spark)
    ddl, schema = SCHEMAS[sink]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def short(batches):
        encoding, table = rank_encoder(path, pattern)
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                out = sink(table)
                out.add(encoding.encode_ordinary(text))
                rows.append(out.row(doc_id))
            yield from table_of(rows, schema)

    is_long = F.length("text") > chunk_chars
    done = docs.filter(~is_long).mapInArrow(short, ddl)
    chunks = _marked(docs.filter(is_long), pattern, chunk_chars, overlap)
    if not rows_in(chunks):
        return done
    pieces, of = _met(chunks, pattern, chunk_chars)
    columns = ["uid", "doc_id", "first", "begin", "end", "chunk_no", "text"]
    ids_schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])

    def piece_ids(batches):
        encoding, _ = rank_encoder(path, pattern)
        for row, text in _whole(batches, columns, chunk_chars):
            at = row["first"] * chunk_chars
            ids = encoding.encode_ordinary(text[row["begin"] - at : None if row["end"] is None else row["end"] - at])
            yield pa.RecordBatch.from_arrays([pa.array([row["uid"]]), pa.array([row["doc_id"]], pa.int64()), pa.array([row["first"]]), pa.array([np.array(ids, dtype="<u4").tobytes()])], schema=ids_schema)

    def together(batches):
        _, table = rank_encoder(path, pattern)
        out, of_uid, of_doc = None, None, None
        for batch in common.slices(batches, 64):
            rows = []
            for uid, doc_id, raw in zip(batch["uid"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if uid != of_uid:
                    if out is not None:
                        rows.append(out.row(of_doc))
                    out, of_uid, of_doc = sink(table), uid, doc_id
                out.add(np.frombuffer(raw, dtype="<u4").tolist())
            yield from table_of(rows, schema)
        if out is not None:
            yield from table_of([out.row(of_doc)], schema)

    wanted = common.written(of.join(pieces, ["uid", "first"]), "pieces")
    alone = wanted.groupBy("uid", "first").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("uid", "first")
    alone = common.written(alone, "several")
    texts = chunks.select("uid", "doc_id", "chunk_no", "text")
    ids_ddl = "uid long, doc_id long, first long, ids binary"
    # A run of one chunk is encoded where it lies; only runs of several are brought together.
    single = wanted if not rows_in(alone) else wanted.join(alone, ["uid", "first"], "left_anti")
    small = F.broadcast(single) if 64 * rows_in(wanted) <= PIECES_BROADCAST else single
    ids = texts.join(small, ["uid", "chunk_no"]).select(columns).mapInArrow(piece_ids, ids_ddl)
    if rows_in(alone):
        ids = ids.unionByName(_runs(chunks, wanted.join(alone, ["uid", "first"], "left_semi")).mapInArrow(piece_ids, ids_ddl))
    long = ids.repartition(common.default_parallelism(spark), "uid").sortWithinPartitions("uid", "first").mapInArrow(together, ddl)
    return done.unionByName(long)


def encode(docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text; a null text counts as empty and has no ids.

    Repeated rows and null ids each give a row of their own; other columns are ignored; an empty table gives none.
    """
    return _encode(docs, path, pattern, chunk_chars, overlap, Ids)


def decode_ids(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes``: the concatenated raw bytes of each row's ``ids``; null ids give no bytes."""
    common.ship_package(tokens.sparkSession)

    def run(batches):
        _, table = rank_encoder(path, pattern)
        for batch in batches:
            raw = [decode(ids or (), table) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Encode and decode every text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids never leave the worker."""
    return _encode(docs, path, pattern, chunk_chars, overlap, Digest)
