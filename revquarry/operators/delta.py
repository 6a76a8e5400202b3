"""Deltas between contents: instructions that copy from a base or insert bytes, applied and made."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Bytes of the base that are indexed together, and the least and greatest lengths of an instruction's run.
WINDOW, LEAST_COPY, MOST_COPY, MOST_INSERT = 16, 4, 0xFFFF, 127


def size_number(n: int) -> bytes:
    """Seven bits a byte, lowest first."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_size(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def offset_number(n: int) -> bytes:
    """A base's distance as packs write it: seven bits a byte, highest first, each further byte counting from one on."""
    out = [n & 127]
    n >>= 7
    while n:
        n -= 1
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(reversed(out))


def read_offset(raw: bytes, at: int) -> tuple[int, int]:
    n = raw[at] & 127
    while raw[at] & 128:
        at += 1
        n = (n + 1 << 7) | raw[at] & 127
    return n, at + 1


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The content that the delta makes of its base; a delta that doesn't fit is an error."""
    expected, at = read_size(delta, 0)
    size, at = read_size(delta, at)
    if expected != len(base):
        raise ValueError("delta is of another base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            offset = length = 0
            for k in range(7):
                if op >> k & 1:
                    if k < 4:
                        offset |= delta[at] << 8 * k
                    else:
                        length |= delta[at] << 8 * (k - 4)
                    at += 1
            length = length or 0x10000
            if offset + length > len(base):
                raise ValueError("delta copies beyond its base")
            out += base[offset : offset + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("reserved delta instruction")
    if len(out) != size:
        raise ValueError("delta makes another size")
    return bytes(out)


def _copy(offset: int, length: int) -> bytes:
    op, rest = 128, bytearray()
    for k in range(4):
        if b := offset >> 8 * k & 255:
            op |= 1 << k
            rest.append(b)
    for k in range(3):
        if b := length >> 8 * k & 255:
            op |= 16 << k
            rest.append(b)
    return bytes([op, *rest])


def make_delta(base: bytes, target: bytes) -> bytes:
    """A delta from base to target: runs of the base found by its blocks and grown both ways, other bytes inserted."""
    blocks: dict[bytes, int] = {}
    for i in range(len(base) - WINDOW, -1, -WINDOW):
        blocks[base[i : i + WINDOW]] = i
    out = bytearray(size_number(len(base)) + size_number(len(target)))
    pending = at = 0  # target[pending:at] is to be inserted

    def insert(end: int) -> None:
        for i in range(pending, end, MOST_INSERT):
            part = target[i : min(end, i + MOST_INSERT)]
            out.append(len(part))
            out.extend(part)

    while at + WINDOW <= len(target):
        found = blocks.get(target[at : at + WINDOW])
        if found is None:
            at += 1
            continue
        start, end = found, found + WINDOW
        first, last = at, at + WINDOW
        while first > pending and start > 0 and base[start - 1] == target[first - 1]:
            start, first = start - 1, first - 1
        while end < len(base) and last < len(target) and base[end] == target[last]:
            end, last = end + 1, last + 1
        insert(first)
        while start < end:
            n = min(MOST_COPY, end - start)
            out += _copy(start, n)
            start += n
        pending = at = last
    insert(len(target))
    return bytes(out)


def with_deltas(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``base, target``) with ``delta``."""
    ship_package(pairs.sparkSession)

    @F.pandas_udf("binary")
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for base, target in batches:
            yield pd.Series([make_delta(bytes(x), bytes(y)) for x, y in zip(base, target, strict=True)])

    return pairs.withColumn("delta", make(F.col("base").cast("binary"), F.col("target").cast("binary")))


def with_targets(pairs: DataFrame, name: str = "made") -> DataFrame:
    """``pairs`` (``base, delta``) with what the delta makes of the base."""
    ship_package(pairs.sparkSession)

    @F.pandas_udf("binary")
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for base, delta in batches:
            yield pd.Series([apply_delta(bytes(x), bytes(y)) for x, y in zip(base, delta, strict=True)])

    return pairs.withColumn(name, make(F.col("base").cast("binary"), "delta"))
