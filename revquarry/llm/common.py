"""What the operators share: the shared folder and written tables of the session module, and reading Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from ..session import discard, new_folder, ship_package, workspace, written

__all__ = ["default_parallelism", "discard", "free_name", "new_folder", "ship_package", "slices", "workspace", "written"]

#: Rows that become Python objects at once.
SLICE_ROWS = 512


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` equals, in whatever case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones: a batch may hold tens of megabytes of text, which as Python strings take more again.

    Workers live on after a task; what it has freed goes back to the system when its input ends.
    """
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass
