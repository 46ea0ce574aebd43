"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import ensure_checkpoint_dir
from tidepool.sources.tables import table_path


def read_columns(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of a driver table; anything else it holds is not read."""
    return spark.read.parquet(table_path(sf_dir, name)).select(*columns)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker that waits for its
    next task keeps what its last one took otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def keep_freed(limit: int = 32 << 20) -> None:
    """Let the C library use freed arrays again, up to ``limit`` bytes, instead of
    handing each back to the system: fresh pages cost more than small sums on them."""
    with contextlib.suppress(AttributeError, OSError):
        library = ctypes.CDLL(None)
        library.mallopt(-3, limit)  # M_MMAP_THRESHOLD
        library.mallopt(-1, limit)  # M_TRIM_THRESHOLD


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; repeated rows share the key."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_remainder(doc_id, modulus: int) -> np.ndarray:
    """crc32 of each doc_id as text, modulo ``modulus`` (null id: crc32 of '')."""
    return np.array(
        [zlib.crc32(b"" if x is None else str(int(x)).encode()) % modulus for x in doc_id], dtype=np.int64
    )


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """Column form of :func:`id_remainder`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n, first = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[first : first + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch into runs of rows of about ``limit`` bytes of text, so that
    working arrays stay small; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; rows do not run together."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row
