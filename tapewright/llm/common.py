"""Shared helpers: tables, Arrow texts as flat bytes, and packing of arrays into binary cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.session import shared_dir

TEXT_CHUNK = 4 << 20  # bytes of text that one numpy pass holds; longer texts are passed in pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame) -> DataFrame:
    """The frame as files in the shared folder: later reads survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


FEW = 1_000_000  # ids that are broadcast: some tens of megabytes


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is among ``ids``; rows with a null key stay.

    The ids are written and counted first. Few are broadcast, so that the texts stay where they are; more are joined by
    shuffling both sides.
    """
    ids = saved(ids.select(key).distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, key, "left_anti").select(*docs.columns)


def digest(column: str = "text"):
    """64-bit digest that tells apart the texts of one document id."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and the offsets of its values; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[ends[0] : ends[-1]], ends - ends[0]


def sized(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, or a single longer text."""
    for batch in batches:
        _, ends = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words_at(buf: np.ndarray, count: int, step: int = 0) -> np.ndarray:
    """The eight bytes from each of the first ``count`` positions, big-endian, as one integer each."""
    padded = np.concatenate([buf, np.zeros(step + 16, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded[step:].view(), (count, 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of ragged runs, run after run."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any length in one binary cell."""
    head = np.array([len(arrays)] + [a.nbytes for a in arrays], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(cell: bytes, *types) -> list[np.ndarray]:
    n = len(types)
    sizes = np.frombuffer(cell, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for kind, size in zip(types, sizes, strict=True):
        out.append(np.frombuffer(cell, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out
