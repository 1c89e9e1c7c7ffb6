"""Questions about a corpus in blocks: rows are gathered to chunks, chunks ask buckets, buckets answer chunks.

Millions of small facts (a hash and where it stands) move as packed arrays: one cell for each chunk of rows and each
bucket of hashes. A bucket sees one cell of every chunk and answers with one cell for every chunk that needs it. What
a chunk repeats is combined before it asks, so a hash in a third of all rows reaches its bucket once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOVED = "chunk long, bucket int, kind int, body binary"
#: Kinds of cells: a chunk's own table, what it asks, what a bucket answers.
TABLE, ASKS, ANSWER = 0, 1, 2

def buckets(parts: int) -> int:
    """Two buckets for each partition: cells are as many as chunks times buckets."""
    return 2 * parts


def chunk_id(*arrays: np.ndarray) -> int:
    """Name of a chunk by its content: the same rows get the same name in every run of the task."""
    h = hashlib.blake2b(digest_size=8)
    for a in arrays:
        h.update(np.ascontiguousarray(a).tobytes())
    return int.from_bytes(h.digest(), "big", signed=True)


class Cells:
    """Collects output cells and hands them over in batches."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, bytes]] = []
        self.size = 0

    def add(self, chunk: int, bucket: int, kind: int, body: bytes) -> None:
        self.rows.append((chunk, bucket, kind, body))
        self.size += len(body)

    def full(self) -> bool:
        return self.size > 8 << 20

    def take(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows, self.size = self.rows, [], 0
        for k in range(0, len(rows), 4096):
            c, b, n, body = zip(*rows[k : k + 4096], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()), pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(body, pa.binary())],
                ["chunk", "bucket", "kind", "body"],
            )


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the keys of each bucket; the keys' high bits choose it."""
    bucket = ((keys >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Cells of one key after another, from input sorted by it: (key, [(chunk, kind, body)])."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        cells = zip(batch.column("chunk").to_pylist(), batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True)
        for k, cell in zip(keys, cells, strict=True):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(cell)
    if held:
        yield now, held


def answered(asked: DataFrame, parts: int, answer: Callable) -> DataFrame:
    """Sends cells to their buckets. ``answer(cells, out)`` gets a bucket's questions and adds answers to ``out``.

    Tables of chunks pass through, dealt out like buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Cells()
        for _, cells in runs(batches, "bucket"):
            asks = []
            for chunk, kind, body in cells:
                if kind == TABLE:
                    out.add(chunk, 0, TABLE, body)
                else:
                    asks.append((chunk, body))
            if asks:
                answer(asks, out)
            if out.full():
                yield from out.take()
        yield from out.take()

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MOVED)


def gathered(answers: DataFrame, parts: int, merge: Callable, schema: str) -> DataFrame:
    """Brings a chunk's table and answers together. ``merge(tables, answers)`` gives record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in runs(batches, "chunk"):
            tables = [body for _, kind, body in cells if kind == TABLE]
            got = [body for _, kind, body in cells if kind == ANSWER]
            yield from merge(tables[0], got)  # equal chunks have equal tables

    return answers.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)

