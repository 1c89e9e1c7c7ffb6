"""Order statistics of moving frames: all frames of a batch are answered at once by a wavelet matrix over ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def order_statistics(codes: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the ``k``-th smallest (from 0) of ``codes[low:high]``; ``codes`` are integers from 0.

    Codes are told apart bit by bit from the highest. At each bit those with a zero come first, in their order, so a
    frame stays a frame in either half, and the number of zeros in it says which half holds the answer.
    """
    found = np.zeros(len(k), np.int64)
    low, high, k = (np.array(x, np.int64) for x in (low, high, k))
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (codes >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - ones)])
        before, until = zeros[low], zeros[high]
        upper = k >= until - before
        k -= np.where(upper, until - before, 0)
        low = np.where(upper, zeros[-1] + low - before, before)
        high = np.where(upper, zeros[-1] + high - until, until)
        found |= upper.astype(np.int64) << bit
        codes = np.concatenate([codes[ones == 0], codes[ones == 1]])
    return found


def frame_quantiles(values: np.ndarray, starts: np.ndarray, frame: int, q: float) -> np.ndarray:
    """Quantile of the last ``frame`` values at each place, interpolated between neighbours; NaN until a frame is full.

    ``starts`` names the first place of each value's own series: a frame never reaches before it, nor holds a NaN.
    """
    out = np.full(len(values), np.nan)
    missing = np.concatenate([[0], np.cumsum(np.isnan(values))])
    ends = np.arange(1, len(values) + 1)
    ends = ends[ends - starts >= frame]
    ends = ends[missing[ends] == missing[ends - frame]]
    if not len(ends):
        return out
    distinct, codes = np.unique(values, return_inverse=True)
    at = q * (frame - 1)
    k = int(at)
    lower = distinct[order_statistics(codes, ends - frame, ends, np.full(len(ends), k))]
    upper = lower
    if at > k:
        upper = distinct[order_statistics(codes, ends - frame, ends, np.full(len(ends), k + 1))]
    with np.errstate(invalid="ignore"):  # equal infinities have no difference
        out[ends - 1] = np.where(lower == upper, lower, lower + (upper - lower) * (at - k))
    return out


def moving_quantile(batches: Iterator[pa.RecordBatch], by: list[str], value: str, frame: int, q: float) -> Iterator[pa.RecordBatch]:
    """The batches' rows and a last column ``threshold``: the quantile of the last ``frame`` values of ``value`` per ``by``.

    Rows come series by series, each in order; a series may run over any number of batches. No more is held than a
    frame and a batch; short batches are gathered up to a frame's length, so that each row is looked at a few times.
    """
    held: pa.Table | None = None  # rows that are out already and belong to frames to come
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= frame:
            done, held = _answered(held, waiting, by, value, frame, q)
            waiting = []
            yield from done
    if waiting:
        yield from _answered(held, waiting, by, value, frame, q)[0]


def _answered(held: pa.Table | None, waiting: list[pa.RecordBatch], by: list[str], value: str, frame: int, q: float):
    fresh = pa.Table.from_batches(waiting)
    rows = (pa.concat_tables([held, fresh]) if held is not None else fresh).combine_chunks()
    if not rows.num_rows:
        return [], held
    changes = np.zeros(rows.num_rows, bool)
    for name in by:
        codes = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy(zero_copy_only=False)
        changes[1:] |= codes[1:] != codes[:-1]
    starts = np.maximum.accumulate(np.where(changes, np.arange(rows.num_rows), 0))
    values = rows.column(value).cast(pa.float64()).to_numpy()
    found = frame_quantiles(values, starts, frame, q)
    skip = rows.num_rows - fresh.num_rows
    answers = pa.array(found[skip:], pa.float64(), mask=np.isnan(found[skip:]))
    keep = max(int(starts[-1]), rows.num_rows - frame + 1)
    return fresh.combine_chunks().append_column("threshold", answers).to_batches(), rows.slice(keep)
