"""Moving order statistics against sorting each frame."""

import numpy as np
import pyarrow as pa
import pytest

from tapewright.operators import frames


def plain(values, frame, q):
    out = np.full(len(values), np.nan)
    for end in range(frame, len(values) + 1):
        part = values[end - frame : end]
        if not np.isnan(part).any():
            out[end - 1] = np.quantile(part, q)
    return out


@pytest.mark.parametrize("frame", [1, 2, 7, 48])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.98, 1.0])
def test_frames_of_one_series(frame, q):
    rng = np.random.default_rng(frame)
    values = rng.integers(-5, 5, 300) * 0.5  # many ties
    values[[60, 61, 200]] = np.nan
    got = frames.frame_quantiles(values, np.zeros(300, int), frame, q)
    assert np.allclose(got, plain(values, frame, q), equal_nan=True)


def test_long_frame():
    values = np.random.default_rng(1).normal(size=4000).cumsum()
    got = frames.frame_quantiles(values, np.zeros(4000, int), 2880, 0.98)
    assert np.isnan(got[:2879]).all() and np.allclose(got[2879::40], plain(values, 2880, 0.98)[2879::40])


def test_order_statistics():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 37, 500)
    low = rng.integers(0, 400, 200)
    high = low + rng.integers(1, 100, 200)
    k = rng.integers(0, high - low)
    want = [np.sort(codes[a:b])[i] for a, b, i in zip(low, high, k)]
    assert frames.order_statistics(codes, low, high, k).tolist() == want


@pytest.mark.parametrize("batch", [1, 3, 17, 1000])
def test_series_over_batches(batch):
    """Any cut into batches gives the same; frames never reach into another series, null keys included."""
    rng = np.random.default_rng(6)
    sizes = {"a": 70, "b": 4, "c": 1, None: 55}
    key = [k for k, n in sizes.items() for _ in range(n)]
    values = rng.normal(size=len(key)).round(1)
    values[5] = np.inf
    whole = pa.table({"key": pa.array(key, pa.string()), "block": pa.array([0] * len(key)), "x": pa.array(values, mask=values == 0.3)})
    cuts = [b for b in whole.to_batches(max_chunksize=batch)] + whole.slice(0, 0).to_batches()
    out = pa.Table.from_batches(list(frames.moving_quantile(iter(cuts), ["key", "block"], "x", 9, 0.9)))
    assert out.select(["key", "block", "x"]).equals(whole)
    seen = np.where(values == 0.3, np.nan, values)
    at, want = 0, []
    for n in sizes.values():
        want.append(plain(seen[at : at + n], 9, 0.9))
        at += n
    assert np.allclose(out.column("threshold").to_numpy(), np.concatenate(want), equal_nan=True)


def test_infinite_values():
    values = np.array([1.0, np.inf, np.inf, np.inf, 2.0])
    assert frames.frame_quantiles(values, np.zeros(5, int), 3, 0.9)[3] == np.inf
    assert list(frames.moving_quantile(iter([]), ["key"], "x", 3, 0.5)) == []
