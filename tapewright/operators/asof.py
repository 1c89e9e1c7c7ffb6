"""As-of joins: the nearest row of another series before or after a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.operators.skew import HOT_ROWS, Track, running

_SIDE, _SEQ, _HIT, _PROBE = "_side", "_seq", "_hit", "_probe"


def asof_join(
    probes: DataFrame,
    values: DataFrame,
    by: Sequence[str],
    *,
    on: str = "ts",
    seq: str = "seq",
    direction: str = "backward",
    take: Sequence[str],
    block: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every probe the last value at or before it (``backward``) or the first at or after it (``forward``).

    Both inputs are put on one time line and scanned once; no pairs are formed, so dense series cost no more
    than their rows. Ties in time count as "at"; among values of one instant ``seq`` decides.
    The time line of a hot key is cut into blocks of equal depth, or into ``block``.
    """
    forward = direction == "forward"
    # The values of an instant have to be passed before its probes, whichever way the scan runs.
    value_side, probe_side = (1, 0) if forward else (0, 1)
    rest = [c for c in probes.columns if c not in (*by, on)]
    left = probes.select(
        *by,
        on,
        F.lit(probe_side).alias(_SIDE),
        F.lit(None).cast(values.schema[seq].dataType).alias(_SEQ),
        F.struct(*(rest or [on])).alias(_PROBE),
    )
    right = values.select(*by, on, F.lit(value_side).alias(_SIDE), F.col(seq).alias(_SEQ), F.struct(*take).alias(_HIT))
    line = left.unionByName(right, allowMissingColumns=True)
    hit = F.when(F.col(_SIDE) == value_side, F.col(_HIT))
    scanned = running(
        line,
        by,
        [on, _SIDE, _SEQ],
        {"_found": Track("last", hit)},
        block=block,
        reverse=forward,
        hot_rows=hot_rows,
    )
    return scanned.where(F.col(_SIDE) == probe_side).select(
        *by, on, *[F.col(f"{_PROBE}.{c}") for c in rest], *[F.col(f"_found.{c}") for c in take]
    )
