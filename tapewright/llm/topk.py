"""Exact top-k inner products with a uniform threshold over score lists: local lists, a safe cutoff, exact resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, table

K = 5
LISTS = 4  # slices of the dimensions; each gives one list of partial scores
ROWS = 8192  # rows of a group, about: what one task holds at once
QUERIES = 512  # queries scored against a group at once
EXACT = float(1 << 53)  # up to here sums of doubles are exact integers
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles with integer values, floor(256 x)) of the rows that take part, each once."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("double"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    good = F.col(vector).isNotNull() & F.forall(F.col(vector), finite) & F.col(key).isNotNull()
    kept = rows.filter(F.coalesce(good, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias("vec_id"), whole.alias("vector")).dropDuplicates(["vec_id", "vector"])


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _partials(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Scores of each slice of dimensions, exact. Sums that doubles cannot hold are made of Python integers."""
    width = max(q.shape[1], x.shape[1], 1)
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width >= EXACT:
        whole = np.frompyfunc(int, 1, 1)
        q, x = whole(q), whole(x)
    edges = np.linspace(0, width, min(lists, width) + 1).astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(edges, edges[1:])]


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Each group's rows and then, a few at a time, the queries sent to it. Input comes sorted by group, rows first."""
    group, held, waiting, done = None, [], [], 0
    rows = None

    def flush(force: bool):
        nonlocal waiting, done
        if waiting and (force or done >= QUERIES):
            asked = pd.concat(waiting)
            waiting, done = [], 0
            if rows is not None and len(rows):
                for k in range(0, len(asked), QUERIES):
                    yield rows, asked.iloc[k : k + QUERIES]

    for frame in frames:
        for g, part in frame.groupby("group", sort=False):
            if g != group:
                yield from flush(True)
                group, held, rows = g, [], None
            own = part[~part["asks"]]
            if len(own):
                held.append(own)
            asked = part[part["asks"]]
            if len(asked):
                if rows is None and held:
                    rows, held = pd.concat(held).sort_values("vec_id"), []
                waiting.append(asked)
                done += len(asked)
                yield from flush(False)
    yield from flush(True)


def _sent(rows: DataFrame, queries: DataFrame, groups: int, n: int) -> DataFrame:
    """Rows dealt to groups and every query sent to each group, sorted so that a task streams them."""
    none = F.lit(None).cast("double")
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"), F.lit(False).alias("asks"), "vec_id", "vector", none.alias("cutoff"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asks"), "vec_id", "vector", "cutoff")
    return dealt.unionByName(asked).repartition(n, "group").sortWithinPartitions("group", "asks")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns that hold each row's k highest scores; of equal scores the first columns."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    if scores.dtype == object:
        least = np.sort(scores, axis=1)[:, [-k]]
    else:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    above, level = scores > least, scores == least
    return above | level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, group_rows: int = ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k highest scores, ties to the smaller id.

    ``rows`` and ``queries`` come from ``quantised``. A query's candidates are the rows with another id. Vectors of
    unequal length count as padded with zeros; repeated rows count once; scores beyond a long are held at its ends.
    Null or not finite vectors and null ids have been left out; empty tables give an empty result.

    The dimensions are cut into ``lists`` slices; a row's score is the sum of its slices' partial scores.
    Phase 1: each group of rows finds, slice by slice, the rows with the k highest partial scores, and their scores.
    The k-th highest of these by query is a safe cutoff: the true k-th score cannot be lower.
    Phase 2: a row whose score reaches the cutoff has a slice with at least cutoff / slices. The cutoffs go out with
    the queries, and each group collects the rows that pass in some slice.
    Phase 3: their missing partial scores are added; what reaches the cutoff goes to the final ranking.
    Every query meets every row, in blocks: a group holds about ``group_rows`` rows, streams ``QUERIES`` queries at a
    time, and returns k rows a slice and query in phase 1, and in phase 3 those that no other group rules out.
    """
    spark = rows.sparkSession
    groups = max(1, -(-rows.count() // group_rows))
    n = min(groups, max(partitions(spark), 1)) if groups < partitions(spark) else partitions(spark)
    out = "query_id long, vec_id long, score long"

    def scored(frame_rows: pd.DataFrame, asked: pd.DataFrame):
        width = max(frame_rows["vector"].map(len).max(), asked["vector"].map(len).max())
        parts = _partials(_matrix(asked["vector"], width), _matrix(frame_rows["vector"], width), lists)
        other = asked["vec_id"].to_numpy()[:, None] != frame_rows["vec_id"].to_numpy()[None, :]
        return parts, other

    def result(asked: pd.DataFrame, frame_rows: pd.DataFrame, pick: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(pick)
        score = total[i, j]
        if score.dtype == object:
            score = np.array([min(max(s, LONG_MIN), LONG_MAX) for s in score], np.int64)
        return pd.DataFrame(
            {"query_id": asked["vec_id"].to_numpy()[i], "vec_id": frame_rows["vec_id"].to_numpy()[j], "score": score.astype(np.int64)}
        )

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held, asked in _groups(frames):
            parts, other = scored(held, asked)
            total = sum(parts)
            pick = np.zeros(total.shape, bool)
            for p in parts:
                lowest = -np.inf if p.dtype != object else min(p.min(), 0) - 1
                pick |= _best(np.where(other, p, lowest), k)
            pick &= other
            lowest = -np.inf if total.dtype != object else min(total.min(), 0) - 1
            pick &= _best(np.where(pick, total, lowest), k)  # of these the group's best k decide the cutoff
            yield result(asked, held, pick, total)

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held, asked in _groups(frames):
            parts, other = scored(held, asked)
            cutoff = asked["cutoff"].to_numpy(float)  # NaN: fewer than k candidates, all pass
            least = np.where(np.isnan(cutoff), -np.inf, cutoff)[:, None]
            passing = np.zeros(other.shape, bool)
            for p in parts:
                passing |= np.asarray(p >= least / len(parts), bool)
            passing &= other
            total = sum(parts)
            passing &= np.asarray(total >= least, bool)
            lowest = -np.inf if total.dtype != object else min(total.min(), 0) - 1
            passing &= _best(np.where(passing, total, lowest), k)
            yield result(asked, held, passing, total)

    asked = queries.withColumn("cutoff", F.lit(None).cast("double"))
    seen = _sent(rows, asked, groups, n).mapInPandas(first, out)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # Scores beyond 2^53 would round up as a double; a cutoff must not exceed the score.
    safe = F.col("score").cast("double")
    safe = F.when(F.abs(safe) >= EXACT, safe - F.abs(safe) * 1e-12).otherwise(safe)
    cutoffs = seen.withColumn("place", place).filter(F.col("place") == k).select(F.col("query_id").alias("vec_id"), safe.alias("cutoff"))
    known = queries.join(cutoffs, "vec_id", "left")
    found = _sent(rows, known, groups, n).mapInPandas(last, out).dropDuplicates()
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_uniform_threshold(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows of all embeddings for every vector whose id is divisible by 50."""
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH good AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum([q.v[i] * r.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM good q JOIN good r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""
