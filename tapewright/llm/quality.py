"""Quality by co-training: one classifier reads the text, one the page's metadata; each labels for the other where it is sure."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import flat, mixed, sized, table
from tapewright.llm.neardup import word_hashes

LABELLED, POOL = 3000, 3000  # documents to learn from, at most: of the labelled ones, and of all
PAIRS = 1024  # hashed byte pairs of the text view
ROUNDS, GROWTH, SURE = 4, 0.1, 0.95  # rounds, share of the pool labelled in each, least confidence
SHRINK = 200  # bytes added to a text's length before shares of pairs are taken
HASHED = 64  # hashed values of language and source

_UPPER, _DIGIT, _MARK, _LETTER = (np.zeros(256, np.float32) for _ in range(4))
_UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = 1
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1


def text_view(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What a text is made of: shares of kinds of characters, of words that repeat the one before, of
    distinct words, and of hashed byte pairs (shrunk in short texts), over the whole text."""
    n = len(ends) - 1
    sizes = np.maximum(np.diff(ends), 1)[:, None]
    owner = np.repeat(np.arange(n), np.diff(ends))
    kinds = np.column_stack([np.bincount(owner, weights=k[buf], minlength=n) for k in (_UPPER, _DIGIT, _MARK, _LETTER)]) / sizes
    words, bounds = word_hashes(buf, ends)
    reader = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.maximum(np.diff(bounds), 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (reader[1:] == reader[:-1])
    pairs = np.unique(np.stack([reader.astype(np.uint64), words]), axis=1)[0].astype(np.int64) if len(words) else reader
    repeats = np.column_stack([np.bincount(reader, weights=again, minlength=n) / counts, np.bincount(pairs, minlength=n) / counts])
    if len(buf) > 1:
        code = buf[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + buf[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)
        code = (code >> np.uint32(22)).astype(np.int64)
        inside = owner[1:] == owner[:-1]
        pairs = np.bincount(owner[:-1][inside] * PAIRS + code[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    else:
        pairs = np.zeros((n, PAIRS))
    return np.column_stack([kinds, repeats, np.sqrt(pairs / (sizes + SHRINK))]).astype(np.float32)


def _hashed(column: pa.Array) -> np.ndarray:
    """Each value's hashed place, taken from all its bytes; a null has none."""
    out = np.zeros((len(column), HASHED), np.float32)
    coded = column.dictionary_encode()
    places = np.array([crc32(v.encode()) for v in coded.dictionary.to_pylist()], np.uint64)
    known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    at = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)[known]
    out[known, (mixed(places) % np.uint64(HASHED)).astype(np.int64)[at]] = 1
    return out


def metadata_view(batch: pa.RecordBatch, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What is known about a page apart from its wording: language, source, stated length, and its layout in lines."""
    n = batch.num_rows
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(n), sizes)
    lines = np.bincount(owner, weights=buf == 10, minlength=n) + 1
    words = np.bincount(owner, weights=buf == 32, minlength=n) + 1
    stated = np.array([v or 0 for v in batch.column("n_chars").to_pylist()], float)
    numbers = np.column_stack([np.log1p(np.maximum(stated, 0)), np.log1p(sizes), np.log1p(lines), np.log1p(sizes / lines), sizes / words / 10])
    return np.column_stack([numbers / 5, _hashed(batch.column("lang")), _hashed(batch.column("source"))]).astype(np.float32)


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    buf, ends = flat(batch.column("text"))
    return text_view(buf, ends), metadata_view(batch, buf, ends)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Linear:
    """Logistic regression on standardised features, classes weighted alike, with its calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
        z = ((x - self.mean) / self.scale).astype(np.float32)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)) / len(y)
        rate = 4.0 / max(np.square(z).sum(axis=1).mean(), 1.0)
        speed, speed_b = np.zeros_like(w), 0.0
        for _ in range(rounds):
            e = (weight * (sigmoid(z @ w + b) - y)).astype(np.float32)
            speed, speed_b = 0.9 * speed - np.float32(rate) * (z.T @ e + np.float32(1e-3) * w), 0.9 * speed_b - rate * e.sum()
            w, b = w + speed, b + speed_b
        self.w, self.b = w, b

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w + self.b, -15, 15)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights (last: offset) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(np.clip(x @ w, -30, 30))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


class Model:
    """Two views' classifiers and how their scores combine: each is calibrated alone, then both together."""

    def __init__(self, text: Linear, meta: Linear, alone: list[np.ndarray], both: np.ndarray):
        self.views, self.alone, self.both = (text, meta), alone, both

    def __call__(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        z = np.column_stack([np.clip(m(x) * a[0] + a[1], -15, 15) for m, x, a in zip(self.views, xs, self.alone, strict=True)])
        return sigmoid(np.clip(z @ self.both[:2] + self.both[2], -30, 30)).astype(np.float64)


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], seed: int = 5) -> Model:
    """Both classifiers from few labels and a pool without: in each round each one labels the documents of the pool it
    is surest of, at most a share and in the classes' proportions, and the other one learns from these too.

    A quarter of the labels is kept aside for calibration.
    """
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.25
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    hold = aside if aside.any() else ~aside
    own = [(x[~aside], y[~aside]) for x in labelled]  # what each view learns from
    models = [Linear(*o) for o in own]
    free = np.ones(len(pool[0]), bool)
    for _ in range(ROUNDS):
        if not free.any():
            break
        taught = []
        for view in (0, 1):
            a = calibrated(models[view](labelled[view][hold])[:, None], y[hold])
            p = sigmoid(models[view](pool[view]) * a[0] + a[1])
            quota = max(int(GROWTH * len(p)), 1)
            for label, sure in ((1, p), (0, 1 - p)):
                at = np.flatnonzero(free & (sure >= SURE))
                at = at[np.argsort(-sure[at], kind="stable")][: max(int(quota * (y == label).mean()), 1)]
                taught.append((1 - view, at, np.full(len(at), label)))
        for view, at, label in taught:
            own[view] = np.concatenate([own[view][0], pool[view][at]]), np.concatenate([own[view][1], label])
            free[at] = False
        models = [Linear(*o) for o in own]
    alone = [calibrated(m(x[hold])[:, None], y[hold]) for m, x in zip(models, labelled, strict=True)]
    z = np.column_stack([np.clip(m(x[hold]) * a[0] + a[1], -15, 15) for m, x, a in zip(models, labelled, alone, strict=True)])
    both = calibrated(z, y[hold])
    for view in (0, 1):  # a view that the other one makes superfluous has no say, rather than an inverted one
        if both[view] < 0:
            rest = calibrated(z[:, [1 - view]], y[hold])
            both = np.zeros(3)
            both[1 - view], both[2] = rest
    return Model(*models, alone, both)


NEEDED = ["doc_id", "text", "lang", "source", "n_chars"]


def _features(docs: DataFrame) -> pd.DataFrame:
    """Both views of a bounded set of documents, computed where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            text, meta = views(batch)
            cells = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (text, meta)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *cells], ["doc_id", "label", "text", "meta"])

    rows = docs.mapInArrow(run, "doc_id long, label int, text binary, meta binary").toPandas()
    return rows.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """The model of a corpus from ``labels.quality``. Samples are the documents first by hash, ``labelled`` and ``pool``
    of them at most; without both classes among the labels there is no model."""
    mark = F.xxhash64("doc_id", F.lit(23))
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    picks = [known.filter(F.col("label") == c).orderBy(mark, "doc_id").limit(labelled // 2) for c in (0, 1)]
    own = slim(docs)
    some = own.filter("doc_id is not null").join(known, "doc_id", "left_anti").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(pool)
    chosen = picks[0].union(picks[1]).union(some.withColumn("label", F.lit(-1)))
    rows = _features(own.join(F.broadcast(chosen), "doc_id").select(*NEEDED, "label"))
    known_rows, free = rows[rows["label"] >= 0], rows[rows["label"] < 0]
    if known_rows["label"].nunique() < 2:
        return None

    def matrix(cells: pd.Series, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(cells), np.float32).reshape(-1, width)

    widths = (6 + PAIRS, 5 + 2 * HASHED)
    both = [tuple(matrix(r[c], w) for c, w in zip(("text", "meta"), widths, strict=True)) for r in (known_rows, free)]
    return co_train(both[0], known_rows["label"].to_numpy(), both[1])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score``: how likely a document is a good one (1.0 for all if there is no model).

    Nulls in any column count as empty or zero, empty and very long texts are scored whole, repeated rows alike; an
    empty table gives an empty result. Row by row, no shuffle. Needs ``doc_id text lang source n_chars``; other columns
    are kept, one named ``score`` is replaced.
    """
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            got = model(views(batch)) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double")


def op4_co_training(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
