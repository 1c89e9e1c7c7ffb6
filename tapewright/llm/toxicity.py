"""Toxicity with a bidirectional gated recurrent network in numpy: character and word inputs, attention pooling, all windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import flat, mixed, sized, spread, table

STEPS, STRIDE = 32, 16  # words of a window, and from one window to the next
WORDS, GRAMS, WIDTH = 1 << 14, 1 << 14, 8  # rows of the word and of the character table, and their width
HIDDEN, ATTENTION = 8, 8
SAMPLE = 1500  # labelled documents of each class to learn from, at most
PER_DOC = 48  # windows of a labelled document to learn from, at most
BLOCK = 4096  # windows scored at once

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def read_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: bytes of all texts, starts and ends of the words, and each text's first word (and the total)."""
    buf, ends = flat(pc.utf8_lower(column.fill_null("")))
    inside = WORD_BYTE[buf]
    edge = ends[:-1][ends[:-1] < len(buf)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return buf, starts, stops, np.searchsorted(starts, ends)


def vocabulary(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Distinct words: for each word the number of its distinct one; of each distinct one the row in the word table, and
    its trigrams' rows in the character table (flat, with counts). Words are padded by a mark at both ends."""
    sizes = stops - starts
    at = spread(starts, sizes)
    first = np.cumsum(sizes) - sizes
    inner = np.arange(len(at)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
        parts = mixed(buf[at].astype(np.uint64) + np.uint64(1)) * powers[inner]
    sums = np.add.reduceat(parts, first) if len(first) else np.empty(0, np.uint64)
    _, sample, number = np.unique(mixed(sums + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
    own = sizes[sample]
    rows = (mixed(sums[sample] + own.astype(np.uint64)) % np.uint64(WORDS)).astype(np.int64)
    at = spread(starts[sample], own)
    first = np.cumsum(own) - own
    inner = np.arange(len(at)) - np.repeat(first, own)
    here = buf[at].astype(np.uint64)
    before = np.where(inner == 0, 1, buf[at - 1]).astype(np.uint64)
    after = np.where(inner == np.repeat(own, own) - 1, 2, buf[np.minimum(at + 1, len(buf) - 1)]).astype(np.uint64)
    grams = (mixed(before << np.uint64(16) | here << np.uint64(8) | after) % np.uint64(GRAMS)).astype(np.int64)
    return number, rows, grams, own


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window. Every word is in one; a text without words has none."""
    counts = np.diff(bounds)
    n = np.where(counts > 0, np.maximum(-(-(counts - STEPS) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[owner] + nth * STRIDE
    return start, np.minimum(STEPS, bounds[owner + 1] - start), owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Reads windows of words both ways and weighs its states by attention. Parameters are plain arrays."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {
            "word": np.zeros((WORDS, WIDTH), np.float32),
            "gram": np.zeros((GRAMS, WIDTH), np.float32),
            "input": draw(2 * WIDTH, 2 * 3 * HIDDEN),
            "bias": np.zeros(2 * 3 * HIDDEN, np.float32),
            "state": draw(2, HIDDEN, 3 * HIDDEN),
            "look": draw(2 * HIDDEN, ATTENTION),
            "weigh": draw(ATTENTION),
            "out": draw(2 * HIDDEN),
            "offset": np.zeros(1, np.float32),
        }

    def inputs(self, rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input of each distinct word: its own vector and the mean of its trigrams' vectors."""
        first = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(self.p["gram"][grams], first, axis=0) / sizes[:, None] if len(rows) else np.zeros((0, WIDTH))
        return np.concatenate([self.p["word"][rows], mean.astype(np.float32)], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, for both directions; a last row of zeros stands for padding."""
        g = x @ self.p["input"] + self.p["bias"]
        return np.concatenate([g, np.zeros((1, g.shape[1]), np.float32)])

    def run(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. ``ids`` (windows, steps) number rows of ``gates``."""
        n, h = len(ids), np.zeros((2, len(ids), HIDDEN), np.float32)
        states = np.empty((n, STEPS, 2, HIDDEN), np.float32)
        kept = []
        both = gates.reshape(-1, 2, 3 * HIDDEN)
        for t in range(STEPS):
            back = STEPS - 1 - t
            g = np.stack([both[ids[:, t], 0], both[ids[:, back], 1]])
            live = np.stack([mask[:, t], mask[:, back]])[..., None]
            a = h @ self.p["state"]
            zr = sigmoid(g[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(g[..., 2 * HIDDEN :] + r * a[..., 2 * HIDDEN :])
            after = np.where(live, c + z * (h - c), h)
            if keep:
                kept.append((h, z, r, c, a[..., 2 * HIDDEN :], live))
            h = after
            states[:, t, 0], states[:, back, 1] = h[0], h[1]
        s = states.reshape(n, STEPS, 2 * HIDDEN)
        u = np.tanh(s @ self.p["look"])
        e = np.where(mask, u @ self.p["weigh"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        w = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", w, s)
        logit = pooled @ self.p["out"] + self.p["offset"][0]
        return (logit, (kept, s, u, w, pooled)) if keep else logit

    def gradients(self, gates, ids, mask, wanted: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted log loss, and that of ``gates``."""
        logit, (kept, s, u, w, pooled) = self.run(gates, ids, mask, keep=True)
        n = len(ids)
        d_logit = ((sigmoid(logit) - wanted) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "offset": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_s = w[..., None] * d_pooled[:, None, :]
        d_w = np.einsum("ntk,nk->nt", s, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
        g["weigh"] = np.einsum("ntk,nt->k", u, d_e)
        d_u = d_e[..., None] * self.p["weigh"] * (1 - u * u)
        g["look"] = s.reshape(-1, 2 * HIDDEN).T @ d_u.reshape(-1, ATTENTION)
        d_s = (d_s + d_u @ self.p["look"].T).reshape(n, STEPS, 2, HIDDEN)
        d_gates = np.zeros((len(gates), 2, 3 * HIDDEN), np.float32)
        g["state"] = np.zeros_like(self.p["state"])
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        turned = self.p["state"].transpose(0, 2, 1)
        for t in range(STEPS - 1, -1, -1):
            back = STEPS - 1 - t
            h, z, r, c, a_c, live = kept[t]
            d_h = d_h + np.stack([d_s[:, t, 0], d_s[:, back, 1]])
            d_live = np.where(live, d_h, 0)
            d_z = d_live * (h - c) * z * (1 - z)
            d_c = d_live * (1 - z) * (1 - c * c)
            d_r = d_c * a_c * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c * r], axis=-1)
            d_g = np.concatenate([d_z, d_r, d_c], axis=-1)
            g["state"] += h.transpose(0, 2, 1) @ d_a
            np.add.at(d_gates, (ids[:, t], 0), d_g[0])
            np.add.at(d_gates, (ids[:, back], 1), d_g[1])
            d_h = np.where(live, d_live * z, d_h) + d_a @ turned
        return g, d_gates.reshape(len(gates), -1)[:-1], logit


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a small logistic regression (last: offset) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def summary(logit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A text's evidence: its best window. A text without words has the least there is."""
    best = np.full(n, -20.0)
    np.maximum.at(best, owner, logit)
    return np.clip(best, -20, 20)[:, None]


class Scorer:
    """A trained network with the calibration of its texts' scores."""

    def __init__(self, network: Network, weights: np.ndarray):
        self.network, self.weights = network, weights

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, starts, stops, bounds = read_words(column)
        if not len(starts):
            return np.empty(0, np.float32), np.empty(0, np.int64)
        number, rows, grams, sizes = vocabulary(buf, starts, stops)
        gates = self.network.gates(self.network.inputs(rows, grams, sizes))
        first, length, owner = windows(bounds)
        out = np.empty(len(first), np.float32)
        for k in range(0, len(first), BLOCK):
            ids, mask = window_ids(number, first[k : k + BLOCK], length[k : k + BLOCK], len(gates) - 1)
            out[k : k + BLOCK] = self.network.run(gates, ids, mask)
        return out, owner

    def scores(self, column: pa.Array) -> np.ndarray:
        logit, owner = self.logits(column)
        x = summary(logit, owner, len(column))
        return sigmoid(np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)).astype(np.float64)


def window_ids(number: np.ndarray, first: np.ndarray, length: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    at = first[:, None] + np.arange(STEPS)
    mask = np.arange(STEPS) < length[:, None]
    return np.where(mask, number[np.minimum(at, len(number) - 1)], padding), mask


def train(texts: list[str], labels: np.ndarray, rounds: int = 4, seed: int = 7) -> Scorer:
    """Learns from whole-text labels: a toxic text has some toxic window, a clean one has none.

    Which windows of a toxic text to learn from is first guessed from how much more often words stand in toxic texts,
    then asked of the network itself. A fifth of the texts is left out of that and calibrates the scores.
    """
    rng = np.random.default_rng(seed)
    network = Network(seed)
    labels = np.asarray(labels)
    if not len(texts) or labels.min() == labels.max():
        return Scorer(network, np.array([0.0, 3.0 if len(labels) and labels.sum() else -3.0]))
    buf, starts, stops, bounds = read_words(pa.array(texts, pa.string()))
    number, rows, grams, sizes = vocabulary(buf, starts, stops)
    first, length, owner = windows(bounds)
    if len(owner):  # at most PER_DOC windows of a text, spread over it at random
        order = np.lexsort((rng.random(len(owner)), owner))
        rank = np.empty(len(owner), np.int64)
        rank[order] = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
        first, length, owner = (x[rank < PER_DOC] for x in (first, length, owner))
    ids, mask = window_ids(number, first, length, len(rows))
    apart = rng.random(len(texts)) < 0.2
    learn = ~apart[owner]
    # Evidence of words: log ratio of the shares of toxic and clean texts that hold them.
    words = np.unique(np.stack([np.repeat(np.arange(len(texts)), np.diff(bounds)), number]), axis=1)
    words = words[:, ~apart[words[0]]]
    toxic = np.bincount(words[1][labels[words[0]] == 1], minlength=len(rows))
    clean = np.bincount(words[1][labels[words[0]] == 0], minlength=len(rows))
    n1, n0 = max((labels[~apart] == 1).sum(), 1), max((labels[~apart] == 0).sum(), 1)
    odds = np.append(np.log((toxic + 0.3) / n1) - np.log((clean + 0.3) / n0), -9)
    guess = np.where(mask, odds[ids], -9).max(axis=1)
    adam = Adam(network.p, 0.01)
    bad = labels[owner] == 1
    gram_first = np.cumsum(sizes) - sizes
    for turn in range(rounds):
        # Of each toxic text the windows that score best; of clean ones those that score best too, and any others.
        best = np.full(len(texts), -1e9)
        np.maximum.at(best, owner, guess)
        top = learn & (guess >= best[owner] - 0.5)
        chosen, others = np.flatnonzero(top & bad), np.flatnonzero(learn & ~bad)
        hard = np.flatnonzero(top & ~bad)
        for _ in range(2):
            some = [rng.permutation(x)[: 2 * len(chosen)] for x in (hard, others)]
            take = np.concatenate([chosen, *some])
            take = rng.permutation(take)
            for k in range(0, len(take), 256):
                pick = take[k : k + 256]
                used, local = np.unique(ids[pick], return_inverse=True)
                local = local.reshape(len(pick), STEPS)
                used = used[used < len(rows)]
                at = spread(gram_first[used], sizes[used])
                x = network.inputs(rows[used], grams[at], sizes[used])
                gates = network.gates(x)
                weight = np.where(bad[pick], 2.0, 1.0).astype(np.float32)
                grad, d_gates, _ = network.gradients(gates, local, mask[pick], bad[pick].astype(np.float32), weight)
                grad["input"], grad["bias"] = x.T @ d_gates, d_gates.sum(axis=0)
                d_x = d_gates @ network.p["input"].T
                grad["word"] = np.zeros_like(network.p["word"])
                np.add.at(grad["word"], rows[used], d_x[:, :WIDTH])
                grad["gram"] = np.zeros_like(network.p["gram"])
                np.add.at(grad["gram"], grams[at], np.repeat(d_x[:, WIDTH:] / sizes[used][:, None], sizes[used], axis=0))
                adam.step(grad)
        gates = network.gates(network.inputs(rows, grams, sizes))
        guess = np.concatenate([network.run(gates, ids[k : k + BLOCK], mask[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)] or [guess])
    scorer = Scorer(network, np.zeros(2))
    held = np.flatnonzero(apart)
    if len(held) < 20 or labels[held].min() == labels[held].max():
        held = np.arange(len(texts))
    logit, owner = scorer.logits(pa.array([texts[i] for i in held], pa.string()))
    scorer.weights = logistic(summary(logit, owner, len(held)), labels[held])
    return scorer


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Texts to learn from: of each class the ``sample`` documents first by hash, folds 1 to 4 only. Bounded by that."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.filter("toxic is not null and doc_id is not null").filter(fold != 0).select("doc_id", F.col("toxic").cast("int").alias("label"))
    mark = F.xxhash64("doc_id", F.lit(17))
    picks = [known.filter(F.col("label") == y).orderBy(mark, "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picks[0].union(picks[1])), "doc_id").toPandas()
    return rows.fillna({"text": ""}).drop_duplicates("doc_id").sort_values("doc_id")


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row, from all overlapping windows of the whole text.

    Inputs are the text alone. A null, empty or wordless text scores what the calibration gives for no windows; null
    ids and repeated rows are kept. Row by row, without a shuffle; memory is bounded by a megabyte of text, or the
    words of one longer text, and a block of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(batch.column("text")))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op8_gated_network(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = labelled(docs, table(spark, sf_dir, "labels"))
    scorer = train(known["text"].tolist(), known["label"].to_numpy())
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return score(docs, scorer).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
