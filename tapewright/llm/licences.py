"""Licence scans with a positional index of rare words: templates are found by where their rarest words stand."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import flat, sized, table

# The phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence wording by label, and the phrase without which a place does not count.
TEMPLATES = [
    ("gpl", "gnu general public license", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

RARE = 3  # words of a template that are looked up
FIT = 0.75  # least share of a template's words that stand in their places

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Pattern:
    label: str
    words: tuple[str, ...]
    needed: tuple[str, ...]  # a run of ``words`` that has to be there whole
    base: bool

    @property
    def needed_at(self) -> int:
        n = len(self.needed)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.needed)


def patterns() -> list[Pattern]:
    base = [Pattern(label, tuple(p.split()), tuple(p.split()), True) for p, label in BASE.items()]
    return base + [Pattern(label, tuple(t.split()), tuple(p.split()), False) for label, t, p in TEMPLATES]


class Index:
    """Numbers the words of a text that occur in licences; other words are -1."""

    def __init__(self, vocabulary: list[str]):
        self.words = vocabulary
        self.raw = [w.encode() for w in vocabulary]
        self.lengths = np.array([len(r) for r in self.raw])
        self.longest = int(self.lengths.max())
        keys = [int.from_bytes(r[:7].ljust(7, b"\0") + bytes([min(len(r), 255)]), "big") for r in self.raw]
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.codes = np.array(keys, np.uint64)[order], order

    def read(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts that lie one after another: each text's first word number (and the total), and the words' codes."""
        low = LOWER[buf]
        inside = WORD_BYTE[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = ends[:-1]
        edges = edges[edges < len(buf)]
        first[edges] = inside[edges]  # a word does not run on into the next text
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = edges[edges > 0] - 1
        last[at] = inside[at]
        stops = np.flatnonzero(last) + 1
        codes = np.full(len(starts), -1, np.int32)
        lengths = stops - starts
        near = np.flatnonzero(lengths <= self.longest)
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        key = np.zeros(len(near), np.uint64)
        for k in range(7):
            byte = np.where(lengths[near] > k, padded[starts[near] + k], 0).astype(np.uint64)
            key = (key << np.uint64(8)) | byte
        key = (key << np.uint64(8)) | lengths[near].astype(np.uint64)
        # Words longer than seven bytes may share a key: each of the key's words is compared in full.
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        hit = np.flatnonzero(hi > lo)
        while len(hit):
            code = self.codes[lo[hit]]
            where = near[hit]
            sure = np.ones(len(hit), bool)
            for k in range(7, self.longest):
                want = np.array([r[k] if k < len(r) else 0 for r in self.raw], np.int16)[code]
                deep = k < self.lengths[code]
                got = padded[np.minimum(starts[where] + k, len(padded) - 1)]
                sure &= ~deep | (got == want)
            codes[where[sure]] = code[sure]
            lo[hit] += 1
            hit = hit[~sure & (lo[hit] < hi[hit])]
        return np.searchsorted(starts, ends), codes


def document_frequency(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows each licence word stands, over the whole table: a row for each licence word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = Index(words), np.zeros(len(words), np.int64)
        for batch in sized(batches):
            bounds, codes = index.read(*flat(batch.column("text")))
            known = np.flatnonzero(codes >= 0)
            owner = np.searchsorted(bounds, known, side="right") - 1
            pair = np.unique(owner * len(words) + codes[known])
            seen += np.bincount(pair % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(seen)], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.collect()}


def places(codes: np.ndarray, bounds: np.ndarray, pattern: Pattern, code: dict[str, int], weight: dict[str, float]):
    """Starts of a pattern's places in word numbers, and the share of its words that stand there.

    The rarest words' positions, shifted by their place in the pattern, propose starts; words in their places and the
    needed phrase decide. A base pattern has to stand there whole, so one rare word proposes all its places.
    """
    words = np.array([code[w] for w in pattern.words])
    n = len(words)
    rare = sorted(set(pattern.words), key=lambda w: (-weight[w], w))[: 1 if pattern.base else RARE]
    starts = [np.flatnonzero(codes == code[w]) - k for w in rare for k in range(n) if pattern.words[k] == w]
    starts = np.unique(np.concatenate(starts))
    total = len(codes)
    must = np.arange(pattern.needed_at, pattern.needed_at + len(pattern.needed))
    low, high = starts + must[0], starts + must[-1]
    starts = starts[(low >= 0) & (high < total)]
    owner = np.searchsorted(bounds, starts + must[0], side="right") - 1
    end = bounds[owner + 1]
    starts, owner, end = (x[starts + must[-1] < end] for x in (starts, owner, end))
    here = np.zeros((len(starts), n), bool)
    for k in range(n):
        at = starts + k
        ok = (at >= bounds[owner]) & (at < end)
        here[ok, k] = codes[at[ok]] == words[k]
    share = here.mean(axis=1) if len(starts) else np.zeros(0)
    good = here[:, must].all(axis=1) & (share >= (1.0 if pattern.base else FIT))
    return starts[good], owner[good], share[good]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence wording of every row: counts and places of the base phrases, labels, and the best template's share.

    A null text counts as empty: no words, no labels, score 0. Null keys and repeated rows are kept. Words run over
    letters a-z after lower-casing A-Z, digits and all bytes beyond ASCII, over the whole text. Word frequencies come
    from one pass over all rows and are as many as licence words; the scan is row by row, without a shuffle.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    every = patterns()
    words = sorted({w for p in every for w in p.words})
    seen = document_frequency(own, words)
    weight = {w: -math.log1p(seen.get(w, 0)) for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, code = Index(words), {w: i for i, w in enumerate(words)}
        for batch in sized(batches):
            bounds, codes = index.read(*flat(batch.column("text")))
            rows = batch.num_rows
            n_base, score = np.zeros(rows, np.int64), np.zeros(rows)
            first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            base, labels = [set() for _ in range(rows)], [set() for _ in range(rows)]
            for p in every:
                starts, owner, share = places(codes, bounds, p, code, weight)
                for i in np.unique(owner):
                    labels[i].add(p.label)
                    if p.base:
                        base[i].add(p.label)
                np.maximum.at(score, owner, share)
                if p.base:
                    n_base += np.bincount(owner, minlength=rows)
                    np.minimum.at(first, owner, starts - bounds[owner])
                    np.maximum.at(last, owner, starts - bounds[owner])
            none = last < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(n_base),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(score),
                ],
                ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = own.schema["key"].dataType.simpleString()
    out = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return own.mapInArrow(run, f"key {kind}, {out}").withColumnRenamed("key", key)


def op7_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
