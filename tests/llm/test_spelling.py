"""Spelling variants against comparison of all pairs."""

import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import spelling


def plain_counts(rows):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def vocabulary():
    """Words with variants of variants, words of two letters in any order, long ones, and words of letters beyond Latin."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéüñßÿÀ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 14))) for _ in range(60)]
    base += ["".join(rng.choice("ab") for _ in range(8)) for _ in range(120)]
    base += ["abcdefgh" * 40, "日本語日本語日本語", "日本語日本語日本🙂"]
    counts = {}
    for w in base:
        counts[w] = rng.choice([2, 5, 40, 300, 40_000])
        for _ in range(4):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            counts.setdefault(v, rng.choice([2, 3, 30, 3000]))
    return counts


@pytest.mark.parametrize("groups,limit", [(12, 50_000), (12, 20), (3, 5), (1, 1)])
def test_forms_against_all_pairs(spark, vocabulary, groups, limit):
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(4)
    got = [tuple(r) for r in spelling.spelling_forms(words, groups, limit).collect()]
    assert len(got) == len(vocabulary) and set(got) == plain_forms(vocabulary)


def test_searches_in_parts(spark, vocabulary, monkeypatch):
    """Cells whose questions come in several parts, crowded leaves and short comparisons give the same pairs."""
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    of = spelling.group_table(words, 4)
    names = pa.array(sorted(vocabulary))
    points, starts = spelling.letters_of(names)
    vectors = spelling.vectors_of(points, starts, of, 4)
    n = len(names)
    want = {(a, b) for a in vocabulary for b in vocabulary if a < b and one_edit(a, b)}
    for held, checked, crowded in ((200_000, 8 << 20, 64), (7, 50, 0), (50, 300, 10**9), (200_000, 8 << 20, 0)):
        monkeypatch.setattr(spelling, "HELD", held)
        monkeypatch.setattr(spelling, "CHECKED", checked)
        monkeypatch.setattr(spelling, "CROWDED", crowded)
        every = np.ones(n, bool)
        a, b = spelling.search(points, starts, vectors, np.zeros(n, np.int64), every, every, np.zeros(n, np.int32))
        pairs = [tuple(sorted((names[int(x)].as_py(), names[int(y)].as_py()))) for x, y in zip(a, b, strict=True)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_questions_beyond_one_search(spark, vocabulary, tmp_path):
    """One task, batches of a few rows: cells go on from search to search."""
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    of = spelling.group_table(words, 4)
    rows = words.selectExpr("0L as cell", "true as own", "0 as spent", "word", "n")
    dealt = spelling.dealt(rows, of, 4, 0, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    before = spelling.HELD
    try:
        spelling.HELD = 40
        got = [tuple(sorted((r.a, r.b))) for r in spelling.searched(dealt, of, 4, 2, 1).collect()]
    finally:
        spelling.HELD = before
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(a, b) for a in vocabulary for b in vocabulary if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_stay_together_behind_a_join(spark, vocabulary, monkeypatch):
    """Adaptive execution may turn the join with the sizes into a broadcast and read what it dealt by mapper."""
    want = {(a, b) for a in vocabulary for b in vocabulary if a < b and one_edit(a, b)}
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        words = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(8)
        for few in (spelling.FEW, 0):
            monkeypatch.setattr(spelling, "FEW", few)
            got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(words).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_order_of_a_pair_plays_no_part(spark, vocabulary, monkeypatch):
    """Rows reach a search in any order, so each run of it may name either word of a pair first."""
    near_pairs = spelling.near_pairs

    def turned(*args):
        def run(batches):
            for batch in batches:
                turn = np.frombuffer(os.urandom(batch.num_rows), np.uint8) % 2 == 1
                a, b, a_n, b_n = (np.array(c.to_pylist(), object) for c in batch.columns)
                swapped = [np.where(turn, y, x).tolist() for x, y in ((a, b), (b, a), (a_n, b_n), (b_n, a_n))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(swapped, batch.schema.types, strict=True)], batch.schema.names)

        return near_pairs(*args).mapInArrow(run, spelling.PAIRS)

    monkeypatch.setattr(spelling, "near_pairs", turned)
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert {tuple(r) for r in spelling.spelling_forms(words).collect()} == plain_forms(vocabulary)


def test_query_against_the_rules(spark, tmp_path):
    rng = random.Random(2)
    pool = ["".join(rng.choice("AEIOUstrnlé") for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(200))) + "," + rng.choice(pool)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 5000 + " " + "x" * 4999), (503, "x" * 5000 + "-" + "x" * 4999), (None, " ".join(pool)), rows[4]]
    docs = spark.createDataFrame([(*r, 5, "w") for r in rows], "doc_id long, text string, n int, word string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in spelling.op12_count_trie(spark, str(tmp_path)).collect()}
    assert got == plain_forms(plain_counts(rows)) and any(r[1] for r in got)


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_forms(spelling.word_counts(empty)).count() == 0


def test_comparing_many_pairs_takes_bounded_memory():
    n = 800_000
    points = np.tile(np.arange(97, 109, dtype=np.uint32), 2)
    points[12] = 122
    starts = np.array([0, 12, 24])
    a, b = np.zeros(n, np.int64), np.ones(n, np.int64)
    tracemalloc.start()
    assert spelling.near(points, starts, a, b).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
