"""Packing against the tokenizers library, the rules of sequences and exhaustive search."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapewright.llm import packing
from tapewright.llm.bpe import vocabulary_path

PATH = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(PATH))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = ["".join(rng.choice("aeioustrnléü日") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", "   ", "one\n\n two  three\t", "x" * 3000, "it's <|endoftext|> 12 <|endoftext|>", texts[0], " ".join(pool) * 3]
    out = [(i, t, 7, "n", b"z") for i, t in enumerate(texts)]
    return out + [out[3], (None, texts[4], 7, "n", b"z"), (None, None, 7, "n", b"z")]


def check(got, rows, library, capacity):
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, *_ in rows)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & at - 1 == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    # Rows with one id and length may be equal or not: the pieces of all of them together are the ids of all of them.
    asked = defaultdict(Counter)
    for (i, ids), n in want.items():
        asked[i, len(ids)].update({ids: n})
    assert set(asked) == set(pieces)
    for key, texts in asked.items():
        n = sum(texts.values())
        at = Counter(start for start, _ in pieces[key])
        if n == 1:
            joined = tuple(x for _, ids in sorted(pieces[key]) for x in ids)
            assert joined == next(iter(texts)) and max(at.values()) == 1
        else:
            assert sum(len(ids) for _, ids in pieces[key]) == n * key[1]


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_every_id_lies_in_one_full_sequence(spark, rows, library, capacity):
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest int, key string, ids binary").repartition(5)
    check(packing.packed(docs, vocabulary_path(PATH), capacity).collect(), rows, library, capacity)


def test_starts_beyond_the_broadcast_bound(spark, rows, library, monkeypatch):
    monkeypatch.setattr(packing, "FEW", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest int, key string, ids binary").repartition(3)
    check(packing.packed(docs, vocabulary_path(PATH), 32).collect(), rows, library, 32)


def test_one_length_for_all_rows(spark, library):
    rows = [(i, "same words in every row") for i in range(500)]
    check(packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_path(PATH), 32).collect(), rows, library, 32)


def test_no_documents(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path(PATH)).count() == 0


def test_query_columns(spark, tmp_path, library):
    text = "A short text, cut nowhere."
    spark.createDataFrame([(4, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op11_cutting_stock(spark, str(tmp_path)).collect()
    ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
    joined = b"".join(ids[r.start : r.start + r.length].tobytes() for r in got)
    assert joined == ids.tobytes() and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got)
    assert {r.doc_tokens for r in got} == {len(ids)}


def most_patterns(histogram, capacity):
    """Most sequences that can be filled exactly, by search over all patterns."""
    lengths = sorted(histogram)
    patterns = [
        p
        for p in itertools.product(*(range(min(histogram[k], capacity // k) + 1) for k in lengths))
        if sum(a * k for a, k in zip(p, lengths, strict=True)) == capacity
    ]

    def best(left, at):
        if at == len(patterns):
            return 0
        top, n = 0, 0
        while all(x >= n * a for x, a in zip(left, patterns[at], strict=True)):
            rest = tuple(x - n * a for x, a in zip(left, patterns[at], strict=True))
            top = max(top, n + best(rest, at + 1))
            n += 1
        return top

    return best(tuple(histogram[k] for k in lengths), 0)


def test_patterns_against_search():
    rng = random.Random(3)
    short = 0
    for _ in range(60):
        capacity = rng.choice([8, 10, 12])
        histogram = {k: rng.randrange(1, 6) for k in rng.sample(range(1, capacity), 4)}
        stock = packing.cutting_stock(histogram, capacity)
        used = Counter()
        for uses, pattern in zip(stock.uses, stock.patterns, strict=True):
            assert sum(k * n for k, n in pattern) == capacity and uses > 0
            used.update({k: n * uses for k, n in pattern})
        assert all(used[k] <= histogram[k] for k in used)
        short += most_patterns(histogram, capacity) - sum(stock.uses)
    assert 0 <= short <= 3  # rounding may cost one here or there


def test_program_reaches_its_bound_on_many_lengths():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.integers(1, 256, 20_000), rng.integers(1, 256, 20_000))  # short ones are more frequent
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    stock = packing.cutting_stock(histogram, 256)
    assert sum(stock.uses) >= 0.999 * int(lengths.sum()) // 256


def test_library_and_faster_library_agree(library):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab  \n\t'sé日½1٣<|>endoftext 　\x1c ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in [*texts, " " * 5000, "a" * 20_000, "\n" * 3000 + "x"]:
        assert packing.token_ids(t, vocabulary_path(PATH)) == library.encode(t, add_special_tokens=False).ids
