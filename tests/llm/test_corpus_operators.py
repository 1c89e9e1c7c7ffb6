"""Corpus operators against plain versions, on small and on awkward tables."""

import hashlib
import pathlib
import random
import re
import time
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tapewright.llm import bpe, components, decontamination, html, licences, neardup, quality, sharding, suffixes, topk, toxicity
from tapewright.llm.common import pack, spread, unpack

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, and repeated rows."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("aeioustrnléü") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    texts = [words(rng, rng.randrange(1, 160), pool) for _ in range(60)]
    passage = words(rng, 70, pool)
    for i in range(8):
        texts.append(words(rng, 20, pool) + "\n" + passage + "\n" + words(rng, 30, pool))
    base = words(rng, 200, pool).split()
    for i in range(8):
        own = list(base)
        own[rng.randrange(200)] = f"edit{i}"
        texts.append(" ".join(own))
    texts += [texts[3], texts[3].upper(), None, "", "   ", "one two", "one  two", "a" * 5000, words(rng, 4000, pool), "ab" * 40]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    extra = [(i, t, "en", "s", len(t or ""), 1, b"x", 2.0, True) for i, t in corpus]
    names = ", chunk int, key binary, score double, kept boolean"
    return spark.createDataFrame(extra, DOCS + names).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_the_library(spark, docs, corpus, library):
    odd = ["it's 12 été ΣΑΣ İ \x1c x y <|endoftext|>end<|startoftext|>", "don'T  #$%&!! \t\n", "日本語 ½ ǅ́", "x" * 3000, "<|ENDOFTEXT|> <| endoftext|>"]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode(frame, bpe.vocabulary_path()).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i].append((ids, library.decode(ids, skip_special_tokens=False)))
    for r in got:
        assert (list(r.ids), r.decoded) in want[r.doc_id]


def test_bpe_of_nothing(empty):
    assert bpe.encoded_digests(empty, bpe.vocabulary_path()).count() == 0


def test_proposals_pass_only_if_exact():
    v = bpe.Vocabulary(bpe.vocabulary_path())
    rng = random.Random(1)
    pieces = ["".join(rng.choice("etaonshrin") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    assert v.encode_pieces(pieces) == [v.merged(p) for p in pieces]
    assert sum(v.propose(p) == v.merged(p) for p in pieces) < len(pieces)  # some do need exact merging


# --- long repeats


def plain_repeats(rows, length=50):
    """(id, text) to the bytes that go, straight from the definition."""
    held = defaultdict(set)
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - length + 1):
                held[b[k : k + length]].add(i)
    first = {s: min(ids) for s, ids in held.items()}
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, b, bytes(gone)))
    return out


@pytest.mark.parametrize("frequent", [2, 2000])
def test_repeats(docs, corpus, frequent):
    got = suffixes.without_repeats(docs, frequent=frequent).collect()
    want = sorted((str(i), bytes(c for c, g in zip(b, gone, strict=True) if not g), len([x for x in gone.split(b"\0") if x])) for i, b, gone in plain_repeats(corpus))
    assert sorted((str(r.doc_id), bytes(r.kept), len(r.removed)) for r in got) == want
    assert any(len(r.removed) > 0 for r in got) and {r.chunk for r in got} == {1}


def test_repeats_at_whole_characters(spark):
    shared = "é" * 40
    frame = spark.createDataFrame([(1, "a" + shared + "ü"), (2, "bc" + shared + "ä"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffixes.without_repeats(frame, whole_chars=True).collect()}
    assert got == {1: "a" + shared + "ü", 2: "bcä", 3: ""}


def test_repeats_of_nothing(empty):
    assert suffixes.without_repeats(empty).count() == 0


def test_previous_smaller():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300):
        v = rng.integers(0, 20, n)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert suffixes.previous_smaller(v).tolist() == want


# --- pages


def page(body, head="<head><title>x</title><style>p{}</style></head>"):
    return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def test_declared_articles(spark):
    body = (
        "<nav><a>Home</a></nav><header>Site</header><div class='cookie-notice'>We use</div><article><header><h1>A &amp; B</h1></header><p>One <b>two\n three<br>four"
        "<p>Five &lt;x&gt; &#233;</p><script>var t='</p>';</script><ul><li>six<li>seven</ul><aside>by the way</aside><form>send</form>"
        "<div class='comments'><p>first!</p></div></article><footer>end</footer>"
    )
    rows = [(1, "http://h/1", page(body)), (2, None, None), (None, "u", ""), (3, "http://h/3", "<p>only <i>this"), (1, "http://h/1", page(body))]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "A & B\n\nOne two three\n\nfour\n\nFive <x> é\n\nsix\n\nseven"
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", want), ("1", want), ("2", ""), ("3", "only this"), ("None", "")]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeats_of_a_host_are_boilerplate(spark):
    note = "<div>this site uses many small things to make your day a bit better</div>"
    end = "<div>read more of our very best stories here and there every day</div>"
    own = {i: " ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)}
    rows = [(i, f"https://Host.example/{i}", page(f"{note}<div><p>{t}</p></div>{end}")) for i, t in own.items()]
    rows += [(9, "https://other.example/9", rows[0][2]), (10, rows[0][1], rows[0][2])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert {i: got[i] for i in own} == own
    assert got[10] == own[0] and "many small things" in got[9]


PAGE = "page_id long, url string, html string"


def own_words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_repeats_inside_declared_articles(spark):
    note = "<div>this site uses many small things to make your day a bit better</div>"
    rows = [(i, f"http://h/{i}", page(f"<main>{note}<div><p>{own_words(i, 20)}</p></div></main>")) for i in range(5)]
    rows += [(5 + i, f"http://t/{i}", page(f"<article>teaser number {i}</article><div>{own_words(i, 60)}</div>")) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert {i: got[i] for i in range(5)} == {i: own_words(i, 20) for i in range(5)}
    assert all(own_words(i, 60) in got[5 + i] for i in range(3))


BODY = "<p>" + "Rain fell on the hills. " * 8 + "</p>"


@pytest.mark.parametrize(
    "page, kept",
    [
        (f'<div class="layout has-sidebar">{BODY}</div>', ["Rain"]),
        (f'<div class="entry-content no-sidebar">{BODY}</div>', ["Rain"]),
        (f'<div class="content-with-sidebar">{BODY}</div>', ["Rain"]),
        (f'<div title="The hidden valley">{BODY}</div>', ["Rain"]),
        (f'<div class="layout right-sidebar">{BODY}</div><div class="right-sidebar">Links</div>', ["Rain"]),
        (f'<article>{BODY}<section id="search-results">Finds</section></article>', ["Rain", "Finds"]),
        (f'<article>{BODY}<section id="comments">Nice</section><div class="reader-comments">Nice</div></article>', ["Rain"]),
        (f'<article><h2 class="post-header">Weather</h2>{BODY}</article>', ["Weather", "Rain"]),
        ("<article><p>so <math><mi>x</mi></math> equals y</p></article>", ["so x equals y"]),
        ("<article><p title=it's>Rain <a href=x'y\">fell</a></p></article>", ["Rain fell"]),
        ('<p>one <b>two</b> three <a href="#">four</a>, five<br>six</p>', ["one two three four, five", "six"]),
        ('<p>seen <span hidden>unseen</span> seen</p><div style="color: red; display:none">unseen</div>', ["seen", "seen"]),
        ('<div class="post comments">Nice</div><div class="row footer">Foot</div><div class="ad300x250">Buy</div><p>Rain</p>', ["Rain"]),
    ],
)
def test_names_of_boxes_are_whole_tokens(page, kept):
    got = [b.text for b in html.main_text(html.blocks(page), [])]
    assert len(got) == len(kept) and all(g == k or k == "Rain" and g.startswith("Rain") for g, k in zip(got, kept))


def test_any_markup_ends_in_linear_time():
    for page in ("<a " + "='" * 20000 + "<b>x" * 2000, "<x " + "= " * 50000, "<" * 100000, "<p title='" * 20000, '<a b="c" ' * 30000):
        start = time.monotonic()
        html.blocks(page)
        assert time.monotonic() - start < 5


@pytest.mark.parametrize("frequent", [html.FREQUENT, 1])
def test_boilerplate_of_short_pages_and_long_tokens(spark, frequent):
    note = "<div>this site uses many small things to make your day a bit better</div>"
    end = "<div>read more of our very best stories here and there every day</div>"
    rows = [(i, f"http://h/{i}", page(f"{note}<p>{own_words(i, 15)}</p>{end}")) for i in range(4)]
    # A page and its edited copy, and pages whose tokens only differ behind their first 64 bytes.
    copied = own_words(9, 60)
    rows += [(9, "http://h/9", page(f"{note}<p>{copied}</p>{end}")), (10, "http://h/10", page(f"{note}<p>{copied} edited</p>{end}"))]
    long = {i: " ".join("\u6f22" * 24 + f"{i}x{k}" for k in range(12)) for i in range(20, 24)}
    rows += [(i, f"http://l/{i}", page(f"<p>{t}</p>")) for i, t in long.items()]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGE), frequent).collect()}
    assert got == {i: own_words(i, 15) for i in range(4)} | {9: copied, 10: copied + " edited"} | long


def held(spark):
    """Bytes of the session's shuffle and checkpoint files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if spark.sparkContext.getCheckpointDir() else None
    kept = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) if folder else 0
    return kept + sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files))


def test_pages_take_less_disk_than_their_streams(spark, tmp_path):
    rng = random.Random(5)
    pool = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 10))) for _ in range(5000)]
    notes = [words(rng, 30, pool) for _ in range(40)]
    rows = [(i, f"http://h{i % 9}/{i}", page(f"<div>{notes[i % 40]}</div><p>{words(rng, 250, pool)}</p>")) for i in range(2000)]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(at)
    size = sum(f.stat().st_size for f in (tmp_path / "pages.parquet").glob("*.parquet"))
    before = held(spark)
    html.extract(spark.read.parquet(at)).write.parquet(str(tmp_path / "texts"))
    assert held(spark) - before < 1.5 * size


@pytest.mark.parametrize("frequent", [html.FREQUENT, 1])
def test_repeated_runs_against_all_windows(spark, frequent):
    rng = random.Random(6)
    pool = ["a", "b", "Ab", "ß" * 70 + "x", "ß" * 70 + "y", "\u0391\u03a3", "&amp;", "c" * 300]
    notes = [words(rng, rng.randrange(3, 20), pool) for _ in range(12)]
    rows = []
    for i in range(120):
        boxes = [rng.choice(notes) if rng.random() < 0.5 else words(rng, rng.randrange(0, 25), pool[: 2 + i % 7]) for _ in range(rng.randrange(0, 5))]
        rows.append((i if i % 17 else None, rng.choice([None, "x", "http://one/1", "//TWO/2", "http://two:80/", f"http://few/{i}"]), page("".join(rng.choice(["<p>{}</p>", "<nav>{}</nav>", "<main>{}</main>"]).format(b) for b in boxes))))
    rows += rows[:40] + [(500 + i, "http://pair/", page(f"<p>{words(rng, 12, ['same'])} {i % 2}</p>")) for i in range(4)]
    rows += [(600, None, None), (601, "http://one/", "")]

    parsed = [html.blocks(text or "") for _, _, text in rows]
    said = [" ".join(b.text.lower() for b in of if b.open) for of in parsed]
    streams = [[w for b in of for w in b.text.lower().split()] for of in parsed]
    pages, hosts = {}, {}
    for (i, url, _), name, stream in zip(rows, said, streams, strict=True):
        if i is not None:
            hosts.setdefault(html.host(url), set()).add(name)
            for k in range(len(stream) - 7):
                pages.setdefault((html.host(url), *stream[k : k + 8]), set()).add(name)
    want = []
    for (i, url, _), of, stream in zip(rows, parsed, streams, strict=True):
        most = min(len(hosts.get(html.host(url), ())), 3)
        starts = [k for k in range(len(stream) - 7) if i is not None and most > 1 and len(pages[html.host(url), *stream[k : k + 8]]) >= most]
        want.append((i, url, "\n\n".join(b.text for b in html.main_text(of, starts))))
    got = html.extract(spark.createDataFrame(rows, PAGE).repartition(5), frequent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(text != "\n\n".join(b.text for b in html.main_text(of, [])) for (_, _, text), of in zip(want, parsed, strict=True)) > 20


# --- quality and toxicity


def test_quality_learns_from_both_views(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(rng, 80, pool)
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text
        rows.append((i, text, "en", "spam" if bad else f"s{i % 5}", len(text)))
        labels.append((i, 0 if bad else 1))
    frame, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:200], "doc_id long, quality int")
    model = quality.fit(frame, known)
    awkward = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", -5)], DOCS)
    got = quality.score(frame.union(awkward), model).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 200]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert quality.fit(frame, known.filter("quality = 1")) is None
    assert {r.score for r in quality.score(frame, None).collect()} == {1.0}
    assert quality.score(frame.limit(0), model).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    gates = rng.standard_normal((9, 2 * 3 * toxicity.HIDDEN))
    ids = rng.integers(0, 8, (4, toxicity.STEPS))
    mask = np.arange(toxicity.STEPS) < np.array([32, 7, 1, 20])[:, None]
    ids[~mask] = 8
    want, weight = np.array([1, 0, 1, 0.0]), np.ones(4)

    def loss():
        z = net.run(gates, ids, mask)
        return float((np.log1p(np.exp(-z)) * want + np.log1p(np.exp(z)) * (1 - want)).mean())

    grad, d_gates, _ = net.gradients(gates, ids, mask, want, weight)
    for array, g, at in [(net.p["state"], grad["state"], (1, 2, 5)), (net.p["look"], grad["look"], (3, 1)), (net.p["out"], grad["out"], (4,)), (gates, d_gates, (2, 40))]:
        array[at] += 1e-3
        up = loss()
        array[at] -= 2e-3
        slope = (up - loss()) / 2e-3
        array[at] += 1e-3
        assert slope == pytest.approx(g[at], rel=1e-2, abs=1e-5)


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("aeiousrtnlm") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(500):
        own = words(rng, rng.randrange(20, 120), pool).split()
        if i % 3 == 0:
            own[rng.randrange(len(own))] = rng.choice(["zorkface", "zorkhead", "grubwit"])
        texts.append(" ".join(own))
        labels.append(int(i % 3 == 0))
    scorer = toxicity.train(texts[:350], np.array(labels[:350]))
    rows = [(i, t) for i, t in enumerate(texts[350:])] + [(None, None), (900, ""), (901, "123 !!"), (902, words(rng, 30000, pool))]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), scorer).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == bool(labels[350 + r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 150]
    assert np.mean(right) > 0.95
    assert all(r.score < 0.5 for r in got if r.doc_id in (900, 901))
    assert toxicity.train([], np.array([])).scores(pa.array(["x", None])).tolist() == toxicity.train(["y"], np.array([0])).scores(pa.array(["z", ""])).tolist()


# --- search


def plain_top(rows, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x):
            v[i] = [int(np.floor(256 * float(np.float32(y)))) for y in x]
    out = []
    for q in sorted(v):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("group_rows", [7, 10_000])
def test_top_k(spark, group_rows):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(9)]  # ties
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (None, [1.0] * 6), (450, [1.0, 2.0]), (451, []), rows[0]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = topk.quantised(frame, "vec_id", "embedding")
    got = topk.top_k(own, own.filter("vec_id % 50 = 0"), 5, group_rows=group_rows).collect()
    assert sorted(map(tuple, got)) == plain_top([r for r in rows], 5)
    assert topk.top_k(own.limit(0), own.limit(0)).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [3e13, 1.0]), (1, [3e13, 1.0]), (2, [3e13, 2.0]), (3, [1e300, 0.0]), (50, [1.0, 1.0])]
    own = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(own, own.filter("vec_id = 0"), 5).collect())
    most = (1 << 63) - 1
    assert got == [(1, 1, most), (2, 2, most), (3, 3, most), (4, 50, int(256 * 3e13) * 256 + 256 * 256)]


# --- near-duplicates


def plain_groups(rows, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return sets, top


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, corpus, percent):
    sets, top = plain_groups(corpus, percent)
    got = neardup.near_duplicates(docs, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in got if r.doc_id is not None) == sorted((str(i), len(sets[i])) for i, _ in corpus if i is not None)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == top
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_near_duplicates_across_components(spark):
    """A chain of texts, each near the next one only: links that the smallest document of a band cannot show."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(30):
        base = list(base)
        base[rng.randrange(10, 110)] = f"n{i}"
        rows.append((i * 7 % 30, " ".join(base)))
    _, top = plain_groups(rows, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 85).collect()
    assert {r.doc_id: r.component_id for r in got} == top


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    common = rng.integers(1, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1, 2**63, 100).astype(np.uint64)])) for _ in range(12)]
    sets += [sets[0][:1], sets[0][:5], np.empty(0, np.uint64)]
    signature = neardup.super_minhash(sets)
    same = [(signature[a] == signature[b]).mean() for a in range(12) for b in range(a)]
    assert np.mean(same) == pytest.approx(0.6, abs=0.02)
    levels = signature[:-1] >> np.uint64(52)
    assert (np.sort(levels[12]) == np.arange(levels.shape[1])).all()  # one element goes through all slots


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    top = {i: i for pair in links for i in pair}
    for _ in range(60):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    alone = {i for i in top if all(a == b for a, b in links if i in (a, b))}
    assert got == {i: t for i, t in top.items() if i not in alone}


# --- licences


def test_licences(docs, corpus, spark):
    texts = ["MIT License and the mit\tlicense; MIT-License", "licensed under CC BY-NC 4.0", "GNU general\npublic license, apache  license", "mit licenses", "xmit license", "ccby cc by"]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining one copy of this software", "permission is granted", "all rights reserved"]
    rows = corpus + [(2000 + i, t) for i, t in enumerate(texts)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for i, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        at, labels = [], set()
        for phrase, label in licences.BASE.items():
            p = [x.encode() for x in phrase.split()]
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want.append((str(i), len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    named = {r.doc_id: r.labels for r in got}
    assert named[2001] == "cc-by,cc-by-nc" and named[2006] == "mit" and named[2007] == "" and named[2008] == "all-rights-reserved"
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- benchmark


def test_templates(spark):
    items = [(1, "Bob has 3 apples and 5 pears while Ann has 3 apples"), (2, "the quick brown fox jumps over one lazy dog today again"), (3, "too few"), (None, "x"), (4, None), (5, "short item of five words")]
    docs = [
        (1, "so: Bob has 3 apples and 5 pears while Ann has 3 apples!"),
        (2, "well, Zoe has 4 apples and 16 pears while Kim has 4 apples"),
        (3, "well, Zoe has 4 apples and 4 pears while Kim has 9 apples"),  # slots disagree
        (4, "THE QUICK BROWN FOX JUMPS OVER ONE LAZY DOG"),
        (5, "the quick brown fox jumps over"),
        (6, "a short item of five words"),
        (7, None),
        (8, ""),
        (None, items[0][1]),
        (1, "so: Bob has 3 apples and 5 pears while Ann has 3 apples!"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontamination.leaks(d, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (6, 5)} and got[1, 1] == 0 and got[2, 1] > 0
    kept = decontamination.decontaminated(d, b)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "7", "8", "None"]
    assert decontamination.leaks(d.limit(0), b).count() == 0 == decontamination.leaks(d, b.limit(0)).count()
    assert "Python" not in decontamination.leaks(d, b)._jdf.queryExecution().toString()


def found_leaks(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_changed) for r in decontamination.leaks(d, b).collect()}


def test_slots_that_contradict_drop_their_windows_only(spark):
    long = "then Alice went along the old river to see what the other people had done there that summer and so {} came home again very late"
    items = [(1, long.format("Alice")), (2, "a shop sells 5 red pens and 3 blue pens to each of them")]
    docs = [(1, long.format("Alicia")), (2, "a shop sells 4 red pens and 4 blue pens to each of them")]
    got = found_leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2)} and got[1, 1] == (13, 0) and got[2, 2] == (7, 2)


def test_items_of_few_plain_words(spark):
    items = [(1, "Compute 12 + 7 - 3 * 4 + 9"), (2, "So Anna Berta Clara Dora Emma Frida Greta Hanna Ida"), (3, "two words")]
    docs = [(i, f"and then: {t} ok") for i, t in items] + [(9, "Compute 12 + 7 - 3 * 4 + 8"), (10, "two other words")]
    assert set(found_leaks(spark, docs, items)) == {(1, 1), (2, 2), (3, 3)}


# --- shards


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_curve_is_a_walk(spark, dims, bits):
    cells = [c.cell for c in sharding.curve(spark, dims, bits).orderBy("place").collect()]
    assert sorted(cells) == list(range(1 << (dims * bits)))
    steps = [[c >> (bits * k) & ((1 << bits) - 1) for k in range(dims)] for c in cells]
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(steps, steps[1:]))


def test_names_are_hashed_whole():
    common = "https://www.example.org/a/long/common/beginning/"
    column = pa.array([common + str(i) for i in range(40)] + [None, "", common + "0"])
    got = quality._hashed(column)
    assert len({r.tobytes() for r in got[:40]}) > 20
    assert not got[40].any() and (got[[*range(40), 41, 42]].sum(axis=1) == 1).all()
    assert (got[0] == got[42]).all()
    assert quality._hashed(pa.array([], pa.string())).shape == (0, quality.HASHED)
    assert not quality._hashed(pa.array([None, None], pa.string())).any()


def test_cut_values_are_exact_ranks(spark):
    values = [5] * 300 + list(range(100)) + [None] * 50
    frame = spark.createDataFrame([(v, None if v is None else f"{v:03d}") for v in values], "n int, s string").repartition(5)
    known = sorted(v for v in values if v is not None)
    first = {v: known.index(v) for v in known}  # rows before a value
    expected = {}
    for v in known:
        expected.setdefault(first[v] * 8 // len(known), v)
    expected = [(v, step) for step, v in sorted(expected.items()) if step]
    assert sharding.cut_values(frame, F.col("n"), 8) == expected
    assert sharding.cut_values(frame, F.col("s"), 8) == [(f"{v:03d}", step) for v, step in expected]
    assert sharding.cut_values(frame.filter("n < 0"), F.col("n"), 8) == []


def test_a_filter_on_any_dimension_skips_shards(spark):
    rng = np.random.default_rng(4)
    # A third of all rows has one source; names have long common beginnings.
    names = [f"https://www.example.org/site-{rng.integers(40) if rng.random() > 0.33 else 7:03d}" for _ in range(4000)]
    rows = [(i, f"l{rng.integers(12)}", n, int(rng.lognormal(6, 2))) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, size long")
    dims = ["lang", "source", "size"]
    ranges = sharding.shard_ranges(sharding.hilbert_shards(frame, dims, ["doc_id"]), dims).collect()
    assert len(ranges) == 24 and {r.rows for r in ranges} <= {166, 167}
    for at, d in enumerate(dims, 1):
        column = [r[at] for r in rows]
        read = [sum(1 for r in ranges if r[f"min_{d}"] <= v <= r[f"max_{d}"]) for v in column]
        # A hash order reads all 24 shards for nearly any value; the rows of the hot source alone fill eight.
        assert np.mean(read) <= 14 and max(read) <= 17, d


def test_shards(spark, docs, empty):
    frame = docs.select("doc_id", "lang", "source", F.length("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))
    got = sharding.hilbert_shards(frame, ["lang", "source", "size"], ["c", "doc_id"], shards=7).collect()
    assert len(got) == docs.count()
    sizes = defaultdict(list)
    for r in got:
        sizes[r.shard].append(r.slot)
    assert set(sizes) == set(range(7)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    none = empty.select("doc_id", "lang", "source", F.length("text").alias("size"), F.lit(0).alias("c"))
    assert sharding.hilbert_shards(none, ["lang", "source", "size"], ["c", "doc_id"]).count() == 0


def test_digests_are_lower_hex(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = bpe.encoded_digests(frame, bpe.vocabulary_path()).first()
    ids = bpe.encode(frame, bpe.vocabulary_path()).first().ids
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


# --- pipeline


def test_pipeline_stages_against_plain_versions(spark, docs, corpus, tmp_path, library):
    import corpus_pipeline

    rng = random.Random(12)
    item = "how many of the seven red boats sail past the old tower"
    leaky = [(300, f"quiz time {item} or so", "en", "s", 60), (301, f"quiz again {item.replace('red', 'dim')}", "en", "s", 60)]
    slim = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(leaky, DOCS))
    bad = [(500 + i, " ".join(w.upper() + "$$$" for w in words(rng, 60, ["ab", "cde", "fghi"]).split()), "en", "junk", 300) for i in range(60)]
    good = [(600 + i, words(rng, 60, [f"w{k}" for k in range(500)]), "en", "s", 300) for i in range(60)]
    slim = slim.union(spark.createDataFrame(bad + good, DOCS))
    slim.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, 0) for i, *_ in bad[:40]] + [(i, 1, 0) for i, *_ in good[:40]] + [(i, 1, 0) for i, _ in corpus if i is not None and i < 75]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frames, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).checkpoint()
        frames.append(now)
    kept, single, cut, clean, tokens = (f.collect() for f in frames)
    assert all(f.columns == slim.columns for f in frames[:4])
    ids = {r.doc_id for r in kept}
    assert not ids & {i for i, *_ in bad} and ids >= {i for i, *_ in good}
    _, top = plain_groups([(r.doc_id, r.text) for r in kept], corpus_pipeline.SIMILAR)
    assert sorted(str(r.doc_id) for r in single) == sorted(str(r.doc_id) for r in kept if r.doc_id is None or top[r.doc_id] == r.doc_id)
    want = []
    for i, raw, gone in plain_repeats([(r.doc_id, r.text) for r in single]):
        mask = np.frombuffer(gone, np.uint8).astype(bool)
        heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        whole = np.add.reduceat(~mask, heads) == 0 if len(raw) else np.empty(0, bool)  # characters that go entirely
        text = "".join(c for c, g in zip(raw.decode(), whole, strict=True) if not g)
        want.append((str(i), text, len(text)))
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in cut) == sorted(want)
    assert {r.doc_id for r in cut} - {r.doc_id for r in clean} == {300} & {r.doc_id for r in cut}
    lengths = sorted((str(r.doc_id), len(library.encode(r.text, add_special_tokens=False).ids)) for r in clean)
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens) == lengths


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """Columns named like those that the operators add come out as they went in; empty tables stay empty."""
    import corpus_pipeline

    rng = random.Random(3)
    pool = [f"w{k}" for k in range(400)]
    passage = words(rng, 40, pool)
    rows = [(i, f"{words(rng, 60, pool)} {passage}", "en", "s", 9, 10 + i, f"k{i}", f"d{i}", [i], "own") for i in range(12)]
    rows += [(None, None, None, None, None, 0, "kn", None, None, None), (90, "", "", "", 0, 1, "ke", "de", [], "own")]
    docs = spark.createDataFrame(rows, f"{DOCS}, Score int, kept string, digest string, spans array<int>, predicted string")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "how many of the seven red boats sail past the old tower")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = {r.doc_id: (r.Score, r.kept, r.digest, r.spans, r.predicted) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all((r.Score, r.kept, r.digest, r.spans, r.predicted) == own[r.doc_id] for r in got), name
        if name == "long_repeats":
            assert sum(passage in (r.text or "") for r in got) == 1 and all(r.n_chars == len(r.text) for r in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_answers_about_segments_take_bounded_memory():
    texts = np.random.default_rng(5).integers(97, 123, 6_000_000).astype(np.uint8)
    start, count, key, owner = suffixes.segments(texts, np.array([0, len(texts)]))
    letters = texts[spread(start, count + suffixes.LENGTH - 1)]
    asks = []
    for doc in (1, 2):  # the second document copies the first one
        body = pack(np.zeros(len(start), np.int32), np.append(doc, np.zeros(len(start) - 1, np.int64)), start.astype(np.uint32), count.astype(np.uint32), letters)
        asks.append((doc, zstandard.ZstdCompressor().compress(body)))
    out = suffixes.Cells()
    tracemalloc.start()
    suffixes._answer_segments(asks, out, suffixes.LENGTH, suffixes.SEED)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 2 * len(letters)
    ((chunk, _, _, body),) = out.rows
    assert chunk == 2 and len(unpack(body, np.uint32, np.uint32, np.uint32)[0]) == len(start)


def test_pieces_are_merged_together_like_one_by_one():
    v = bpe.Vocabulary(bpe.vocabulary_path())
    texts = ["Unterscheidungen", "zzqx" * 9, "a", "e" * 48, "ab" * 40, "été", "漢字かな", "1'", "\x00\x07", "x" * 130]
    pieces = [p for t in texts for p in v.pieces(t)]
    assert v.merged_all(pieces) == [v.merged(p) for p in pieces]
    assert v.merged_all([]) == []


def test_windows_are_made_once_and_in_generated_code(spark):
    rows = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "too few")], "doc_id long, text string")
    words = rows.select("doc_id", decontamination.typed_words(F.col("text")).alias("words"))
    made = decontamination.windows(words.withColumn("codes", decontamination.codes(F.col("words"))), ["doc_id"], 8)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode(hashes" in plan and not re.search(r"Filter .*size\(", plan)
    assert [(r.doc_id, r.at) for r in made.orderBy("at").collect()] == [(1, 0), (1, 1)]
    for length in range(1, 10):
        own = decontamination.windows(words.withColumn("codes", decontamination.codes(F.col("words"))), ["doc_id"], length)
        assert own.filter("doc_id = 1").count() == 10 - length == own.filter("doc_id = 1").select("hash").distinct().count()
