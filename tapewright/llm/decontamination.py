"""Benchmark decontamination by templates: numbers, names and units become typed slots, template windows are joined by hash.

DataFrame functions only. A word of a text is kept with its type in front: ``#`` for a number, ``@`` for a name, ``%``
for a unit, nothing for any other word. The template of a word is its type, or the word itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import table, without

WINDOW = 8  # words
LEAST = 4  # plain words of a window that is searched for by its template; with fewer, all words have to be equal
SMALL = 2_000_000  # windows of a benchmark that is broadcast; a larger one is joined by shuffling

# Units of measure that may follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg lb lbs pound pounds oz ounce ounces t ton "
    "tons ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years hz khz mhz ghz w kw mw v a kb mb gb tb k °c °f % percent degrees usd eur gbp dollar dollars euro euros cent cents"
).split()

UNIT = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
APART = r"[^a-z\p{L}\p{M}\p{N}#@%_]+"


def typed_words(text: Column) -> Column:
    """Words of a text with their types. A capitalised word that follows a word or a comma counts as a name, but not one
    all in capitals: shouting changes no template. Patterns start at the rare character, which most places lack."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[#@%<>_]", " ")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})(?=\p{Ll})", "@$0")
    n = F.regexp_replace(t, r"(\p{N})[.,:/](?=\p{N})", "$1_")
    n = F.regexp_replace(n, r"\p{N}(?<![\p{L}\p{N}_]\p{N})(?=[\p{N}_]*(?!\p{L}))[\p{N}_]*+(?!\p{L})", "#$0")
    n = F.regexp_replace(n, rf"(?<=\p{{N}})\s?(?i:({UNIT}))(?![\p{{L}}\p{{N}}])", " %$1")
    return F.array_remove(F.split(F.lower(F.when(t.rlike(r"\p{N}"), n).otherwise(t)), APART), "")


def template(words: Column) -> Column:
    first = lambda w: F.substring(w, 1, 1)
    return F.transform(words, lambda w: F.when(first(w).isin("#", "@", "%"), first(w)).otherwise(w))


def codes(words: Column) -> Column:
    first = lambda w: F.substring(w, 1, 1)
    # The marks stand before all letters, so one comparison tells most words from slots.
    slot = lambda w: F.when(first(w).isin("#", "@", "%"), first(w)).otherwise(w)
    return F.transform(words, lambda w: F.when(w >= "a", F.xxhash64(w)).otherwise(F.xxhash64(slot(w))))


def windows(rows: DataFrame, keep: list[str], length: int) -> DataFrame:
    """A row for each window of ``length`` words: ``at`` (its first word), ``hash`` of its template, its ``words``.

    ``rows`` has ``words`` and ``codes``, a hash of each word's template. Hashes of windows are made of those of two
    shorter ones, which may overlap: a handful of steps over all places at once.
    """
    rows = rows.select(*keep, "words", F.col("codes").alias("hashes"))
    span = 1
    while span < length:
        step = min(span, length - span)
        rows = rows.withColumn("hashes", F.zip_with("hashes", F.slice("hashes", step + 1, F.size("hashes")), lambda a, b: F.xxhash64(a, b)))
        span += step
    rows = rows.withColumn("hashes", F.slice("hashes", 1, F.greatest(F.size("words") - length + 1, F.lit(0))))
    # Of a column, not of an expression: so windows are made in generated code and share the row's words. Without "outer" a
    # filter on the array's size would be put below all steps and do them over again.
    rows = rows.select(*keep, "words", F.posexplode_outer("hashes").alias("at", "hash"))
    return rows.filter(F.col("hash").isNotNull())


def _plain(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~F.substring(w, 1, 1).isin("#", "@", "%")))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows``, ``n_changed``, ``share``: documents that hold a benchmark question.

    A document and an item match where a window of ``window`` words has one template (the whole item, where it is
    shorter), at least ``LEAST`` of its words being plain, and its slots agree with the alignment: a slot value of the
    item has one value in the document, the one that most of its places have (the unchanged one of equally many).
    Windows that contradict it are left out, windows without a changed slot never are. Windows and items with fewer
    than ``LEAST`` plain words match where all words are equal.
    ``n_windows`` counts the matched windows of the best alignment, ``share`` is their part of the item's windows,
    ``n_changed`` the slots with another value: a re-parameterised question has some. Null and empty texts and items
    match nothing, null ids are left out, repeated rows count once, and empty tables give an empty result.

    The document side is not shuffled while the benchmark is small, which is counted first; beyond ``SMALL`` windows
    both sides are shuffled by hash. Matched windows are summed up by document, item and alignment, a group no larger
    than the item.
    """
    base = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), typed_words(F.col("text")).alias("words"))
    base = base.filter(F.size("words") > 0)
    short = [r[0] for r in base.filter(F.size("words") < window).select(F.size("words")).distinct().collect()]  # below ``window`` values
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), typed_words(F.col("text")).alias("words"))
    literal = F.transform("words", lambda w: F.xxhash64(w))
    found = None
    for length in [window, *sorted(short)]:
        fitting = base.filter(F.size("words") >= window) if length == window else base.filter(F.size("words") == length)
        # Windows with too few plain words are searched for as they stand.
        for exact in (False, True):
            coded = lambda rows: rows.withColumn("codes", literal if exact else codes(F.col("words")))  # noqa: B023, E731
            asked = windows(coded(fitting), ["item_id"], length).select(
                "item_id",
                F.col("at").alias("item_at"),
                "hash",
                F.slice("words", F.col("at") + 1, F.lit(length)).alias("asked"),
                (F.size("words") - length + 1).alias("of"),
            )
            plain = _plain(F.col("asked"))
            asked = asked.filter(plain < LEAST if exact else plain >= LEAST).distinct()
            count = asked.count()
            if found is not None and not count:
                continue
            if count <= SMALL:
                asked = F.broadcast(asked)
            # As a generated row, ``got`` keeps its check behind the join: inside, each window would carry a copy of its text's words there.
            got = F.explode(F.array(F.slice("words", F.col("at") + 1, F.lit(length))))
            seen = windows(coded(own), ["doc_id"], length).join(asked, "hash").withColumn("got", got)
            seen = seen.filter(F.col("got") == F.col("asked") if exact else template(F.col("got")) == template(F.col("asked")))
            part = seen.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "of", "asked", "got")
            found = part if found is None else found.union(part)
    line = ["doc_id", "item_id", "shift"]
    placed = F.transform(F.arrays_zip("asked", "got"), lambda p, i: F.struct((F.col("item_at") + i).alias("place"), p["asked"].alias("asked"), p["got"].alias("got")))
    slots = F.filter(placed, lambda p: F.substring(p["asked"], 1, 1).isin("#", "@", "%"))
    value = lambda p: F.struct(p["asked"].alias("asked"), p["got"].alias("got"))
    lines = found.withColumn("slots", slots).groupBy(*line).agg(F.max("of").alias("of"), F.collect_set(F.struct("item_at", "slots")).alias("windows"))
    lines = lines.withColumn("places", F.array_distinct(F.flatten(F.col("windows.slots"))))
    times = lambda v: F.size(F.filter("places", lambda p: (p["asked"] == v["asked"]) & (p["got"] == v["got"])))
    tally = F.transform(F.array_distinct(F.transform("places", value)), lambda v: F.struct(v["asked"].alias("asked"), v["got"].alias("got"), times(v).alias("n")))
    lines = lines.withColumn("tally", tally)
    # The value that most places of an item's value have; of equally many the unchanged one, else none.
    beats = lambda o, v: (o["n"] > v["n"]) | ((o["n"] == v["n"]) & (v["asked"] != v["got"]))
    others = lambda v: F.exists("tally", lambda o: (o["asked"] == v["asked"]) & (o["got"] != v["got"]) & beats(o, v))
    lines = lines.withColumn("agreed", F.transform(F.filter("tally", lambda v: ~others(v)), value))
    lines = lines.select(*line, "of", "agreed", F.explode("windows").alias("w")).withColumn("slots", F.transform("w.slots", value))
    lines = lines.filter((F.size(F.array_except("slots", "agreed")) == 0) | ~F.exists("slots", lambda v: v["asked"] != v["got"]))
    lines = lines.groupBy(*line).agg(F.countDistinct("w.item_at").alias("n_windows"), F.max("of").alias("of"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    changed = F.size(F.filter("slots", lambda p: p["asked"] != p["got"]))
    best = lines.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", -changed, "of")).alias("b"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.n_windows").alias("n_windows"),
        (-F.col("b.col2")).cast("int").alias("n_changed"),
        (F.col("b.n_windows") / F.col("b.of")).alias("share"),
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark question; rows with a null id stay."""
    return without(docs, leaks(docs, items))


def op9_templates(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
