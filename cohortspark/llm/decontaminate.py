"""Benchmark decontamination by a broadcast hash set of test n-grams.

A window is ten consecutive words of a test item; an item of fewer words is one window.  A
window of L words that occurs in a document covers one of the document's positions 0, t, 2t, ...
with t = L - a + 1 and all a words from there on.  So only the a-grams at these positions are
hashed and looked up among the a-grams of the test windows.  The few positions found are then
verified: the windows around them are compared word by word with the test windows.

All of it is DataFrame functions.  The hash set is broadcast when it is measured to be small,
and joined by shuffle beyond that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import LETTER_WORD, lower_ascii
from cohortspark.operators.joins import lookup_join
from cohortspark.session import materialise

WINDOW, ANCHOR = 10, 4
LETTER_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case words of a text; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(LETTER_WORD), F.lit(0))


def _layout(length: int) -> tuple[int, int]:
    """Words of an anchor and the distance between looked-up positions for windows of ``length`` words."""
    size = min(ANCHOR, length)
    return size, length - size + 1


def _gram(of: str, start: Column, length: int) -> Column:
    return F.slice(F.col(of), start + 1, length)


def _up_to(first: Column, last: Column) -> Column:
    """first..last, or nothing."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def test_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, length, gram) for every window of the test items; items without words have none."""
    known = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    known = known.withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = _up_to(F.lit(0), F.size("w") - F.col("length"))
    grams = F.transform(starts, lambda s: F.array_join(F.slice(F.col("w"), s + 1, F.col("length")), " "))
    return known.select("item", "length", F.explode(grams).alias("gram")).distinct()


def _anchors(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct hashes of the anchors inside the test windows."""

    def of(length: int) -> DataFrame:
        size, step = _layout(length)
        split = windows.where(F.col("length") == length).select(F.split("gram", " ").alias("w"))
        hashes = F.transform(_up_to(F.lit(0), F.lit(step - 1)), lambda s: F.xxhash64(F.lit(length), _gram("w", s, size)))
        return split.select(F.explode(hashes).alias("anchor"))

    return reduce(DataFrame.unionByName, [of(n) for n in lengths]).distinct()


def _look(length: int, size: int) -> Callable[[Column], Column]:
    return lambda at: F.struct(F.xxhash64(F.lit(length), _gram("w", at, size)).alias("anchor"), F.lit(length).alias("length"), at.alias("at"))


def _window(length: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.array_join(_gram("w", s, length), " ").alias("gram"), s.alias("start"), (s + length).alias("end"))


def _looked_up(lengths: list[int]) -> Column:
    """(anchor, length, at) for the looked-up positions of a document, after a row that stands for the document.

    That row has a key of its own, so that the rows of all documents do not meet where anchors are joined.
    """
    arrays = [F.array(F.struct(F.xxhash64("doc_id", "digest").alias("anchor"), F.lit(0).alias("length"), F.lit(-1).alias("at")))]
    for length in lengths:
        size, step = _layout(length)
        last = F.size("w") - size
        positions = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        arrays.append(F.transform(positions, _look(length, size)))
    return F.concat(*arrays)


def _around(lengths: list[int]) -> Column:
    """All windows that cover a found position: (gram, first word, word after the last)."""

    def at(found: Column) -> Column:
        choice = F.lit(None)
        for length in lengths:
            _, step = _layout(length)
            starts = _up_to(F.greatest(found["at"] - (step - 1), F.lit(0)), F.least(found["at"], F.size("w") - length))
            choice = F.when(found["length"] == length, F.transform(starts, _window(length))).otherwise(choice)
        return choice

    return F.flatten(F.transform("found", at))


def _covered(spans: str) -> Column:
    """Number of words in a union of (start, end) spans."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def add(state: Column, span: Column) -> Column:
        fresh = F.greatest(span["end"] - F.greatest(span["start"], state["reach"]), F.lit(0))
        return F.struct(F.greatest(state["reach"], span["end"]).alias("reach"), (state["n"] + fresh).alias("n"))

    return F.aggregate(F.sort_array(spans), start, add)["n"]


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, digest, n_words, spans, n_hit, items, copies.

    ``digest`` tells texts with the same id apart; equal rows are one row with their number in
    ``copies``.  ``spans`` are the occurrences of test windows (null if none), ``n_hit`` the words
    inside them, ``items`` the sorted ids of the items that occur; an item without an id counts as a
    hit but is not listed.  Null and empty texts have no words; an empty benchmark or an empty table is fine.
    """
    windows = materialise(test_windows(items, item_key, item_text, window))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``window`` values
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    split = source.select("doc_id", "digest", words(F.col("text")).alias("w"))
    looked = split.select("doc_id", "digest", F.size("w").alias("n_words"), F.explode(_looked_up(lengths)).alias("a"))
    looked = looked.select("doc_id", "digest", "n_words", "a.*")
    if lengths:
        anchors = _anchors(windows, lengths).select("anchor", F.lit(True).alias("known"))
        looked = lookup_join(looked, anchors, ["anchor"], heavy_rows=None)
    else:
        looked = looked.withColumn("known", F.lit(False))
    own = F.col("at") < 0
    found = F.collect_set(F.when(~own & F.col("known"), F.struct("length", "at"))).alias("found")
    base = looked.where(own | F.col("known")).groupBy("doc_id", "digest")
    base = materialise(base.agg(F.max("n_words").cast("bigint").alias("n_words"), F.count_if(own).alias("copies"), found))

    suspects = base.where(F.size("found") > 0).select("doc_id", "digest", "found")
    if not lengths or suspects.isEmpty():
        nothing = F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans")
        return base.select("doc_id", "digest", "n_words", "copies", nothing, F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    again = lookup_join(source, suspects, ["doc_id", "digest"], "inner", null_safe=True, heavy_rows=None)
    again = again.select("doc_id", "digest", "found", words(F.col("text")).alias("w"))
    tried = again.select("doc_id", "digest", F.explode(_around(lengths)).alias("t")).select("doc_id", "digest", "t.*")
    met = materialise(lookup_join(tried.distinct(), windows.select("gram").distinct(), ["gram"], "left_semi", heavy_rows=None))
    spans = met.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    named = lookup_join(met.select("doc_id", "digest", "gram").distinct(), windows.select("item", "gram"), ["gram"], "inner", heavy_rows=None)
    named = named.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = base
    for side in (spans, named):
        side = side.withColumnsRenamed({"doc_id": "_key", "digest": "_digest"})
        out = out.join(side, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left").drop("_key", "_digest")
    return out.select(
        "doc_id", "digest", "n_words", "copies", "spans", F.coalesce(_covered("spans"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _judged(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """The documents as ``_row`` with ``text`` and the spans found in it."""
    met = hits(docs, items, key, text).where("n_hit > 0").select(F.col("doc_id").alias("_key"), "digest", "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    return lookup_join(rows, met, ["_key", "digest"], null_safe=True, heavy_rows=None)


def remove_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no test window occurs, with their own columns.

    Null and empty texts have no window and stay, equal rows are judged alike, and without items every document stays.
    """
    return _judged(docs, items, key, text).where("spans IS NULL").select("_row.*")


def remove_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, with the words of occurring test windows taken out of the text.

    A removed word goes with the separator before it, so what stands around a span stays as it was.  A null text stays null.
    """
    judged = _judged(docs, items, key, text)
    clean = judged.where("spans IS NULL").select("_row.*")
    hit = judged.where("spans IS NOT NULL").withColumns({
        "_w": F.regexp_extract_all("text", F.lit(LETTER_WORD_ANY_CASE), F.lit(0)), "_s": F.split("text", LETTER_WORD_ANY_CASE, -1),
    })
    numbered = F.transform("_w", lambda w, i: F.struct(F.concat(F.element_at("_s", i + 1), w).alias("piece"), i.alias("i")))
    outside = F.filter(numbered, lambda x: ~F.exists("spans", lambda s: (s["start"] <= x["i"]) & (x["i"] < s["end"])))
    cut = F.concat(F.array_join(F.transform(outside, lambda x: x["piece"]), ""), F.element_at("_s", -1))
    columns = [(cut if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    return clean.unionByName(hit.select(*columns))
