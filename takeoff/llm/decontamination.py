"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index stores, for the terms that a search needs, the sorted positions of each in every text. A search takes the windows of
the benchmark items, 10 words each or the whole of a shorter item, and from each the two terms that the corpus has least often.
Their lists, moved back by the terms' offsets, are intersected: what remains are the places where both stand as in the item. The
remaining words are compared in the text itself. Windows whose two terms stand within a number of words of their right distance
are the proximity matches.

Texts are keyed by their MD5, so exact copies share their entries, and neither nulls nor repeats in doc_id matter: each row of
the documents gives one row. Null text: no word. Items without a word, or null, have no window; a null item_id counts as the
empty id. Items of one id are one item. An empty benchmark leaves every document clean; no documents give no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from takeoff.llm.common import documents, is_few, lower_ascii, shuffled, staged

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many terms (20 bytes each or so) are broadcast; more are joined by shuffling the tokens.
BROADCAST_TERMS = 100_000


def words(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, pos, term) of every word of a text."""
    return docs.select(text_key(F.col(text)).alias("key"), F.posexplode(words(F.col(text))).alias("pos", "term"))


def with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Tokens of the given terms; `terms` is a staged table of distinct ones."""
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return found.join(F.broadcast(terms) if few else shuffled(terms), "term")


def index(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, key, positions): the postings of the given terms in all documents, as a table in the shared folder."""
    lists = with_terms(tokens(docs, text), terms).groupBy("term", "key").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return staged(lists, "postings")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of items that have words; item numbers a text of an id."""
    out = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
    return out.where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "words"))


def windows_of(items: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, start, length, first, second, first_term, second_term): the offsets of each window's two rarest terms within its item."""
    size = F.size("words")
    offsets = items.select("item", size.alias("size"), F.least(size, F.lit(window)).alias("length"), F.posexplode("words").alias("offset", "term"))
    first, last = F.greatest(F.col("offset") - F.col("length") + 1, F.lit(0)), F.least(F.col("offset"), F.col("size") - F.col("length"))
    # each word with the windows that hold it, ten at most
    inside = offsets.join(frequency, "term", "left").select("*", F.explode(F.sequence(first, last)).alias("start"))
    rarest = W.partitionBy("item", "start").orderBy(F.coalesce("n", F.lit(0)), "offset")
    ranked = inside.withColumn("rank", F.row_number().over(rarest)).where("rank <= 2")
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    return ranked.groupBy("item", "start", "length").agg(
        at("offset", 1).alias("first"), F.coalesce(at("offset", 2), at("offset", 1)).alias("second"),
        at("term", 1).alias("first_term"), F.coalesce(at("term", 2), at("term", 1)).alias("second_term"))


class Search:
    """The items' windows, their rarest terms and the postings of these."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text"):
        self.docs, self.window, self.text = docs, window, text
        self.items = staged(items_of(benchmark), "items")
        vocabulary = staged(self.items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
        frequency = with_terms(tokens(docs, text), vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.windows = staged(windows_of(self.items, frequency, window), "windows")
        self.ends = self.windows.select("item", F.explode(F.array(
            F.struct(F.col("first").alias("offset"), F.col("first_term").alias("term")), F.struct(F.col("second").alias("offset"), F.col("second_term").alias("term")))).alias("e")).select("item", "e.*").distinct()
        self.postings = index(docs, staged(self.ends.select("term").distinct(), "terms"), text)

    def candidates(self) -> DataFrame:
        """(key, item, shift, starts): windows of an item both of whose rarest terms stand in a text at the same shift."""
        placed = self.postings.join(self.ends, "term").select("key", "item", "offset", F.explode("positions").alias("pos"))
        lined = placed.groupBy("key", "item", (F.col("pos") - F.col("offset")).alias("shift")).agg(F.collect_set("offset").alias("offsets"))
        of_item = self.windows.groupBy("item").agg(F.collect_list(F.struct("start", "first", "second")).alias("windows"))
        both = F.filter("windows", lambda w: F.array_contains("offsets", w["first"]) & F.array_contains("offsets", w["second"]) & (F.col("shift") + w["start"] >= 0))
        return lined.join(of_item, "item").select("key", "item", "shift", F.transform(both, lambda w: w["start"]).alias("starts")).where(F.size("starts") > 0)

    def exact(self, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """A row per document: the kept columns, its `words`, and `hits`: item_id, start and end of every exact window."""
        found = self.candidates().join(self.items, "item").groupBy("key").agg(
            F.collect_list(F.struct("item_id", "shift", "starts", F.col("words").alias("item_words"))).alias("found"))
        keyed = self.docs.select(*dict.fromkeys([*keep, self.text.partition(".")[0]]), text_key(F.col(self.text)).alias("key"))
        found = staged(found, "found")
        if is_few(found.select("key")):  # texts without a candidate stay where they are, those with one are few or copies
            keys = F.broadcast(found.select("key"))
            parts = [keyed.join(keys, "key", "left_anti").withColumn("found", F.lit(None).cast(found.schema["found"].dataType)), keyed.join(keys, "key", "left_semi").join(shuffled(found), "key")]
        else:
            parts = [keyed.join(shuffled(found), "key", "left")]
        rows = functools.reduce(DataFrame.union, [p.select(*keep, words(F.col(self.text)).alias("words"), "found") for p in parts])

        def hits(c: Column) -> Column:
            size = F.least(F.size(c["item_words"]), F.lit(self.window))
            same = F.filter(c["starts"], lambda s: F.slice("words", c["shift"] + s + 1, size) == F.slice(c["item_words"], s + 1, size))
            return F.transform(same, lambda s: F.struct((c["shift"] + s).alias("start"), (c["shift"] + s + size).alias("end"), c["item_id"].alias("item_id")))

        none = F.array().cast("array<struct<start: int, end: int, item_id: string>>")
        return rows.select(*keep, "words", F.coalesce(F.array_sort(F.flatten(F.transform("found", hits))), none).alias("hits"))

    def near(self, slop: int) -> DataFrame:
        """(key, item, start): windows whose two rarest terms stand in a text within `slop` words of their distance in the item."""
        first = self.postings.withColumnsRenamed({"term": "first_term", "positions": "a"})
        second = self.postings.withColumnsRenamed({"term": "second_term", "positions": "b"})
        gap = F.col("second") - F.col("first")
        close = F.exists("a", lambda p: F.exists("b", lambda q: F.abs(q - p - gap) <= slop))
        return self.windows.join(first, "first_term").join(second, ["key", "second_term"]).where(close).select("key", "item", "start")


def covered(hits: Column) -> Column:
    """Number of words inside the union of sorted hits."""
    def step(acc: Column, h: Column) -> Column:
        more = F.greatest(h["end"] - F.greatest(h["start"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], h["end"]).alias("end"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, text: str = "text") -> DataFrame:
    """The kept columns, n_words, n_hit, items (sorted ids of items with an exact window) and contaminated; a row per document."""
    out = Search(docs, benchmark, window, text).exact(keep)
    return out.select(*keep, F.size("words").cast("long").alias("n_words"), covered(F.col("hits")).alias("n_hit"),
                      F.array_sort(F.array_distinct(F.col("hits.item_id"))).alias("items"), (F.size("hits") > 0).alias("contaminated"))


def op4_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
