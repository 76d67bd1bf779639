"""Counts over whole texts that the rules and the quality classifier use, and ratios of them."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeoff.llm.common import bounded, held_out, per_text

BLANKS = [9, 10, 11, 12, 13, 32]
SYMBOLS = list(b"#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters",
          "n_digits", "n_bangs", "n_pipes", "n_stops")
DDL = ", ".join(f"{c} bigint" for c in COUNTS)
#: Ratios by name: numerator and denominator.
RATIOS = {
    "upper_share": ("n_upper", "n_letters"), "symbols_a_word": ("n_symbols", "n_words"), "bangs_a_word": ("n_bangs", "n_words"),
    "pipes_a_word": ("n_pipes", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"), "digit_share": ("n_digits", "word_chars"), "word_length": ("word_chars", "n_words"),
    "words_a_stop": ("n_words", "n_stops"),
}


def counts(text: bytes) -> tuple[int, ...]:
    """In the order of COUNTS. Words stand between blanks; upper case, letters and digits are those of ASCII."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]  # strip() takes the blanks of words
    points = len(text) - int(seen[0x80:0xC0].sum())
    upper, letters = int(seen[65:91].sum()), int(seen[65:91].sum() + seen[97:123].sum())
    return (len(words), points - int(seen[BLANKS].sum()), int(seen[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated(words), len(lines),
            len(set(words)), upper, letters, int(seen[48:58].sum()), int(seen[33]), int(seen[124]), int(seen[[33, 46, 63]].sum()))


def repeated(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the counts of each whole text; null text: empty, all zero."""
    return per_text(docs, lambda texts: [list(c) for c in zip(*map(counts, texts))], DDL, keep)


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)) for k, (a, b) in RATIOS.items()})


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): the labels 0 or 1 of documents that aren't held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label): at most `limit` labelled documents that aren't held out. Their ids are few, so no text is shuffled for it."""
    chosen = bounded(known_labels(labels, label), "doc_id", limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
