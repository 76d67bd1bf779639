"""License scans: templates with optional and replaceable regions, compiled into token automata.

Words are matched, so case, punctuation and line breaks don't count. `[[ ... ]]` marks an optional region, `<<name:0-20>>` a
replaceable one of 0 to 20 words of any kind. A text is accepted where all the other, mandatory words stand exactly and in order.
Besides, plain phrases are looked up; their places make the base counts and labels.

Null text: empty; a text without a match has null places, empty labels and score 0. A null doc_id keeps its row, repeated rows
too. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from takeoff.llm.common import documents, per_text

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The wording of common license notices, by label.
TEMPLATES = [
    ("mit", "[[Released]] [[Licensed]] [[Distributed]] under the [[terms of the]] MIT License"),
    ("apache-2.0", "Licensed under the Apache License[[,]] Version 2.0"),
    ("gpl-3.0", "[[This work is]] licensed under the GNU General Public License[[,]] version 3"),
    ("gpl-2.0", "[[This work is]] licensed under the GNU General Public License[[,]] version 2"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc-by-4.0", "[[This work is]] licensed under [[a]] CC BY 4.0"),
    ("cc-by-sa-4.0", "[[This work is]] licensed under [[a]] CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "[[This work is]] licensed under [[a]] CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 [[International]] License"),
    ("mit", "[[Copyright (c) <<holder:0-20>>]] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("all-rights-reserved", "[[Copyright [[(c)]] <<holder:0-10>>]] All rights reserved"),
]

KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(KEPT).split()


class Automaton:
    """States are numbers; `steps[s]` has the next states by word, `any_word[s]` those that every word leads to, `free[s]` those without a word."""

    def __init__(self, label: str, template: str):
        self.label, self.required = label, set()
        self.steps: list[dict[bytes, set[int]]] = []
        self.any_word: list[set[int]] = []
        self.free: list[set[int]] = []
        end, depth, opened = self.state(), 0, []
        for part in re.findall(r"\[\[|\]\]|<<\w+:\d+-\d+>>|(?:(?!\[\[|\]\]|<<).)+", template):
            if part == "[[":
                opened.append(end)
                depth += 1
            elif part == "]]":
                self.free[opened.pop()].add(end)
                depth -= 1
            elif part.startswith("<<"):
                least, most = map(int, re.findall(r"\d+", part.partition(":")[2]))
                states = [end]
                for _ in range(most):
                    states.append(self.state())
                    self.any_word[states[-2]].add(states[-1])
                end = self.state()
                for s in states[least:]:
                    self.free[s].add(end)
            else:
                for w in words(part.encode()):
                    s = self.state()
                    self.steps[end].setdefault(w, set()).add(s)
                    end = s
                    if not depth:
                        self.required.add(w)
        self.accepting = end
        self.first = set().union(*(self.steps[s] for s in self.closed({0})))

    def state(self) -> int:
        self.steps.append({}), self.any_word.append(set()), self.free.append(set())
        return len(self.steps) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            new = self.free[todo.pop()] - out
            out |= new
            todo += new
        return out

    def end(self, text: list[bytes], start: int) -> int | None:
        """Where the longest accepted text that begins at a word ends."""
        now, best, i = self.closed({0}), None, start
        while now and i < len(text):
            now = self.closed(set().union(*(self.steps[s].get(text[i], set()) | self.any_word[s] for s in now)))
            i += 1
            if self.accepting in now:
                best = i
        return best


@functools.cache
def automata() -> tuple[Automaton, ...]:
    return tuple(Automaton(*t) for t in TEMPLATES)


def template_matches(text: list[bytes]) -> list[tuple[str, int, int]]:
    """(label, first word, word after the last) of each place where a template is accepted."""
    seen, out = set(text), []
    for a in automata():
        if a.required <= seen:
            starts = [i for i, w in enumerate(text) if w in a.first]
            out += [(a.label, i, e) for i in starts if (e := a.end(text, i)) is not None]
    return out


def phrase_places(text: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place of a phrase."""
    joined, out = b" " + b" ".join(text) + b" ", []
    for phrase, label in PHRASES.items():
        wanted, at, word, last = f" {phrase} ".encode(), -1, 0, 0
        while (at := joined.find(wanted, at + 1)) >= 0:
            word += joined.count(b" ", last, at)  # on from the last place: each blank is counted once
            last = at
            out.append((word, label))
    return out


def scan(text: bytes) -> tuple:
    found = words(text)
    base, more = phrase_places(found), template_matches(found)
    at = [i for i, _ in base]
    base_labels = {x for _, x in base}
    return (len(found), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
            ",".join(sorted(base_labels | {x for x, _, _ in more})), 1.0 if more else 0.5 if base else 0.0,
            [{"label": x, "first_word": i, "end_word": e} for x, i, e in more])


def scanned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the base figures and labels, all labels, a score (1: a template, 0.5: a phrase only) and the accepted spans."""
    columns = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
               "spans array<struct<label: string, first_word: bigint, end_word: bigint>>")
    return per_text(docs, lambda texts: [list(c) for c in zip(*map(scan, texts))], columns, keep)


def op10_template_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir)).drop("spans")
