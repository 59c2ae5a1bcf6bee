"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is any run of consecutive words, as long as the template's window: ``WINDOW`` words, or twice
the template's own if that is more.  The query takes the words of the whole text, so that
a template which wraps over line breaks is found; ``scan`` without ``across_lines`` ends blocks
at line breaks.  A template matches a block that contains at least ``THRESHOLD`` of its
distinct words.  All templates are ordered by the words' frequency in the whole corpus,
rarest first; a text can only match if it holds one of the template's first
|T| - required + 1 words (prefix filter), has enough distinct words (length filter), and if
the words that remain behind the first hit are enough (positional filter).  For what passes, the
distinct words in every window are counted by one slide over the places of the
template's words, so the join finds every match.

Only the frequencies of template words are gathered, as many rows as templates have words.

Defined results: null and empty texts have no words; very long texts are scanned whole; words of equal
frequency go by their letters, and templates that tie all give their labels; repeated rows are
scanned each; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import table

THRESHOLD = 0.8
WINDOW, STRIDE = 96, 32

#: The phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening sentences of common public licenses and notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "All rights reserved"),
    ("proprietary", "This document is confidential and proprietary and may not be reproduced without permission"),
]

#: ASCII that parts words becomes a space, A-Z lower case; other bytes stay.
_FOLD = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand one after another."""
    found = []
    for phrase, label in phrases.items():
        want = words_of(phrase)
        at = -1
        try:
            while want:
                at = words.index(want[0], at + 1)
                if words[at : at + len(want)] == want:
                    found.append((at, label))
        except ValueError:
            pass
    return found


class TemplateIndex:
    """Templates under their prefix words, in the corpus's order of frequency."""

    def __init__(self, templates, threshold: float, counts: dict[str, int]):
        self.templates, self.by_word = [], {}
        for label, text in templates:
            distinct = sorted({w.decode() for w in words_of(text)}, key=lambda w: (counts.get(w, 0), w))
            if not distinct:
                continue
            need = math.ceil(threshold * len(distinct) - 1e-9)
            number = len(self.templates)
            self.templates.append((label, frozenset(w.encode() for w in distinct), need, max(WINDOW, 2 * len(words_of(text)))))
            for place, word in enumerate(distinct[: len(distinct) - need + 1]):
                self.by_word.setdefault(word.encode(), []).append((number, place))
        self.prefix = frozenset(self.by_word)

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """(label, best containment) of all templates that a block of ``words`` meets."""
        block = set(words)
        first: dict[int, int] = {}
        for word in self.prefix & block:
            for number, place in self.by_word[word]:
                first[number] = min(place, first.get(number, place))
        for number, place in first.items():
            label, wanted, need, window = self.templates[number]
            if len(block) < need or len(wanted) - place < need:
                continue
            shared = len(wanted & block)
            if shared >= need:
                if len(words) > window:
                    shared = most_distinct(words, wanted, window)
                if shared >= need:
                    yield label, shared / len(wanted)


def most_distinct(words: list[bytes], wanted: frozenset[bytes], window: int) -> int:
    """The most distinct ``wanted`` words that ``window`` consecutive words hold."""
    places = [(i, w) for i, w in enumerate(words) if w in wanted]
    held: Counter = Counter()
    best = start = 0
    for at, word in places:
        held[word] += 1
        while places[start][0] <= at - window:
            gone = places[start][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            start += 1
        best = max(best, len(held))
    return best


def blocks_of(line: list[bytes]) -> Iterator[list[bytes]]:
    """A line's blocks at fixed strides: the plain version that tests hold the slide against."""
    if len(line) <= WINDOW:
        yield line
    else:
        for at in range(0, len(line) - WINDOW + STRIDE, STRIDE):
            yield line[at : at + WINDOW]


def scan_text(text: str | None, index: TemplateIndex, phrases: dict[str, str] = PHRASES, across_lines: bool = False) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    words = words_of(text)
    places = phrase_places(words, phrases)
    base, labels, score = {x for _, x in places}, set(), 0.0
    if not index.prefix.isdisjoint(words):
        for run in [words] if across_lines else map(words_of, text.split("\n")):
            for label, share in index.matches(run):
                labels.add(label)
                score = max(score, share)
    starts = [s for s, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def word_counts(docs: DataFrame, wanted: frozenset[bytes], text_col: str = "text") -> dict[str, int]:
    """How often each wanted word occurs in all texts; one row per wanted word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(filter(wanted.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, across_lines: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    counts = word_counts(docs, frozenset(w for _, t in templates for w in words_of(t)), text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, threshold, counts)
        for batch in batches:
            rows = [scan_text(t.as_py(), index, phrases, across_lines) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op6_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), across_lines=True)
