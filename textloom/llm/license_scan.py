"""License scans by an exact set-similarity join of text blocks with licence templates.

A block matches a template when it holds at least `threshold` of the template's distinct
words (containment). Words are ordered by their frequency in the whole collection, rarest
first. A block can only match if it holds one of the template's first
n - ceil(threshold * n) + 1 words in that order (prefix filter), has enough template words
at all (length filter), and enough of them left from the first common word on, in both
(positional filter); what passes is counted exactly. Blocks are lines; a line of more than
`block_words` words is cut into windows of that size that start every half window, so any
template up to half a window long lies whole in one of them. For templates that are wrapped,
the same windows run over the words of the whole text; those that cross a line end are blocks
for the templates that no line of the text matches. Windows are widened to twice the longest
template.

Scale: two narrow passes over the documents. The first counts template words (at most
MAX_TEMPLATE_WORDS partial counts a task), the second matches against an index of template
prefixes; both sizes depend on the templates only. There is no shuffle of text.

Defined results: a null or empty text has no words, blocks or labels; texts are read whole;
repeated rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, words_of

#: The phrases counted as such, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of well-known licence notices, and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
THRESHOLD = 0.9
BLOCK_WORDS = 64
#: Bound on the distinct words of all templates together; more is refused, not cut.
MAX_TEMPLATE_WORDS = 100_000


def needed(size: int, threshold: float) -> int:
    """The least number of common words: ceil(threshold * size), safe against rounding."""
    return math.ceil(threshold * size - 1e-9)


class Index:
    """Templates as frequency-ordered word lists, and the inverted index of their prefixes."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], threshold: float):
        words = {w for _, text in templates for w in words_of(text)}
        if len(words) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"{len(words)} template words; at most {MAX_TEMPLATE_WORDS} fit one pass")
        self.rank = {w: k for k, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(self.rank[w] for w in words_of(text)) for _, text in templates]
        self.needs = [needed(len(s), threshold) for s in self.sets]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, (ranks, need) in enumerate(zip(self.sets, self.needs, strict=True)):
            for i, r in enumerate(sorted(ranks)[: len(ranks) - need + 1]):
                self.prefixes.setdefault(r, []).append((t, i))
        words_by_rank = {r: w for w, r in self.rank.items()}
        self.starters = frozenset(words_by_rank[r] for r in self.prefixes)

    def matches(self, block: list[bytes]) -> dict[int, float]:
        """Template number to containment, for the templates that the block matches."""
        ranks = sorted({self.rank[w] for w in block if w in self.rank})
        held, found, seen = frozenset(ranks), {}, set()
        for j, r in enumerate(ranks):
            for t, i in self.prefixes.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first common word decides the positional filter
                size, need = len(self.sets[t]), self.needs[t]
                if len(ranks) >= need and 1 + min(size - i - 1, len(ranks) - j - 1) >= need and (common := len(self.sets[t] & held)) >= need:
                    found[t] = common / size
        return found


def windows_of(words: list[bytes], block_words: int) -> list[tuple[int, list[bytes]]]:
    """(start, words) of the windows that start every half window; all words if they fit one."""
    if len(words) <= block_words:
        return [(0, words)]
    half = block_words // 2
    return [(s, words[s : s + block_words]) for s in range(0, len(words) - block_words + half, half)]


def line_blocks(text: str | None, block_words: int = BLOCK_WORDS) -> list[list[bytes]]:
    """The word lists of the blocks that lie in one line."""
    return [w for line in (text or "").encode().split(b"\n") for _, w in windows_of(words_of(line), block_words)]


def crossing_blocks(text: str | None, block_words: int = BLOCK_WORDS) -> list[list[bytes]]:
    """The word lists of the windows over the whole text that cross a line end."""
    lines = [words_of(line) for line in (text or "").encode().split(b"\n")]
    words = [w for line in lines for w in line]
    of = [no for no, line in enumerate(lines) for _ in line]
    return [w for s, w in windows_of(words, block_words) if w and of[s] != of[s + len(w) - 1]]


def blocks_of(text: str | None, block_words: int = BLOCK_WORDS) -> list[list[bytes]]:
    """The word lists of the blocks of a text."""
    return line_blocks(text, block_words) + crossing_blocks(text, block_words)


def template_frequencies(df: DataFrame, text_col: str, templates: tuple[tuple[str, str], ...]) -> dict[bytes, int]:
    """How often each template word occurs in all texts; bounded by the templates' vocabulary."""
    vocabulary = frozenset(w for _, text in templates for w in words_of(text))

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter[bytes] = Counter()
        for text in b.column(0).to_pylist():
            n.update(w for w in words_of(text) if w in vocabulary)
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = map_batches(df.select(text_col), per_batch, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}  # at most MAX_TEMPLATE_WORDS rows


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        wanted = words_of(phrase)
        start = -1
        for _ in range(words.count(wanted[-1])):
            start = words.index(wanted[-1], start + 1)
            first = start - len(wanted) + 1
            if first >= 0 and words[first : start + 1] == wanted:
                found.append((first, label))
    return found


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word, base_labels, labels, n_blocks, score.

    n_blocks counts the blocks that match a template, windows across lines only where they match
    one that no line of the text does; score is the best containment, 1 where
    a phrase stands."""
    index = Index(templates, template_frequencies(df, text_col, templates), threshold)
    id_type = df.schema[id_col].dataType
    block_words = max(block_words, 2 * max((len(words_of(text)) for _, text in templates), default=0))

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for text in b.column(1).to_pylist():
            words = words_of(text)
            places = phrase_places(words, PHRASES) if b"license" in words else []
            base = {label for _, label in places}
            labels, best, blocks = set(base), 1.0 if places else 0.0, 0
            if not index.starters.isdisjoint(words):
                in_lines: set[int] = set()
                for across, some in ((False, line_blocks), (True, crossing_blocks)):
                    for block in some(text, block_words):
                        if index.starters.isdisjoint(block):
                            continue
                        found = {t: c for t, c in index.matches(block).items() if not across or t not in in_lines}
                        if found:
                            blocks += 1
                            labels |= {index.labels[t] for t in found}
                            best = max(best, *found.values())
                            in_lines |= set() if across else set(found)
            starts = [s for s, _ in places]
            rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), blocks, round(best, 6)))
        columns = list(zip(*rows, strict=True))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_blocks", "score"])

    schema = f"`{id_col}` {id_type.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, n_blocks bigint, score double"
    return map_batches(df.select(id_col, text_col), per_batch, schema)
