"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words, and a block holds it if it has at least PERCENT of them (containment). Blocks are windows
over a document's words, twice as wide as the templates of their size class and half overlapping, so any notice that
is no longer than its class stands in one block whole, wherever its lines break.

Words are ordered by how many documents of the corpus have them, rarest first. If a block and a template share ``need``
words, the first |template| - need + 1 words of the template and the first |block| - need + 1 words of the block, both in this
order, have a word in common (prefix filter); a block with fewer than ``need`` words can't do it (length filter); nor can one where
what follows the first common prefix word on either side is too short for the rest (positional filter). What passes
is counted in full. Only words of some template can be shared, so a block is its words among those; they are bounded by the templates,
which are a parameter of at most MOST_WORDS words in all, whatever the corpus holds. So they go to every task, and no text is
shuffled: one pass counts document frequencies, one pass joins.

Beside templates, phrases are looked for word by word, at every place.

Cases: a null text is an empty one, without words, places or labels; a very long text has as many blocks as it needs; repeated rows
give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm import textnum
from readlog.llm.storage import documents

PERCENT, SMALLEST, MOST_WORDS = 90, 16, 1_000_000
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Public license notices and statements, with the label of each.
TEMPLATES = (
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_INSIDE = np.ones(256, bool)
_INSIDE[0x00:0x30] = _INSIDE[0x3A:0x61] = _INSIDE[0x7B:0x80] = False
SEED = 41


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased texts, and the number of its first word by row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def size_class(n: int) -> int:
    """Words of the class: the next power of two."""
    return max(SMALLEST, 1 << (n - 1).bit_length())


@dataclass(frozen=True)
class Vocabulary:
    """The words of all templates and phrases, numbered."""

    words: list[str]

    def __post_init__(self) -> None:
        if len(self.words) > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} distinct words")

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, with the number and the length of each one's word."""
        raw = [w.encode() for w in self.words]
        ends = np.cumsum([0, *map(len, raw)])
        hashes = textnum.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:], SEED)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], order, np.diff(ends)[order]


def vocabulary(templates: tuple, phrases: tuple) -> Vocabulary:
    return Vocabulary(sorted({w for _, text in templates for w in words_of(text)} | {w for text, _ in phrases for w in words_of(text)}))


class Reader:
    """Texts to the numbers of their words, -1 for those of no template."""

    def __init__(self, known: Vocabulary):
        self.hashes, self.numbers, self.lengths = known.lookup()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and that of the first word by row."""
        data, offsets = textnum.text_bytes(column)
        data = textnum.lower_ascii(data)
        start, end, first = _word_spans(data, offsets)
        hashes = textnum.word_hashes(data, start, end, SEED)
        if not len(hashes) or not len(self.hashes):
            return np.full(len(hashes), -1), first
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes) & (self.lengths[at] == end - start)
        return np.where(same, self.numbers[at], -1), first


def word_frequencies(docs: DataFrame, known: Vocabulary) -> list[int]:
    """How many documents have each known word: one number a word of the vocabulary, none a word of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = Reader(known), np.zeros(len(known.words), np.int64)
        for batch in batches:
            for piece in textnum.pieces(batch):
                numbers, first = read(piece.column("text"))
                rows = textnum.rows_of(first, len(numbers))[numbers >= 0]
                pairs = np.unique(rows * len(counts) + numbers[numbers >= 0])
                counts += np.bincount(pairs % max(1, len(counts)), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["number", "n"])

    sums = docs.select("text").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()
    out = [0] * len(known.words)
    for r in sums:
        out[r.number] = r.n
    return out


class Join:
    """Templates of one size class, indexed by their prefixes."""

    def __init__(self, templates: list[tuple[int, list[int]]], n_words: int, percent: int):
        """``templates``: number and ranks (rarest word 0) of each."""
        self.numbers = np.array([t for t, _ in templates])
        self.sizes = np.array([len(ranks) for _, ranks in templates])
        self.need = -(-percent * self.sizes // 100)
        self.holds = np.zeros((len(templates), n_words), bool)
        postings = []
        for i, (_, ranks) in enumerate(templates):
            self.holds[i, ranks] = True
            postings += [(r, i, p) for p, r in enumerate(sorted(ranks)[: len(ranks) - self.need[i] + 1])]
        self.word, self.template, self.place = np.array(sorted(postings), np.int64).reshape(-1, 3).T
        self.n_words = n_words

    def __call__(self, blocks: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, template number and shared words of all that reach containment; entries are ordered by (block, rank)."""
        begin = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]) if len(blocks) else np.zeros(0, bool))
        sizes = np.diff(np.append(begin, len(blocks)))
        of = np.repeat(np.arange(len(begin)), sizes)
        place, size = np.arange(len(blocks)) - begin[of], sizes[of]
        low, high = np.searchsorted(self.word, ranks), np.searchsorted(self.word, ranks, "right")
        hits = np.repeat(np.arange(len(blocks)), high - low)
        if not len(hits):
            return hits, hits, hits
        posting = np.arange(len(hits)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[hits]
        template, there = self.template[posting], self.place[posting]
        need, here, n = self.need[template], place[hits], size[hits]
        passes = (n >= need) & (here <= n - need)  # length filter, prefix of the block
        _, first = np.unique((of[hits] * len(self.numbers) + template)[passes], return_index=True)  # the first common prefix word
        kept = np.flatnonzero(passes)[first]
        kept = kept[1 + np.minimum(self.sizes[template[kept]] - there[kept] - 1, n[kept] - here[kept] - 1) >= need[kept]]  # positional filter
        block, template = of[hits[kept]], template[kept]
        counts = sizes[block]
        entries = np.repeat(begin[block] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.add.reduceat(self.holds[np.repeat(template, counts), ranks[entries]].astype(np.int64), np.cumsum(counts) - counts) if len(block) else counts
        good = shared >= self.need[template]
        return blocks[begin[block[good]]], template[good], shared[good]


def joins(templates: tuple, known: Vocabulary, frequencies: list[int], percent: int) -> tuple[np.ndarray, dict[int, Join]]:
    """The rank of each word, rarest first and ties by the word, and a join for each size class."""
    rank = np.empty(len(known.words), np.int64)
    rank[sorted(range(len(rank)), key=lambda i: (frequencies[i], known.words[i]))] = np.arange(len(rank))
    number = {w: i for i, w in enumerate(known.words)}
    classes: dict[int, list[tuple[int, list[int]]]] = {}
    for t, (_, text) in enumerate(templates):
        ordered = words_of(text)
        if ordered:
            classes.setdefault(size_class(len(ordered)), []).append((t, sorted({int(rank[number[w]]) for w in ordered})))
    return rank, {size: Join(some, len(rank), percent) for size, some in classes.items()}


def found_templates(numbers: np.ndarray, first: np.ndarray, rank: np.ndarray, by_class: dict[int, Join]) -> Iterator[tuple[int, int, float]]:
    """(row, template, containment) of all blocks that hold a template."""
    known = np.flatnonzero(numbers >= 0)
    rows = textnum.rows_of(first, len(numbers))[known]
    place, ranks = known - first[rows], rank[numbers[known]]
    widest = int(np.diff(first).max(initial=0)) // SMALLEST + 2
    for size, join in by_class.items():
        window = place // size
        blocks = np.concatenate([window, window[window > 0] - 1])  # windows of 2 * size words, one every size words
        keys = np.concatenate([rows, rows[window > 0]]) * widest + blocks
        entries = np.unique(keys * join.n_words + np.concatenate([ranks, ranks[window > 0]]))
        block, template, shared = join(entries // join.n_words, entries % join.n_words)
        yield from zip((block // widest).tolist(), join.numbers[template].tolist(), (shared / join.sizes[template]).tolist(), strict=True)


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row a row. ``templates`` are (label, text),
    ``phrases`` (text, label). score is the highest containment of a phrase (1 where it stands) or a template that was found, else 0."""
    known = vocabulary(templates, phrases)
    frequencies = word_frequencies(docs, known)
    number = {w: i for i, w in enumerate(known.words)}
    sought = [([number[w] for w in words_of(text)], label) for text, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(known)
        rank, by_class = joins(templates, known, frequencies, percent)
        for batch in batches:
            for piece in textnum.pieces(batch):
                numbers, first = read(piece.column("text"))
                n = piece.num_rows
                places, least, most = np.zeros(n, np.int64), np.full(n, len(numbers)), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                labels: list[set[str]] = [set() for _ in range(n)]
                score = np.zeros(n)
                end_of = np.repeat(first[1:], np.diff(first))
                for words, label in sought:
                    starts = np.flatnonzero(numbers == words[0])
                    starts = starts[starts + len(words) <= end_of[starts]]
                    for k, w in enumerate(words[1:], 1):
                        starts = starts[numbers[starts + k] == w]
                    rows = np.searchsorted(first, starts, "right") - 1
                    places += np.bincount(rows, minlength=n)
                    np.minimum.at(least, rows, starts - first[rows])
                    np.maximum.at(most, rows, starts - first[rows])
                    score[rows] = 1.0
                    for row in np.unique(rows):
                        base[row].add(label)
                for row, template, share in found_templates(numbers, first, rank, by_class):
                    labels[row].add(templates[template][0])
                    score[row] = max(score[row], share)
                none = places == 0
                arrays = [
                    piece.column("doc_id"), pa.array(np.diff(first)), pa.array(places), pa.array(least, mask=none), pa.array(most, mask=none),
                    pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b | x)) for b, x in zip(base, labels, strict=True)], pa.string()), pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _quoted(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def oracle(templates: tuple = TEMPLATES, phrases: tuple = PHRASES, percent: int = PERCENT) -> str:
    """DuckDB SQL for the query: every block against every template, every place against every phrase."""
    named = ", ".join(f"({i}, '{label}', {size_class(len(words_of(text)))}, {_quoted(sorted(set(words_of(text))))})" for i, (label, text) in enumerate(templates))
    said = ", ".join(f"('{label}', {_quoted(words_of(text))})" for text, label in phrases)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT * FROM (VALUES {named}) v(id, label, size, set)), p AS (SELECT * FROM (VALUES {said}) v(label, words)),
b AS (SELECT rid, size, list_distinct(ws[pos + 1 : pos + 2 * size]) AS words FROM (SELECT rid, ws, size, unnest(range(0, len(ws), size)) AS pos FROM d, (SELECT DISTINCT size FROM t) s) x),
m AS (SELECT rid, label, len(list_intersect(words, set)) AS shared, len(set) AS n FROM b JOIN t USING (size)),
f AS (SELECT rid, label, shared / n AS share FROM m WHERE 100 * shared >= {percent} * n),
k AS (SELECT rid, label, unnest(list_filter(range(0, len(ws) - len(words) + 1), lambda i: ws[i + 1 : i + len(words)] = words)) AS pos FROM d, p),
g AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM k GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT * FROM f UNION ALL SELECT rid, label, 1 FROM k) u GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0) AS score
FROM d LEFT JOIN g USING (rid) LEFT JOIN l USING (rid)"""
