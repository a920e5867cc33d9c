"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or for one template, as notices are wrapped, a run of neighbouring lines without an empty one
between: the last words of its first line, the first ones of its last line, each as many as the template has, and the
lines between, together no longer than the template. Its set is its distinct words. It matches a template when it holds
at least ``THRESHOLD`` of the template's distinct words.

1. Words of the templates are ordered by how many documents of the whole corpus hold them, rare first; other words can't
   add to an overlap. That count is one pass and a grouped sum over a vocabulary of fixed size.
2. A template of n words that needs o of them is found through its n - o + 1 rarest words (prefix). A second pass emits
   the blocks that hold any template's prefix word, with their words in that order.
3. Blocks and templates meet on prefix words; the length filter drops blocks of fewer words than the template needs, the
   positional filter those where the words from the match on can't reach it. What is left is compared in full, once per
   block and template.

Beside the join, fixed phrases are looked for in whole texts, word by word.

Edge cases: null and empty texts have no words, no labels and score 0; equal doc_ids get a row each, numbered within
their task, so that their blocks stay apart; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, texts_of

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening lines of common licenses, and their labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "rights-reserved": "Copyright. All rights reserved.",
}
THRESHOLD = 0.8

#: Bytes outside words become spaces, A-Z lower case; bytes beyond ASCII belong to words.
_WORDS = bytes((x + 32 if 65 <= x <= 90 else x) if (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 or x >= 128) else 32 for x in range(256))
_LINES = bytes(10 if x == 10 else _WORDS[x] for x in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _places(flat: bytes, phrase: bytes) -> list[int]:
    """Starts, in words, of the phrase in words joined by single spaces (a space before and after)."""
    out, n, before, at = [], 0, 0, flat.find(phrase)
    while at >= 0:
        n += flat.count(b" ", before, at)
        out.append(n)
        before, at = at, flat.find(phrase, at + 1)
    return out


def _vocabulary(templates: dict[str, str]) -> list[bytes]:
    return sorted({w for t in templates.values() for w in words(t)})


def runs_of(lines: list[list[bytes]], at: int, most: int) -> list[tuple[int, int, set[bytes]]]:
    """(first, last, words) of the runs of two lines or more that hold line ``at`` and whose inner lines have ``most`` words
    together at most; of runs with one first line the longest."""
    out, first, before = [], at, 0
    while first >= 0 and lines[first]:
        if first < at:
            before += len(lines[first + 1]) if first + 1 < at else 0
            if before > most:
                break
        last, inner = at, before
        while last + 1 < len(lines) and lines[last + 1]:
            more = len(lines[last]) if last > first else 0
            if inner + more > most:
                break
            inner, last = inner + more, last + 1
        if last > first:
            words = [*lines[first][-most:], *(w for x in lines[first + 1 : last] for w in x), *lines[last][:most]]
            out.append((first, last, set(words)))
        first -= 1
    return out


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(word, df): documents that hold each of these words."""

    def count(batches):
        known, n = {w: k for k, w in enumerate(vocabulary)}, np.zeros(len(vocabulary), np.int64)
        names = frozenset(known)
        for b in batches:
            for text in b.column(1).to_pylist():
                for w in names.intersection(words(text)):
                    n[known[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in vocabulary], pa.string()), pa.array(n)], names=["word", "df"])

    return texts_of(docs).mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Documents with what the phrases gave, and matches (row, doc_id, line, last, label, containment) of blocks,
    which are lines or runs of lines from ``line`` to ``last``."""
    spark = docs.sparkSession
    vocabulary = _vocabulary(templates)
    df = {r.word: r.df for r in document_frequencies(docs, vocabulary).collect()}  # a row per word of the templates
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w.decode(), 0), w)))}
    sets = {label: sorted(order[w] for w in set(words(t))) for label, t in templates.items()}
    least = {label: math.ceil(threshold * len(s) - 1e-9) for label, s in sets.items()}
    starts = {k for label, s in sets.items() for k in s[: len(s) - least[label] + 1]}
    lengths = {label: len(words(t)) for label, t in templates.items()}
    begins = {label: frozenset(w for w, k in order.items() if k in s[: len(s) - least[label] + 1]) for label, s in sets.items()}
    prefix_words = frozenset(w for w, k in order.items() if k in starts)
    index = spark.createDataFrame([(label, k, p, len(s), least[label], s) for label, s in sets.items() for p, k in enumerate(s[: len(s) - least[label] + 1])], "label string, word int, at int, size int, least int, template array<int>")
    spaced = {label: [b" " + w.encode() + b" " for w, x in phrases.items() if x == label] for label in set(phrases.values())}

    def rows(batches):
        number = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lined = text.encode("utf-8", "surrogatepass").translate(_LINES)
                every = lined.split()
                flat = b" " + b" ".join(every) + b" "
                found = {label: [p - 0 for w in ws for p in _places(flat, w)] for label, ws in spaced.items()}
                at = [p for ps in found.values() for p in ps]
                blocks = []
                if not prefix_words.isdisjoint(every):
                    lines, runs = [line.split() for line in lined.split(b"\n")], {}
                    for k, line in enumerate(lines):
                        own = set(line)
                        if not own.isdisjoint(prefix_words):
                            blocks.append({"line": k, "last": k, "only": None, "own": sorted(order[w] for w in own if w in order), "size": len(own)})
                            for label, some in begins.items():
                                if not own.isdisjoint(some):
                                    for i, j, held in runs_of(lines, k, lengths[label]):
                                        runs[label, i, j] = held
                    blocks += [{"line": i, "last": j, "only": label, "own": sorted(order[w] for w in held if w in order), "size": len(held)} for (label, i, j), held in runs.items()]
                out.append((number, d, len(every), len(at), min(at, default=None), max(at, default=None), sorted(x for x, ps in found.items() if ps), blocks))
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("line", pa.int32()), ("last", pa.int32()), ("only", pa.string()), ("own", pa.list_(pa.int32())), ("size", pa.int32())]))]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    read = texts_of(docs).mapInArrow(rows, "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<line: int, last: int, only: string, own: array<int>, size: int>>")
    read = stage(read, "blocks")
    blocks = read.select("row", "doc_id", F.explode("blocks").alias("b")).select("row", "doc_id", "b.*")
    met = blocks.select("row", "doc_id", "line", "last", "only", "own", "size", F.posexplode("own").alias("here", "word")).join(F.broadcast(index.withColumnRenamed("size", "of")), "word").where("only is null or only = label")
    # length; then what both have from the match on
    met = met.where(F.col("size") >= F.col("least")).where(1 + F.least(F.col("of") - F.col("at") - 1, F.size("own") - F.col("here") - 1) + F.least("at", "here") >= F.col("least"))
    once = met.groupBy("row", "doc_id", "line", "last", "label").agg(F.first("own").alias("own"), F.first("template").alias("template"), F.first("least").alias("least"))
    same = F.size(F.array_intersect("own", "template"))
    matches = once.where(same >= F.col("least")).select("row", "doc_id", "line", "last", "label", (same / F.size("template")).alias("containment"))
    return read.drop("blocks"), matches


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, matches = scan(table(spark, sf_dir, "documents"))
    found = matches.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    rows = documents.join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
