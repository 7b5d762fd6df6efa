"""License scans: phrases, and text blocks that contain a license template, by an exact set-similarity join.

A template is a set of words. A text is read in blocks: windows of words, each half over the next. A template of n words
is held against blocks of two times the next power of two from n on, so any stretch of n words lies whole in one. A block
meets a template if it holds `percent` of its words or more: o words, rounded up.

Words of templates are counted over all documents and put in order, the rarest first. By this order a block that holds o
of a template's words must hold one of its first |T| - o + 1 (prefix). Only blocks with such a word become sets, of
the words that any template has. A set is dropped if it has fewer than o words (length), or if after the first word
that the two share not enough are left in either of them (position). For the others the shared words are counted. No
filter loses a block. Templates are a parameter of bounded size (`MOST_WORDS`), which is sent to all tasks; the documents
are read where they lie, once for the counts and once for the join.

Words are maximal runs of 0-9, a-z and bytes over 127, after lower-casing A-Z; they are known by 64-bit hashes. Null and
empty texts have no words. Very long texts are hashed in pieces. Rows are treated one by one, so repeated ids stay; other
columns are not read, whatever their names. An empty table gives an empty result, and templates without words meet none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, decontamination

#: The share of a template's words that a block must hold, in percent.
PERCENT = 80
#: The most words of all templates together.
MOST_WORDS = 100_000

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices of public licenses and the label of each.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-family", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
)


class Templates:
    """The templates' words in the global order, and what the filters need."""

    def __init__(self, templates: tuple[tuple[str, str], ...], percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be over 0 and 100 at most")
        found = [(label, hashes) for (label, _), hashes in zip(templates, decontamination.words_of([t for _, t in templates])) if len(hashes)]
        if sum(len(h) for _, h in found) > MOST_WORDS:
            raise ValueError(f"templates may have {MOST_WORDS} words together")
        self.labels = [label for label, _ in found]
        self.half = np.array([1 << max(0, int(len(h) - 1).bit_length()) for _, h in found], np.int64)
        sets = [np.unique(h) for _, h in found]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = -(-percent * self.size // 100)
        self.words = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.has = np.array([np.isin(self.words, s) for s in sets], bool).reshape(-1, len(self.words))
        self.rank = np.arange(len(self.words))

    def place(self, word: np.ndarray) -> np.ndarray:
        """The place of each word among the templates' words, or -1."""
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)

    def order(self, counts: np.ndarray) -> "Templates":
        """Ranks the words, the rarest first, and finds the prefix of each template: the first rows of `ranked`."""
        by_count = np.lexsort((self.words, counts))
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[by_count] = np.arange(len(self.words))
        self.has = self.has[:, by_count]
        before = np.cumsum(self.has, 1) - self.has  # words of the template that come earlier in the order
        self.prefix = self.has & (before < (self.size - self.need + 1)[:, None])
        self.before = before
        return self


def counts(docs: DataFrame, text: str, templates: Templates) -> np.ndarray:
    """How often each of the templates' words stands in all documents."""

    def run(batches):
        total = np.zeros(len(templates.words), np.int64)
        for batch in batches:
            data, offsets = common.utf8(batch.column(0))
            for lo, hi in common.steps(offsets):
                at = templates.place(decontamination.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0])
                total += np.bincount(at[at >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    out = np.zeros(len(templates.words), np.int64)
    # a row for each word of the templates at most
    for r in common.mapped(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def places_of(word: np.ndarray, at: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after the other within a text."""
    here = np.flatnonzero(word[: len(word) - len(phrase) + 1] == phrase[0]) if 0 < len(phrase) <= len(word) else np.zeros(0, np.int64)
    for k, h in enumerate(phrase[1:].tolist(), 1):
        here = here[word[here + k] == h]
    return here[here + len(phrase) <= at[np.searchsorted(at, here, "right")]]


def blocks_of(word: np.ndarray, at: np.ndarray, t: Templates) -> tuple[np.ndarray, ...]:
    """(text, template, first word, end, shared words) of all blocks that meet a template, by text."""
    place = t.place(word)
    where = np.flatnonzero(place >= 0)
    rank = t.rank[place[where]]
    row = np.searchsorted(at, where, "right") - 1
    n, position = np.diff(at), where - at[row]
    out = []
    for half in np.unique(t.half).tolist():
        mine = np.flatnonzero(t.half == half)
        windows = np.maximum(-(-n // half) - 1, 1)
        base = np.concatenate([[0], np.cumsum(windows)])
        number = position // half
        # each word stands in the window that begins in its half, and in the one before
        block = np.concatenate([base[row] + number, base[row] + number - 1])
        sound = np.concatenate([number < windows[row], number > 0])
        ranks = np.concatenate([rank, rank])[sound]
        block = block[sound]
        marked = np.unique(block[t.prefix[mine].any(0)[ranks]])
        if not len(marked):
            continue
        index = np.minimum(np.searchsorted(marked, block), len(marked) - 1)
        use = marked[index] == block
        entry = np.unique(index[use] * len(t.words) + ranks[use])  # sets, each in the global order
        own, word_of = np.divmod(entry, len(t.words))
        first = np.searchsorted(own, np.arange(len(marked)))
        size = np.diff(np.append(first, len(own)))
        for k in mine.tolist():
            hits = np.flatnonzero(t.prefix[k][word_of])
            which, at_first = np.unique(own[hits], return_index=True)
            hits = hits[at_first]  # the first word that the template and the set share
            left = np.minimum(t.size[k] - t.before[k][word_of[hits]], size[which] - (hits - first[which]))
            which = which[(size[which] >= t.need[k]) & (left >= t.need[k])]
            shared = np.bincount(own[t.has[k][word_of]], minlength=len(marked))[which]
            which, shared = which[shared >= t.need[k]], shared[shared >= t.need[k]]
            text = np.searchsorted(base, marked[which], "right") - 1
            begin = (marked[which] - base[text]) * half
            out.append((text, np.full(len(text), k), begin, np.minimum(begin + 2 * half, n[text]), shared))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    found = [np.concatenate(x) for x in zip(*out)]
    order = np.lexsort((found[1], found[2], found[0]))
    return tuple(x[order] for x in found)


FOUND = "n_words long, phrases array<struct<label: string, word: int>>, blocks array<struct<label: string, first: int, last: int, shared: int, size: int>>"


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple = TEMPLATES, phrases: tuple = PHRASES, percent: int = PERCENT) -> DataFrame:
    """The columns `keep` with n_words, the phrases (label and first word of each place) and the blocks that meet a
    template: its label, the block's first and last word, and how many of the template's words it holds."""
    names = list(keep)
    t = Templates(templates, percent)
    t.order(counts(docs, text, t))
    known = list(zip((label for _, label in phrases), decontamination.words_of([p for p, _ in phrases])))
    rows, texts = common.reading(docs, names, text)
    out, arrow = common.schema_of(docs, names, FOUND)

    def lists(row: np.ndarray, n: int, columns: list[pa.Array], kind: pa.DataType) -> pa.ListArray:
        ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type)))

    def run(batches):
        labels = pa.array(t.labels, pa.string())
        for batch in batches:
            data, offsets = common.utf8(texts(batch))
            for lo, hi in common.steps(offsets):
                word, at = decontamination.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found = [places_of(word, at, p) for _, p in known]
                where, kind = np.concatenate([*found, np.zeros(0, np.int64)]), np.repeat(np.arange(len(known)), list(map(len, found)))
                order = np.lexsort((kind, where))
                where, kind = where[order], kind[order]
                row = np.searchsorted(at, where, "right") - 1
                base = lists(row, hi - lo, [pa.array([known[k][0] for k in kind], pa.string()), pa.array(where - at[row])], arrow.field("phrases").type)
                own, k, first, end, shared = blocks_of(word, at, t)
                met = lists(own, hi - lo, [labels.take(pa.array(k)), pa.array(first), pa.array(end - 1), pa.array(shared), pa.array(t.size[k])], arrow.field("blocks").type)
                yield common.columns(batch, lo, hi, names, {"n": np.diff(at), "p": base, "b": met}, arrow)

    return common.mapped(rows, run, out)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license phrases and templates of every document. score: 1 with a phrase, else the largest share of a template
    that a block which meets it holds, else 0."""
    found = license_scan(common.table(spark, sf_dir, "documents"))
    of = lambda column, field: F.transform(column, lambda x: x[field])
    labels = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    share = F.array_max(F.transform("blocks", lambda x: x["shared"] / x["size"]))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(of("phrases", "word")).cast("long").alias("first_word"), F.array_max(of("phrases", "word")).cast("long").alias("last_word"),
        labels(of("phrases", "label")).alias("base_labels"), labels(F.concat(of("phrases", "label"), of("blocks", "label"))).alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def _oracle(percent: int = PERCENT) -> str:
    """Windows, words and thresholds without any filter."""
    split = lambda text: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        w = split(text)
        size = len(set(w))
        rows += [f"({k}, '{label}', {1 << (len(w) - 1).bit_length()}, {size}, {-(-percent * size // 100)}, '{x}')" for x in sorted(set(w))]
    phrases = ", ".join(f"('{label}', {split(p)})" for p, label in PHRASES)
    return rf"""
    WITH t(k, label, half, size, need, word) AS (VALUES {", ".join(rows)}), f(label, phrase) AS (VALUES {phrases}),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
    w AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
    o AS (SELECT r, k, label, size, need, word, unnest([p // half, p // half - 1]) AS i, greatest((n + half - 1) // half - 1, 1) AS windows FROM w JOIN t USING (word)),
    b AS (SELECT r, label, count(DISTINCT word) / size AS share FROM o WHERE i >= 0 AND i < windows GROUP BY r, k, label, size, need, i HAVING count(DISTINCT word) >= need),
    m AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM b GROUP BY r),
    q AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS p FROM d JOIN f ON list_contains(w, phrase[1])),
    g AS (SELECT r, count(*) AS n, min(p) AS lo, max(p) AS hi, list(DISTINCT label) AS labels FROM q GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_base, g.lo AS first_word, g.hi AS last_word, coalesce(array_to_string(list_sort(g.labels), ','), '') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(g.labels, []), coalesce(m.labels, [])))), ',') AS labels, CASE WHEN g.n > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END AS score
    FROM d LEFT JOIN g USING (r) LEFT JOIN m USING (r)"""


ORACLE_SQL = _oracle()
