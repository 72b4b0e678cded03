"""License scans: exact set-similarity join of text blocks with templates.

Templates are in classes of length h (powers of two from the least that holds their
words). For a class a document is cut into blocks of 2 h words, each h words after
the one before, so any passage of up to h + 1 words lies in a block. A block meets a
template when it has at least THRESHOLD of the template's distinct words; all of
them for a notice of fewer than WHOLE words, of which one more or less is another
license. Words are put in one global order, rarest first by their document frequency
over the whole corpus; a block that meets a template must have a word of the
template's prefix, must be long enough, and from the place of that word on must still
be able to reach the threshold: these filters are exact, and what they leave is counted.

A document's score is the greatest containment of a template that it meets, or
NAMED where a phrase only names a license.

Templates are a fixed table, so what is shipped does not grow with the data;
documents are read twice, once for frequencies, with no shuffle but of counts.

Cases: null and empty texts have no words, no label and score 0; repeated rows
count each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import alnum_words, documents, id_text, map_arrow, utf8

#: Words of well-known license texts, and notices that stand for them. The label is what is before the
#: slash. No notice has all words of another, which would be met with it.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "mit/notice": "Released under the MIT License",
    "mit/notice 2": "Licensed under the MIT License",
    "apache/notice": "Licensed under the Apache License, Version 2.0",
    "gpl/notice": "licensed under the GNU General Public License, version 3",
    "gpl/notice 2": "licensed under the GNU General Public License, version 2",
    "bsd/notice": "Licensed under the BSD 3-Clause License",
    "bsd/notice 2": "Use of this source code is governed by a BSD-style license",
    "cc-by-sa/notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc/notice": "Licensed under CC BY-NC 4.0",
    "cc0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}
#: Phrases that name a license.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
THRESHOLD = 0.8
WHOLE = 16  #: notices of fewer distinct words must be there whole
NAMED = 0.6  #: score of a document that only names a license
STEP = 16  #: the least h


def needed(words: set, threshold: float = THRESHOLD) -> int:
    """How many of a template's distinct words a block must have."""
    return len(words) if len(words) < WHOLE else max(1, math.ceil(threshold * len(words) - 1e-9))


def step_of(template: str) -> int:
    """h of a template's class."""
    h = STEP
    while h < len(alnum_words(template.encode())):
        h *= 2
    return h


@dataclass
class Index:
    """Templates as word sets in global order, with an index of their prefixes."""

    need: dict[str, int]
    words: dict[str, list[bytes]]
    prefix: dict[bytes, list[tuple[str, int]]]
    rank: dict[bytes, int]

    @classmethod
    def of(cls, templates: dict[str, str], frequency: dict[bytes, int], threshold: float) -> Index:
        sets = {k: set(alnum_words(t.encode())) for k, t in templates.items()}
        order = sorted({w for s in sets.values() for w in s}, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: i for i, w in enumerate(order)}
        words = {k: sorted(s, key=rank.__getitem__) for k, s in sets.items()}
        need = {k: needed(s, threshold) for k, s in sets.items()}
        prefix: dict[bytes, list] = {}
        for k, w in words.items():
            for at in range(len(w) - need[k] + 1):
                prefix.setdefault(w[at], []).append((k, at))
        return cls(need, words, prefix, rank)

    def matches(self, block: list[bytes]) -> dict[str, float]:
        """Containment of each template that the block meets."""
        if self.prefix.keys().isdisjoint(block):
            return {}
        own = sorted(self.rank.keys() & set(block), key=self.rank.__getitem__)
        out, seen = {}, set()
        for i, w in enumerate(own):
            for k, at in self.prefix.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)
                # w is the first that both have, so what follows it bounds the overlap
                if len(own) < self.need[k] or 1 + min(len(own) - i - 1, len(self.words[k]) - at - 1) < self.need[k]:
                    continue
                both = len(set(own).intersection(self.words[k]))
                if both >= self.need[k]:
                    out[k] = both / len(self.words[k])
        return out


def phrases(words: list[bytes]) -> list[tuple[int, str]]:
    """Start and label of every place of a phrase, in order."""
    out = []
    at = -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(out)
        for phrase, label in PHRASES.items():
            start = at - len(phrase) + 1
            if start >= 0 and all(words[start + j] == p.encode() for j, p in enumerate(phrase)):
                out.append((start, label))


def frequencies(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """In how many rows each word of the templates is: a row a word reaches the driver."""
    vocabulary = {w for t in templates.values() for w in alnum_words(t.encode())}

    def rows(batch):
        n = Counter()
        for text in utf8(batch.column(1)):
            n.update(vocabulary.intersection(alnum_words(text)))
        yield from ((w, c) for w, c in n.items())

    counts = map_arrow(id_text(df, id_col, text_col), rows, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(
    df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, places (start and label of each phrase) and blocks (first
    word, words, template and containment of each block that meets a template)."""
    frequency = frequencies(df, templates, id_col, text_col)
    classes: dict[int, dict[str, str]] = {}
    for name, t in templates.items():
        classes.setdefault(step_of(t), {})[name] = t
    indexes = [(h, Index.of(own, frequency, threshold)) for h, own in sorted(classes.items())]

    def rows(batch):
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            words = alnum_words(text)
            blocks = []
            there = set(words)
            for step, index in indexes:
                if index.prefix.keys().isdisjoint(there):
                    continue
                for at in range(0, max(1, len(words) - step), step):
                    block = words[at : at + 2 * step]
                    blocks += [{"first": at, "words": len(block), "template": k, "containment": c} for k, c in index.matches(block).items()]
            yield key, len(words), [{"first": a, "label": x} for a, x in phrases(words)], blocks

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(
        id_text(df, id_col, text_col), rows,
        f"doc_id {kind}, n_words long, places array<struct<first:long,label:string>>, "
        "blocks array<struct<first:long,words:long,template:string,containment:double>>",
        lambda r: 64 * (len(r[2]) + len(r[3])),
    )


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base, own = F.col("places.label"), F.transform("blocks.template", lambda t: F.substring_index(t, "/", 1))
    named = F.when(F.size("places") > 0, NAMED).otherwise(0.0)
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"), join(base).alias("base_labels"), join(F.concat(base, own)).alias("labels"),
        F.greatest(named, F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def _rows() -> str:
    """Templates for the SQL: label, words, h, how many are needed."""
    out = []
    for name, t in TEMPLATES.items():
        words = [w.decode() for w in alnum_words(t.encode())]
        out.append(f"('{name.partition('/')[0]}', '{' '.join(words)}', {step_of(t)}, {needed(set(words))})")
    return ", ".join(out)


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT label, list_distinct(string_split(words, ' ')) AS t, h, need FROM (VALUES %s) v(label, words, h, need)),
p AS (SELECT doc_id, CASE WHEN w[i + 1:i + 2] = ['mit', 'license'] THEN 'mit' WHEN w[i + 1:i + 2] = ['apache', 'license'] THEN 'apache'
                          WHEN w[i + 1:i + 3] = ['general', 'public', 'license'] THEN 'gpl' END AS label, i
      FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list(DISTINCT label)) AS ls FROM p WHERE label IS NOT NULL GROUP BY doc_id),
x AS (SELECT doc_id, h, list_distinct(w[i + 1:i + 2 * h]) AS x
      FROM (SELECT doc_id, w, h, unnest(range(0, greatest(1, len(w) - h), h)) AS i FROM d, (SELECT DISTINCT h FROM q))),
k AS (SELECT doc_id, label, len(list_intersect(x.x, q.t)) AS o, len(q.t) AS m, need FROM x JOIN q USING (h)),
m AS (SELECT doc_id, count(*) AS n, max(o / m) AS c, list(DISTINCT label) AS ls FROM k WHERE o >= need GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, b.a AS first_word, b.z AS last_word,
       coalesce(array_to_string(b.ls, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(b.ls, []) || coalesce(m.ls, []))), ',') AS labels,
       greatest(CASE WHEN b.n > 0 THEN 0.6 ELSE 0.0 END, coalesce(m.c, 0.0))::DOUBLE AS score, CAST(coalesce(m.n, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
""" % _rows()
