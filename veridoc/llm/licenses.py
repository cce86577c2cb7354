"""Licence scans by a positional index of rare words.

Each template of the catalogue is a list of words. The index holds, for the words of a template that are rarest in
the corpus (highest IDF, counted over all documents), the positions where they stand in it. A file's words are
looked up there; each hit names a template and the place in the file where it would begin, and places that enough
hits agree on are compared word by word and kept if the template's mandatory key phrases stand where they should.

A template counts where at least half of its words stand at their places. Of m positions, any m - need + v hold v
of the ``need`` that must agree, so the index of that many rarest positions loses no place, whatever the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks

#: Words that a key phrase may stand away from its place in the template.
SLACK = 8
#: Share of a template's words that must stand at their places.
SHARE = 0.5
#: Votes of rare words that a place needs, if the template has so many words.
VOTES = 3

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of public licences: label, text, mandatory key phrases.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        ("permission is hereby granted free of charge", "sublicense and or sell"),
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "version 3 of the license"),
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        ("gnu general public license", "version 2 of the license"),
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products derived from this software",),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license v 2 0",),
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("released into the public domain",)),
)

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    """Words of a text by the rule of the scan; for templates."""
    raw = text.encode().lower()
    return "".join(chr(b) if _IN_WORD[b] and b < 128 else " " if b < 128 else "?" for b in raw).split()


def word_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and second eight bytes and byte length of every word of all texts, and the words of each text."""
    raw = [(t or "").encode().lower() for t in texts]  # of bytes, only A-Z are lowered
    data = np.frombuffer(b" ".join(raw) + b" " * 24, np.uint8)
    inside = _IN_WORD[data]
    edge = np.diff(inside.view(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    spans = np.flatnonzero(edge == -1) - starts
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    low = eights[starts] & _KEPT[np.minimum(spans, 8)]
    high = eights[starts + 8] & _KEPT[np.clip(spans - 8, 0, 8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    return low, high, spans, np.diff(np.searchsorted(starts, ends), prepend=0)


class Catalogue:
    """Templates as word numbers, and how to find these numbers in texts.

    templates: (label, text, key phrases) each; base: label by phrase. Words longer than 16 bytes are refused.
    """

    def __init__(self, templates=TEMPLATES, base=BASE):
        rows = [(label, split_words(text), [split_words(k) for k in keys]) for label, text, keys in templates]
        phrases = [(label, split_words(p)) for p, label in base.items()]
        self.words = sorted({w for _, ws, _ in rows for w in ws} | {w for _, ws in phrases for w in ws})
        if any(len(w) > 16 for w in self.words):
            raise ValueError("a template has a word of more than 16 bytes")
        number = {w: i for i, w in enumerate(self.words)}
        self.labels = [label for label, _, _ in rows]
        self.templates = [np.array([number[w] for w in ws]) for _, ws, _ in rows]
        self.keys = [[(self._place(ws, k), np.array([number[w] for w in k])) for k in ks] for _, ws, ks in rows]
        self.base = [(label, np.array([number[w] for w in ws])) for label, ws in phrases]
        low, high, _, _ = word_keys([" ".join(self.words)])
        mixed = low ^ (high * _MIX)
        self.order = np.argsort(mixed)
        self.mixed, self.low, self.high = mixed[self.order], low[self.order], high[self.order]

    @staticmethod
    def _place(words: list[str], key: list[str]) -> int:
        found = [i for i in range(len(words)) if words[i : i + len(key)] == key]
        if not found:
            raise ValueError(f"key phrase {key} is not in its template")
        return found[0]

    def find(self, low: np.ndarray, high: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words of no template."""
        mixed = low ^ (high * _MIX)
        at = np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)
        same = (self.low[at] == low) & (self.high[at] == high) & (spans <= 16)
        return np.where(same, self.order[at], -1)

    def index(self, idf: np.ndarray) -> RareIndex:
        return RareIndex(self, idf)


class RareIndex:
    """Positions of each template's rarest words, grouped by word."""

    def __init__(self, catalogue: Catalogue, idf: np.ndarray):
        self.catalogue, self.idf = catalogue, idf
        self.need, self.votes, word, template, place = [], [], [], [], []
        for t, ws in enumerate(catalogue.templates):
            need = int(np.ceil(SHARE * len(ws)))
            votes = min(VOTES, need)
            rarest = np.argsort(-idf[ws], kind="stable")[: len(ws) - need + votes]
            self.need.append(need)
            self.votes.append(votes)
            word += ws[rarest].tolist()
            template += [t] * len(rarest)
            place += rarest.tolist()
        order = np.argsort(word, kind="stable")
        self.template, self.place = np.array(template)[order], np.array(place)[order]
        self.first = np.searchsorted(np.array(word)[order], np.arange(len(catalogue.words) + 1))
        self.gap = 2 * SLACK + 2 * max(map(len, catalogue.templates))

    def scan(self, texts: list[str | None]) -> tuple[list, list, list, list, list, list, list]:
        """Words, base places, first and last of these, base labels, all labels and score of each text."""
        cat = self.catalogue
        low, high, spans, counts = word_keys(texts)
        # texts lie apart in one line of places, so that no template or slack reaches from one into another
        begins = np.arange(1, len(texts) + 1) * self.gap + np.cumsum(counts) - counts
        line = np.full(int(counts.sum()) + (len(texts) + 2) * self.gap, -1)
        line[np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(len(low))] = cat.find(low, high, spans)
        at = np.flatnonzero(line >= 0)
        ids = line[at]
        order = np.argsort(ids, kind="stable")
        by_word, from_ = at[order], np.searchsorted(ids[order], np.arange(len(cat.words) + 1))
        text_of = lambda places: np.searchsorted(begins, places, "right") - 1

        def stands(phrase: np.ndarray) -> np.ndarray:
            """Places where the phrase stands, from those of its rarest word."""
            j = int(np.argmax(self.idf[phrase]))
            begin = by_word[from_[phrase[j]] : from_[phrase[j] + 1]] - j
            for k, w in enumerate(phrase):
                begin = begin[line[begin + k] == w]
            return begin

        n = len(texts)
        n_base, first, last, score = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n)
        marks: list[set[str]] = [set() for _ in texts]
        for label, phrase in cat.base:
            places = stands(phrase)
            owner = text_of(places)
            np.add.at(n_base, owner, 1)
            np.minimum.at(first, owner, places - begins[owner])
            np.maximum.at(last, owner, places - begins[owner])
            score[owner] = 1.0
            for i in np.unique(owner).tolist():
                marks[i].add(label)
        base = [",".join(sorted(m)) for m in marks]
        for t, owner, share in self._matches(line, by_word, from_, stands, text_of):
            np.maximum.at(score, owner, share)
            for i in np.unique(owner).tolist():
                marks[i].add(cat.labels[t])
        some = n_base > 0
        ends = lambda x: [int(v) if s else None for v, s in zip(x, some, strict=True)]
        return counts.tolist(), n_base.tolist(), ends(first), ends(last), base, [",".join(sorted(m)) for m in marks], score.tolist()

    def _matches(self, line, by_word, from_, stands, text_of) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, texts, shares of the template's words) of all places that hold one."""
        cat = self.catalogue
        sizes, postings = np.diff(from_), np.diff(self.first)
        words = np.flatnonzero((sizes > 0) & (postings > 0))
        begins: dict[int, list[np.ndarray]] = {}
        for w in words.tolist():
            hits = by_word[from_[w] : from_[w + 1]]
            for p in range(self.first[w], self.first[w + 1]):
                begins.setdefault(int(self.template[p]), []).append(hits - self.place[p])
        for t, parts in begins.items():
            begin, votes = np.unique(np.concatenate(parts), return_counts=True)
            begin = begin[votes >= self.votes[t]]
            for offset, phrase in cat.keys[t]:
                if not len(begin):
                    break
                places = np.sort(stands(phrase))
                near = np.searchsorted(places, begin + offset - SLACK)
                begin = begin[(near < len(places)) & (np.append(places, np.iinfo(np.int64).max)[near] <= begin + offset + SLACK)]
            if not len(begin):
                continue
            ws, agree = cat.templates[t], np.zeros(len(begin), np.int64)
            for q, w in enumerate(ws):
                agree += line[begin + q] == w
            ok = agree >= self.need[t]
            # a place just before a text's first word belongs to that text
            yield t, text_of(begin[ok] + self.gap // 2), agree[ok] / len(ws)


def word_idf(docs: DataFrame, text_col: str = "text", catalogue: Catalogue | None = None) -> np.ndarray:
    """IDF of each word of the catalogue over all documents: log((N + 1) / (df + 1)). One short row of counts for
    each Arrow batch is summed by Spark; what reaches the driver is bounded by the catalogue's words."""
    catalogue = catalogue or Catalogue()

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            seen = np.zeros(len(catalogue.words) + 1, np.int64)
            seen[-1] = len(texts)
            for lo, hi in blocks(texts):
                low, high, spans, counts = word_keys(texts[lo:hi])
                ids = catalogue.find(low, high, spans)
                owner = np.repeat(np.arange(hi - lo), counts)[ids >= 0]
                pairs = np.unique(owner * len(catalogue.words) + ids[ids >= 0])
                seen[:-1] += np.bincount(pairs % len(catalogue.words), minlength=len(catalogue.words))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(len(catalogue.words) + 1)
    for r in rows:
        seen[r["word"]] = r["n"]
    return np.log((seen[-1] + 1) / (seen[:-1] + 1))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalogue: Catalogue | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts all places of base phrases, first_word and last_word are the first and last of these in words
    from 0 (null without any). labels joins the base labels and those of templates found. score is the largest
    share of a template's words that stand at their places; a base phrase stands whole, so it scores 1.

    Null and empty texts have no words, no labels and score 0. Texts are read whole. Repeated rows and null ids
    stay; several templates of one label count once; other columns are left out, so their names cannot clash; an
    empty table gives no rows.
    """
    catalogue = catalogue or Catalogue()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = catalogue.index(word_idf(rows, "text", catalogue))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in blocks(texts):
                found = [pa.array(x, k) for x, k in zip(index.scan(texts[lo:hi]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *found], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def twin_sql() -> str:
    """The scan in SQL, without an index: every word is compared with every template."""
    quoted = lambda w: "'" + w + "'"
    rows = [(t, q, w) for t, (_, text, _) in enumerate(TEMPLATES) for q, w in enumerate(split_words(text))]
    sizes = [(t, label, len(split_words(text)), int(np.ceil(SHARE * len(split_words(text))))) for t, (label, text, _) in enumerate(TEMPLATES)]
    keys = [(t, Catalogue._place(split_words(text), split_words(k)), split_words(k)) for t, (_, text, ks) in enumerate(TEMPLATES) for k in ks]
    listed = lambda ws: "[" + ",".join(map(quoted, ws)) + "]"
    base = ",".join(f"({quoted(label)}, {listed(p.split())})" for p, label in BASE.items())
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM words),
template(t, q, w) AS (VALUES {",".join(f"({t},{q},{quoted(w)})" for t, q, w in rows)}),
sizes(t, label, m, need) AS (VALUES {",".join(f"({t},{quoted(x)},{m},{n})" for t, x, m, n in sizes)}),
keys(t, q, k) AS (VALUES {",".join(f"({t},{q},{listed(k)})" for t, q, k in keys)}),
base(label, k) AS (VALUES {base}),
phrases AS (SELECT DISTINCT k FROM (SELECT k FROM keys UNION ALL SELECT k FROM base)),
stands AS (SELECT doc_id, k, p FROM places JOIN phrases ON w = k[1] WHERE ws[p + 1 : p + len(k)] = k),
based AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS b, list(DISTINCT label) AS labels FROM stands JOIN base USING (k) GROUP BY doc_id),
aligned AS (SELECT doc_id, t, p - q AS d, count(*) AS n FROM places JOIN template USING (w) GROUP BY ALL),
enough AS (SELECT doc_id, t, d, n, m, label FROM aligned JOIN sizes USING (t) WHERE n >= need),
kept AS (SELECT doc_id, label, n / m AS share FROM enough e WHERE NOT EXISTS (SELECT 1 FROM keys WHERE keys.t = e.t AND NOT EXISTS
    (SELECT 1 FROM stands s WHERE s.doc_id = e.doc_id AND s.k = keys.k AND s.p BETWEEN e.d + keys.q - {SLACK} AND e.d + keys.q + {SLACK}))),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM kept GROUP BY doc_id)
SELECT words.doc_id, len(ws) AS n_words, coalesce(based.n, 0) AS n_base, a AS first_word, b AS last_word,
    coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(based.labels, found.labels))), ','), '') AS labels,
    greatest(CASE WHEN based.n > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM words LEFT JOIN based ON based.doc_id = words.doc_id LEFT JOIN found ON found.doc_id = words.doc_id"""
