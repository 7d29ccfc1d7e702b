"""License notices in texts: winnowed fingerprints of templates pick candidates, banded alignment measures them.

The inverted index maps fingerprints (five-word shingles that winnowing chooses) to templates and places. A text looks up
all of its shingles, so a template that shares a chosen shingle is found wherever it stands. Hits of a template on nearby
diagonals are aligned with it inside a band, and the match is reported with its coverage and span.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare, to_batch
from .decontaminate import _Lookup, _shingle_hashes, _word_hashes, words_of

#: Words of a shingle, shingles of a winnowing window, half width of the alignment's band in words, least coverage.
SHINGLE_WORDS, WINNOW, BAND, LEAST_COVERAGE = 5, 4, 8, 0.8

#: Notices by SPDX identifier. Each is the licence's own wording or its usual one-line form.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def winnow(hashes: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the least hash in each window, the last of equal ones; of fewer hashes than a window, of all."""
    chosen = set()
    for at in range(max(1, len(hashes) - window + 1)):
        part = hashes[at : at + window]
        if len(part):
            chosen.add(at + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(chosen)


@dataclass(frozen=True)
class Match:
    license: str
    template: int
    start: int  #: first word in the text
    end: int  #: after the last
    matched: int
    coverage: float


def align(template: list[bytes], text: list[bytes], band: int = BAND) -> tuple[int, int, int]:
    """(matched words, start, end in `text`) of the best alignment of a whole template with any part of a text.

    A match counts 2, a mismatch or gap -1; text before and after is free. Only cells within `band` of the diagonal
    that starts `band` words into the text are computed.
    """
    width, low = 2 * band + 1, -(10**9)
    # a cell: (score, matches, start); column k of row i is text word i + k
    row = [(0, 0, k) for k in range(width)]
    for i, word in enumerate(template):
        new, beside = [], (low, 0, 0)
        for k in range(width):
            at = i + k
            score, matched, start = row[k]
            if at < len(text):
                hit = text[at] == word
                best = (score + (2 if hit else -1), matched + hit, start)
            else:
                best = (low, 0, 0)
            if k + 1 < width and row[k + 1][0] - 1 > best[0]:  # the template's word is left out
                best = (row[k + 1][0] - 1, *row[k + 1][1:])
            if beside[0] - 1 > best[0] and at < len(text):  # the text's word is
                best = (beside[0] - 1, *beside[1:])
            new.append(best)
            beside = best
        row = new
    k = max(range(width), key=lambda k: (row[k][0], -k))
    score, matched, start = row[k]
    return matched, start, min(len(text), len(template) + k)


class Index:
    """Winnowed shingles of all templates."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.templates = [(name, number, words_of(t.encode())) for name, texts in templates.items() for number, t in enumerate(texts)]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        sizes = set()
        for k, (_, _, words) in enumerate(self.templates):
            size = min(SHINGLE_WORDS, len(words))
            if size:
                sizes.add(size)
                hashes = _shingle_hashes(_word_hashes(words), size)
                for place in winnow(hashes):
                    postings[int(hashes[place])].append((k, place))
        self.hashes = sorted(postings)
        self.lookup = _Lookup(np.array(self.hashes, np.uint64), tuple(sorted(sizes)))
        self.postings = [postings[h] for h in self.hashes]

    def matches(self, words: list[bytes], least: float) -> list[Match]:
        """Matches of at least that coverage, in order; of overlapping ones, that with most matched words, then most coverage."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for _, places, numbers in self.lookup.find(words):
            for place, number in zip(places.tolist(), numbers.tolist(), strict=True):
                for template, at in self.postings[number]:
                    diagonals[template].add(place - at)
        found = []
        for template, starts in diagonals.items():
            name, number, own = self.templates[template]
            done = 0
            for start in sorted(starts):
                if done and start < done:
                    continue  # inside the last match
                begin = max(done, start - BAND)
                part = words[begin : start + len(own) + BAND + 1]
                pad = [b""] * (BAND - start + begin)
                matched, a, b = align(own, pad + part)
                if matched >= least * len(own):
                    shift = begin - len(pad)
                    found.append(Match(name, number, max(0, a + shift), min(len(words), b + shift), matched, matched / len(own)))
                    done = found[-1].end
        kept: list[Match] = []
        for m in sorted(found, key=lambda m: (-m.matched, -m.coverage, m.start, m.license, m.template)):
            if all(m.end <= x.start or m.start >= x.end for x in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.start)


_MATCH = pa.list_(
    pa.struct([("license", pa.string()), ("template", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("matched_words", pa.int32()), ("coverage", pa.float64())])
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    least_coverage: float = LEAST_COVERAGE,
) -> DataFrame:
    """(id column, n_matches, licenses: distinct names in order, matches) for each row.

    Each match has the licence, the template's number, the code points it spans, its matched words and their share of the
    template. Null and empty texts have none. Templates are an argument of bounded size and travel with the code.
    Repeated rows and ids each get a row, an empty table an empty result; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_matches", pa.int64()), ("licenses", pa.list_(pa.string())), ("matches", _MATCH)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = index.matches(words_of(text.encode()), least_coverage) if text and index.hashes else []
                places = [m.span() for m in _WORD.finditer(text)] if found else []
                matches = [
                    {"license": m.license, "template": m.template, "start_char": places[m.start][0], "end_char": places[m.end - 1][1],
                     "matched_words": m.matched, "coverage": m.coverage}
                    for m in found
                ]
                out.append((doc_id, len(found), sorted({m.license for m in found}), matches))
            yield to_batch(out, schema)

    kind = "array<struct<license:string,template:int,start_char:long,end_char:long,matched_words:int,coverage:double>>"
    out = rows.mapInArrow(scan, f"id long, n_matches long, licenses array<string>, matches {kind}")
    return out.select(F.col("id").alias(id_col), "n_matches", "licenses", "matches")
