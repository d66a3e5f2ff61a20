"""License scans by conditional compression.

A cue of licensing opens a block that reaches over the words before and after
it, by the longest template's length on both sides and over any line ends;
blocks that meet are one.  A block's words are compressed once plainly and once with each license
template as a raw zstandard dictionary; the share of bytes saved orders the
templates.  Every one is confirmed by its exact wording: the template's words
are aligned with every stretch of the block by their longest common
subsequence, and the words missing from and added to the template are reported.

``scan`` gives one row per confirmed stretch: start and end in code points, the
license, the saving on the stretch, and the differences.  Of overlapping
stretches the one with the most matching words less foreign ones wins, then the
shorter, then the template that saves more of the block, then the one listed
first; all that do not overlap a better one are reported.  A stretch that lacks a
number of the template is of another version and does not confirm it.  Null and empty texts
and texts without a cue give none; repeated rows are scanned each; an empty
table gives an empty table.  Only the named id and text columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Wordings of public licenses and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "reserved": "All rights reserved.",
}
CUE = re.compile(r"licen[cs]e|copyright|rights\W+reserved|warrant|redistribut|permission\W+is|public\W+domain|creative\W+commons|\bcc\W+by\b|spdx", re.I)
#: The share of template words that must match, and of the aligned stretch that may be foreign.
MATCHED, FOREIGN = 0.85, 0.2

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@lru_cache(maxsize=1)
def _compressors():
    import zstandard as z

    plain = z.ZstdCompressor(level=9)
    with_ = {}
    for name, text in TEMPLATES.items():
        d = z.ZstdCompressionDict(" ".join(words(text)).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=9)
        with_[name] = z.ZstdCompressor(dict_data=d)
    return plain, with_, {name: words(text) for name, text in TEMPLATES.items()}


def savings(block: str) -> list[tuple[float, str]]:
    """(share of bytes saved, template), best first."""
    plain, with_, _ = _compressors()
    raw = " ".join(words(block)).encode()
    base = len(plain.compress(raw))
    return sorted(((1 - len(c.compress(raw)) / base, name) for name, c in with_.items()), key=lambda x: -x[0])


def wording(template: list[str], block: list[str]) -> tuple[int, list[str], list[str]]:
    """Matching words, words missing from the block, and foreign words within the aligned stretch."""
    n, m = len(template), len(block)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if template[i] == block[j] else max(best[i + 1][j], best[i][j + 1])
    covered, inside, i, j = set(), set(), 0, 0
    while i < n and j < m:
        if template[i] == block[j]:
            covered.add(i)
            inside.add(j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    if not covered:
        return 0, template, []
    return len(covered), [w for i, w in enumerate(template) if i not in covered], [block[i] for i in range(min(inside), max(inside) + 1) if i not in inside]


def stretches(template: list[str], block: list[str]) -> list[tuple[int, int, int]]:
    """(matching words, start, end) of each stretch of the block's words that confirms the template."""
    wanted, m = Counter(template), len(template)
    need, reach = math.ceil(MATCHED * m), longest(m)
    if (wanted & Counter(block)).total() < need:
        return []
    at, full = {}, (1 << m) - 1
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    out, held, common = [], Counter(), 0
    for k in range(len(block) + reach):  # words of the template among block[start : start + reach], which bounds what can match
        if k < len(block) and block[k] in at:
            held[block[k]] += 1
            common += held[block[k]] <= wanted[block[k]]
        start = k - reach + 1
        if start < 0:
            continue
        if common >= need and block[start] in at:
            free = full  # bit-parallel longest common subsequence: a zero bit for each match
            for stop in range(start, min(start + reach, len(block))):
                hit = at.get(block[stop], 0)
                if hit:
                    both = free & hit
                    free = (free + both | free - both) & full
                    n = m - free.bit_count()
                    if n >= need and stop + 1 - start - n <= FOREIGN * (stop + 1 - start):
                        out.append((n, start, stop + 1))
        if start < len(block) and block[start] in at:
            common -= held[block[start]] <= wanted[block[start]]
            held[block[start]] -= 1
    return out


def longest(n: int) -> int:
    """Words that a stretch of n matching words can have, or one more."""
    return int(n / (1 - FOREIGN)) + 1


def blocks(text: str, spans: list[tuple[int, int]]):
    """(first, last + 1) of the runs of words within reach of a cue; ``spans`` are those of the text's words."""
    reach = max(longest(len(t)) for t in _compressors()[2].values())
    starts = [a for a, _ in spans]
    first = last = None
    for cue in CUE.finditer(text):
        # The cue may begin within a word, and its pattern may hold several.
        low, high = max(bisect_right(starts, cue.start()) - 1 - reach, 0), min(bisect_left(starts, cue.end()) + reach, len(spans))
        if first is not None and low > last:
            yield first, last
            first = None
        first, last = low if first is None else first, high
    if first is not None:
        yield first, last


def licenses(text: str | None) -> list[tuple[int, int, str, float, int, str]]:
    """(start, end, license, saving, matching words, differences) of each confirmed stretch."""
    out = []
    if not text or not CUE.search(text):
        return out
    templates = _compressors()[2]
    every = [m.span() for m in _WORD.finditer(text)]
    for first, last in blocks(text, every):
        spans = every[first:last]
        block = [text[a:b].lower() for a, b in spans]
        found = []
        for rank, (_, name) in enumerate(savings(text[spans[0][0] : spans[-1][1]])):
            found += [(b - a - 2 * n, b - a, rank, a, b, name) for n, a, b in stretches(templates[name], block)]
        used, rows = bytearray(len(block)), []
        for _, size, _, a, b, name in sorted(found):
            if not any(used[a:b]):
                n, missing, foreign = wording(templates[name], block[a:b])
                if any(c.isdigit() for w in missing for c in w):  # another version is another license
                    continue
                used[a:b] = b"\1" * size
                at, to = spans[a][0], spans[b - 1][1]
                saved = next(x for x, k in savings(text[at:to]) if k == name)
                rows.append((at, to, name, saved, n, " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in foreign])))
        out += sorted(rows)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, license, saving, n_words, differences), one row per confirmed stretch."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string())
    names = ["doc_id", "start", "end", "license", "saving", "n_words", "differences"]

    def run(batches):
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in licenses(t.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, "doc_id bigint, start bigint, end bigint, license string, saving double, n_words bigint, differences string")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
SQL: dict[str, str] = {}
