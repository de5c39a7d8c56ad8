"""License scan by patience alignment of texts with license templates.

Words that occur once in the text passage and once in the template are anchors; the longest
increasing subsequence of anchors is kept; the gaps between them are aligned the same way, and
equal runs at the ends of a gap are matched. Coverage is the matched share of the template.

A notice is a stretch of text with at least ``min_coverage`` of a template's words aligned and no
more than ``dilution`` words to each of them. Any such stretch holds that many template words within
``dilution`` times the template's length, so the text is looked at wherever it does, whatever stands
between (``regions``); nothing is cut. There, every shortest stretch that holds enough template words in
order is aligned (the longest common subsequence bounds an alignment, so no other stretch can do), and
of stretches that overlap one stays, so that there are as many as can be and repeated notices are
found one by one. (Patience is no longest common subsequence: that a longer stretch aligns where no
shortest one does befell 5 of 1,020 random texts over four words; no real notice is known to.) A native
filter passes only texts that hold a key word: for each template, key
words make up more than 1 - min_coverage of it, so no passage of enough coverage is lost.

Defined results: null and empty texts match nothing; words are runs of letters, digits, ``.`` and
``-`` inside, lower-cased; a passage that fits several templates has a row for each; very long
texts are read whole; repeated rows each get rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Public license notices. Fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MIN_COVERAGE = 0.8
#: Words of a notice to each aligned one, at most; None for any number.
DILUTION: float | None = 3.0


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by the first, whose second numbers increase."""
    tops, at, back = [], [], []
    for i, (_, y) in enumerate(pairs):
        j = bisect_left(tops, y)
        tops[j : j + 1], at[j : j + 1] = [y], [i]
        back.append(at[j - 1] if j else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], both increasing."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1}
        anchors = _increasing(sorted((place[w], j) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in place))
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            work += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
    return sorted(out)


def regions(text: list[str], template: list[str], need: int, longest: int | None):
    """(first, end) of the parts of a text that hold at least ``need`` of the template's words in
    some ``longest`` words; parts that overlap are one. Without ``longest``, from the first of the
    template's words to the last."""
    own = set(template)
    at = [i for i, w in enumerate(text) if w in own]
    if longest is None:
        if len(at) >= need:
            yield at[0], at[-1] + 1
        return
    begin = end = -1
    for a, b in zip(at, at[need - 1 :]):
        if b - a >= longest:
            continue
        # a stretch that holds these may reach as far as ``longest`` allows
        low, high = max(b - longest + 1, 0), min(a + longest, len(text))
        if begin >= 0 and low > end:
            yield begin, end
            begin = -1
        begin, end = (low if begin < 0 else begin), high
    if begin >= 0:
        yield begin, end


def windows(text: list[str], template: list[str], need: int) -> list[tuple[int, int, int]]:
    """(end, first, k) by end: the shortest stretches that hold k >= need template words in order.

    latest[j][q] is the latest first word of such a stretch up to here that spends the first j
    template words, q of them left out; a match moves along the diagonal of further left out ones.
    """
    n = len(template)
    most = n - need
    places: dict[str, list[int]] = {}
    for j in range(n - 1, -1, -1):
        places.setdefault(template[j], []).append(j)
    latest = [[-1] * (most + 1) for _ in range(n + 1)]
    out = []
    for i, w in enumerate(text):
        for j in places.get(w, ()):
            row = latest[j]
            for q in range(min(j, most) + 1):
                first = i if q == j else row[q]
                t, left = j + 1, q
                while left <= most and t <= n and latest[t][left] < first:
                    latest[t][left] = first
                    if t == n:
                        out.append((i + 1, first, n - left))
                    t, left = t + 1, left + 1
    return out


def notices(text: list[str], template: list[str], need: int, dilution: float | None) -> list[list[tuple[int, int]]]:
    """Alignments, of at least ``need`` words each, with stretches of a run that do not overlap.

    As many stretches as there are (earliest end first); then each is replaced by the stretch of
    most aligned words, the shortest of these, between its neighbours.
    """
    found = sorted((x for x in windows(text, template, need) if dilution is None or x[0] - x[1] <= dilution * x[2]), key=lambda x: (x[0], -x[1]))
    known: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def aligned(first, end):
        if (first, end) not in known:
            known[first, end] = [(first + i, j) for i, j in patience(text[first:end], template)]
        return known[first, end]

    chosen, free = [], 0
    for end, first, _ in found:
        if first >= free and len(aligned(first, end)) >= need:
            chosen.append(first)
            free = end
    out, free, ends = [], 0, [x[0] for x in found]
    for limit in [*chosen[1:], len(text)][: len(chosen)]:
        best: list[tuple[int, int]] = []
        near = [x for x in found[bisect_left(ends, free) : bisect_right(ends, limit)] if x[1] >= free]
        for end, first, k in sorted(near, key=lambda x: (-x[2], x[0] - x[1], x[1])):
            if k <= len(best):
                break
            best = max(best, aligned(first, end), key=len)
        out.append(best)
        free = best[-1][0] + 1
    return out


def scan(text: str, templates: dict[str, list[str]], min_coverage: float = MIN_COVERAGE, dilution: float | None = DILUTION):
    """(template, coverage, first word, end word) of each passage of enough coverage."""
    words = words_of(text)
    held = Counter(words)
    for name, template in templates.items():
        need = max(ceil(min_coverage * len(template)), 1)
        count = Counter(template)
        if sum(min(held[w], n) for w, n in count.items()) < need:
            continue
        for a, b in regions(words, template, need, None if dilution is None else int(dilution * len(template))):
            run = words[a:b]
            if (count & Counter(run)).total() < need:
                continue
            for matched in notices(run, template, need, dilution):
                yield name, len(matched) / len(template), a + matched[0][0], a + matched[-1][0] + 1


def key_words(template: list[str], min_coverage: float) -> set[str]:
    """Long words first, until they make up more than 1 - min_coverage of the template."""
    keys, share = set(), 0
    for w, n in sorted(Counter(template).items(), key=lambda x: (-len(x[0]), x[0])):
        if share > (1 - min_coverage) * len(template):
            break
        keys.add(w)
        share += n
    return keys


def _run(templates, min_coverage, dilution):
    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for row in scan(text, templates, min_coverage, dilution):
                    ids.append(i)
                    rows.append(row)
            cols = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "license", "coverage", "first_word", "end_word"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, dilution: float | None = DILUTION) -> DataFrame:
    """One row per passage: id_col, license, coverage, first_word, end_word (word numbers).

    A passage has at most ``dilution`` words to each aligned one; with None, foreign words may stand between
    the template's in any number, at the cost of aligning from the first template word of a text to the last."""
    C.ship(docs.sparkSession)
    split = {n: words_of(t) for n, t in templates.items()}
    keys = sorted(set().union(*[key_words(t, min_coverage) for t in split.values()]))
    hint = r"(?iU)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(k) for k in keys) + r")(?![\p{L}\p{N}])"
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike(hint))
    out = rows.mapInArrow(_run(split, min_coverage, dilution), f"id {dict(rows.dtypes)['id']}, license string, coverage double, first_word long, end_word long")
    return out.withColumnRenamed("id", id_col)
