"""License scans (op 4): winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans.

Texts and templates are word sequences. Every run of ``GRAM`` words is hashed and the least hash of each ``WINDOW``
neighbouring runs is a fingerprint, so any common stretch of GRAM + WINDOW - 1 words shares one. An inverted index of
the templates' fingerprints gives candidate diagonals; each group of near diagonals is aligned
with its template in a band, and the path gives the matched words and the span in the text. The words before and behind a
match are searched for further copies.

Defined results: null and empty texts have no match; repeated rows give repeated matches; an empty table gives an
empty table; texts are scanned whole; of matches of several templates on one span the one with more matched words
stays, ties by template name; other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm import vec
from lodestrata.llm.common import text_map

GRAM, WINDOW, BAND = 3, 3, 12
#: Share of a template's words that a match covers at least.
COVERAGE = 0.8
#: Characters of all templates at most.
TEMPLATE_CHARS = 20_000_000

# Public license notices and texts, by name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-notice": "This library is licensed under the GNU Lesser General Public License.",
    "AGPL-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}


def winnow(h: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose hash is the least of some ``window`` neighbours of one text; all places of shorter texts."""
    n = len(h)
    chosen = np.zeros(n, bool)
    if not n:
        return np.flatnonzero(chosen)
    sizes = np.bincount(doc)
    chosen |= sizes[doc] < window
    if n >= window:
        views = np.lib.stride_tricks.sliding_window_view(h, window)
        whole = doc[window - 1 :] == doc[: n - window + 1]
        chosen[(np.arange(len(views)) + views.argmin(axis=1))[whole]] = True
    return np.flatnonzero(chosen)


class Index:
    """Templates as word hashes, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        w = vec.Words(list(templates.values()))
        self.words = [w.h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        h, doc = vec.grams(w, GRAM)
        head = np.searchsorted(doc, np.arange(len(self.names)))
        at = winnow(h, doc)
        order = np.argsort(h[at], kind="stable")
        self.prints, self.template = h[at][order], doc[at][order]
        self.place = (at - head[doc[at]])[order]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in h, place in the index) of equal fingerprints."""
        lo, hi = np.searchsorted(self.prints, h), np.searchsorted(self.prints, h, "right")
        hit = np.flatnonzero(hi > lo)
        count = hi[hit] - lo[hit]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(hit, count), np.repeat(lo[hit], count) + inner


@lru_cache(4)
def index_of(items: tuple) -> Index:
    return Index(dict(items))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Best alignment of the whole template with a stretch of ``text`` near the diagonal text place - place = shift.

    Returns (matched words, first and past-the-last word of the stretch). Match 2, mismatch -1, gap -1; template
    words before the stretch and behind it are gaps.
    """
    width = 2 * band + 1
    offset = np.arange(width)
    rows = np.empty((len(template) + 1, width), np.int32)
    rows[0] = 0
    far = -(10**6)
    hits = np.zeros((len(template) + 1, width), bool)
    for i, word in enumerate(template.tolist(), 1):
        at = i - 1 + shift - band + offset  # text word of each cell
        inside = (at >= 0) & (at < len(text))
        equal = inside & (text[np.clip(at, 0, max(len(text) - 1, 0))] == word) if len(text) else inside
        hits[i] = equal
        diagonal = rows[i - 1] + np.where(equal, 2, -1) + np.where(inside, 0, far)
        skip = np.append(rows[i - 1][1:], far) - 1  # a template word without a text word
        best = np.maximum(diagonal, skip)
        rows[i] = np.maximum.accumulate(best + offset) - offset  # text words without a template word
    d, i = int(rows[-1].argmax()), len(template)
    matched, first, last = 0, -1, -1
    while i > 0:
        value, at = rows[i, d], i - 1 + shift - band + d
        if 0 <= at < len(text) and value == rows[i - 1, d] + (2 if hits[i, d] else -1):
            if hits[i, d]:
                matched, first, last = matched + 1, at, max(last, at + 1)
            i -= 1
        elif d + 1 < width and value == rows[i - 1, d + 1] - 1:
            i, d = i - 1, d + 1
        elif d > 0 and value == rows[i, d - 1] - 1:
            d -= 1
        else:
            break
    return matched, first, last


def copies(template: np.ndarray, text: np.ndarray, place: np.ndarray, shift: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first and past-the-last word) of every copy, from fingerprints by place in the text."""
    out, failed = [], []
    parts = [(0, len(place), 0, len(text))]  # hits from, to; words from, to
    while parts:
        i, j, lo, hi = parts.pop()
        while i < j:
            s = int(shift[i])
            k = bisect_right(failed, s)
            if (k and s - failed[k - 1] <= BAND) or (k < len(failed) and failed[k] - s <= BAND // 2):
                i += 1  # its band has been searched
                continue
            near = shift[i : min(j, int(np.searchsorted(place, place[i] + len(template) + BAND)))]
            s = int(near[near >= s - BAND].min())
            n, a, b = align(template, text[lo:hi], s - lo + BAND // 2)
            if n >= coverage * len(template):
                a, b = a + lo, b + lo
                out.append((n, a, b))
                parts.append((max(i, int(np.searchsorted(place, b))), j, b, hi))
                parts.append((i, min(j, int(np.searchsorted(place, a - GRAM, "right"))), lo, a))
                break
            insort(failed, s)
            i += 1
    return out


def matches(index: Index, texts: list[str], coverage: float = COVERAGE) -> list[tuple[int, str, float, int, int, int]]:
    """(text, template, coverage, matched words, start, end in code points) of every match."""
    w = vec.Words(texts)
    h, doc = vec.grams(w, GRAM)
    at = winnow(h, doc)
    place, entry = index.lookup(h[at])
    if not len(place):
        return []
    gram = at[place]
    own = doc[gram]
    head = np.searchsorted(doc, np.arange(len(texts)))
    template = index.template[entry]
    shift = gram - head[own] - index.place[entry]
    order = np.lexsort((gram, template, own))
    own, template, gram, shift = own[order], template[order], gram[order], shift[order]
    place = gram - head[own]
    edges = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (template[1:] != template[:-1])))
    found: list = []
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
        d, t = int(own[lo]), int(template[lo])
        text = w.h[w.first[d] : w.first[d + 1]]
        for n, a, b in copies(index.words[t], text, place[lo:hi], shift[lo:hi], coverage):
            start, end = int(w.s[w.first[d] + a] - w.starts[d]), int(w.e[w.first[d] + b - 1] - w.starts[d])
            found.append((d, index.names[t], round(n / len(index.words[t]), 4), n, start, end))
    found.sort(key=lambda x: (x[0], -x[3], x[1], x[4]))
    kept: dict[int, list] = {}
    for m in found:
        if all(min(m[5], k[5]) - max(m[4], k[4]) <= 0.5 * (m[5] - m[4]) for k in kept.get(m[0], [])):
            kept.setdefault(m[0], []).append(m)
    return sorted((m for ms in kept.values() for m in ms), key=lambda m: (m[0], m[4], m[1]))


def template_table(templates: DataFrame, name: str = "name", text: str = "text", most: int = TEMPLATE_CHARS) -> dict[str, str]:
    """Templates of a table, as ``scan`` takes them; null names and texts are left out, and of equal names the least text
    counts. Their size is checked before they are read, as every task gets them all."""
    rows = templates.where(F.col(name).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"{size} characters of templates; at most {most} go to every task")
    return {r["name"]: r["text"] for r in rows.orderBy("name").collect()}


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | DataFrame | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, coverage, matched_words, start, end. ``templates``: by name, or a table of name
    and text."""
    schema = f"doc_id {dict(df.dtypes)[doc_id]}, license string, coverage double, matched_words int, start bigint, end bigint"
    if isinstance(templates, DataFrame):
        templates = template_table(templates)
    items = tuple((TEMPLATES if templates is None else templates).items())

    def make():
        index = index_of(items)

        def kernel(texts, kept):
            rows = matches(index, texts, coverage)
            ids = kept[doc_id]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            return {"doc_id": [ids[d] for d in cols[0]], "license": cols[1], "coverage": cols[2], "matched_words": cols[3], "start": cols[4], "end": cols[5]}

        return kernel

    return text_map(df, schema, make, text, (doc_id,))
