"""License scans by patience alignment.

A template's coverage is the share of its words that align, in order, with words of the text: anchors are
the words unique to both sides, their longest increasing subsequence is kept, and the gaps between are
aligned alike. Words are runs of ASCII letters and digits, lower-cased. A template is aligned with every stretch of the
text of its length / DENSITY words (3.3 times its length; 1.7 times for a short line) that has enough of its words for the coverage asked for, an exact upper bound;
words scattered over more of the text are prose, not a license. The whole text is searched. One row per document and template found; texts that are null, empty or clean give none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import map_texts, table

#: Notices of public licenses.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
COVERAGE = 0.8
#: Template words to a word of the stretch of text that is aligned with it; of templates under SHORT words, whose few words prose may hold, too.
DENSITY, SHORT, SHORT_DENSITY = 0.3, 20, 0.6
_WORD = re.compile(r"[a-z0-9]+")


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned places of a and b."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in place]
        tails: list[int] = []
        ends: list[int] = []
        back: dict[int, int] = {}
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tails, j)
            tails[at : at + 1] = [j]
            ends[at : at + 1] = [k]
            back[k] = ends[at - 1] if at else -1
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        out += chain
        if chain:
            for (i, j), (x, y) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
                if i + 1 < x and j + 1 < y:
                    todo.append((i + 1, x, j + 1, y))
    return sorted(out)


def scan(words: list[str], template: list[str], least: float, density: float | None = None) -> tuple[float, int, int] | None:
    """Best coverage with the first and last word aligned; the first of equal ones.

    All stretches of ceil(length / density) words of the text are aligned that begin with a word of the template, a quarter of a
    stretch apart at least: within one, no fewer than least * density of the words are the template's.
    """
    need, size = least * len(template), Counter(template)
    density = density or (DENSITY if len(template) >= SHORT else SHORT_DENSITY)
    spots = [k for k, w in enumerate(words) if w in size]
    span, best, at = math.ceil(len(template) / density), None, 0
    while at < len(spots):
        some = spots[at : bisect_left(spots, spots[at] + span)]
        found = Counter(words[k] for k in some)
        most = sum(min(n, size[w]) for w, n in found.items())
        if most >= need and (best is None or most > best[0]):  # an upper bound of what aligns
            got = align(template, [words[k] for k in some])
            if len(got) >= need and (best is None or len(got) > best[0]):
                best = (len(got), some[got[0][1]], some[got[-1][1]])
                if best[0] == len(template):
                    break
        at = max(at + 1, bisect_left(spots, spots[at] + span // 4))
    return best and (best[0] / len(template), *best[1:])


def scan_licenses(df: DataFrame, keep: list[str], templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """keep plus license, coverage, first_word, last_word: a row per template found."""
    known = {k: _WORD.findall(t.lower()) for k, t in (templates or TEMPLATES).items()}
    sets = {k: set(t) for k, t in known.items()}

    def make(texts):
        out = []
        for t in texts:
            words = _WORD.findall((t or "").lower())
            have, rows = set(words), []
            for k, template in known.items():
                missing = sum(w not in have for w in template) if len(sets[k] & have) >= 1 else len(template)
                if template and len(template) - missing >= least * len(template) and (got := scan(words, template, least)):
                    rows.append({"license": k, "coverage": round(got[0], 6), "first_word": got[1], "last_word": got[2]})
            out.append(rows)
        return {"found": pa.array(out, pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])))}

    rows = map_texts(df, keep, "text", make, "found array<struct<license:string,coverage:double,first_word:bigint,last_word:bigint>>")
    return rows.select(*keep, F.explode("found").alias("f")).select(*keep, "f.*")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
