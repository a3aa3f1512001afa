"""Licence scan: Dice coefficient over word bigrams against licence templates.

Text is lower-cased and cut into words of letters and digits; a unit's set is its distinct word bigrams, or its one word
where it has no more.  The units of a document are its lines, its whole text and its runs of two or more consecutive
lines, so a notice is found however it is wrapped and whatever stands around it.  A unit matches a template where
``2 |A and B| >= threshold (|A| + |B|)``, which needs sizes within ``threshold / (2 - threshold)`` of each other, and that
the document holds this share of the template's bigrams: only such templates are compared.  A line and the whole text
take the template of the highest coefficient, then the smaller name.

Of the runs that begin at a line, each template has the best, then the shortest.  These are taken by coefficient, then
number of lines, first line and name, unless they overlap a matching unit of about their size (within the same bounds),
be it a run taken before, a line or the whole text.  So a licence counts once, and a notice within a licence for itself.

The templates are given with the call and bounded: ``MOST_BIGRAMS`` bigrams in all, or an error is raised.

Defined results: a null or wordless text has no match; repeated rows are judged alike; an empty table gives an empty
result; templates without words are ignored.  Columns that are not in ``keep`` are ignored.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BIGRAMS = 1_000_000
WORD = re.compile(r"[^\W_]+")

# Short public licence notices and the texts of short licences, by SPDX name (or a name of the same form).
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

# Whole licence texts and headers, a file each.
WHOLE_TEXTS = {
    name: pkgutil.get_data("slidelake.llm", f"licence_texts/{name}.txt").decode()
    for name in (
        "Apache-2.0-notice Apache-2.0-text BSD-2-Clause-text BSD-3-Clause-text CC0-1.0-text GPL-2.0-full-header GPL-2.0-text GPL-3.0-full-header "
        "GPL-3.0-text ISC-text LGPL-2.1-text LGPL-3.0-text MIT-text MPL-2.0-text"
    ).split()
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(own: list[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(zip(own, own[1:])) if len(own) > 1 else frozenset([tuple(own)] if own else [])


class TemplateIndex:
    """Templates in order of size."""

    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.threshold = threshold
        sets = {name: bigrams(words(text)) for name, text in templates.items()}
        self.sets = sorted(((len(s), name, s) for name, s in sets.items() if s), key=lambda x: x[:2])
        if sum(n for n, _, _ in self.sets) > MOST_BIGRAMS:
            raise ValueError(f"templates have more than {MOST_BIGRAMS} bigrams")
        self.bound = threshold / (2 - threshold)
        self.known = frozenset().union(*(s for _, _, s in self.sets))
        self.single = any(len(x) == 1 for x in self.known)

    def near(self, every: list[str]) -> list[tuple[int, str, frozenset]]:
        """The templates of which a text with these words holds enough for any of its units to match."""
        own = self.known.intersection(zip(every, every[1:]))
        if self.single:
            own |= self.known.intersection(zip(every))
        return [x for x in self.sets if x[0] * self.bound <= len(own) and x[0] * self.bound <= len(own & x[2])]

    def match(self, own: list[str], near: list) -> tuple[str, float, int] | None:
        """(licence, coefficient, size of the unit)."""
        # Repeated bigrams only make a set smaller.
        if not own or max(1, len(own) - 1) < near[0][0] * self.bound:
            return None
        unit = bigrams(own)
        n = len(unit)
        best = None
        for size, name, s in near:
            if n * self.bound <= size <= n / self.bound:
                dice = 2 * len(unit & s) / (n + size)
                if dice >= self.threshold and (best is None or (-dice, name) < (-best[1], best[0])):
                    best = (name, dice, n)
        return best

    def runs(self, cut: list[list[str]], near: list) -> Iterator[tuple[float, int, int, str, int, int]]:
        """(-coefficient, lines, first line, licence, last line, size) of the best run at each line for each template."""
        every = [w for own in cut for w in own]
        pairs = list(zip(every, every[1:]))
        # (line, its first word, the word behind its last) of each line with words.
        places, at = [], 0
        for i, own in enumerate(cut):
            if own:
                places.append((i, at, at + len(own)))
                at += len(own)
        for size, name, s in near:
            hits = [k for k, x in enumerate(pairs) if x in s]
            least, most = size * self.bound, size / self.bound
            for p, (i, start, end) in enumerate(places[:-1]):
                first = bisect_left(hits, start)
                if len(hits) - first < least:
                    break
                # A first line without a bigram of the template only adds to the run's size.
                if hits[first] >= end:
                    continue
                unit, common, best, k = set(), 0, None, start
                for j, _, stop in places[p:]:
                    for x in pairs[k : stop - 1]:
                        if x not in unit:
                            unit.add(x)
                            common += x in s
                    k = max(k, stop - 1)
                    if len(unit) > most:
                        break
                    dice = 2 * common / (len(unit) + size)
                    if j > i and dice >= self.threshold and (best is None or dice > -best[0]):
                        best = (-dice, j - i + 1, i, name, j, len(unit))
                if best:
                    yield best

    def scan(self, text: str | None) -> list[tuple[int, str, float]]:
        """(line, licence, coefficient) of each line that matches, and of each run by its first line; line -1 is the whole text."""
        lines = (text or "").split("\n")
        cut = [words(line) for line in lines]
        every = [w for own in cut for w in own]
        near = self.near(every)
        if not near:
            return []
        out, whole, taken = [], [], []
        for i, own in enumerate(cut):
            if hit := self.match(own, near):
                out.append((i, *hit[:2]))
                taken.append((i, i, hit[2]))
        if len(lines) > 1 and (hit := self.match(every, near)):
            whole.append((-1, *hit[:2]))
            taken.append((0, len(lines) - 1, hit[2]))
        for dice, _, i, name, j, n in sorted(self.runs(cut, near)):
            if not any(a <= j and i <= b and n * self.bound <= m <= n / self.bound for a, b, m in taken):
                out.append((i, name, -dice))
                taken.append((i, j, n))
        return out + whole


def _scanner(index: TemplateIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            found = [[{"line": a, "licence": b, "dice": c} for a, b, c in index.scan(t.as_py())] for t in batch.column(i)]
            kind = pa.list_(pa.struct([("line", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())]))
            cols = [c for k, c in enumerate(batch.columns) if k != i]
            names = [n for k, n in enumerate(batch.schema.names) if k != i]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], [*names, "matches"])

    return run


def scan_licences(
    documents: DataFrame, templates: dict[str, str] = TEMPLATES | WHOLE_TEXTS, threshold: float = 0.9, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns of each row with ``matches``: the line (of a run its first; -1: the whole text), licence and coefficient of each."""
    index = TemplateIndex(templates, threshold)
    rows = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    schema = T.StructType([f for f in rows.schema if f.name != "text"])
    match = T.StructType().add("line", "long").add("licence", "string").add("dice", "double")
    schema = schema.add("matches", T.ArrayType(match))
    return rows.mapInArrow(_scanner(index), schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "matches")
