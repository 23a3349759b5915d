"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines that may speak of a licence (headers anywhere, the whole of a licence file) become TF-IDF vectors of word
unigrams and bigrams and are compared with every template by cosine. So is every window of as many words as the template
has around each licence word, across line ends, so that neither wrapping nor text around a notice hides it. The licence
words come from the templates: of each one so many (the weightiest) that no text without any of them can reach the cosine
that the template needs; only templates with such a word in a text are compared with it. SPDX
identifiers are names, not wording: they are read as such and count as a cosine of 1. A licence file gives its licence to the files of
its directory and of all directories below it that have none of their own and no nearer licence file; ancestors are
reached by joins on paths, longest first.

Defined cases: a null or empty text has no licence of its own but may inherit one; a null path inherits nothing; a file
with headers of several licences has the one of greatest cosine, ties go to the first name in alphabetical order; a
template of under SHORT words ('All rights reserved.') must be met nearly word for word and gives way to any other
notice in the file, as such words stand beside many licences; an SPDX expression counts each licence it names; of
several licence files in a directory the first path decides; repeated rows are judged alike; a text longer than a slice
is a slice of its own; an empty table, or no templates, gives no licences; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, in_worker, materialize, slices, strings

#: Notices as the licences themselves word them.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0."),
    "Artistic-2.0": ("you can redistribute it and/or modify it under the terms of the Artistic License (2.0)",),
    "BSD-2-Clause": ("Released under the 2-Clause BSD License.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the 3-Clause BSD License."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-3.0": ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-NC-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "CC-BY-SA-3.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",),
    "CDDL-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License.",),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL",),
    "GFDL-1.3": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Released under the MIT License."),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ODbL-1.0": ("This database is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License",),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications",),
    "proprietary": ("All rights reserved. No part of this work may be reproduced or distributed without written permission.", "All rights reserved."),
}
LEAST = 0.55
#: Templates of fewer words are short, and the cosine that they need: 'Some rights reserved.' has 0.6 with 'All rights reserved.'
SHORT, LEAST_SHORT = 4, 0.9
_WORD = re.compile(r"[a-z0-9]+")
_FILE = re.compile(r"(^|/)(licen[sc]e|copying|notice|copyright)([._-][^/]*)?$", re.I)
_ID = r"[a-z0-9][a-z0-9.+-]*"
_SPDX = re.compile(rf"spdx-license-identifier[ \t]*:[ \t]*([( \t]*{_ID}(?:[) \t]*[ \t)](?:and|or|with)[( \t][( \t]*{_ID})*)", re.I)
#: A rank without a licence; others are (whether the template is short, -cosine, name), the least is the best.
NONE = (2, 0.0, "")


def _words(text: str) -> list[str]:
    return [x for x in _WORD.findall(text.lower()) if x != "the"]


def _terms(w: list[str]) -> Counter:
    return Counter([*w, *zip(w, w[1:])])


class Templates:
    """The templates' TF-IDF vectors, and which of their words a text must hold one of."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST):
        every = [(name, _words(x)) for name, texts in sorted(templates.items()) for x in texts]
        df = Counter(t for _, w in every for t in _terms(w))
        self.rare = log(1 + len(every)) + 0.1
        self.idf = {t: log((1 + len(every)) / (1 + n)) + 0.1 for t, n in df.items()}
        self.names = [name for name, _ in every]
        self.by_id = {name.lower(): name for name in self.names}
        self.sizes = [len(w) for _, w in every]
        self.short = [n < SHORT for n in self.sizes]
        self.needs = [max(least, LEAST_SHORT) if x else least for x in self.short]
        self.vectors: list[dict[object, float]] = []
        self.keys: list[frozenset] = []
        self.by_word: dict[str, list[int]] = {}
        for k, (_, w) in enumerate(every):
            terms = _terms(w)
            norm = sqrt(sum((n * self.idf[t]) ** 2 for t, n in terms.items()))
            self.vectors.append({t: n * self.idf[t] / norm for t, n in terms.items()})
            self.keys.append(frozenset(self.vectors[k]))
            for x in self._needed(k):
                self.by_word.setdefault(x, []).append(k)

        whole = "|".join(sorted(map(re.escape, self.by_word)))
        self.may = re.compile("spdx-license-identifier" + (rf"|(?<![a-z0-9])(?:{whole})(?![a-z0-9])" if whole else ""))

    def _needed(self, k: int) -> list[str]:
        """Words of template k without all of which a text's cosine stays below what the template needs."""
        out, left = [], dict(self.vectors[k])
        weight = lambda w: sum(v * v for t, v in left.items() if t == w or (not isinstance(t, str) and w in t))
        for w in sorted({t for t in left if isinstance(t, str)}, key=lambda w: (-min(len(w), 5), -weight(w), w)):
            if sqrt(sum(v * v for v in left.values())) + 1e-6 < self.needs[k]:
                break
            out.append(w)
            left = {t: v for t, v in left.items() if t != w and (isinstance(t, str) or w not in t)}
        return out

    def _able(self, terms: set) -> list[int]:
        """The templates that terms can reach: they hold a word that it needs, and no text of them has a greater cosine than the root of what they make up of it."""
        some = {k for w in self.by_word.keys() & terms for k in self.by_word[w]}
        return [k for k in some if sqrt(sum([self.vectors[k][t] ** 2 for t in terms & self.keys[k]])) + 1e-6 >= self.needs[k]]

    def _rank(self, k: int, cosine: float) -> tuple[int, float, str]:
        cosine = round(cosine, 9)  # equal wording ties, whatever the order of the sums
        return (int(self.short[k]), -cosine, self.names[k]) if cosine >= self.needs[k] else NONE

    def best(self, text: str) -> tuple[int, float, str]:
        """The rank of a whole text; words that no template has lengthen the text's vector."""
        terms = _terms(_words(text))
        here = set(terms)
        able = self._able(here)
        if not able:
            return NONE
        norm = sqrt(sum([(n * self.idf.get(t, self.rare)) ** 2 for t, n in terms.items()]))
        return min(self._rank(k, sum([terms[t] * self.idf[t] * self.vectors[k][t] for t in here & self.keys[k]]) / norm) for k in able)

    def _slide(self, k: int, w: list[str]) -> float:
        """The greatest cosine of template k with a run of as many words of w as it has (with w if that has fewer)."""
        size, vector, count = self.sizes[k], self.vectors[k], Counter()
        dot = norm = top = 0.0
        for i, x in enumerate(w):
            for t in (x, (w[i - 1], x)) if i else (x,):
                f = self.idf.get(t, self.rare)
                dot += f * vector.get(t, 0.0)
                norm += (2 * count[t] + 1) * f * f
                count[t] += 1
            if i >= size:
                for t in (w[i - size], (w[i - size], w[i - size + 1])):
                    f = self.idf.get(t, self.rare)
                    dot -= f * vector.get(t, 0.0)
                    norm -= (2 * count[t] - 1) * f * f
                    count[t] -= 1
            if i >= size - 1 or i == len(w) - 1:
                top = max(top, dot / sqrt(norm))
        return top

    def around(self, text: str) -> tuple[int, float, str]:
        """The best rank of the windows of words around the licence words of a text, and of its SPDX identifiers."""
        text, found = text.lower(), NONE
        at = [(m.start(), m[0]) for m in _WORD.finditer(text) if m[0] != "the"]
        starts, w = [x for x, _ in at], [x for _, x in at]
        reach, regions = max(self.sizes, default=0), []
        for m in self.may.finditer(text):
            k = max(bisect_right(starts, m.start()) - 1, 0)
            if regions and k - reach <= regions[-1][1]:
                regions[-1][1] = k + reach
            else:
                regions.append([max(k - reach, 0), k + reach])
        for lo, hi in regions:
            part = w[lo:hi]
            for k in self._able({*part, *zip(part, part[1:])}):
                found = min(found, self._rank(k, self._slide(k, part)))
        for m in _SPDX.finditer(text):
            for x in re.findall(_ID, m[1]):
                name = self.by_id.get(re.sub(r"(-only|-or-later|\+)$", "", x.rstrip(".")))
                if name:
                    found = min(found, (0, -1.0, name))
        return found


def _sentences(text: str, may: re.Pattern) -> Iterator[str]:
    """Lines with a licence word, each alone and with the one that follows."""
    at, low = 0, text.lower()
    if len(low) != len(text):  # a letter that has two in lower case: places differ, so the lowered text is cut
        text = low
    while m := may.search(low, at):
        begin = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield text[begin:end]
        longer = text.find("\n", end + 1)
        yield text[begin : len(text) if longer < 0 else longer]
        at = end


def scan_licenses(files: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, path, own_license, own_cosine, is_license_file of each row of files (doc_id, path, text)."""
    given = {k: tuple(v) for k, v in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = Templates(given, least), {}
        for batch in slices(batches):
            names, cosines, is_file = [], [], []
            for path, text in zip(batch.column("path").to_pylist(), strings(batch.column("text"))):
                found = NONE
                whole = bool(path and _FILE.search(path))
                parts = list(_sentences(text, known.may))
                if parts:
                    found = known.around(text)
                for part in [text, *parts] if whole else parts:
                    if (got := memo.get(part)) is None:
                        got = known.best(part)
                        if len(memo) < 50_000 and len(part) < 500:
                            memo[part] = got
                    found = min(found, got)
                names.append(found[2] or None)
                cosines.append(-found[1] or 0.0)
                is_file.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("path"), pa.array(names, pa.string()), pa.array(cosines, pa.float64()), pa.array(is_file, pa.bool_())], ["doc_id", "path", "own_license", "own_cosine", "is_license_file"])

    return files.select("doc_id", "path", "text").mapInArrow(in_worker(run), "doc_id long, path string, own_license string, own_cosine double, is_license_file boolean")


def inherit_licenses(scanned: DataFrame) -> DataFrame:
    """Adds license, license_from and inherited: a file's own licence, or that of the licence file in the nearest ancestor directory.

    scanned is written once: it is read for the files that give, for the folders that want, and for the result.
    """
    scanned = materialize(scanned, "scanned-files")
    folder = F.regexp_replace(F.coalesce(F.col("path"), F.lit("")), r"[^/]*$", "")
    givers = (
        scanned.where("is_license_file and own_license is not null")
        .groupBy(folder.alias("_folder"))
        .agg(F.min(F.struct("path", "own_license")).alias("_g"))
        .select("_folder", F.col("_g.path").alias("_from"), F.col("_g.own_license").alias("_given"))
    )
    # a folder's ancestors are few (its depth); folders are far fewer than files, so the search goes over distinct folders
    wanted = scanned.where("own_license is null and path is not null").select(folder.alias("_of")).distinct()
    parts = F.split("_of", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    nearest = (
        wanted.select("_of", F.explode(F.array_distinct(ancestors)).alias("_folder"))
        .join(givers, "_folder")
        .groupBy("_of")
        .agg(F.max(F.struct(F.length("_folder").alias("n"), "_from", "_given")).alias("_best"))
        .select("_of", "_best._from", "_best._given")
    )
    # folders that get a licence are far fewer than files: a folder with a third of all files is no hot key in a broadcast
    nearest = broadcast_if_small(materialize(nearest, "nearest-licences"))
    return (
        scanned.withColumn("_of", F.when(F.col("own_license").isNull() & F.col("path").isNotNull(), folder))
        .join(nearest, "_of", "left")
        .select("doc_id", "path", "own_license", "own_cosine", "is_license_file", F.coalesce("own_license", "_given").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("_from")).alias("license_from"), (F.col("own_license").isNull() & F.col("_given").isNotNull()).alias("inherited"))
    )
