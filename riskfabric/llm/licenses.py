"""License scans: units of a text compared with license templates by the Dice coefficient over word bigrams.

A unit is a line, a block of lines between blank lines, or the whole text. All are normalised to lower-case words. Dice
is 2 |A & B| / (|A| + |B|) over distinct bigrams; to reach t, |A| must lie between t / (2 - t) |B| and (2 - t) / t |B|, so a
template is compared with a unit only within these bounds, and a unit without enough bigrams of any template is left out
before its size is counted. Everything happens within a row: no shuffle, whatever the copies or the hot source.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.common import let

THRESHOLD = 0.8

# SPDX identifiers with published notices and the usual one-line forms.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                         "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
]


GNU = [("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",))]
#: Notices of the common licenses and versions, for `scan_notices`; the list of op1 stays as its SQL has it.
NOTICES = [t for t in TEMPLATES if t[0] not in ("BSD-3-Clause", "GPL-3.0-only", "GPL-3.0-or-later")]
for _family, _word, _versions in GNU:
    for _v in _versions:
        for _said in sorted({_v, _v.removesuffix(".0")}):
            _license = f"the GNU {_word}General Public License"
            _program = "This program is free software: you can redistribute it and/or modify it under the terms of"
            NOTICES += [
                (f"{_family}-{_v}-only", f"This work is licensed under {_license}, version {_said}."),
                (f"{_family}-{_v}-only", f"{_program} {_license} as published by the Free Software Foundation, version {_said} of the License."),
                (f"{_family}-{_v}-only", f"{_program} {_license} version {_said} as published by the Free Software Foundation."),
                (f"{_family}-{_v}-or-later", f"{_program} {_license} as published by the Free Software Foundation, either version {_said} of the License, or (at your option) any later version."),
                (f"{_family}-{_v}-or-later", f"This work is licensed under {_license}, version {_said} or later.")]
for _kind in ("", "SA", "NC", "ND", "NC SA", "NC ND"):
    _long = "-".join(["Attribution", *({"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}[k] for k in _kind.split())])
    for _v, _region in (("3.0", "Unported"), ("4.0", "International")):
        _name = f"CC BY {_kind}".strip().replace(" ", "-").replace("CC-BY", "CC BY")
        NOTICES += [(f"{_name.replace(' ', '-')}-{_v}", f"Licensed under {_name} {_v}."),
                    (f"{_name.replace(' ', '-')}-{_v}", f"This work is licensed under a Creative Commons {_long} {_v} {_region} License.")]
_opening = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
_no_endorsement = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                   "without specific prior written permission.")
NOTICES += [
    ("BSD-2-Clause", f"{_opening} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", f"{_opening} {_no_endorsement} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal.")]
NOTICES = list(dict.fromkeys(NOTICES))


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalised_lines(text: Column) -> Column:
    """Lines of lower-cased words with single spaces between them; a blank line is empty."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")))


def units_of(text: Column) -> Column:
    """Distinct lines, blocks of lines and the whole, without empty ones."""
    def all_units(lines: Column) -> Column:
        blocks = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda b: F.trim(F.translate(b, "\n", " ")))
        whole = F.array_join(F.filter(lines, lambda x: x != ""), " ")
        return F.filter(F.array_distinct(F.concat(lines, blocks, F.array(whole))), lambda u: u != "")

    return let(normalised_lines(text), all_units)


def bigrams_of(unit: Column) -> Column:
    """All word bigrams of a normalised unit, repeats included."""
    return let(F.split(unit, " "), lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """id, `licenses` (distinct ids found, sorted, comma-joined), `n_matches` (unit and template pairs) and `best_dice`.

    One row per input row. Null, empty and word-less texts have no match and a null best_dice. A unit that fits several
    templates counts for each. Templates of one word have no bigram and match nothing. Only the two columns are read.
    """
    known = [(name, grams) for name, text in (templates or TEMPLATES) if (grams := template_bigrams(text))]
    vocabulary = sorted({g for _, grams in known for g in grams})
    fewest = min(len(g) for _, g in known) * threshold / (2 - threshold)
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in known])

    def compared(unit: Column) -> Column:
        def against(grams: Column) -> Column:
            fits = F.filter(table, lambda t: (F.size(grams) >= t["n"] * (threshold / (2 - threshold)) - 1e-9) & (F.size(grams) <= t["n"] * ((2 - threshold) / threshold) + 1e-9))
            scored = F.transform(fits, lambda t: F.struct(t["name"].alias("name"), (F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])).alias("dice")))
            return F.filter(scored, lambda s: s["dice"] >= threshold)

        return let(unit, lambda grams: F.when(
            F.size(F.array_distinct(F.filter(grams, lambda g: g.isin(vocabulary)))) >= fewest,
            let(F.array_distinct(grams), against)).otherwise(F.slice(F.transform(table, lambda t: F.struct(t["name"].alias("name"), F.lit(0.0).alias("dice"))), F.lit(1), F.lit(0))))

    found = F.flatten(F.transform(units_of(F.col(text_col)), lambda u: compared(bigrams_of(u))))
    return docs.select(F.col(id_col), found.alias("_found")).select(
        id_col, F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["name"]))), ",").alias("licenses"),
        F.size("_found").alias("n_matches"), F.array_max(F.transform("_found", lambda m: m["dice"])).alias("best_dice"))


def word_pairs(text: str | None) -> list[tuple[str, str]]:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return list(zip(words, words[1:]))


class Notices:
    """Finds license notices anywhere in a text, whatever else stands on their line."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.known = [(name, grams) for name, text in templates if (grams := set(word_pairs(text)))]
        self.threshold = threshold
        self.having: dict[tuple[str, str], list[int]] = {}
        for t, (_, grams) in enumerate(self.known):
            for g in grams:
                self.having.setdefault(g, []).append(t)

    def windows(self, grams: list[tuple[str, str]], t: int, places: list[int]) -> Iterator[tuple[int, int, int, int, float]]:
        """(score, template, start, stop, dice) of the best run from each place that reaches the threshold.

        A run starts and ends with a bigram of the template (others at its ends only lower Dice) and is as long as the bounds on
        sizes allow. It can reach the threshold only where enough places lie within that length.
        """
        own = self.known[t][1]
        n, longest = len(own), int(len(own) * (2 - self.threshold) / self.threshold + 1e-9)
        need = -int(-(n * self.threshold / (2 - self.threshold) - 1e-9) // 1)
        for j in range(len(places) - need + 1):
            start = places[j]
            if places[j + need - 1] - start >= longest:
                continue
            seen, shared, best = set(), 0, None
            for at in range(start, min(start + longest, len(grams))):
                if (g := grams[at]) in seen:
                    continue
                seen.add(g)
                if g in own:
                    shared += 1
                    dice = 2 * shared / (len(seen) + n)
                    if dice >= self.threshold and (best is None or dice >= best[4]):
                        best = (3 * shared - len(seen) - n, t, start, at + 1, dice)
            if best:
                yield best

    def find(self, text: str | None) -> list[tuple[str, float]]:
        """(license, dice) of each notice. Of overlapping matches the best stays, or all on an exact tie: the one with the
        most bigrams shared after taking off those that only the run or only the template has."""
        grams = word_pairs(text)
        places: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            for t in self.having.get(g, ()):
                places.setdefault(t, []).append(i)
        matches = sorted((m for t, p in places.items() for m in self.windows(grams, t, p)), key=lambda m: (-m[0], -m[4], m[2], m[3], m[1]))
        taken: list[tuple[int, int, int, float]] = []  # by start; one entry for each place, so they do not overlap
        ties: dict[int, set[int]] = {}
        out = []
        for score, t, start, stop, dice in matches:
            i = bisect_left(taken, (stop,)) - 1
            if i < 0 or taken[i][1] <= start:
                insort(taken, (start, stop, score, dice))
                ties[start] = {t}
            elif taken[i][:1] + taken[i][2:] == (start, score, dice) and t not in ties[start]:
                ties[start].add(t)
            else:
                continue
            out.append((self.known[t][0], dice))
        return out


def scan_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """As `scan_licenses`, but runs of words instead of units, so a notice is found inside a longer line or a flat text.

    `n_matches` counts notices. Without `templates` those in `NOTICES` are compared.
    """
    known = templates or NOTICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = Notices(known, threshold)
        for batch in batches:
            found = [notices.find(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([",".join(sorted({name for name, _ in f})) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int32()),
                 pa.array([max((d for _, d in f), default=None) for f in found], pa.float64())], names=[id_col, "licenses", "n_matches", "best_dice"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, licenses string, n_matches int, best_dice double")
