"""Licence scans, in DataFrame expressions only.

A paragraph is a run of lines without a blank line in it. Its lines are judged one by one first (a line may hold a notice
of its own); a paragraph with further anchors is then judged as one text, so that a notice wrapped over lines is found
besides. n_paragraphs counts, and ``paragraph`` numbers, the non-empty lines; a wrapped notice has the number of its run's
first such line with an anchor. A single line has one family, a paragraph each that is probable, confirmed and near the best one. A multinomial
logistic regression over sparse word n-grams (1 to 3 words) scores each paragraph for licence families and for unknown. It is
trained from fixed notices of each family, with words left out, and from lines of the corpus and fixed sentences about
licences that grant none as unknown. Its temperature and the least margin of a family are calibrated by cross-validation:
on notices, and unknown lines, that the fold's fit has not seen in any form. A prediction must be confirmed by its family's templates: the share of a template's distinguishing
word pairs that the paragraph holds.

Only texts with at least one word of the model's anchors are scored; without one the model's family scores can't
reach the least probability, so nothing is lost. At most ``UNKNOWN`` distinct corpus lines of either sort (those with a word about
licences, and the others), picked by a hash, train the model as unknown: a parameter of ``fit`` that bounds what the driver
learns from; lines that a family's template confirms are left out, as they aren't unknown. Every line of every text is scanned.

Defined cases: null and empty texts have no paragraph; very long texts are scanned whole; repeated paragraphs count each; an
empty table gives no rows and rows of equal doc_id stay apart; columns n_paragraphs and licenses of the input are replaced.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framequarry.llm.common import hashed_sample, without

UNKNOWN = 1500
CONFIRMED = 0.34
#: What of the best family's margin another family in the same paragraph must have.
BESIDE = 0.7
ADDED = ("n_paragraphs", "licenses")

# Notices of each licence family.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT license", "SPDX-License-Identifier: MIT"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only", "GNU GPL v3"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "GNU GPL v2"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "bsd": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 2-Clause license", "SPDX-License-Identifier: BSD-3-Clause"],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0-only", "GNU AGPL v3"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal", "Released under CC0 1.0, public domain dedication"],
    "proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"],
}
# Sentences about licences and rights that grant or forbid nothing.
PLAIN = ["the license plate of the car was renewed", "a driving license is required", "all rights of the people", "the public library is free", "version 2 of the report", "terms of the contract", "the general public was there", "he lost his fishing license last year", "we compared open source licenses in this article", "the software is distributed on a disc", "free software is a matter of liberty", "copyright law differs between countries", "they asked for permission to use the hall", "the foundation published version 3 of its plan", "creative people and common goods"]
FAMILIES = sorted(NOTICES)
#: Parts of the notices held out in turn.
FOLDS = 3
_WORD = "[a-z0-9]+"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


class LicenseModel:
    """Weights of n-grams for each family, the anchors, and the least probability."""

    def __init__(self, unknown: list[str], seed: int = 7):
        rng = random.Random(seed)
        rows: list[tuple[set[str], str, int]] = []  # n-grams, class, fold
        for family in FAMILIES:
            for k, notice in enumerate(NOTICES[family]):
                words = words_of(notice)
                for i in range(12):
                    kept = words if i < 3 else [w for w in words if rng.random() > 0.12]
                    rows.append((grams(kept), family, k % FOLDS if len(NOTICES[family]) > 1 else -1))
        rows += [(grams(words_of(text)), "unknown", i % FOLDS) for i, text in enumerate([*unknown, *PLAIN])]
        notices = {g for f in FAMILIES for n in NOTICES[f] for g in grams(words_of(n))}
        # n-grams of common words alone tell nothing; the other words of the vocabulary are the anchors
        spread = Counter(w for text in unknown for w in set(words_of(text)))
        self.common = {w for w, n in spread.items() if n >= max(2, len(unknown) / 400)}
        self.vocabulary = sorted(g for g in notices if not set(g.split()) <= self.common)
        self.classes = [*FAMILIES, "unknown"]
        held: list[tuple[float, int]] = []  # greatest margin and class of rows the fit hasn't seen
        for fold in range(FOLDS):
            self._train([(x, y) for x, y, k in rows if k != fold])
            held += [(max(self.margins(x)), self.classes.index(y)) for x, y, k in rows if k == fold]
        self._train([(x, y) for x, y, _ in rows])
        self._calibrate(held)

    def _train(self, rows: list[tuple[set[str], str]], rounds: int = 120) -> None:
        """Ridge multinomial logistic regression; equal rows are one row with a weight, each class weighs alike."""
        at = {g: i for i, g in enumerate(self.vocabulary)}
        counts = Counter((tuple(sorted(at[g] for g in x if g in at)), self.classes.index(y)) for x, y in rows)
        totals: Counter[int] = Counter()
        for (_, y), n in counts.items():
            totals[y] += n
        k, data = len(self.classes), sorted(counts.items())
        x, y = np.zeros((len(data), len(at)), np.float32), np.zeros((len(data), k), np.float32)
        for i, ((found, c), _) in enumerate(data):
            x[i, list(found)] = 1
            y[i, c] = 1
        share = np.array([n / totals[c] for (_, c), n in data], np.float32)[:, None]
        w, bias = np.zeros((len(at), k), np.float32), np.zeros(k, np.float32)
        for _ in range(rounds):
            z = x @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            e = share * (y - p / p.sum(axis=1, keepdims=True))
            w += 0.5 * (x.T @ e / k * 4 - 0.002 * w)
            bias += 0.5 * e.sum(axis=0) / k
        self.bias = [float(b) for b in bias]
        self.weights = {g: [float(v) for v in w[i]] for g, i in at.items() if np.abs(w[i]).max() > 0.02}

    def margins(self, found: set[str] | list[str]) -> list[float]:
        """Each family's score less that of unknown."""
        z = [b + sum(self.weights[g][c] for g in found if g in self.weights) for c, b in enumerate(self.bias)]
        return [v - z[-1] for v in z[:-1]]

    def _calibrate(self, of: list[tuple[float, int]]) -> None:
        """The least margin of a family: between held-out unknown lines' greatest and the held-out notices' own, nearer the first."""
        unknown = max((m for m, y in of if y == len(FAMILIES)), default=0.0)
        own = sorted(m for m, y in of if y < len(FAMILIES))
        low = own[len(own) // 20] if own else unknown + 1
        self.least = max(0.2, unknown + 0.35 * (low - unknown) if low > unknown else unknown)
        self.slope = 4 / max(0.5, low - self.least)
        base = max(b - self.bias[-1] for b in self.bias[:-1])
        hopeful = [g for g, v in self.weights.items() if max(v[:-1]) > v[-1]]
        self.anchors = sorted({w for g in hopeful for w in g.split() if w not in self.common}) if base <= self.least else []

    def pattern(self) -> str:
        """A paragraph that this doesn't find can't reach the least margin."""
        if not self.anchors:
            return "(?s)."
        heads: dict[str, list[str]] = defaultdict(list)
        for w in self.anchors:
            heads[w[0]].append(w[1:])
        return rf"(?i)(?:^|[^a-z0-9])(?:{'|'.join(f'{h}(?:{"|".join(t)})' for h, t in sorted(heads.items()))})(?![a-z0-9])"


@cache
def templates() -> dict[str, list[list[str]]]:
    """For each family the distinguishing word pairs of each notice: those no other family has."""
    pairs = {f: [{" ".join(p) for p in zip(w, w[1:], strict=False)} for w in map(words_of, NOTICES[f])] for f in FAMILIES}
    return {f: [sorted(p - {x for g in FAMILIES if g != f for q in pairs[g] for x in q}) or sorted(p) for p in pairs[f]] for f in FAMILIES}


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+", -1), lambda p: F.trim(p) != "")


def _lines(text: Column, anchors: str) -> Column:
    """The non-empty lines: struct(i, p, first: of its paragraph, hot: has an anchor)."""
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?>\r\n|\r|\n) *+(?=[\r\n])", -1), _paragraphs)
    lines = F.flatten(F.transform(blocks, lambda b: F.transform(b, lambda p, j: F.struct(p.alias("p"), (j == 0).alias("first")))))
    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["first"].alias("first"), x["p"].rlike(anchors).alias("hot")))


def _runs(lines: Column, hits: Column) -> Column:
    """Each paragraph of two or more lines with an anchor that isn't in a line of ``hits``: struct(i, p, start, stop), its lines joined."""
    starts = F.transform(F.filter(lines, lambda x: x["first"]), lambda x: x["i"])
    stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
    named = F.transform(hits, lambda h: h["paragraph"])
    parts = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"), F.when(b - a > 1, F.slice(lines, a + 1, b - a)).alias("lines")))
    open_ = lambda x: F.filter(x["lines"], lambda y: y["hot"] & ~F.array_contains(named, y["i"]))
    parts = F.filter(parts, lambda x: F.exists(x["lines"], lambda y: y["hot"] & ~F.array_contains(named, y["i"])))
    return F.transform(parts, lambda x: F.struct(open_(x)[0]["i"].alias("i"), F.array_join(F.transform(x["lines"], lambda y: y["p"]), "\n").alias("p"), x["start"].alias("start"), x["stop"].alias("stop")))


def _grams(words: Column) -> Column:
    n = F.size(words)
    pair = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    triple = F.zip_with(F.slice(pair, 1, F.greatest(n - 2, F.lit(0))), F.slice(words, 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pair, triple))


def covered(line: str) -> bool:
    """Whether some family's template confirms the line."""
    words = words_of(line)
    found = grams(words)
    return any(sum(p in found for p in t) >= CONFIRMED * len(t) for own in templates().values() for t in own)


def fit(docs: DataFrame, unknown: int = UNKNOWN) -> LicenseModel:
    """A model with corpus lines as unknown, among them lines that speak of licences but that no template confirms."""
    lines = docs.select(F.explode(_paragraphs(F.col("text"))).alias("p")).withColumn("about", F.lower("p").rlike("licen|copyright|spdx|gnu|creative commons|redistribut|all rights"))
    n = {r.about: r["count"] for r in lines.groupBy("about").count().collect()}
    fraction = F.when(F.col("about"), min(1.0, unknown / max(1, n.get(True, 0)))).otherwise(min(1.0, unknown / max(1, n.get(False, 0))))
    some = hashed_sample(lines, "p", fraction).distinct()  # equal lines all fall into the sample, or none, and count once
    order = F.row_number().over(Window.partitionBy("about").orderBy(F.xxhash64("p"), "p"))
    picked = some.withColumn("n", order).filter(F.col("n") <= unknown).collect()
    return LicenseModel(sorted(r.p for r in picked if not r.about or not covered(r.p)))


def scan(docs: DataFrame, model: LicenseModel, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with n_paragraphs and licenses: array of struct(paragraph, family, probability, coverage)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    d = without(docs, ADDED) if "text" not in ADDED else docs
    anchors = model.pattern()
    text = F.col("text")
    d = d.select(*[F.col(f"`{c}`") for c in keep], _lines(text, anchors).alias("__p"))
    d = d.withColumn("__hot", F.filter("__p", lambda x: x["hot"]))
    weights = F.create_map(*[x for g, v in sorted(model.weights.items()) for x in (F.lit(g), F.array(*[F.lit(a - v[-1]) for a in v[:-1]]))]) if model.weights else None
    start = F.array(*[F.lit(b - model.bias[-1]) for b in model.bias[:-1]])
    known = F.array(*[F.lit(g) for g in sorted(model.weights)])
    own = templates()
    pairs = F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.array(*[F.array(*[F.lit(p) for p in t]) for t in own[f]]))])
    families = F.array(*[F.lit(f) for f in FAMILIES])

    def judged(x: Column, *more: Column) -> Column:
        found = _grams(F.regexp_extract_all(F.lower(x["p"]), F.lit(_WORD), F.lit(0)))
        margins = F.aggregate(F.array_intersect(found, known), start, lambda s, g: F.zip_with(s, F.element_at(weights, g), lambda a, b: a + b))
        return F.struct(x["i"].alias("paragraph"), margins.alias("margins"), found.alias("found"), *more)

    def named(x: Column) -> Column:
        top = F.array_max(x["margins"])
        family = F.element_at(families, F.array_position(x["margins"], top).cast("int"))
        cover = F.array_max(F.transform(F.element_at(pairs, family), lambda t: F.size(F.array_intersect(t, x["found"])) / F.size(t)))
        return F.struct(x["paragraph"].alias("paragraph"), family.alias("family"), (1 / (1 + F.exp(-(top - model.least) * model.slope))).alias("probability"), cover.alias("coverage"))

    def confirmed(h: Column) -> Column:
        return (h["probability"] >= 0.5) & (h["coverage"] >= CONFIRMED)

    def each(x: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            cover = F.array_max(F.transform(F.element_at(pairs, families[k]), lambda t: F.size(F.array_intersect(t, x["found"])) / F.size(t)))
            known = F.exists("__single", lambda h: (h["family"] == families[k]) & (h["paragraph"] >= x["start"]) & (h["paragraph"] < x["stop"]))
            return F.when((m >= model.least) & (m >= BESIDE * F.array_max(x["margins"])) & ~known, F.struct(x["paragraph"].alias("paragraph"), families[k].alias("family"), (1 / (1 + F.exp(-(m - model.least) * model.slope))).alias("probability"), cover.alias("coverage")))

        return F.filter(F.transform(x["margins"], one), confirmed)

    kind = "array<struct<paragraph:int,family:string,probability:double,coverage:double>>"
    none = F.array().cast(kind)
    hits = F.filter(F.transform(F.transform("__hot", lambda x: judged(x)), named), confirmed)
    d = d.withColumn("__single", F.when(F.size("__hot") > 0, hits).otherwise(none))
    d = d.withColumn("__runs", F.when(F.size("__hot") > F.size("__single"), _runs(F.col("__p"), F.col("__single"))).otherwise(F.array().cast("array<struct<i:int,p:string,start:int,stop:int>>")))
    wrapped = F.flatten(F.transform(F.transform("__runs", lambda x: judged(x, x["start"], x["stop"])), each))
    both = F.when(F.size("__runs") > 0, F.array_sort(F.concat(F.col("__single"), wrapped))).otherwise(F.col("__single"))
    return d.select(*keep, F.size("__p").cast("long").alias("n_paragraphs"), both.alias("licenses"))
