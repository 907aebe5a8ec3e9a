"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by template comparison.

A paragraph is what stands between lines without a letter or digit, so comment marks neither join nor part notices. It is
judged as a whole, however it is wrapped: in windows of twice the longest template, so that every template lies in one. Its
lines are judged too, as prose may hold a notice of one line.

A multinomial logistic regression (L1) on the presence of words and word pairs tells the family of a line or window, or
``unknown`` (licence-like, of no known family) or ``none``. It is trained on the driver, on the notices below with seeded
word losses, insertions and mixtures; a temperature fitted on held-out variants calibrates its probabilities, the unknown
class's among them. A line is of its likeliest family, a window of every family likelier than ``none``, as it may hold
several. A family is confirmed if the words hold at least 0.8 of the five-word shingles of one of its templates (of a
shorter template, all its words in a row); a line that no template confirms counts as unknown, unless its paragraph is
confirmed. Of families whose templates share half of their shingles, as those of one foundation do, a paragraph is of the
one it holds more of. The document is of the family of which some paragraph or line holds the most shingles.

Scoring is one projection over whole texts, by SQL expressions alone: no shuffle, no join, no Python on executors.
Paragraphs without one of ``ANCHORS``, of which every notice holds one, are ``none`` unread.

Defined results: null and empty texts have no licence; ids pass through as they are, null or repeated; equal rows give
equal rows; ties go to the likelier family, then to the earlier paragraph, then to the first by name; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed wordings of public licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain.", "Released under CC0 1.0 Universal."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": ("All rights reserved.", "This document is confidential and proprietary and may not be reproduced without written permission."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. For more information, please refer to <https://unlicense.org>",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ),
}
#: Licence-like lines of no family above, and lines that only sound like one.
OTHERS: dict[str, tuple[str, ...]] = {
    "unknown": (
        "Licensed under the terms of the customer agreement.", "This software is licensed under a commercial license.", "See the license for details.", "Distributed under its own license, version 7.",
        "Use is subject to license terms.", "This material may be used under the community license of its owner.", "Released under an internal license.", "This work is licensed for personal use only.",
        "Licensed under the house terms.", "Licensed under the owner license.", "Released under the member license.", "This work is licensed under the letter agreement.", "Licensed under terms of its own.",
    ),
    "none": (
        "The software was released in the spring and the source was public.", "A driver must carry a license at all times.", "The public library is free for all.", "You should have received a copy of the letter.",
        "The notice above the door was included in the copies.", "Permission to leave was granted by the general.", "The version of the story that was published is wrong.", "The terms of use of the domain changed.",
        "Rights and duties are reserved for members.", "The foundation of the house was free of water.", "The mit of the story is a form of work.", "Conditions at the source of the river are met.",
        "The warranty of the car had ended by then.", "No person was liable for the damages of the storm.", "He asked for a copy of the software and paid the fee.", "The names of the authors may be found at the end.",
    ),
}
#: Every notice above holds one of these.
ANCHORS = ("licen", "copyright", "rights reserved", "public domain", "free software", "permission", "redistribut", "warrant", "cc0")
STOP = frozenset("the a an of and or to in is are be been was this that these with without by as at any all for from on not you your may it its can under shall if has have will which who had were but they their i we he she use used file work form must new one out no".split())
CLASSES = (*TEMPLATES, *OTHERS)
SHINGLE, SHARE, SURE = 5, 0.8, 0.5
PARTS = 64


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams(w: list[str]) -> set[str]:
    return {*(x for x in w if x not in STOP and len(x) > 1), *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if not (a in STOP and b in STOP) and not (len(a) < 2 and len(b) < 2))}


@cache
def train(seed: int = 5, variants: int = 24) -> tuple[dict[str, list[float]], list[float]]:
    """The weights of each gram over CLASSES, and the biases; both already divided by the temperature."""
    rng = random.Random(seed)
    pool = [w for lines in OTHERS.values() for line in lines for w in words(line)]
    rows: list[tuple[set[str], int]] = [(set(), CLASSES.index("none"))] * 400
    for k, name in enumerate(CLASSES):
        lines = TEMPLATES.get(name) or OTHERS[name]
        for line in lines:
            for i in range(variants if len(line) < 200 else variants // 2):
                w = [x for x in words(line) if i == 0 or rng.random() > 0.08]
                around = [rng.choice(pool) for _ in range(rng.randrange(12))] if i % 2 else []
                at = rng.randrange(len(around) + 1)
                rows.append((grams(around[:at] + w + around[at:]), k))
    # a licence of no known family is known by its few common words, whatever the others are
    rows += [(grams([w for w in words(line) if rng.random() > 0.4]), CLASSES.index("unknown")) for line in OTHERS["unknown"] for _ in range(2 * variants)]
    for _ in range(800):
        rows.append((grams([rng.choice(pool) for _ in range(rng.randrange(2, 25))]), CLASSES.index("none")))
    rng.shuffle(rows)
    names = sorted({g for r, _ in rows for g in r})
    single = {g for g in names if " " not in g}
    names = [g for g in names if " " not in g or not single.isdisjoint(g.split())]
    number = {g: i for i, g in enumerate(names)}
    # every row also holds a last feature whose weights stay zero, so that none is empty
    lists = [[*(number[g] for g in r if g in number), len(names)] for r, _ in rows]
    y = np.array([k for _, k in rows])
    fold = np.arange(len(rows)) % 5 == 0
    w, b = np.zeros((len(names) + 1, len(CLASSES))), np.zeros(len(CLASSES))

    def flat(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = [lists[i] for i in np.flatnonzero(own)]
        return np.concatenate([np.array(c) for c in chosen]), np.cumsum([0] + [len(c) for c in chosen[:-1]])

    at, starts = flat(~fold)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    order = np.argsort(at, kind="stable")
    used, firsts = np.unique(at[order], return_index=True)
    one = np.eye(len(CLASSES))[y[~fold]]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, 121):
        off = _softmax(np.add.reduceat(w[at], starts) + b) - one
        slope = np.zeros_like(w)
        slope[used] = np.add.reduceat(off[of[order]], firsts) / len(one)
        slope[-1] = 0
        for value, grad, mm, vv in ((w, slope, m, v), (b, off.mean(axis=0), mb, vb)):
            mm += 0.1 * (grad - mm)
            vv += 0.01 * (grad * grad - vv)
            move = 0.1 / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
            value -= move * mm / (1 - 0.9**step)
            if value is w:
                w[:] = np.sign(w) * np.maximum(np.abs(w) - np.minimum(move * 1e-5, 0.1), 0)
    at, starts = flat(fold)
    z, held = np.add.reduceat(w[at], starts) + b, y[fold]
    heat = min((0.5 + 0.1 * i for i in range(40)), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), held] + 1e-12).mean())
    w = w[:-1]
    keep = np.abs(w).max(axis=1) > 1e-3
    table = {g: [round(float(c), 6) for c in w[i] / heat] for i, g in enumerate(names) if keep[i] or " " not in g and g not in STOP and keep[[j for j, n in enumerate(names) if " " in n and g in n.split()]].any()}
    return table, [round(float(c), 6) for c in b / heat]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def shingles(w: list[str]) -> list[str]:
    return [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rivals() -> dict[str, list[str]]:
    """For each family those that have a template half of whose shingles are in one of its own."""
    sets = {f: [set(shingles(words(t))) for t in ts] for f, ts in TEMPLATES.items()}
    alike = lambda a, b: any(2 * len(x & y) >= min(len(x), len(y)) for x in a for y in b if min(len(x), len(y)) > SHINGLE)
    return {f: [g for g in sets if g != f and alike(sets[f], sets[g])] for f in sets}


def table_literal(table: dict[str, list[float]]) -> str:
    """The weights as a list of maps, a few grams each: a lookup in a map reads it from the start."""
    parts: list[dict[str, list[float]]] = [{} for _ in range(PARTS)]
    for g, w in table.items():
        parts[zlib.crc32(g.encode()) % PARTS][g] = w
    return f"from_json({_literal(json.dumps(parts))}, 'array<map<string,array<double>>>')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, licences): for each notice its paragraph and line from 0 (-1: the paragraph as a whole), family,
    probability, whether it is confirmed, and how many shingles of its templates are held."""
    table, bias = train()
    among = lambda values: f"({', '.join(map(_literal, sorted(values)))})"
    anchor = _literal(f"(?i){'|'.join(ANCHORS)}")
    single = among(g for g in table if " " not in g)
    every = among(table)
    known = {f: [{"n": len(words(t)), "s": shingles(words(t))} for t in ts] for f, ts in TEMPLATES.items()}
    templates = f"from_json({_literal(json.dumps(known))}, 'map<string,array<struct<n:int,s:array<string>>>>')"
    start, names, families = f"array({', '.join(f'{b}D' for b in bias)})", f"array({', '.join(map(_literal, CLASSES))})", f"array({', '.join(map(_literal, TEMPLATES))})"
    most = max(t["n"] for ts in known.values() for t in ts)
    pieces: dict[int, set[str]] = {}
    for t in (t for ts in known.values() for t in ts):
        pieces.setdefault(min(SHINGLE, t["n"]), set()).update(t["s"])
    opens = among({x.split()[0] for ts in pieces.values() for x in ts})
    held = " OR ".join(f"array_join(slice(u.w, k, {n}), ' ') IN {among(ts)}" for n, ts in sorted(pieces.items()))
    found = "transform(element_at({}, {}), t -> named_struct('n', size(t.s), 's', filter(t.s, s -> instr(u.t, concat(' ', s, ' ')) > 0)))".format
    told = lambda of: f"size(array_distinct(flatten(transform(filter({found(templates, of)}, t -> size(t.s) >= {SHARE}D * t.n), t -> t.s))))"
    kin = f"from_json({_literal(json.dumps(rivals()))}, 'map<string,array<string>>')"
    notice = "named_struct('paragraph', u.i, 'line', u.line, 'family', {}, 'probability', {}, 'confirmed', {}, 'held', {})".format
    none, likeliest = CLASSES.index("none"), f"element_at({names}, CAST(array_position(u.z, array_max(u.z)) AS INT))"
    of_line = notice("u.family", "u.p", f"u.p >= {SURE}D AND u.n > 0", f"IF(u.p >= {SURE}D, u.n, 0)")
    beaten = f"exists(best, b -> a.paragraph = b.paragraph AND array_contains(element_at({kin}, a.family), b.family) AND struct(b.held, b.probability) > struct(a.held, a.probability))"
    of_window = "filter(transform(filter({}, (f, j) -> u.z[j] >= u.z[{}]), (f, j) -> {}), x -> x.held > 0)".format(families, none, notice("f", f"1D / (1D + exp(u.z[{none}] - u.z[array_position({names}, f) - 1]))", "true", told("f")))
    same = "a.paragraph = b.paragraph AND a.family = b.family"
    steps = {
        # paragraphs, then their lines as lists of words, then the lines and windows to judge
        "x": rf"IF(text RLIKE {anchor}, filter(transform(split(text, '\\n(?:[^A-Za-z0-9\\n]*\\n)+'), (p, i) -> named_struct('i', i, 'p', p)), s -> s.p RLIKE {anchor}), NULL)",
        "lines": r"transform(x, s -> named_struct('i', s.i, 'l', transform(split(lower(s.p), '\\n'), l -> filter(split(l, '[^a-z0-9]+'), w -> w <> ''))))",
        "windows": f"filter(flatten(transform(filter(lines, s -> size(s.l) > 1), s -> transform(sequence(1, greatest(1, size(flatten(s.l)) - {most}), {most}), k -> named_struct('i', s.i, 'line', -1, 'w', slice(flatten(s.l), k, {2 * most}))))), u -> exists(sequence(1, size(u.w)), k -> element_at(u.w, k) IN {opens} AND ({held})))",
        "units": f"concat(filter(flatten(transform(lines, s -> transform(s.l, (w, k) -> named_struct('i', s.i, 'line', k, 'w', w)))), u -> exists(u.w, w -> w IN {single})), windows)",
        "grams": f"transform(units, u -> named_struct('i', u.i, 'line', u.line, 't', concat(' ', array_join(u.w, ' '), ' '), 'g', filter(array_distinct(concat(u.w, zip_with(u.w, slice(u.w, 2, size(u.w)), (a, b) -> concat(a, ' ', b)))), g -> g IN {every})))",
        "scored": f"transform(grams, u -> named_struct('i', u.i, 'line', u.line, 't', u.t, 'z', aggregate(u.g, {start}, (acc, g) -> zip_with(acc, element_at(get({table_literal(table)}, CAST(crc32(CAST(g AS BINARY)) % {PARTS} AS INT)), g), (a, b) -> a + b))))",
        "judged": f"transform(filter(scored, u -> u.line >= 0), u -> named_struct('i', u.i, 'line', u.line, 't', u.t, 'family', {likeliest}, 'p', 1D / aggregate(transform(u.z, z -> exp(z - array_max(u.z))), 0D, (a, b) -> a + b)))",
        "counted": f"transform(filter(judged, u -> u.family <> 'none'), u -> named_struct('i', u.i, 'line', u.line, 'family', u.family, 'p', u.p, 'n', IF(u.family = 'unknown', 0, {told('u.family')})))",
        "by_line": f"transform(transform(counted, u -> {of_line}), a -> named_struct('paragraph', a.paragraph, 'line', a.line, 'family', IF(a.confirmed, a.family, 'unknown'), 'probability', a.probability, 'confirmed', a.confirmed, 'held', a.held))",
        "by_window": f"flatten(transform(filter(scored, u -> u.line < 0), u -> {of_window}))",
        # a paragraph's family counts once: by the window that holds most of it, if that is more than any line holds
        "longer": f"filter(by_window, a -> NOT exists(by_line, b -> {same} AND b.held >= a.held))",
        "best": f"transform(array_distinct(transform(longer, a -> named_struct('paragraph', a.paragraph, 'family', a.family))), a -> array_max(transform(filter(longer, b -> {same}), b -> named_struct('held', b.held, 'probability', b.probability, 'paragraph', b.paragraph, 'family', b.family))))",
        "paragraphs": f"transform(filter(best, a -> NOT {beaten}), a -> named_struct('paragraph', a.paragraph, 'line', -1, 'family', a.family, 'probability', a.probability, 'confirmed', true, 'held', a.held))",
        "single": f"filter(by_line, a -> IF(a.confirmed, NOT exists(paragraphs, b -> {same}), NOT exists(paragraphs, b -> a.paragraph = b.paragraph)))",
        "licences": "coalesce(array_sort(concat(single, paragraphs)), array())",
    }
    return _project(docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), id_col, steps)


def _project(rows: DataFrame, id_col: str, steps: dict[str, str]) -> DataFrame:
    """One column after the other; each goes once no later one reads it."""
    named = list(steps)
    for k, (name, step) in enumerate(steps.items()):
        later = " ".join(list(steps.values())[k + 1 :])
        keep = [c for c in rows.columns if c != id_col and re.search(rf"\b{c}\b", later)]
        rows = rows.select(id_col, *keep, F.expr(step).alias(name))
    return rows.select(id_col, named[-1])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the licence that it holds the most text of, if confirmed, else ``unknown`` if something is licence-like, else
    ``none``."""
    best = F.expr("array_max(transform(filter(licences, p -> p.confirmed), p -> named_struct('held', p.held, 'probability', p.probability, 'first', -p.paragraph, 'family', p.family)))")
    rows = scan(docs, id_col, text_col).withColumn("best", best)
    family = F.coalesce("best.family", F.when(F.size("licences") > 0, "unknown").otherwise("none"))
    return rows.select(id_col, family.alias("family"), F.col("best.probability").alias("probability"), F.col("best").isNotNull().alias("confirmed"), F.size("licences").cast("long").alias("n_paragraphs"))
