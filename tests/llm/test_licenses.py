"""Licence notices as files hold them, and the SQL scorer against plain loops over the same weights."""

import math
import random
import re
import textwrap

import pytest

from tideline.llm import licenses as L

HEADERS = {
    "mit": ["The MIT License (MIT)", "Copyright (c) 2021 A. Author. All rights reserved.", *L.TEMPLATES["mit"][2:5]],
    "bsd": ["Copyright (c) 2020, A. Author\nAll rights reserved.", *L.TEMPLATES["bsd"][:5]],
    "isc": ["Copyright (c) 2004-2010 by the authors. All rights reserved.", *L.TEMPLATES["isc"][:2]],
    "gpl": ["This file is part of a program.", L.TEMPLATES["gpl"][3], "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.", L.TEMPLATES["gpl"][4]],
    "agpl": [L.TEMPLATES["agpl"][1], L.TEMPLATES["agpl"][2]],
    "lgpl": [L.TEMPLATES["lgpl"][1]],
    "apache-2.0": ["Copyright 2020 The Authors. All rights reserved.", " ".join(L.TEMPLATES["apache-2.0"][1:2]), L.TEMPLATES["apache-2.0"][3]],
    "mpl-2.0": [L.TEMPLATES["mpl-2.0"][0]],
    "unlicense": list(L.TEMPLATES["unlicense"][:2]),
    "zlib": ["Copyright (C) 1995 A. Author", *L.TEMPLATES["zlib"][:2]],
}
MARKS = [("", "", ""), ("# ", "#", ""), ("/*\n", " * ", " */"), ("// ", "//", "")]


def comment(parts, mark, width):
    opens, line, ends = mark
    lines = [x for p in parts for x in [*(y for q in p.split("\n") for y in textwrap.wrap(q, width)), ""]]
    first = opens if opens.endswith("\n") else ""
    lead = line if opens.endswith("\n") else opens
    return first + "\n".join((lead + x).rstrip() for x in lines) + "\n" + ends


@pytest.mark.parametrize("width", [60, 78])
def test_headers_of_files(spark, width):
    data = [(f, comment(parts, m, width) + "\n\nimport os\n" + "x = 1\n" * 50) for f, parts in HEADERS.items() for m in MARKS]
    got = L.licences(spark.createDataFrame(data, "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["family"], r["confirmed"]) for r in got] == [(f, f, True) for f, _ in data]


def test_two_notices_in_one_paragraph(spark):
    text = " ".join([L.TEMPLATES["mit"][2], "Some words between the two of them.", L.TEMPLATES["bsd"][0]])
    got = L.scan(spark.createDataFrame([("x", "\n".join(textwrap.wrap(text, 70)))], "doc_id string, text string")).first()["licences"]
    assert {(p["family"], p["confirmed"]) for p in got} == {("mit", True), ("bsd", True)}


def brute(text):
    """(paragraph, line, family, probability, confirmed, held) as scan() has them, by loops."""
    table, bias = L.train()
    single = {g for g in table if " " not in g}
    known = {f: [L.shingles(L.words(t)) for t in ts] for f, ts in L.TEMPLATES.items()}
    most = max(len(L.words(t)) for ts in L.TEMPLATES.values() for t in ts)
    near = lambda s: re.search("|".join(L.ANCHORS), s.lower())
    lower = lambda s: [w for w in re.split(r"[^a-z0-9]+", s.lower()) if w]

    def judge(w):
        found = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        z = list(bias)
        for g in found & table.keys():
            z = [a + b for a, b in zip(z, table[g], strict=True)]
        joined = f" {' '.join(w)} "
        held = {}
        for f, ts in known.items():
            hits = [[s for s in t if f" {s} " in joined] for t in ts]
            held[f] = len({s for t, h in zip(ts, hits, strict=True) if len(h) >= L.SHARE * len(t) for s in h})
        return z, held

    lines, whole, out = [], [], []
    for i, p in enumerate(re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+", text)):
        if not near(p):
            continue
        rows = [lower(x) for x in p.split("\n")]
        for k, w in enumerate(rows):
            if set(w) & single:
                z, held = judge(w)
                f = L.CLASSES[z.index(max(z))]
                if f != "none":
                    prob = math.exp(max(z)) / sum(map(math.exp, z))
                    sure = prob >= L.SURE and held.get(f, 0) > 0
                    lines.append((i, k, f if sure else "unknown", prob, sure, held[f] if sure else 0))
        flat = [w for r in rows for w in r]
        best = {}
        for at in range(0, max(1, len(flat) - most), most) if len(rows) > 1 else ():
            w = flat[at : at + 2 * most]
            z, held = judge(w)
            for f, n in held.items():
                odds = z[L.CLASSES.index(f)] - z[L.CLASSES.index("none")]
                if n and odds >= 0 and any(f" {s} " in f" {' '.join(w)} " for t in known[f] for s in t):
                    best[f] = max(best.get(f, (0, 0)), (n, 1 / (1 + math.exp(-odds))))
        best = {f: b for f, b in best.items() if not any(x[0] == i and x[2] == f and x[5] >= b[0] for x in lines)}
        kin = L.rivals()
        whole += [(i, -1, f, b[1], True, b[0]) for f, b in best.items() if not any(best.get(g, (0, 0)) > b for g in kin[f])]
    for x in lines:
        if not any(y[0] == x[0] and (not x[4] or y[2] == x[2]) for y in whole):
            out.append(x)
    return sorted(out + whole)


def test_sql_scores_as_plain_loops(spark):
    rng = random.Random(4)
    pool = [w for t in L.OTHERS["none"] for w in L.words(t)] + ["lorem", "ipsum", "é", "über"]
    texts = [None, "", "\n\n", "Released under the MIT License.\nAll rights reserved."]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice([t for ts in [*L.TEMPLATES.values(), *L.OTHERS.values()] for t in ts])
            if rng.random() < 0.3:
                t = " ".join(w for w in t.split() if rng.random() > 0.15)
            t = " ".join([*rng.choices(pool, k=rng.randrange(20)), t, *rng.choices(pool, k=rng.randrange(150) if rng.random() < 0.2 else 3)])
            parts.append("\n".join(textwrap.wrap(t, rng.choice([30, 70, 10_000]))))
        texts.append(rng.choice(["\n", "\n\n", "\n * \n"]).join(parts))
    got = {r["doc_id"]: [tuple(p) for p in r["licences"]] for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert [(p[:3], p[4:]) for p in sorted(got[i])] == [(p[:3], p[4:]) for p in want], t
        assert [p[3] for p in sorted(got[i])] == pytest.approx([p[3] for p in want], abs=1e-9)
    assert sum(map(len, got.values())) > 150


def test_every_notice_holds_an_anchor():
    assert all(re.search("|".join(L.ANCHORS), t.lower()) for ts in [*L.TEMPLATES.values(), L.OTHERS["unknown"]] for t in ts)


def test_held_out_variants():
    """The classifier alone, on corrupted notices that it was not trained on."""
    table, bias = L.train()
    rng, right, n = random.Random(99), 0, 0
    for f, ts in L.TEMPLATES.items():
        for t in ts:
            w = [x for x in L.words(t) if rng.random() > 0.05]
            z = list(bias)
            for g in L.grams(w) & table.keys():
                z = [a + b for a, b in zip(z, table[g], strict=True)]
            n, right = n + 1, right + (L.CLASSES[z.index(max(z))] == f)
    assert right >= 0.85 * n
