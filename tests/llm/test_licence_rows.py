"""Licence scan on texts that hold only parts of templates."""

import random
import re

from stridewell.llm import licences

PARTS = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Redistribution and use in source and binary forms",
    "You may obtain a copy of the License at",
]


def scanned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return licences.scan(docs).collect()


def test_parts_of_templates_keep_their_rows(spark):
    rows = [*enumerate(PARTS), (None, PARTS[0]), (1, PARTS[1]), (7, None), (8, "")]
    got = scanned(spark, rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert {(r.licence, r.dice, r.n_matched, r.licences) for r in got} == {(None, None, 0, "")}


def brute(rows, templates=licences.TEMPLATES, cut=licences.CUT):
    """Every line, whole text and window of a template's words, compared."""

    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    def bigrams(w):
        return {f"{x} {y}" for x, y in zip(w, w[1:])}

    out = []
    for d, text in rows:
        lines = [words(x) for x in text.split("\n")] if text else []
        w = [x for line in lines for x in line]
        spans, at = {(0, len(w))}, 0
        for line in lines:
            spans.add((at, at + len(line)))
            at += len(line)
        hits = set()
        for k, (name, notice) in enumerate(templates):
            have = bigrams(words(notice))
            m = len(words(notice))
            for a, b in spans | {(i, i + m) for i in range(len(w) - m + 1)}:
                own = bigrams(w[a:b])
                dice = round(2 * len(own & have) / (len(own) + len(have)), 6)
                if dice >= cut:
                    hits.add((a, b - 1, dice, k, name))
        n, end, top = 0, -1, 0.0
        for a, e, dice, _, _ in sorted(hits):
            if a > end:
                n, end, top = n + 1, e, dice
            elif dice > top or (dice == top and e > end):
                end, top = e, dice
        best = max(hits, key=lambda h: (h[2], -h[3]), default=(0, 0, None, 0, None))
        names = ",".join(sorted({h[4] for h in hits}))
        out.append((d, len(lines), n, best[4], best[2], names))
    return out


def wrapped(text, n=12, mark="# "):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_notices_wrapped_or_inside_a_line_are_found(spark):
    mit = licences.TEMPLATES[4][1]
    code = " ".join(f"x{i}" for i in range(240))
    rows = [
        (1, wrapped(mit) + "\n" + code),
        (2, code + "\n" + wrapped(licences.TEMPLATES[6][1], 9, " * ") + "\n" + code),
        (3, "This tool is Released under the MIT License. It reads tables and writes more tables"),
        (4, code),
    ]
    got = {r.doc_id: (r.licence, r.dice, r.n_matched) for r in scanned(spark, rows)}
    assert got == {1: ("MIT", 1.0, 1), 2: ("GPL-3.0", 1.0, 1), 3: ("MIT", 1.0, 1), 4: (None, None, 0)}


def test_licences_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, "word"), *((9, p) for p in PARTS)]
    common = "the of this License software under MIT a to in permission version".split()
    for d in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [rng.choice(common) for _ in range(rng.choice([0, 3, 40]))]
            w = licences.TEMPLATES[rng.randrange(len(licences.TEMPLATES))][1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                w.insert(rng.randrange(len(w)), rng.choice(common))
            parts += w[rng.choice([0, 0, 2]) : len(w) - rng.choice([0, 0, 2])] * rng.choice([1, 1, 2])
        breaks = rng.choice([0.0, 0.1, 0.3])
        rows.append((d % 140, "".join(x + ("\n" if rng.random() < breaks else " ") for x in parts)))
    got = [tuple(r) for r in scanned(spark, rows)]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert sum(r[2] > 0 for r in got) > 100
