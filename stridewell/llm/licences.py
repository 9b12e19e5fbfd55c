"""Licence scan: Dice coefficient over word bigrams against templates.

A text is normalised to one sequence of lower-case words.  Each line, the whole
text, and each window of a template's number of words that slides over the
sequence is compared with the template as sets of bigrams.  A unit that reaches
the cut ``t`` shares at least ``size t / (2 - t)`` bigrams with a template of
``size``, so a text that holds fewer of them is done; in the others the
positions of shared bigrams give the windows that can reach the cut.  All steps
are built-in expressions on the row; nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence notices, by licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in"
        " all copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met: 1. Redistributions of source"
        " code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to"
        " endorse or promote products derived from this software without specific prior written"
        " permission.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event"
        " will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the"
        " following restrictions: 1. The origin of this software must not be misrepresented; you"
        " must not claim that you wrote the original software. If you use this software in a"
        " product, an acknowledgment in the product documentation would be appreciated but is not"
        " required. 2. Altered source versions must be plainly marked as such, and must not be"
        " misrepresented as being the original software. 3. This notice may not be removed or"
        " altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to"
        " copy, modify, publish, use, compile, sell, or distribute this software, either in source"
        " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by"
        " any means.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
)
CUT = 0.8

NORMAL = "array_remove(split(lower({}), '[^\\\\p{{L}}\\\\p{{N}}]+', -1), '')"
BIGRAMS = "transform(slice(w, 1, greatest(0, size(w) - 1)), (x, i) -> concat(x, ' ', w[i + 1]))"
#: Dice is rounded to six places before it meets the cut.
SLACK = 1e-6


def template_table(spark, templates=TEMPLATES) -> list[tuple]:
    """(template, licence, bigram positions, distinct bigrams) of each template
    that has a bigram."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    known = (
        spark.createDataFrame(rows, "template int, licence string, text string")
        .withColumn("w", F.expr(NORMAL.format("text")))
        .withColumn("b", F.expr(BIGRAMS))
        .where("size(b) > 0")
        .select("template", "licence", F.size("b"), F.array_distinct("b"))
    )
    return sorted(tuple(r) for r in known.collect())  # one row a template


def _literal(known: list[tuple], cut: float) -> F.Column:
    """The templates as an array of structs.  ``need``: least shared bigrams of
    a unit that reaches the cut, of ``least`` to ``most`` distinct bigrams."""
    low = cut - SLACK
    return F.array(
        *(
            F.struct(
                F.lit(k).alias("template"),
                F.lit(name).alias("licence"),
                F.lit(m).alias("m"),
                F.array(*map(F.lit, grams)).alias("grams"),
                F.lit(max(1, math.ceil(len(grams) * low / (2 - low) - 1e-9))).alias("need"),
                F.lit(math.floor(len(grams) * (2 - low) / low + 1e-9)).alias("most"),
            )
            for k, name, m, grams in known
        )
    )


def _units() -> str:
    """Spans (first bigram, bigrams) of ``b`` in which template ``t`` can reach
    the cut: windows that hold ``need`` of the shared positions ``p``, lines
    and the whole text."""
    windows = (
        "flatten(transform(filter(sequence(0, size(p) - t.need), i -> p[i + t.need - 1] - p[i] < t.m"
        " and greatest(0, p[i + t.need - 1] - t.m + 1) <= least(p[i], size(b) - t.m)),"
        " i -> sequence(greatest(0, p[i + t.need - 1] - t.m + 1), least(p[i], size(b) - t.m))))"
    )
    windows = f"transform(array_distinct({windows}), s -> named_struct('s', s, 'n', t.m))"
    shared = "filter(transform(b, (x, i) -> if(array_contains(t.grams, x), i, -1)), i -> i >= 0)"
    # A template of many repeats can have fewer shared positions than it needs.
    windows = f"if(size(p) < t.need, cast(array() as array<struct<s:int,n:int>>), {windows})"
    return (
        f"array_union(flatten(transform(array({shared}), p -> {windows})),"
        " filter(spans, u -> u.n >= t.need))"
    )


def _matches(cut: float) -> str:
    """All units that reach the cut, as structs, for the row's ``near``
    templates."""
    part = "slice(b, u.s + 1, u.n)"
    scored = (
        f"transform({_units()}, u -> named_struct('s', u.s, 'e', u.s + u.n,"
        f" 'dice', transform(array(size(array_distinct({part}))), n -> if(n > t.most, 0D,"
        f" round(2D * size(array_intersect({part}, t.grams)) / (n + size(t.grams)), 6)))[0],"
        " 'template', t.template, 'licence', t.licence))"
    )
    return f"flatten(transform(near, t -> filter({scored}, x -> x.dice >= {cut}D)))"


def scan(
    docs: DataFrame,
    templates=TEMPLATES,
    cut: float = CUT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_matched, licence (of the best
    unit; ties to the first template), dice (rounded to six places) and
    licences (all names found, sorted, comma-joined).

    Units are each line, the whole text, and each window of a template's
    number of words, compared with that template.  ``n_matched`` counts the
    places of units that reach the cut, by order of start: of units that
    overlap the last place's, the better one (higher Dice, then later end)
    stands for it.

    Null and empty texts have no lines and no licence; a unit under two words
    has no bigram; null ids and repeated rows stay; an empty table gives no
    rows.
    """
    known = template_table(docs.sparkSession, templates)
    if not known:
        raise ValueError("no template has two words")
    every = sorted({g for *_, grams in known for g in grams})
    table = _literal(known, cut)
    lines = F.expr(f"if({text_col} is null or {text_col} = '', cast(array() as array<string>), split({text_col}, '\\n', -1))")
    shaped = (
        docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
        .select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.expr(f"transform(lines, x -> {NORMAL.format('x')})").alias("by_line"),
        )
        .withColumn("w", F.flatten("by_line"))
        .withColumn("b", F.expr(BIGRAMS))
        .withColumn("met", F.array_intersect("b", F.array(*map(F.lit, every))))
        .withColumn("table", F.when(F.size("met") > 0, table).otherwise(F.slice(table, 1, 0)))
        .withColumn(
            "near", F.expr("filter(table, t -> size(array_intersect(met, t.grams)) >= t.need)")
        )
    )
    # Lines by their first bigram; the end is one word before the next line's.
    by_line = (
        "aggregate(by_line, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,n:int>>)),"
        " (a, x) -> named_struct('at', a.at + size(x), 'out', if(size(x) < 2, a.out,"
        " array_append(a.out, named_struct('s', a.at, 'n', size(x) - 1)))), a -> a.out)"
    )
    found = shaped.select(
        "doc_id",
        "n_lines",
        "b",
        "near",
        F.expr(
            "if(size(near) = 0, cast(array() as array<struct<s:int,n:int>>),"
            f" array_union({by_line}, array(named_struct('s', 0, 'n', size(b)))))"
        ).alias("spans"),
    ).select("doc_id", "n_lines", F.expr(f"array_sort({_matches(cut)})").alias("hits"))
    # Words s to e of a unit: it is apart from the last place if it starts later.
    places = (
        "aggregate(hits, named_struct('n', 0L, 'e', -1, 'dice', 0D), (a, x) -> case"
        " when x.s > a.e then named_struct('n', a.n + 1L, 'e', x.e, 'dice', x.dice)"
        " when x.dice > a.dice or (x.dice = a.dice and x.e > a.e)"
        " then named_struct('n', a.n, 'e', x.e, 'dice', x.dice) else a end, a -> a.n)"
    )
    best = "array_max(transform(hits, x -> named_struct('dice', x.dice, 'low', -x.template, 'licence', x.licence)))"
    return found.select(
        "doc_id",
        "n_lines",
        F.expr(places).alias("n_matched"),
        F.expr(best).alias("best"),
        F.expr("array_join(array_sort(array_distinct(transform(hits, x -> x.licence))), ',')").alias(
            "licences"
        ),
    ).select(
        "doc_id",
        "n_lines",
        "n_matched",
        F.col("best.licence").alias("licence"),
        F.col("best.dice").alias("dice"),
        "licences",
    )
