"""Licence notices by a positional rare-token index, in DataFrame functions only.

Document frequencies of the templates' words are counted over the whole corpus. The index
holds, for each template, its words of highest inverse document frequency with their positions.
A file's occurrences of such words, its own rarest licence words, look up the postings; what agrees in
relative position is intersected. Only for templates that the index has found at some offset are the
mandatory key phrases looked for, and a verified template whose rare weight is mostly covered is
reported. All of this is row-local: files are neither shuffled nor joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Fixed by the query's contract: phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Label, notice, mandatory key phrases (all must stand in the file). Words are lower case and bare, as
#: the scan reads them; the notices are those of the public licences.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted", "without restriction"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        ("in compliance with the license", "apache org licenses"),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4",),
    ),
    (
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    (
        "cc-by-nd",
        "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
        ("creative commons attribution noderivatives",),
    ),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    (
        "agpl-3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    (
        "epl-2",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        ("eclipse public license",),
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
        ("neither the name of", "endorse or promote products"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software",
        ("express or implied warranty", "in no event will the authors be held liable"),
    ),
    (
        "boost-1",
        "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt",
        ("boost software license",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software",
        ("free and unencumbered software",),
    ),
    (
        "ofl-1",
        "this font software is licensed under the sil open font license version 1 1",
        ("sil open font license",),
    ),
    (
        "odbl-1",
        "this database is made available under the open database license any rights in individual contents of the database "
        "are licensed under the database contents license",
        ("open database license",),
    ),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
#: Words of highest inverse document frequency that each template puts into the index.
RARE = 6
#: Share of a template's rare weight that must agree at one offset.
COVER = 0.6
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words of a text in lower case, each with a space on either side."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def word_statistics(norm: DataFrame, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each word of the templates, over all rows of ``norm(norm)``."""
    vocab = sorted({w for _, text, _ in templates for w in text.split()})
    held = F.array_intersect(F.split("norm", " "), F.array(*map(F.lit, vocab)))
    counts = norm.select(F.explode_outer(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    df = {r.w: r["count"] for r in counts}  # one row for each word of the templates at most
    return df.pop("", 0), {w: df.get(w, 0) for w in vocab}


def rare_postings(n: int, df: dict[str, int], templates=TEMPLATES, rare: int = RARE) -> list[tuple[int, str, int, float]]:
    """``(template, word, position, idf)``: the index, bounded by the templates."""
    from math import log

    idf = {w: log((n + 1) / (c + 0.5)) for w, c in df.items()}
    out = []
    for t, (_, text, _) in enumerate(templates):
        words = text.split()
        for w in sorted(set(words), key=lambda w: (-idf[w], w))[:rare]:
            out += [(t, w, p, idf[w]) for p, x in enumerate(words) if x == w]
    return out


def index_shares(places: Column, postings, templates: int, weight: dict[int, float]) -> Column:
    """For each template the largest share of its rare weight that agrees at one offset, 0 where nothing meets.

    ``places`` is the array ``struct<w, p>`` of a file's index words. Their postings give (template,
    offset, word) hits; sorted, each offset's hits stand together and are summed in one pass.
    """
    words = sorted({w for _, w, _, _ in postings})
    index = F.create_map(
        *(
            x
            for n, w in enumerate(words)
            for x in (
                F.lit(w),
                F.array(
                    *(
                        F.struct(F.lit(t).alias("t"), F.lit(at).alias("at"), F.lit(n).alias("n"), F.lit(idf).alias("idf"))
                        for t, w2, at, idf in postings
                        if w2 == w
                    )
                ),
            )
        )
    )
    hits = F.flatten(
        F.transform(
            places,
            lambda x: F.transform(
                F.try_element_at(index, x["w"]),
                lambda y: F.struct(y["t"].alias("t"), (x["p"] - y["at"]).alias("o"), y["n"].alias("n"), y["idf"].alias("idf")),
            ),
        )
    )
    none = F.lit(-1)
    zero = F.struct(none.alias("t"), F.lit(0).alias("o"), none.alias("n"), F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0.0), templates).alias("best"))

    def step(acc, x):
        here = (acc["t"] == x["t"]) & (acc["o"] == x["o"])
        total = F.when(here & (acc["n"] == x["n"]), acc["sum"]).when(here, acc["sum"] + x["idf"]).otherwise(x["idf"])
        best = F.when(acc["best"][x["t"]] >= total, acc["best"]).otherwise(F.transform(acc["best"], lambda b, i: F.when(i == x["t"], total).otherwise(b)))
        return F.struct(x["t"].alias("t"), x["o"].alias("o"), x["n"].alias("n"), total.alias("sum"), best.alias("best"))

    weights = F.array(*(F.lit(weight.get(t, 1.0)) for t in range(templates)))
    best = F.aggregate(F.sort_array(hits), zero, step, lambda acc: acc["best"])
    return F.transform(best, lambda b, i: F.least(F.lit(1.0), F.round(b / weights[i], 9)))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, rare: int = RARE, cover: float = COVER) -> DataFrame:
    """Licences per row of ``docs(doc_id, text)``.

    Returns ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.
    ``score`` is 1 where a phrase stands, else the best verified template's share of rare weight
    at one offset, else 0. A null text is empty; no words give zero counts, null places and
    empty labels. Repeated rows and null ids keep their rows, other columns are ignored, an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    norm = rows.select("doc_id", normalised(F.col("text")).alias("norm"))
    postings = rare_postings(*word_statistics(norm.select("norm"), templates), templates, rare)
    weight: dict[int, float] = {}
    for t, _, idf in {(t, w, idf) for t, w, _, idf in postings}:
        weight[t] = weight.get(t, 0.0) + idf

    count, first, last, base = [], [], [], []
    n_words = F.when(F.col("norm") == "  ", 0).otherwise(spaces(F.col("norm")) - 1)
    for phrase, label in phrases:
        has = F.contains("norm", F.lit(f" {phrase} "))
        parts = F.split("norm", f"(?<= ){phrase}(?= )", -1)
        count.append(F.when(has, F.size(parts) - 1).otherwise(0))
        first.append(F.when(has, spaces(parts[0]) - 1))
        last.append(F.when(has, n_words - (spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        base.append(F.when(has, F.lit(label)))
    one = lambda xs, f: xs[0] if len(xs) == 1 else f(*xs)
    # The index comes first: a file without any index word is done after one pass over its words.
    words = sorted({w for _, w, _, _ in postings})
    numbered = F.transform(F.split(F.trim("norm"), " "), lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    some = F.col("norm").rlike(f" (?:{'|'.join(words)}) ")
    places = F.when(some, F.filter(numbered, lambda x: F.array_contains(F.array(*map(F.lit, words)), x["w"])))
    found = norm.select(
        "doc_id",
        "norm",
        n_words.cast("long").alias("n_words"),
        reduce(lambda a, b: a + b, count).cast("long").alias("n_base"),
        one(first, F.least).cast("long").alias("first_word"),
        one(last, F.greatest).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*base)))).alias("base"),
        index_shares(places, postings, len(templates), weight).alias("shares"),
    )
    holds = lambda keys: reduce(lambda a, b: a & b, [F.contains("norm", F.lit(f" {p} ")) for p in keys])
    verified = F.array(*(F.when((F.col("shares")[t] > 0) & holds(keys), F.col("shares")[t]) for t, (_, _, keys) in enumerate(templates)))
    found = found.withColumn("verified", F.when(F.col("shares").isNotNull(), verified))
    labels = F.array(*(F.lit(label) for label, _, _ in templates))
    more = F.filter(F.transform("verified", lambda s, i: F.when(s >= cover, labels[i])), lambda x: x.isNotNull())
    more = F.coalesce(more, F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("verified"), F.lit(0.0))).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
