"""License scans with a positional index of rare template words.

The highest-IDF words of each license notice are indexed with their positions. Each file looks up every
indexed word it holds; every posting votes for the offset of its template in the file, and postings that agree on the offset
are the intersection by relative position. A template with enough votes is reported if its key phrase stands in the
file and no other template that shares its words agrees better at the same place. Document frequencies are counted over all documents; the rest is SQL expressions over one document.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import fresh

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label) of the plain search.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: (label, notice, mandatory key phrase) of the index, in words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license", "attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("apache", "spdx license identifier apache 2 0", "license identifier apache 2 0"),
    ("bsd", "spdx license identifier bsd 3 clause", "license identifier bsd"),
    ("gpl", "spdx license identifier gpl 2 0 only", "license identifier gpl"),
    ("lgpl", "spdx license identifier lgpl 2 1 only", "license identifier lgpl"),
    ("mpl", "spdx license identifier mpl 2 0", "license identifier mpl"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
#: Words of a template that are indexed, at most; least share of votes.
INDEXED = 6
LEAST_SHARE = 0.5


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), lambda v: use(v))[0]


def license_words(text: Column) -> Column:
    """Words of ASCII digits and letters (A–Z lower-cased) and non-ASCII characters; null has none."""
    # the two letters whose lower case is or holds an ASCII letter stay foreign
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[İK]", "é"))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def template_vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """How many documents hold each template word, and how many documents there are."""
    vocabulary = template_vocabulary()
    held = F.array_intersect(license_words(F.col(f"`{text_col}`")), F.array(*map(F.lit, vocabulary)))
    # one more element counts the document itself
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}  # as many rows as the templates have words
    return {w: found.get(w, 0) for w in vocabulary}, found.get("", 0)


def _index(df: dict[str, int], n: int) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, position) of the indexed words and the number of postings of each template."""
    idf = {w: log((n + 1) / (c + 1)) for w, c in df.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        most = min(INDEXED, (len(words) + 1) // 2)
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:most]
        at = [(w, p) for p, w in enumerate(words) if w in rare]
        for w, p in at:
            postings.setdefault(w, []).append((t, p))
        sizes.append(len(at))
    return postings, sizes


def _rivals(postings: dict[str, list[tuple[int, int]]], sizes: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each template the others (template, shift) of another label that get half the votes or more where it gets half of
    its own: at offset o + shift if it stands at o."""
    shared: dict[tuple[int, int, int], int] = {}
    for at in postings.values():
        for t, p in at:
            for u, q in at:
                if TEMPLATES[t][0] != TEMPLATES[u][0]:
                    shared[t, u, p - q] = shared.get((t, u, p - q), 0) + 1
    found: dict[int, list[tuple[int, int]]] = {}
    for (t, u, shift), n in sorted(shared.items()):
        if n >= LEAST_SHARE * sizes[t]:
            found.setdefault(t, []).append((u, shift))
    return found


def _n_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(line: Column, n_words: Column, phrase: str) -> Column:
    """Number of places of a phrase in the words of ``line`` (spaces around each), first and last start."""
    size = len(phrase.split())
    gaps = F.split(line, f"(?<= ){phrase}(?= )")
    found = _once(
        gaps,
        lambda g: F.struct(
            (F.size(g) - 1).cast("long").alias("n"),
            (_n_spaces(g[0]) - 1).cast("long").alias("first"),
            (n_words - (_n_spaces(F.element_at(g, -1)) - 1) - size).cast("long").alias("last"),
        ),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(line.contains(f" {phrase} "), found).otherwise(none)


def _runs(votes: Column) -> Column:
    """Equal neighbours of sorted votes as (template, offset, how many)."""
    ends = F.filter(
        F.transform(votes, lambda v, i: F.struct(v["t"].alias("t"), v["off"].alias("off"), (i + 1).alias("end"), (~F.get(votes, i + 1).eqNullSafe(v)).alias("last"))),
        lambda x: x["last"],
    )
    size = lambda e, x, i: x["end"] - F.coalesce(F.get(e, i - 1)["end"], F.lit(0))
    return _once(ends, lambda e: F.transform(e, lambda x, i: F.struct(x["t"].alias("t"), x["off"].alias("off"), size(e, x, i).alias("n"))))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a plain phrase, else the largest share of a verified template's indexed words that agree on one
    offset; 0 with no license. A null text has no words.
    """
    postings, sizes = _index(*document_frequency(docs, text_col))
    index = F.create_map(
        *[
            x
            for w, at in postings.items()
            for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in at]))
        ]
    )
    names = [fresh([id_col], x) for x in ("words", "line", "places", "best")]
    words, line, places, best = names
    df = docs.select(F.col(f"`{id_col}`"), license_words(F.col(f"`{text_col}`")).alias(words))
    df = df.withColumn(line, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))

    def votes(known: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(known, x["w"]))
        voted = F.transform(
            at, lambda x: F.transform(index[x["w"]], lambda y: F.struct(y["t"].alias("t"), (x["i"] - y["p"]).alias("off")))
        )
        return F.sort_array(F.flatten(voted))

    held = F.array_intersect(F.col(words), F.array(*map(F.lit, postings)))

    rivals = _rivals(postings, sizes)

    def shares(runs: Column) -> Column:
        """(score, label) of the templates that are verified and keep a place of their own."""

        def of(t: int) -> Column:
            """Runs of a template with votes enough, none without its key phrase."""
            enough = F.filter(runs, lambda r: (r["t"] == t) & (r["n"] >= LEAST_SHARE * sizes[t]))
            return F.when(F.col(line).contains(f" {TEMPLATES[t][2]} "), enough).otherwise(F.slice(runs, 1, 0))

        def left(mine: Column, u: int, shift: int, t: int) -> Column:
            """Runs of ``t`` at whose place ``u`` has no larger share, nor an equal one of a longer notice."""
            longer = len(TEMPLATES[u][1].split()) > len(TEMPLATES[t][1].split())
            beats = lambda n, m: (n * sizes[t] >= m * sizes[u]) if longer else (n * sizes[t] > m * sizes[u])
            free = lambda at: F.filter(mine, lambda r: ~F.coalesce(beats(at[r["off"] + shift], r["n"]), F.lit(False)))
            places_of = lambda o: F.map_from_arrays(F.transform(o, lambda r: r["off"]), F.transform(o, lambda r: r["n"]))
            return F.when(F.size(mine) == 0, mine).otherwise(_once(_once(of(u), places_of), free))

        out = []
        for t, (label, _, _) in enumerate(TEMPLATES):
            mine = of(t)
            for u, shift in rivals.get(t, []):
                mine = _once(mine, lambda m, u=u, shift=shift, t=t: left(m, u, shift, t))
            n = F.coalesce(F.array_max(F.transform(mine, lambda r: r["n"])), F.lit(0))
            out.append(F.struct(F.least(n / F.lit(float(sizes[t])), F.lit(1.0)).alias("score"), F.lit(label).alias("label")))
        return F.filter(F.array(*out), lambda x: x["score"] >= LEAST_SHARE)

    found = _once(_once(held, votes), lambda v: _once(_runs(v), shares))
    none = F.array().cast("array<struct<score:double,label:string>>")
    n = F.size(words)
    df = df.withColumns(
        {
            places: F.array(*[_places(F.col(line), n, p) for p, _ in PHRASES]),
            best: F.when(F.size(held) > 0, found).otherwise(none),
        }
    )
    at = F.col(places)
    base = F.filter(F.array(*[F.when(at[k]["n"] > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    return df.select(
        id_col,
        n.cast("long").alias("n_words"),
        sum((at[k]["n"] for k in range(1, len(PHRASES))), at[0]["n"]).alias("n_base"),
        F.least(*[at[k]["first"] for k in range(len(PHRASES))]).alias("first_word"),
        F.greatest(*[at[k]["last"] for k in range(len(PHRASES))]).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.transform(best, lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform(best, lambda x: x["score"])), F.lit(0.0)))
        .alias("score"),
    )
