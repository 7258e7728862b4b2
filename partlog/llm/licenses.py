"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of letters and digits in lower case; a shingle is ``SHINGLE`` consecutive
words.  Every template is cut into pieces of at most ``PIECE`` words.  Texts are cut into
windows of ``WINDOW`` words that overlap so far that each run of ``PIECE`` words lies within
one whole.  A window and a piece share a band when one of ``BANDS`` hash functions takes its
smallest value over the shingles of both at the same shingle.  A piece of n words inside of
a window has a Jaccard similarity of at least j = (n - 2) / (WINDOW - 2), so all bands miss
it with probability (1 - j) ** BANDS, below 1e-7 from five words.  Shorter pieces, such as a
notice of three words, would be missed more often: they need no bands, since any of their
shingles retrieves them exactly.  Windows without any shingle of a template cannot share a
band, so they are left out before anything is hashed; this loses nothing.

Templates found this way are verified exactly: the share of the template's distinct
shingles that stand anywhere in the document, since a template may run over many windows.

All of it is DataFrame operations.  Texts do not move: only the shingle hashes of documents
with a hit go on.  The given templates travel with the plan, so their size is checked.

Defined results: null and empty texts hold nothing; templates with fewer words than a
shingle are rejected with an error; repeated rows are found as often as they stand there;
null ids stay; ties between templates all stay; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import written

SHINGLE = 3
PIECE = 12
WINDOW = 16
STEP = WINDOW - PIECE + 1
BANDS = 72
MISS = 1e-7  # pieces that all bands miss more often are retrieved exactly
THRESHOLD = 0.75
MAX_TEMPLATE_WORDS = 50_000

# Short notices as they stand in files, and first sentences of public texts.
# The headers of the GNU licenses share most words: a text that holds one may hold more than
# the threshold of another; ``best`` tells which one stands there.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the Software without"
        " restriction."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with"
        " or without fee is hereby granted."
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright.",
    "all-rights-reserved": "All rights reserved.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the"
        " terms of the GNU General Public License as published by the Free Software Foundation,"
        " either version"
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the"
        " terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation; either version"
    ),
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the"
        " terms of the GNU Affero General Public License as published by the Free Software"
        " Foundation, either version"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
        " If a copy of the MPL was not distributed with this file, You can obtain one at"
    ),
}


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda w: w != "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also for use inside of other lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingles_of(text: Column) -> Column:
    """Hashes of each ``SHINGLE`` consecutive words of a text, in order."""
    return let(words_of(text), _shingles)


def _shingles(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(SHINGLE)])
    )


def bands_of(shingles: Column) -> Column:
    """The smallest value of each hash function over the shingles; the seed is the band."""

    def smallest(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))

    return F.array(*[smallest(band) for band in range(BANDS)])


def _pieces(templates: DataFrame) -> DataFrame:
    """(template, piece, shingles) of each template."""
    words = templates.select("template", words_of(F.col("text")).alias("w"))
    short = words.where(F.size("w") < SHINGLE).head()
    if short is not None:
        raise ValueError(f"template {short['template']} has fewer than {SHINGLE} words")
    cut = words.select(
        "template",
        F.size("w").alias("n"),
        "w",
        F.explode(
            F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)), F.lit(PIECE - SHINGLE + 1))
        ).alias("start"),
    )
    return cut.select(
        "template", "start", let(F.slice("w", F.col("start") + 1, F.lit(PIECE)), _shingles).alias("s")
    )


def missed(shingles: int) -> float:
    """The most probable that all bands miss a piece of so many shingles in a window."""
    return (1 - shingles / (WINDOW - SHINGLE + 1)) ** BANDS


EXACT = max(n for n in range(WINDOW - SHINGLE + 1) if missed(n) > MISS)  # shingles, at most


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and template found: doc_id, template, containment, first_word, best.

    ``templates`` maps names to texts.  ``first_word`` counts the words of the document
    before the first window that retrieved the template.  ``best`` is false if all that the
    document has of the template also belongs to one that it holds more of, as when one of
    the GNU headers is found beside another.
    """
    spark = docs.sparkSession
    rows = sorted((TEMPLATES if templates is None else templates).items())
    given = spark.createDataFrame(rows, "template string, text string")
    total = sum(len(t.split()) for _, t in rows)
    if total > MAX_TEMPLATE_WORDS:  # the given list is what is broadcast
        raise ValueError(f"{total} words of templates, more than {MAX_TEMPLATE_WORDS}; scan in parts")
    pieces = written(_pieces(given), "license-pieces")
    whole = written(
        given.select("template", F.array_distinct(shingles_of(F.col("text"))).alias("all")),
        "license-templates",
    )
    wanted = pieces.select(F.explode("s").alias("s")).distinct()  # at most as many as words
    known = sorted(r["s"] for r in wanted.collect())

    # Keep documents with a shingle of some template, and the places where one stands.
    # Arrays of one element keep the optimiser from computing a column again in a filter.
    texts = docs.select("doc_id", F.explode(F.array(shingles_of(F.col("text")))).alias("s"))
    at = F.filter(
        F.transform(F.col("s"), lambda s, i: F.when(s.isin(known), i)), lambda i: i.isNotNull()
    )
    hit = texts.select("doc_id", "s", F.explode(F.array(at)).alias("at")).where(F.size("at") > 0)
    hit = written(hit.withColumn("row", F.monotonically_increasing_id()), "license-hits")

    # Windows start at multiples of STEP; these are the ones that hold a hit.
    reach = WINDOW - SHINGLE
    first = lambda i: F.greatest(F.ceil((i - reach) / F.lit(STEP)), F.lit(0)).cast("int")
    last = lambda i: F.floor(i / F.lit(STEP)).cast("int")
    numbers = F.array_distinct(
        F.flatten(F.transform("at", lambda i: F.sequence(first(i), F.greatest(first(i), last(i)))))
    )
    windows = hit.select("row", F.explode(numbers).alias("window"), "s").select(
        "row",
        (F.col("window") * STEP).alias("start"),
        F.slice("s", F.col("window") * STEP + 1, F.lit(reach + 1)).alias("s"),
    )
    signed = windows.where(F.size("s") > 0).select(
        "row", "start", F.posexplode(let(F.col("s"), bands_of)).alias("band", "value")
    )
    asked = pieces.where(F.size("s") > EXACT).select(
        "template", F.posexplode(let(F.col("s"), bands_of)).alias("band", "value")
    )
    by_band = signed.join(F.broadcast(asked.distinct()), ["band", "value"])  # BANDS a piece
    # Short pieces: by any of their shingles, at the first window that holds it.
    short = pieces.where(F.size("s") <= EXACT).select("template", F.explode("s").alias("value")).distinct()
    listed = sorted({r["value"] for r in short.collect()})  # a part of the known ones
    exact = F.filter("at", lambda i: F.get("s", i).isin(listed))
    at_once = (
        hit.select("row", "s", F.explode(exact).alias("i"))
        .select("row", (first(F.col("i")) * STEP).alias("start"), F.get("s", F.col("i")).alias("value"))
        .join(F.broadcast(short), "value")
    )
    found = ("row", "start", "template")
    retrieved = (
        by_band.select(*found)
        .unionByName(at_once.select(*found))
        .groupBy("row", "template")
        .agg(F.min("start").alias("first_word"))
    )
    # A template may run over several windows: look at all of the document's shingles.
    held = hit.select("row", "doc_id", F.array_distinct("s").alias("s"))
    verified = retrieved.join(F.broadcast(whole), "template").join(held, "row")
    matched = F.array_intersect("all", "s")
    verified = verified.withColumn("matched", matched)
    verified = verified.withColumn("containment", F.size("matched") / F.size("all"))
    # A document's templates together: at most as many as there are templates.
    one = F.struct("template", "containment", "first_word", "matched")
    each = (
        verified.where(F.col("containment") >= threshold)
        .groupBy("row", "doc_id")
        .agg(F.collect_list(one).alias("found"))
    )

    def judged(x: Column) -> Column:
        inside = lambda o: F.size(F.array_except(x["matched"], o["matched"])) == 0
        better = F.exists("found", lambda o: (o["containment"] > x["containment"]) & inside(o))
        return F.struct(*[x[c].alias(c) for c in ("template", "containment", "first_word")], (~better).alias("best"))

    return each.select("doc_id", F.inline(F.transform("found", judged)))
