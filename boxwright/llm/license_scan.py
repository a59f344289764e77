"""License notices in texts: MinHash bands over word windows, then exact containment. DataFrame operations only.

1. Templates are put into classes by their number of shingles.  For each class a
   text's five-word shingles are cut into windows of twice the longest template
   of the class, each overlapping the next by half, so that a notice as long as
   its template lies whole in one window.
2. A window's sketch has the least of its shingles' hashes in each of 2^bits
   buckets (their first bits): MinHash with one permutation, each bucket a band
   of one value.  Templates have sketches of the same kind.
3. Windows and templates with an equal band meet.  The number of bits is the
   least with which a template is missed with at most the stated probability:
   its value in a bucket is the window's too, unless the window lacks that
   shingle or another one's hash is less (``miss_bound``).
4. Each retrieved (window, template) pair is verified by exact containment: the
   share of the template's shingles that the window holds.

Only windows that hold a shingle whose hash is some template's band can have a
band in common with one.  A bitmap of the templates' bands, 1024 bits for each,
marks such places of a text in one pass, so that other windows need no sketch.
Nothing but retrieved windows is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.session import checkpoint_dir

#: Shingles of a class' templates that are broadcast (8 bytes each); with more of them Spark chooses the join.
BROADCAST_SHINGLES = 1_000_000

# fixed values: short public license notices, by name
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; an empty array for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; of fewer words, the whole run's one."""
    n = F.size(words)
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), run)).otherwise(F.array().cast("array<bigint>"))


def miss_bound(places: list[float], n: int, containment: float, others: int) -> float:
    """The probability with which a template is missed, at most.

    ``places``: where in its bucket each of the template's bands lies, as a share
    of all hashes; ``n``: its shingles; ``others``: shingles of a window.  A band
    that the window holds is found if none of the others falls before it in its
    bucket.  Of the shingles that may lack, either the most useful ones lack, or
    (as their hashes are random) any; the lesser of the two bounds holds.
    """
    held = math.ceil(containment * n - 1e-9)
    lost = sorted(-math.expm1(others * math.log1p(-x)) for x in places)
    worst = math.prod(lost[n - held :]) if len(lost) > n - held else 1.0
    return min(worst, math.prod(1 - held / n * (1 - q) for q in lost))


def bands_of(shingles: set[int], bits: int) -> list[int]:
    """The least hash in each bucket."""
    least: dict[int, int] = {}
    for h in sorted(shingles):
        least.setdefault(h >> 64 - bits, h)
    return sorted(least.values())


def _bits(templates: list[set[int]], containment: float, miss: float, others: int) -> int:
    for bits in range(4, 48):
        share = lambda h: (h & (1 << 64 - bits) - 1) / 2**64  # noqa: B023, E731
        if all(miss_bound([share(h) for h in bands_of(t, bits)], len(t), containment, others) <= miss for t in templates):
            return bits
    return 48


def _marked(values: list[int]) -> Callable[[Column], Column]:
    """A test that all of the values pass, and about one in 1024 others."""
    width = max(10, (1024 * len(values)).bit_length())
    words = [0] * (1 << width - 5)
    for v in values:
        at = v & (1 << width) - 1
        words[at >> 5] |= 1 << (at & 31)
    bitmap = F.from_json(F.lit(str(words)), "array<bigint>")  # one constant, folded once

    def test(s: Column) -> Column:
        at = s.bitwiseAND(F.lit((1 << width) - 1))
        word = F.get(bitmap, F.shiftright(at, 5).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    containment: float = 0.8,
    miss: float = 1e-6,
) -> DataFrame:
    """doc_id, license, containment, first_word and n_words (of the window) of every license found in a text.

    A license is in a text if some window holds at least ``containment`` of its
    template's distinct shingles of ``size`` words.  One row per text and
    license: the window with the highest containment, then the first.
    Templates shorter than ``size`` words are one shingle of all their words,
    and are sought as such in the text.

    Null, empty and wordless texts hold nothing.  Null ids are kept as null.
    Every row of ``docs`` has its own rows, whether its id is null or repeated.  Texts of any
    length are scanned whole.  No templates or no rows: no rows.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    templates = TEMPLATES if templates is None else templates
    listed = F.array(*[F.struct(F.lit(x).alias("license"), F.lit(t).alias("text")) for x, t in sorted(templates.items()) or [("", "")]])
    named = spark.range(1).select(F.inline(listed)).select("license", words_of(F.col("text")).alias("w"))
    sized = {r.license: r.n for r in named.select("license", F.size("w").alias("n")).collect() if r.n}
    if not sized:
        return spark.range(0).selectExpr("id AS doc_id", "'' AS license", "0D AS containment", "0 AS first_word", "0 AS n_words")
    # a class holds templates up to four times the shortest; those of less than ``size`` words need shingles of their own length
    classes: dict[int, dict[int, list[str]]] = {}
    for x, n in sized.items():
        k = min(n, size)
        classes.setdefault(k, {}).setdefault((n - k + 1).bit_length() // 2, []).append(x)
    parts = [_scan(docs, named, sized, list(c.values()), id_col, text_col, k, containment, miss) for k, c in sorted(classes.items())]
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("at"), "n_words"))
    return (
        reduce(DataFrame.union, parts)
        .groupBy("row", "doc_id", "license")
        .agg(best.alias("b"))
        .select("doc_id", "license", "b.containment", (-F.col("b.at")).cast("int").alias("first_word"), F.col("b.n_words").cast("int").alias("n_words"))
    )


def _scan(docs: DataFrame, named: DataFrame, sized: Mapping[str, int], classes: list[list[str]], id_col: str, text_col: str, size: int, containment: float, miss: float) -> DataFrame:
    """The verified windows of all classes of templates with shingles of one length."""
    spark = docs.sparkSession
    mine = [x for names in classes for x in names]
    known = named.filter(F.col("license").isin(mine)).select("license", F.explode(F.array_distinct(shingles_of(F.col("w"), size))).alias("s"))
    of: dict[str, set[int]] = {}
    for r in known.collect():  # the templates' shingles: as long as the templates, whatever the corpus
        of.setdefault(r.license, set()).add(r.s)
    steps = [max(sized[x] for x in names) for names in classes]  # windows of 2 x step shingles start at every step-th word
    bits = [_bits([of[x] for x in names], containment, miss, 2 * step) for names, step in zip(classes, steps, strict=True)]
    rows = [(c, x, v) for c, names in enumerate(classes) for x in names for v in bands_of(of[x], bits[c])]
    bands = spark.createDataFrame(rows, "cls int, license string, value bigint")
    sets = spark.createDataFrame([(x, sorted(t)) for x, t in sorted(of.items())], "license string, set array<bigint>")
    if sum(len(t) for t in of.values()) <= BROADCAST_SHINGLES:
        bands, sets = F.broadcast(bands), F.broadcast(sets)
    marked = _marked([v for *_, v in rows])

    def sketch(window: Column, bits: int) -> Column:
        """The marked ones of a window's bands."""
        bucket = lambda s: F.shiftright(s, 64 - bits)
        return F.element_at(F.transform(F.array(F.sort_array(window)), lambda o: F.filter(o, lambda s, i: marked(s) & ((i == 0) | (bucket(F.get(o, i - 1)) != bucket(s))))), 1)

    def sketches(c: int) -> Column:
        """Windows of a class with a marked place, each with its bands."""
        step = steps[c]
        last = F.greatest(F.ceil(F.size("s") / step).cast("int") - 2, F.lit(0))
        around = F.transform("places", lambda i: F.floor(i / step).cast("int"))
        numbers = F.filter(F.array_distinct(F.concat(around, F.transform(around, lambda k: k - 1))), lambda k: (k >= 0) & (k <= last))
        return F.transform(numbers, lambda k: F.struct(F.lit(c).alias("cls"), F.lit(step).alias("step"), k.alias("window"), sketch(F.slice("s", k * step + 1, F.lit(2 * step)), bits[c]).alias("bands")))

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("w"))
    hashed = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").alias("n"), shingles_of(F.col("w"), size).alias("s"))
    placed = hashed.withColumn("places", F.array_compact(F.transform("s", lambda s, i: F.when(marked(s), i))))
    cut = F.filter(F.concat(*[sketches(c) for c in range(len(classes))]), lambda x: F.size(x["bands"]) > 0)
    windows = (
        # outer, then a filter: for an inner one Spark would compute the sketches a second time
        placed.select("row", "doc_id", "n", "s", F.explode_outer(cut).alias("x"))
        .filter("x is not null")
        .select("row", "doc_id", "n", "x.cls", "x.step", "x.window", F.slice("s", F.col("x.window") * F.col("x.step") + 1, 2 * F.col("x.step")).alias("held"), F.explode("x.bands").alias("value"))
    )
    found = windows.join(bands, ["cls", "value"]).select("row", "doc_id", "n", "window", "step", "held", "license").distinct()
    first = F.col("window") * F.col("step")
    return (
        found.join(sets, "license")
        .withColumn("containment", F.size(F.array_intersect("held", "set")) / F.size("set"))
        .filter(F.col("containment") >= containment)
        .select("row", "doc_id", "license", "containment", first.cast("int").alias("first_word"), F.least(2 * F.col("step"), F.col("n") - first).cast("int").alias("n_words"))
    )
