"""License scan by MinHash bands over overlapping text windows (DataFrame functions only).

Texts and templates are lower-cased, cut into words at white space and ASCII punctuation, and read as hashes
of five-word shingles. Templates are grouped by size: a group holds templates of up to M shingles (M a power
of two). For each group every text is cut into windows of 2M shingles, one every M, so that an occurrence of a
template lies wholly within a window.

Windows and templates have MinHash signatures by one permutation: shingle hashes are dealt into `BINS` = 64 bins, and the least of
each bin is a band of one row. A bin agrees with a probability of the similarity J of the two sets. Templates fill over half
of M and match in 80 % or more, so J is over 0.8 * 0.5 / 2.1 = 0.19, and of 64 bands one agrees with a probability of
1 - 0.81^64, which is over 0.999998. Bands of more rows would need similar sets, which a window and a template within are not.
For groups of up to SMALL = 16 shingles, whose windows have 32, every shingle is a band, and the probability is 1.

A retrieved pair of window and template is verified once: the share of the template's shingles, as text, that the window
contains must be `threshold` = 0.8 or more. The template index is a constant of this module or an argument, collected
on the driver by nature; it is broadcast up to `MAX_INDEX` bands and shuffled beyond.

Edge cases: null text is empty; texts of fewer than five words have no shingle and no result; templates of
fewer than five words are refused; very long texts give more windows, not longer ones; repeated rows give
repeated results (rows are told apart by place); null ids are kept; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BINS, SMALL, MAX_INDEX = 5, 64, 16, 200_000
#: ASCII white space and punctuation.
BREAKS = r"[\s!-/:-@\[-`{-~]+"

#: Names and texts of license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
)


def shingles(text: str) -> list[str]:
    """The distinct shingles of a template."""
    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w]
    if len(words) < WORDS:
        raise ValueError(f"a template needs {WORDS} words: {text!r}")
    return sorted({" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)})


def signature(hashes: Column, m: int | Column) -> Column:
    """The bands of a set of shingle hashes in group m: the least hash of each bin, or all of them in a small group."""
    if isinstance(m, int) and m <= SMALL:
        return F.array_distinct(hashes)
    # The bin in the highest bits, the rest of the hash below: sorted, the first of each bin is its least.
    binned = F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), 57).bitwiseOR(F.shiftrightunsigned(h, 7)))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 57) != F.shiftright(F.get(s, i - 1), 57)))
    return F.get(F.transform(F.array(F.sort_array(binned)), first), F.lit(0))


def window(m: int):
    """Of the first shingle of a window: its bands and its words."""
    return lambda i: F.struct(F.lit(m).alias("m"), i.alias("at"), signature(F.slice("h", i + 1, F.lit(2 * m)), m).alias("bands"), F.slice("words", i + 1, F.lit(2 * m + WORDS - 1)).alias("words"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """A row for each document and license found: doc_id, license, matched (shingles contained) and shingles of the best template and window, n_windows."""
    spark = docs.sparkSession
    sets = [shingles(t) for _, t in templates]
    group = [max(SMALL, 1 << (len(s) - 1).bit_length()) for s in sets]
    known = spark.createDataFrame([(g, k, name, s) for k, (g, (name, _), s) in enumerate(zip(group, templates, sets, strict=True))], "m int, template int, license string, wanted array<string>")
    # The hash of a shingle is that of the hashes of its words.
    hashed = F.transform("wanted", lambda x: F.xxhash64(*[F.xxhash64(F.get(F.split(x, " "), F.lit(i))) for i in range(WORDS)]))
    bands = F.when(F.col("m") <= SMALL, signature(hashed, SMALL)).otherwise(signature(hashed, 2 * SMALL))
    index = known.select("m", "template", F.explode(bands).alias("band"))
    # Templates have as many bands as shingles at most.
    small = sum(map(len, sets)) <= MAX_INDEX
    side = F.broadcast if small else lambda df: df

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), BREAKS, -1), "").alias("words"))
    rows = rows.filter(F.size("words") >= WORDS).withColumn("w", F.transform("words", lambda x: F.xxhash64(x)))
    at = lambda i: [F.get(F.col("w"), i + k) for k in range(WORDS)]
    rows = rows.withColumn("h", F.transform(F.sequence(F.lit(0), F.size("w") - WORDS), lambda i: F.xxhash64(*at(i)))).drop("w")
    # The windows of all groups together, so that each text is cut into words once.
    starts = lambda m: F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - 1), F.lit(m))
    windows = rows.select("row", "doc_id", F.explode(F.concat(*[F.transform(starts(m), window(m)) for m in sorted(set(group))])).alias("x"))
    windows = windows.select("row", "doc_id", "x.m", "x.at", "x.words", F.explode("x.bands").alias("band"))
    # Few windows share a band with a template; those that share several are verified once.
    found = windows.join(side(index), ["m", "band"]).drop("band").dropDuplicates(["row", "m", "at", "template"]).join(side(known.drop("m")), "template")
    texts = F.transform(F.sequence(F.lit(0), F.size("words") - WORDS), lambda i: F.array_join(F.slice("words", i + 1, F.lit(WORDS)), " "))
    contained = F.size(F.array_intersect("wanted", texts))
    found = found.filter(F.size("words") >= WORDS).select("row", "doc_id", "m", "at", "license", contained.alias("matched"), F.size("wanted").alias("shingles"))
    found = found.filter(F.col("matched") >= F.ceil(F.lit(threshold) * F.col("shingles")))
    best = found.groupBy("row", "license").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.struct((F.col("matched") / F.col("shingles")).alias("share"), "matched", "shingles")).alias("best"), F.count_distinct("m", "at").alias("n_windows")
    )
    return best.select("doc_id", "license", F.col("best.matched").cast("bigint").alias("matched"), F.col("best.shingles").cast("bigint").alias("shingles"), "n_windows")
