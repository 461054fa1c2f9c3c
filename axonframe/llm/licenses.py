"""Licence notices: MinHash bands over overlapping text windows fetch templates, exact shingle containment verifies."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored
from .license_texts import FULL_TEXTS

SHINGLE = 5
THRESHOLD = 0.8
#: Chance at most that a window holding enough of a template shares no band with it.
MISS = 1e-6
#: Longs at most of a filter of template words or shingles (2 MB), and bits that it sets for each. With over 260,000 shingles it lets more through; what it lets through is checked.
MOST_LONGS = 1 << 18
PROBES = 4
#: Notices that name a licence, and full texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    *FULL_TEXTS,
)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles_of(words: Column) -> Column:
    last = F.size(words) - SHINGLE
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<long>"))


@dataclass(frozen=True)
class Size:
    """How templates of ``least`` to ``most`` words are looked for: windows of
    ``window`` shingles, one every ``stride``, so that any place of a template lies
    whole in a window; bands of ``rows`` min-hashes."""

    least: int
    most: int
    stride: int
    window: int
    bands: int
    rows: int


def size_for(least: int, most: int, threshold: float = THRESHOLD, miss: float = MISS) -> Size:
    stride = max(1, least // 4)
    window = most - SHINGLE + stride
    own = least - SHINGLE + 1
    shared = math.ceil(threshold * own - 1e-9)
    jaccard = shared / (window + own - shared)
    for rows in (4, 3, 2, 1):
        bands = 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log1p(-(jaccard**rows)))
        if bands * rows <= 64 or rows == 1:
            return Size(least, most, stride, window, bands, rows)
    raise AssertionError


def sizes_for(lengths: list[int]) -> list[Size]:
    """Classes of template lengths, each at most a fifth longer than its shortest."""
    out: list[list[int]] = []
    for n in sorted(set(lengths)):
        if out and n <= 1.2 * out[-1][0]:
            out[-1].append(n)
        else:
            out.append([n])
    return [size_for(c[0], c[-1]) for c in out]


def bands_of(window: Column, size: Column) -> Column:
    """The band keys of a window of shingles, ``size`` being a struct like :class:`Size`."""

    def key(b: Column) -> Column:
        low = F.transform(F.sequence(F.lit(0), size["rows"] - 1), lambda r: F.array_min(F.transform(window, lambda h: F.xxhash64(h, b * size["rows"] + r))))
        return F.xxhash64(size["least"], b, low)

    return F.transform(F.sequence(F.lit(0), size["bands"] - 1), key)


def _bits(key: Column, longs: int) -> list[Column]:
    """The places of a key in a filter of so many longs, a power of two: steps of one half of the key from the other."""
    step = F.shiftrightunsigned(key, 33).bitwiseOR(1)
    return [(key.bitwiseAND(0x7FFFFFFF) + step * i).bitwiseAND(64 * longs - 1) for i in range(PROBES)]


def bits_of(keys: DataFrame) -> tuple[Column, int]:
    """A Bloom filter of the longs of ``keys`` (key), 64 bits a key or more up to MOST_LONGS in all: one constant array, and how many longs it has."""
    longs = 1 << min(int(math.log2(MOST_LONGS)), max(6, math.ceil(math.log2(max(1, keys.count())))))
    places = keys.select(F.explode(F.array(*_bits(F.col("key"), longs))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    rows = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    every = dict(zip(rows.column("at").to_pylist(), rows.column("bits").to_pylist()))
    # one literal that the optimizer turns into an array once, however many keys there are
    return F.split(F.lit(",".join(str(every.get(i, 0)) for i in range(longs))), ",").cast("array<bigint>"), longs


def may_hold(key: Column, bits: tuple[Column, int]) -> Column:
    """Whether ``key`` is in the filter; with 64 bits a key one in 80,000 others is taken for one that is."""
    array, longs = bits
    out = None
    for place in _bits(key, longs):
        word = F.get(array, F.shiftright(place, 6).cast("int"))
        on = F.call_function("shiftrightunsigned", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
        out = on if out is None else out & on
    return out


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents (doc_id, text) that hold a template (license, text): doc_id, license, containment.

    Containment is the greatest share of the template's distinct five-word shingles
    within one window. Null and empty texts, and texts and templates under five
    words, match nothing. Documents equal in id and text give one row a licence;
    null ids stay null; other columns are ignored; empty tables give an empty table.
    Templates stay a table: only the lengths that they have and a filter of a few
    bytes a shingle are in the plan, which is as long for any number of them.
    """
    spark: SparkSession = docs.sparkSession
    known = templates.select("license", words_of(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") >= SHINGLE)
    known = known.select("license", "w", F.size("w").alias("n"), F.array_distinct(shingles_of(F.col("w"))).alias("of"))
    known = stored(known, "templates")
    sizes = sizes_for([r.n for r in known.select("n").distinct().collect()])
    if not sizes:
        return spark.createDataFrame([], "doc_id long, license string, containment double")
    classes = F.array(*[F.struct(*[F.lit(getattr(s, k)).alias(k) for k in ("least", "most", "stride", "window", "bands", "rows")]) for s in sizes])
    # each shingle of a template has its longest word, so a document without any of these holds no shingle
    spans = F.transform(F.sequence(F.lit(0), F.col("n") - SHINGLE), lambda i: F.array_max(F.transform(F.slice("w", i + 1, SHINGLE), lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"])
    needed = bits_of(known.select(F.explode(spans).alias("word")).select(F.xxhash64("word").alias("key")).distinct())
    every = bits_of(known.select(F.explode("of").alias("key")).distinct())
    # stored, so that words and shingles are made once and not again for each use
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.exists(words_of(text), lambda w: may_hold(F.xxhash64(w), needed)))
    kept = stored(kept.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(text).alias("w")), "words")
    held = kept.select("doc_id", "text_hash", shingles_of(F.col("w")).alias("h"))
    held = held.withColumn("mark", F.transform("h", lambda h: may_hold(h, every))).where(F.exists("mark", lambda m: m))
    held = stored(held, "shingles")

    def windows(size: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size("h") - 1, size["stride"])
        some = F.filter(starts, lambda s: F.exists(F.slice("mark", s + 1, size["window"]), lambda m: m))
        return F.transform(some, lambda s: F.struct(s.alias("at"), size["window"].alias("size"), bands_of(F.slice("h", s + 1, size["window"]), size).alias("bands")))

    # of a window only its place and its bands go into the join; its shingles are fetched for those that meet a template
    cut = held.select("doc_id", "text_hash", F.explode(F.flatten(F.transform(classes, windows))).alias("x"))
    mine = cut.select("doc_id", "text_hash", "x.at", "x.size", F.explode("x.bands").alias("band"))
    own = F.filter(classes, lambda s: F.col("n").between(s["least"], s["most"]))[0]
    theirs = stored(known.withColumn("own", own).select("license", F.explode(bands_of(F.col("of"), F.col("own"))).alias("band")), "bands")
    pairs = mine.join(sized(theirs, 64), "band").select("doc_id", "text_hash", "at", "size", "license").distinct()
    pairs = stored(pairs, "candidates")
    fetched = held.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "h")
    window = F.slice("h", F.col("at") + 1, F.col("size"))
    checked = pairs.join(fetched, F.expr("doc_id <=> d and text_hash = t")).select("doc_id", "text_hash", "license", window.alias("window"))
    checked = checked.join(known.select("license", "of"), "license").select("doc_id", "text_hash", "license", F.expr("size(array_intersect(window, of)) / size(of)").alias("containment"))
    found = checked.where(F.col("containment") >= threshold)
    return found.groupBy("doc_id", "text_hash", "license").agg(F.max("containment").alias("containment")).select("doc_id", "license", "containment")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(templates=TEMPLATES) -> str:
    """What :func:`scan` returns, by comparing every window with every template."""
    import re

    lengths = {n: len(re.sub(r"[\W_]+", " ", t.lower()).split()) for n, t in templates}
    sizes = {n: next(s for s in sizes_for(list(lengths.values())) if s.least <= k <= s.most) for n, k in lengths.items()}
    values = ", ".join(f"({_literal(n)}, {_literal(t)}, {sizes[n].stride}, {sizes[n].window})" for n, t in templates)
    return rf"""
WITH t(license, text, stride, size) AS (VALUES {values}),
tw AS (SELECT *, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t),
ts AS (SELECT license, stride, size, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM tw),
dw AS (SELECT DISTINCT doc_id, text, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, text, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS h FROM dw WHERE len(w) >= 5),
hit AS (SELECT * FROM ds, ts WHERE list_has_any(h, s)),
win AS (SELECT doc_id, text, license, s, h, size, unnest(range(0, len(h), stride)) AS pos FROM hit)
SELECT doc_id, license, round(max(len(list_intersect(s, h[pos + 1:pos + size])) / len(s)), 9) AS containment
FROM win GROUP BY doc_id, text, license HAVING containment >= {THRESHOLD}
"""
