"""License scans: MinHash bands over text windows find templates, shingle containment verifies them. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import written_once

#: Words of a shingle, and the share of a template's shingles that a window must hold.
SHINGLE, CONTAINED = 5, 0.8

#: Short public notices and the openings of public license texts.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "apache-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


@dataclass(frozen=True)
class Size:
    """A class of templates by their number of shingles, and how they are looked for.

    A window holds ``window`` shingles and starts at every ``stride``-th, so a
    text of up to window - stride shingles lies whole in one. Its least hash
    within each of ``bands`` classes of hashes is a band of one row. A shared
    shingle is the least of its class unless another of the window's falls
    below it: with 24 shingles over 8192 classes each shared one collides with
    probability over 0.998, and with 320 over 128 one of the at least 24 that a
    contained text of 30 shares does with more than 1 - 0.68**24 = 0.9999.
    """

    name: str
    most: int
    window: int
    stride: int
    bands: int


SIZES = (Size("short", 16, 24, 8, 8192), Size("long", 256, 320, 64, 128))
#: Shingles of all templates up to which their tables are copied to every task.
COPIED = 200_000


def size_for(shingles: int) -> Size:
    """The class of a template with so many shingles; beyond the last one each is four times as large as the one before.

    The 205 or more shared shingles of a contained text of 257 make one of the
    128 bands collide with more than 1 - (1 - 205 / 1331)**128 > 1 - 1e-9.
    """
    for size in SIZES:
        if shingles <= size.most:
            return size
    while shingles > size.most:
        size = Size(f"long{4 * size.most}", 4 * size.most, 4 * size.window, 4 * size.stride, size.bands)
    return size


def _normal(text: str) -> str:
    """SQL: letters in lower case, all but letters and digits one space."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"trim(regexp_replace(translate({text}, '{upper}', '{lower}'), '[^a-z0-9]+', ' '))"


def template_shingles(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """The distinct shingles of each template; one with fewer than a shingle's words is refused."""
    out = {}
    for name, text in templates.items():
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has {len(words)} words")
        out[name] = list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))
    return out


def cover_words(shingles: list[str], contained: float) -> set[str]:
    """Words in more than the share of the shingles that may be missing: a match holds one of them.

    Long words first, as they are rarer. Lossless: with all shingles that hold
    such a word gone, too few are left.
    """
    words: set[str] = set()
    while sum(not words.isdisjoint(s.split()) for s in shingles) <= len(shingles) * (1 - contained) + 1e-9:
        left = [s for s in shingles if words.isdisjoint(s.split())]
        words.add(max({w for s in left for w in s.split()}, key=lambda w: (min(len(w), 7), sum(w in s.split() for s in left), w)))
    return words


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Templates that a window of a document's text holds: doc_id, license_id, n_shingles, n_found, containment.

    1. Only texts with one of the templates' cover words can match; others are
       filtered in the scan. Texts become arrays of shingle hashes, once.
    2. Windows around cover words are taken in the sizes of the templates, two
       for notices and openings, larger ones for whole texts. Each window's shingles
       are dealt into classes by hash; the least of each class is a band.
    3. Bands equal to a template's give candidates, one per document and
       template. The template tables are copied to the tasks if they have at
       most ``COPIED`` shingles, else they are joined like any other.
    4. A candidate is verified over all its windows of that size: ``n_found`` is
       the greatest number of the template's distinct shingles in one window,
       and containment is its share of ``n_shingles``.

    Everything is done per document in the DataFrame engine; the shuffles are by
    document and window, so no template or phrase, however common, gathers in a
    task. Null and empty texts hold nothing; a very long
    text is one array of its words and one of its shingles, several times its
    size, in a task; rows that repeat doc_id and text
    give one result; a null doc_id is kept as null. No documents, or none with a
    license, give an empty result.
    """
    spark = docs.sparkSession
    shingles = template_shingles(templates)
    covers = {name: cover_words(s, contained) for name, s in shingles.items()}
    size_of = {name: size_for(len(s)) for name, s in shingles.items()}
    table = _template_table(spark, shingles, size_of)
    words = sorted(set().union(*covers.values()))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(
        F.col("text").rlike("(?i)(" + "|".join(words) + ")")
    )
    arrays = texts.select("doc_id", F.xxhash64("text").alias("text_key"), F.expr(f"split({_normal('text')}, ' ')").alias("words"))
    arrays = arrays.where(F.size("words") >= SHINGLE).withColumn(
        "shingles",
        F.expr(
            f"transform(sequence(0, size(words) - {SHINGLE}), "
            "i -> concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))"
        ),
    )
    spots = {z: "|".join(sorted(set().union(*(covers[n] for n in covers if size_of[n] == z)))) for z in set(size_of.values())}
    copied = F.broadcast if sum(map(len, shingles.values())) <= COPIED else lambda df: df
    found = []
    for z in sorted(spots, key=lambda z: z.most):
        # Windows that hold a shingle with a cover word.
        starts = (
            f"array_distinct(flatten(transform(filter(sequence(0, size(shingles) - 1), "
            f"i -> shingles[i] rlike '(^| )({spots[z]})( |$)'), "
            f"i -> sequence(greatest(0, i div {z.stride} - {z.window // z.stride - 1}), i div {z.stride}))))"
        )
        found.append(arrays.select(
            "doc_id", "text_key", F.lit(z.name).alias("size"), F.expr(f"explode({starts})").alias("w"),
            F.lit(z.stride).alias("stride"), F.lit(z.window).alias("width"), F.lit(z.bands).alias("bands"),
            F.col("shingles"),
        ).select(
            "doc_id", "text_key", "size", "w", "bands",
            F.expr("transform(slice(shingles, cast(w * stride + 1 as int), width), s -> xxhash64(s))").alias("window"),
        ))
    windows = found[0]
    for more in found[1:]:
        windows = windows.union(more)
    windows = written_once(windows.distinct(), "licenses")
    bands = (
        windows.select("doc_id", "text_key", "size", "w", "bands", F.explode("window").alias("h"))
        .groupBy("doc_id", "text_key", "size", "w", F.expr("pmod(h, bands)").alias("band")).agg(F.min("h").alias("h"))
    )
    sign = table.groupBy("license_id", "size", F.expr("pmod(h, bands)").alias("band")).agg(F.min("h").alias("h"))
    candidates = bands.join(copied(sign), ["size", "band", "h"]).select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("size").alias("class"), "license_id"
    ).distinct()
    whole = table.groupBy("license_id").agg(F.collect_set("h").alias("all"))
    same = F.expr("doc_id <=> id AND text_key = key AND size = class")
    return (
        windows.join(candidates, same)
        .join(copied(whole), "license_id")
        .groupBy("doc_id", "text_key", "license_id")
        .agg(F.first(F.size("all")).alias("n_shingles"), F.max(F.size(F.array_intersect("window", "all"))).alias("n_found"))
        .where(F.col("n_found") >= F.lit(contained) * F.col("n_shingles"))
        .groupBy("doc_id", "license_id").agg(F.max("n_shingles").cast("long").alias("n_shingles"), F.max("n_found").cast("long").alias("n_found"))
        .withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    )


def _template_table(spark: SparkSession, shingles: Mapping[str, list[str]], size_of: Mapping[str, Size]) -> DataFrame:
    """One row per template and shingle: license_id, size, bands and hash."""
    rows = [(name, size_of[name].name, size_of[name].bands, s) for name, many in shingles.items() for s in many]
    return spark.createDataFrame(rows, "license_id string, size string, bands int, s string").select(
        "license_id", "size", "bands", F.xxhash64("s").alias("h")
    )


def license_sql(templates: Mapping[str, str] = TEMPLATES, contained: float = CONTAINED) -> str:
    """The same result by comparing every shingle of every text with every template, in SQL."""
    shingles = template_shingles(templates)
    size_of = {name: size_for(len(s)) for name, s in shingles.items()}
    values = ", ".join(
        f"('{name}', '{s}', {size_of[name].window // size_of[name].stride}, {size_of[name].stride}, {len(many)})"
        for name, many in shingles.items() for s in many
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = f"trim(regexp_replace(translate(text, '{upper}', '{lower}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH template(license_id, shingle, spans, stride, n_shingles) AS (VALUES {values}),
word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i
  FROM (SELECT doc_id, string_split({text}, ' ') AS w FROM documents WHERE text IS NOT NULL)
),
run AS (
  SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d,
                              lead(word, 4) OVER d) AS shingle, lead(word, 4) OVER d AS last
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
hit AS (SELECT * FROM run JOIN template USING (shingle) WHERE last IS NOT NULL),
held AS (
  SELECT doc_id, license_id, n_shingles, w, count(DISTINCT shingle) AS n
  FROM (SELECT *, unnest(range(greatest(0, i // stride - spans + 1), i // stride + 1)) AS w FROM hit)
  GROUP BY ALL
)
SELECT doc_id, license_id, CAST(n_shingles AS BIGINT) AS n_shingles, max(n) AS n_found,
       max(n) / CAST(n_shingles AS DOUBLE) AS containment
FROM held GROUP BY doc_id, license_id, n_shingles HAVING max(n) >= {contained} * n_shingles"""
