"""License scans: normalised text compared to licence templates by Dice coefficient over word bigrams.

A document's units are its lines, its paragraphs of several lines and, where it has
several paragraphs, the whole text, and besides the windows of a template's length that lie
where at least one in ``ALIGNED`` of its bigrams stands in its place: notices inside a
sentence, beside other words, or wrapped over commented lines are found there.  A unit and a
template are normalised alike (lower case, letters and digits only) and compared by

    dice = 2 * shared bigrams / (bigrams of the unit + bigrams of the template).

Dice can reach ``threshold`` only if the sizes are within a factor of
``(2 - threshold) / threshold``; units outside the bounds of every template are never
split into words, and a unit meets a template only inside its bounds.  Bigrams are
looked up in an inverted index of the templates (a fixed, small table), so a unit is
compared with templates it shares a bigram with, and no pair of unit and template is
formed otherwise.

Texts without any of the words or bigrams that a match must hold are not split into units.

All steps are DataFrame expressions; rows are keyed by document and unit, so no group
is larger than one unit's matching bigrams.

Cases: null or empty texts have no licence; a unit of one word has that word as its
only bigram; the larger Dice comes first, of equal ones the longer template, then its name; rows that share a
``doc_id`` are each reported with the licences of all of them; a null ``doc_id`` counts
as one id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Public licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("AGPL-3.0-header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("BSD-2-Clause-clause",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("BSD-3-Clause-clause",
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("ISC-permission",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0-header",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation; either version 3 of the License, or "
     "(at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT-permission",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions"),
    ("MIT-warranty",
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
     "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
]


ALIGNED = 4


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_places(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, int, str, int]]:
    """(template, place, bigram, number of words) of every bigram of a template."""
    return [
        (name, q, f"{words[q]} {words[q + 1]}", len(words))
        for name, text in sorted(templates) for words in [template_words(text)] for q in range(len(words) - 1)
    ]


def template_bigrams(templates: list[tuple[str, str]] = TEMPLATES) -> dict[str, set[str]]:
    """Normalised bigrams per template."""
    found = {}
    for name, text in templates:
        words = template_words(text)
        found[name] = {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)
    return found


def needed_parts(templates: list[tuple[str, str]], threshold: float) -> tuple[list[str], list[str]]:
    """Words and bigrams of which every text that reaches the threshold with some template holds one.

    Such a text shares at least ``threshold / (2 - threshold)`` of the template's bigrams.
    Long words are taken, then bigrams, until fewer bigrams than that are left without.
    """
    words: set[str] = set()
    bigrams: set[str] = set()
    for own in template_bigrams(templates).values():
        shared = threshold / (2 - threshold) * len(own) - 1e-9
        long_words = sorted({w for b in own for w in b.split() if len(w) >= 5}, key=lambda w: (-len(w), w))
        for part in [*long_words, *sorted(own, key=lambda b: (-len(b), b))]:
            left = [b for b in own if b not in bigrams and not words & set(b.split())]
            if len(left) < shared:
                break
            if any(part in b.split() for b in left):
                words.add(part)
            elif part in left:
                bigrams.add(part)
    return sorted(words), sorted(bigrams)


def size_bounds(size: int, threshold: float) -> tuple[float, float]:
    """Sizes of units that can reach the threshold with a template of ``size`` bigrams.

    Widened, since the quotients of whole numbers may be rounded past the whole number they stand for.
    """
    return size * threshold / (2 - threshold) - 1e-9, size * (2 - threshold) / threshold + 1e-9


def _index(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    rows = [
        (bigram, name, len(own), *size_bounds(len(own), threshold))
        for name, own in sorted(template_bigrams(templates).items()) for bigram in sorted(own)
    ]
    return spark.createDataFrame(rows, "bigram string, license string, size int, least double, most double")


def units(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``unit`` (number inside the document) and normalised ``words`` joined by spaces."""
    clean = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split("clean", "\n")
    blocks = F.split("clean", r"\n ?\n[ \n]*")
    several = F.when(F.instr("clean", "\n") > 0, blocks).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.size("several") > 1, F.array("clean")).otherwise(F.array().cast("array<string>"))
    longer = F.filter("several", lambda b: F.instr(F.trim(b), "\n") > 0)
    joined = F.transform(F.concat(longer, "whole"), lambda b: F.replace(b, F.lit("\n"), F.lit(" ")))
    rows = docs.select("doc_id", F.coalesce(clean, F.lit("")).alias("clean"))
    rows = rows.withColumn("lines", lines).withColumn("several", several).withColumn("whole", whole)
    return rows.select("doc_id", F.posexplode_outer(F.concat("lines", joined)).alias("unit", "words")).select(
        "doc_id", "unit", F.trim("words").alias("words")
    )


def bigrams_of(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.transform(
        F.sequence(F.lit(0), F.size(words) - 2),
        lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)),
    )).otherwise(words)


def match_windows(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Windows at or above the threshold: ``doc_id``, ``unit`` (null), ``license``, its ``size``, ``dice``."""
    spark = docs.sparkSession
    places = spark.createDataFrame(template_places(templates), "license string, q int, bigram string, length int")
    whole = spark.createDataFrame(
        [(name, sorted(own)) for name, own in sorted(template_bigrams(templates).items())], "license string, own array<string>")
    clean = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.split(clean, " ").alias("list")).filter(F.size("list") > 1)
    rows = rows.dropDuplicates(["doc_id", "row"])
    seeds = rows.select("doc_id", "row", F.posexplode(bigrams_of(F.col("list"))).alias("p", "bigram"))
    # fixed, small tables; seeds of one diagonal are counted in each task first
    starts = seeds.join(F.broadcast(places), "bigram").groupBy(
        "doc_id", "row", "license", "length", (F.col("p") - F.col("q")).alias("start")
    ).agg(F.count(F.lit(1)).alias("aligned")).filter(F.col("aligned") * ALIGNED >= F.col("length") - 1)
    key = lambda side: [F.col(f"{side}.doc_id"), F.col(f"{side}.row")]
    (a, b), (c, d) = key("s"), key("r")
    lists = rows.alias("r")
    first = F.greatest(F.col("start"), F.lit(0))
    windows = starts.alias("s").join(lists, a.eqNullSafe(c) & (b == d)).join(F.broadcast(whole), "license").select(
        F.col("s.doc_id").alias("doc_id"), "license", "own",
        F.array_distinct(bigrams_of(F.slice("list", first + 1, F.col("start") + F.col("length") - first))).alias("bigrams"),
    )
    dice = F.lit(2.0) * F.size(F.array_intersect("bigrams", "own")) / (F.size("bigrams") + F.size("own"))
    return windows.select(
        "doc_id", F.lit(None).cast("int").alias("unit"), "license", F.size("own").alias("size"), dice.alias("dice")
    ).filter(F.col("dice") >= threshold)


def match_units(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Units at or above the threshold: ``doc_id``, ``unit`` (null for windows), ``license``, its ``size``, ``dice``."""
    index = _index(docs.sparkSession, templates, threshold)
    sizes = [len(own) for own in template_bigrams(templates).values()]
    least, most = size_bounds(min(sizes), threshold)[0], size_bounds(max(sizes), threshold)[1]
    # one look at each text: an array of one element names the lower-cased text once
    alone, together = needed_parts(templates, threshold)
    beside = "|".join(b.replace(" ", r"[^\p{L}\p{N}]+") for b in together) or "(?!)"
    holds_one = F.exists(
        F.array(F.lower(F.coalesce("text", F.lit("")))),
        lambda low: functools.reduce(operator.or_, [*(F.contains(low, F.lit(w)) for w in alone), low.rlike(beside)]),
    )
    held = docs.filter(holds_one)
    words = units(held).withColumn("list", F.split("words", " +"))
    pairs = bigrams_of(F.col("list"))
    # repeated bigrams only lower the size, so the number of words is tested from below only
    enough = F.size("list") >= F.ceil(F.lit(least))
    sized = words.select(
        "doc_id", "unit", F.when(enough & (F.col("words") != ""), F.array_distinct(pairs)).alias("bigrams")
    ).withColumn("n", F.coalesce(F.size("bigrams"), F.lit(0)))
    inside = F.when((F.col("n") >= least) & (F.col("n") <= most), F.col("bigrams"))
    # conditions sit inside the expressions: as filters they would be pushed below the
    # projections and evaluate the costly arrays again
    seeds = sized.select("doc_id", "unit", "n", F.explode_outer(inside).alias("bigram"))
    met = seeds.join(F.broadcast(index), "bigram").filter("n between least and most")
    shared = met.groupBy("doc_id", "unit", "license", "n", "size").agg(F.count(F.lit(1)).alias("both"))
    dice = F.lit(2.0) * F.col("both") / (F.col("n") + F.col("size"))
    matched = shared.select("doc_id", "unit", "license", "size", dice.alias("dice")).filter(F.col("dice") >= threshold)
    return matched.unionByName(match_windows(held, templates, threshold))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row: ``doc_id``, best ``license`` and its ``dice`` (null without one), all ``licenses`` (sorted)."""
    docs = docs.select("doc_id", "text")
    found = match_units(docs, templates, threshold).groupBy("doc_id").agg(
        F.max("dice").alias("dice"),
        F.array_sort(F.collect_set("license")).alias("licenses"),  # at most one entry per template
        F.min(F.struct(F.negative("dice").alias("order"), F.negative("size").alias("shorter"), "license")).alias("first"),
    ).select(F.col("doc_id").alias("found_id"), F.col("first.license").alias("license"), "dice", "licenses")
    rows = docs.select("doc_id")
    return rows.join(found, rows["doc_id"].eqNullSafe(found["found_id"]), "left").select(
        "doc_id", "license", "dice", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses")
    )
