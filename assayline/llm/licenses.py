"""License scans: MinHash bands over overlapping windows, exact shingle containment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.decontam import word_array

SHINGLE = 5
#: Wordings of public licence notices.
TEMPLATES = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT-line", "Released under the MIT License."),
    ("MIT-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _shingles(words: Column) -> Column:
    """The distinct shingles of at least SHINGLE words, as text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _signature(hashes: Column, bands: int) -> Column:
    """The bands of one row each: struct(band, least hash)."""

    def least(i: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(i))))

    return F.array(*[F.struct(F.lit(i).alias("band"), least(i).alias("least")) for i in range(bands)])


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, half, shingles) of templates (name, text); half is the template's number of words, and half a window of its size."""
    t = spark.createDataFrame(list(templates), "license string, text string").select("license", word_array(F.col("text")).alias("w"))
    return t.where(F.size("w") >= SHINGLE).select("license", F.size("w").alias("half"), _shingles(F.col("w")).alias("shingles"))


def scan(docs: DataFrame, templates=TEMPLATES, share: float = 0.8, bands: int = 64) -> DataFrame:
    """(doc_id, license, containment, windows, first_word) for each template found in a row of docs (doc_id, text).

    Windows: each text's words (A-Z lower-cased) are covered by windows of
    2 * half words, one every half words, so an unaltered notice lies
    whole within one, as any half + 1 consecutive words do. One that foreign words spread over more is
    found only where one window holds enough of its shingles, which its place decides.
    Retrieval: a window meets a template of its size in a band if both have the
    same least hash there. The template has n = half - 4 shingles and the window
    2 * half - 4 at most; where it holds 0.8 of them or more (all of fewer than
    five) their Jaccard similarity is 1/6 or more, least for five words, so 64
    bands of one row miss a match with probability (5/6) ** 64, or 9e-6. A band
    can only be shared if the window holds the very shingle that is the
    template's least; so signatures are made for windows with such a shingle
    alone, with the same outcome. Verification: the share of the template's
    distinct shingles in the window, word for word, is at least `share`.
    windows: how many windows match; containment: the highest; first_word: the
    place of the first such window. templates: (name, text) pairs kept by the
    caller, a list of bounded size; those under five words are left out.
    Documents without matches, null and short texts give no row; repeated rows
    count once; null doc_ids are one document for each text.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    hashes = F.transform("shingles", lambda s: F.xxhash64(s))
    keyed = table.withColumn("hashes", hashes)
    keys = keyed.select("license", "half", "hashes", F.inline(_signature(F.col("hashes"), bands)))
    lead = F.filter("hashes", lambda h: F.xxhash64(h, F.col("band")) == F.col("least"))
    leads = keys.select("half", F.explode(lead).alias("h")).distinct()

    split = docs.select("doc_id", F.xxhash64("text").alias("th"), word_array(F.col("text")).alias("w"))
    at = split.select("doc_id", "th", "w", F.posexplode("w").alias("p", "a")).where(F.col("p") <= F.size("w") - SHINGLE)
    at = at.withColumn("h", F.xxhash64(F.concat_ws(" ", "a", *[F.get("w", F.col("p") + i) for i in range(1, SHINGLE)])))
    near = at.join(F.broadcast(leads), "h")  # templates x bands rows at most
    k = F.floor(F.col("p") / F.col("half")).cast("int")
    near = near.withColumn("k", F.explode(F.array(k, k - 1))).where((F.col("k") >= 0) & (F.col("p") + SHINGLE <= (F.col("k") + 2) * F.col("half")))
    windows = near.select("doc_id", "th", "half", "k", F.slice("w", F.col("k") * F.col("half") + 1, 2 * F.col("half")).alias("w")).dropDuplicates(["doc_id", "th", "half", "k"])

    windows = windows.withColumn("own", _shingles(F.col("w"))).withColumn("own_hashes", F.transform("own", lambda s: F.xxhash64(s)))
    met = windows.select("doc_id", "th", "half", "k", "own", F.inline(_signature(F.col("own_hashes"), bands)))
    met = met.join(F.broadcast(keys.select("license", "half", "band", "least")), ["half", "band", "least"])
    met = met.select("doc_id", "th", "half", "k", "license", "own").dropDuplicates(["doc_id", "th", "half", "k", "license"])
    got = met.join(F.broadcast(table.select("license", "shingles")), "license")
    got = got.withColumn("c", F.size(F.array_intersect("own", "shingles")) / F.size("shingles")).where(F.col("c") >= share)
    return got.groupBy("doc_id", "th", "license").agg(
        F.max("c").alias("containment"), F.count("*").alias("windows"), F.min(F.col("k") * F.col("half")).cast("bigint").alias("first_word")
    ).drop("th")
