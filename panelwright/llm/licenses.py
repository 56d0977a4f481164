"""License notices found by MinHash bands over overlapping text windows.

All in DataFrame functions.  A notice's shingles are hashed; the smallest hashes
under several seeds are its bands, of one row each.  Windows of a text overlap by
two thirds, so a notice lies whole in one of them, which is at most three times
as long.  A band then agrees with probability one third at least, and one of 32
bands with 0.999997; where a window has just 80 % of the notice, with 0.9999.
Notices that share a band are candidates, and their shingles are compared
exactly.

Two steps that lose nothing go first: texts without any template shingle's
longest word are passed over, and so are shingles that no template has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SHINGLE = 5
BANDS = 32
TEMPLATE_BYTES = 8 << 20  # templates of at most this size are broadcast

# Names and notices as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("all-rights-reserved", "All rights reserved."),
]


def words_of(text: Column) -> Column:
    """A-Z lower-cased runs of letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), "")


def shingles(words: str, k: int = SHINGLE) -> Column:
    """Hashes of each k consecutive words, at least of one: fewer words are one shingle."""
    w = F.col(words)
    last = F.greatest(F.size(w) - k, F.lit(0))
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _bands(hashes: Column, bands: int) -> Column:
    """The smallest hash under each seed."""
    return F.array(*[F.struct(F.lit(s).alias("seed"), F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(s)))).alias("low")) for s in range(bands)])


def template_table(spark: SparkSession, templates=TEMPLATES, k: int = SHINGLE) -> DataFrame:
    """(template, license, n_words, grams): templates without a word are left out, and equal ones are one."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, license string, text string").withColumn("w", words_of(F.col("text"))).where(F.size("w") > 0)
    t = t.select("template", "license", F.size("w").alias("n_words"), F.col("w"), F.array_distinct(shingles("w", k)).alias("grams"))
    return t.dropDuplicates(["license", "w"])


def _anchors(t: DataFrame, k: int) -> DataFrame:
    """One row of words, of each shingle of a template its longest: a text with none of these words shares no shingle with a template."""
    w = F.col("w")
    longest = lambda s: F.aggregate(s, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
    found = t.select(F.explode(F.transform(starts, lambda i: longest(F.slice(w, i, k)))).alias("a"))
    return found.agg(F.sort_array(F.collect_set("a")).alias("anchors"))  # one for each shingle of the templates at most, whose size is checked


def scan(docs: DataFrame, templates=TEMPLATES, *, k: int = SHINGLE, bands: int = BANDS, containment: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, n_templates) for each document and each license found in it.

    A template is found where a window of the text has containment percent or
    more of its distinct shingles of k words; a template or text of fewer words
    is one shingle, found only if a run of so many words equals it.  containment
    is the largest of the license's templates, from 0 to 100, and n_templates
    how many of them were found.

    Null and empty texts, and templates without a word, match nothing.  Rows
    that repeat an id are one document.  Other columns are ignored, whatever
    their names.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    t = store.materialise(template_table(spark, templates, k), "templates")
    if store.plan_bytes(t) > TEMPLATE_BYTES:
        raise ValueError("the templates are too large to be sent to every executor: scan with parts of them")
    sizes = sorted(r["n"] for r in t.select(F.least("n_words", F.lit(k)).alias("n")).distinct().collect())
    text = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    near = store.materialise(text.crossJoin(F.broadcast(_anchors(t, k))).where(F.arrays_overlap("w", "anchors")).select("id", "w"), "near-licenses")  # one row beside each
    found = None
    for size in sizes:  # templates of k words or more, and each smaller size
        mine = t.where(F.least("n_words", F.lit(k)) == size)
        part = _match(near, mine, size, bands, containment)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select(F.col(id_col).alias("id"), F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("part")).where("false")
    best = found.groupBy("id", "license", "template").agg(F.max("part").alias("part"))
    best = best.groupBy("id", "license").agg(F.max("part").alias("containment"), F.count("*").cast("long").alias("n_templates"))
    return best.withColumnRenamed("id", id_col)


def _match(near: DataFrame, templates: DataFrame, k: int, bands: int, containment: int) -> DataFrame:
    """Templates whose shingles have k words, looked up in windows of the texts.

    A class is the templates of m to 2m - 1 shingles, for a power of two m; its
    windows hold 3m shingles and begin at each multiple of m, so each template
    of the class lies whole in one.
    """
    grams = templates.select("template", "license", "grams", F.pow(F.lit(2.0), F.floor(F.log2(F.size("grams")))).cast("int").alias("m"))
    keyed = grams.select("template", "license", "grams", "m", F.explode(_bands(F.col("grams"), bands)).alias("band")).select("template", "license", "grams", "m", "band.seed", "band.low")
    classes = sorted(r["m"] for r in grams.select("m").distinct().collect())
    hashed = near.where(F.size("w") >= k).select("id", shingles("w", k).alias("h"))
    known = F.broadcast(grams.select(F.explode("grams").alias("g")).distinct())
    spots = hashed.select("id", F.posexplode("h").alias("p", "g")).join(known, "g", "left_semi")
    # window j of class m holds places j * m up to j * m + 3 * m: each place is in three of them
    spots = spots.withColumn("m", F.explode(F.array(*map(F.lit, classes)))).withColumn("back", F.explode(F.array(*map(F.lit, range(3)))))
    window = spots.withColumn("j", F.floor(F.col("p") / F.col("m")) - F.col("back")).where("j >= 0").groupBy("id", "m", "j").agg(F.sort_array(F.collect_set("g")).alias("h"))
    window = window.select("id", "m", "h").distinct()
    asked = window.select("id", "m", "h", F.explode(_bands(F.col("h"), bands)).alias("band")).select("id", "m", "h", "band.seed", "band.low")
    hit = asked.join(F.broadcast(keyed), ["m", "seed", "low"]).select("id", "h", "template", "license", "grams").distinct()
    part = F.size(F.array_intersect("grams", "h")) * 100.0 / F.size("grams")
    return hit.select("id", "license", "template", part.alias("part")).where(F.col("part") >= containment)
