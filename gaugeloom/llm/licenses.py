"""License scans: templates found by MinHash over overlapping windows, verified by shingle containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.spotsigs import let

#: Words of a shingle; MinHash functions, each a band of its own.
K, BANDS = 5, 64
#: Share of a template's shingles that a window must hold.
CONTAINED = 0.8
SMALLEST = 8

#: Notices by which texts name their license.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit-licensed", "This project is licensed under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """The hash of the K words from each place where K words begin."""
    return F.when(F.size(words) >= K, F.transform(F.slice(words, 1, F.size(words) - (K - 1)), lambda _, i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, K))))).otherwise(F.array().cast("array<long>"))


def window_words(n_words: int) -> int:
    """Words of the windows in which a template is sought. They begin every quarter of a window, so one holds it whole."""
    size = SMALLEST
    while size * 3 // 4 < n_words:
        size *= 2
    return size


def min_hashes(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, j))))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row for each document and template found in it: doc_id, license, containment, first_word, n_windows.

    containment: the largest share of the template's five-word shingles in one window (0.8 at least); first_word:
    the place of the first word of the first window that holds the template; n_windows: windows that hold the template.
    Windows without any shingle of a template can't share a minimum with it and are passed over. In the others,
    the least values of 64 hash functions are bands of one row. A window that holds 0.8 of a template has a
    Jaccard similarity of 0.2 or more to it, so all bands miss it with a probability under 1e-6.
    Texts that are null, empty or without template words give no row; rows without doc_id are scanned as
    others; rows that repeat a doc_id count as one document, a window at a place once. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = [(name, words_of(F.lit(text))) for name, text in templates]
    table = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("license"), shingles_of(w).alias("all"), F.size(w).alias("n")) for n, w in own))).alias("t")).select("t.*")
    known = table.select("license", "n", F.array_distinct("all").alias("shingles")).collect()  # the caller's templates, hashed
    if any(r["n"] < K for r in known):
        raise ValueError(f"a template has {K} words at least")
    values = sorted({s for r in known for s in r["shingles"]})
    sizes = sorted({window_words(r["n"]) for r in known})
    is_known = lambda s: s.isin(values)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = let(words_of(text), shingles_of)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.filter(F.array(whole), lambda h: F.exists(h, is_known))).alias("h"))

    def windows(h: Column) -> Column:
        def of(size: int) -> Column:
            step = size // 4
            starts = F.sequence(F.lit(0), F.size(h) - 1, F.lit(step))
            held = F.transform(starts, lambda s: F.struct(F.lit(size).alias("size"), s.alias("start"), F.array_distinct(F.slice(h, s + 1, size - K + 1)).alias("shingles")))
            return F.filter(held, lambda w: F.exists(w["shingles"], is_known))

        return F.concat(*(of(size) for size in sizes))

    # a document's last windows may be shorter
    found = some.select("doc_id", F.explode(windows(F.col("h"))).alias("w")).select("doc_id", "w.*")
    banded = found.select("doc_id", "size", "start", "shingles", F.posexplode(min_hashes(F.col("shingles"))).alias("band", "least"))
    names = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(r["license"]).alias("license"), F.lit(window_words(r["n"])).alias("t_size"), F.array(*(F.lit(s) for s in r["shingles"])).alias("t_shingles")) for r in known))).alias("t")).select("t.*")
    t_bands = names.select("license", "t_size", "t_shingles", F.posexplode(min_hashes(F.col("t_shingles"))).alias("t_band", "t_least"))
    hits = banded.join(F.broadcast(t_bands), (F.col("band") == F.col("t_band")) & (F.col("least") == F.col("t_least")) & (F.col("size") == F.col("t_size")))  # BANDS rows for each of the caller's templates
    share = F.size(F.array_intersect("shingles", "t_shingles")) / F.size("t_shingles")
    verified = hits.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= CONTAINED)
    each = verified.groupBy("doc_id", "license", "start").agg(F.max("containment").alias("containment"))
    return each.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count("*").alias("n_windows"))
