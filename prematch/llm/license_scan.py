"""Find licence notices inside documents (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_key, small_side, written

# Notices as they are published, one per line: id, text.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced"),
)
SHINGLE = 3        # words
WINDOW = 6         # shingles in a window of the text
STRIDE = 3         # so that any 3 shingles in a row lie inside one window
BANDS = 8          # of one row each: a window that agrees with a template window by J is retrieved with 1 - (1 - J) ** BANDS, 0.996 at J = 1/2
CONTAINED = 0.8
LICENSE_WORD = r"[a-z0-9]+"
KEY_ROWS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))


def with_shingles(rows: DataFrame) -> DataFrame:
    """rows with s in place of text: hashes of the 3-word shingles of the lower-cased words, in order.

    The words are a column of their own first: inside the lambda they would be split again for every shingle.
    """
    rows = rows.withColumn("w", words(F.col("text")))
    starts = F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1))
    hashes = F.transform(starts, lambda p: F.xxhash64(F.slice("w", p, SHINGLE)))
    return rows.withColumn("s", F.when(F.size("w") >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))).drop("w", "text")


def _keys(rows: DataFrame, stride: int, *others: str) -> DataFrame:
    """(id, key) of the column s of shingle hashes: for each window and band the least of the band's hashes; others: columns whose values are added.

    Bands hash with seeds of their own, so one key column serves all. The keys are an array column before they are
    exploded: with the hashes beside it, every exploded row would carry the whole document. explode_outer, as explode adds
    a filter on the array's size, which is pushed below the projections and computes the array again without them.
    """
    starts = F.when(F.size("s") > 0, F.sequence(F.lit(1), F.greatest(F.size("s") - (WINDOW - stride), F.lit(1)), F.lit(stride)))
    rows = rows.select("id", starts.alias("p"), *others, *[F.transform("s", _band_hash(b)).alias(f"h{b}") for b in range(BANDS)])
    mins = [F.transform("p", _least_in_window(f"h{b}")) for b in range(BANDS)]
    return rows.select("id", F.array_distinct(F.flatten(F.array(*mins, *others))).alias("keys")).select("id", F.explode_outer("keys").alias("key"))


def _band_hash(b: int):
    return lambda x: F.xxhash64(x, F.lit(b))


def _least_in_window(hashes: str):
    return lambda p: F.array_min(F.slice(hashes, p, WINDOW))


def template_table(spark: SparkSession, templates) -> DataFrame:
    return with_shingles(spark.createDataFrame(list(templates), "id string, text string"))


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(row_key, template, containment) for every document that holds at least that share of a template's shingles.

    Candidates are documents with a window whose MinHash agrees with one of a template's windows in some band; the
    template keys are a fixed small table, so documents are scanned in place. Containment is then exact: distinct
    shingles of the template that the whole document has, divided by those that the template has.

    Null, empty and short texts have no shingles and no match. Repeated rows share one result. No rows: no rows.
    """
    known = written(template_table(docs.sparkSession, templates))
    bands = _keys(known, 1).select(F.col("id").alias("template"), "key", F.lit(0).alias("shingle"))
    wanted = known.select(F.col("id").alias("template"), F.explode("s").alias("key"), F.lit(1).alias("shingle"))
    table = small_side(written(bands.unionByName(wanted).distinct()), KEY_ROWS)
    # seeds part the keys of bands from those of shingles, so one pass over the documents finds both
    rows = with_shingles(docs.select(row_key(F.col("doc_id"), F.col("text")).alias("id"), "text"))
    found = _keys(rows, STRIDE, "s").select(F.col("id").alias("row_key"), "key").join(table, "key")
    found = found.groupBy("row_key", "template").agg(F.min("shingle").alias("least"), F.countDistinct(F.when(F.col("shingle") == 1, F.col("key"))).alias("n"))
    total = F.broadcast(known.select(F.col("id").alias("template"), F.size(F.array_distinct("s")).alias("total")))
    share = F.col("n") / F.col("total")
    return found.filter("least = 0").join(total, "template").select("row_key", "template", share.alias("containment")).filter(F.col("containment") >= contained)


def licenses(docs: DataFrame, **settings) -> DataFrame:
    """docs with license_ids (sorted, comma-joined, empty if none) and n_licenses."""
    found = scan(docs, **settings).groupBy(F.col("row_key").alias("lic_key")).agg(F.array_join(F.array_sort(F.collect_set("template")), ",").alias("lic_ids"), F.countDistinct("template").alias("lic_n"))
    kept = [c for c in docs.columns if c not in ("license_ids", "n_licenses")]
    # the key is a column before the join, so a text that nobody asks for is not shuffled
    joined = docs.select(*kept, row_key(F.col("doc_id"), F.col("text")).alias("lic_key")).join(found, "lic_key", "left")
    return joined.select(*kept, F.coalesce("lic_ids", F.lit("")).alias("license_ids"), F.coalesce("lic_n", F.lit(0)).alias("n_licenses"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses(read_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "license_ids", "n_licenses")


_VALUES = ", ".join(f"('{i}', '{t}')" for i, t in TEMPLATES)
_SHINGLES = "SELECT id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS p FROM {0} WHERE len(w) >= 3)"
OP2_SQL = rf"""
WITH t AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {_VALUES}) v(id, text)),
tg AS (SELECT DISTINCT * FROM ({_SHINGLES.format('t')})),
d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
dg AS (SELECT DISTINCT * FROM ({_SHINGLES.format('d')})),
hit AS (SELECT dg.id, tg.id AS template, count(*) AS n FROM dg JOIN tg USING (g) GROUP BY ALL),
ok AS (SELECT hit.id, template FROM hit JOIN (SELECT id AS template, count(*) AS total FROM tg GROUP BY ALL) USING (template) WHERE n >= 0.8 * total)
SELECT doc_id, coalesce(string_agg(template, ',' ORDER BY template), '') AS license_ids, count(template) AS n_licenses
FROM d LEFT JOIN ok USING (id) GROUP BY d.id, doc_id
"""
