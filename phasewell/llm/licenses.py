r"""Operator 6, license scans: diagonal voting between rolling word 3-grams and templates.

Every 3-gram of every text is joined with the 3-grams of the templates (a fixed, small table, sent
to all tasks). A hit votes for the diagonal ``position in text - position in template``. Votes are
counted per diagonal, diagonals next to each other are merged (a word more or less moves a match
by one), and a merged span is kept if it covers enough of the template. The hash of a 3-gram is
made of its words' numbers in the templates' vocabulary, so that equal hashes are equal words and a
counted vote is already verified word for word. A base phrase is found where one diagonal has all
its votes.

Scale: one pass over the texts gives a narrow table of word counts and 3-grams of template words;
texts are never shuffled. Hits are combined on the map side, keyed by a hash of (doc_id, text)
besides the template, so that hot sources and common license lines spread over all tasks.

Edge cases: a null text counts as empty; rows equal in doc_id and text get equal results (votes are
counted once per place); texts of fewer than three words have no hit; extra columns are kept by
``scan`` (generated columns start with ``_c_``); an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import Words, checkpoint, filled, row_key, slices, table

K = 3
#: Diagonals at most this far apart are one match.
NEIGHBOURS = 2
#: Share of a template's 3-grams that a match must cover.
COVER = 0.6

#: Base phrases (label, words).
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: License notices in general use (label, text).
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl-3", "GNU Affero General Public License version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("cc-by", "licensed under a Creative Commons Attribution"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("all-rights-reserved", "All rights reserved"),
]

#: What stands between words once A-Z are in lower case, in RE2's notation.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Each byte of a text: a space where no word has it, A-Z in lower case, else itself.
BYTES = np.array([c + 32 if chr(c) in string.ascii_uppercase else c if c >= 128 or chr(c) in string.ascii_lowercase + string.digits else 32 for c in range(256)], np.uint8)


def spaced(texts: pa.Array) -> pa.Array:
    """Texts (large strings without nulls) in lower case, with spaces for all that is between words."""
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    inside = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(BYTES[inside]))


def _python_words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split(" ") if w]


def template_rows() -> list[tuple[int, str, str, int, int, bool]]:
    """(template, label, gram, position, grams of the template, base)."""
    out = []
    for n, (label, text) in enumerate(BASE + TEMPLATES):
        w = _python_words(text)
        grams = [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]
        out += [(n, label, g, i, len(grams), n < len(BASE)) for i, g in enumerate(grams)]
    return out


def vocabulary() -> list[str]:
    return sorted({w for _, text in BASE + TEMPLATES for w in _python_words(text)})


def template_table(spark: SparkSession) -> DataFrame:
    """template_rows with the hash of each gram: its words' numbers in the vocabulary, from 1, as digits."""
    number = {w: i for i, w in enumerate(vocabulary(), 1)}
    base = len(number) + 1
    rows = [(n, label, sum(number[w] * base ** (K - 1 - j) for j, w in enumerate(gram.split(" "))), *rest) for n, label, gram, *rest in template_rows()]
    return spark.createDataFrame(rows, "template int, label string, hash bigint, place int, grams int, base boolean")


def gram_table(keyed: DataFrame) -> DataFrame:
    """(key, n_words, at, hash) of each row of keyed (key, text): places and hashes of the rolling k-grams.

    The hash tells all k-grams of template words apart; a k-gram with any other word has none, since
    no template can have it.
    """
    known = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = pa.array(known, pa.large_string()), len(known) + 1
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(spaced(filled(part.column("text"))))
                number = pc.fill_null(pc.add(pc.index_in(w.words, value_set=words), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                rolled = number[w.ids] if len(number) else np.zeros(0, np.int64)
                starts = np.arange(max(0, len(rolled) - K + 1))
                code, whole = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
                for j in range(K):
                    at = rolled[j : j + len(starts)]
                    code, whole = code * base + at, whole & (at > 0)
                starts = starts[whole]
                owner = np.searchsorted(w.offsets, starts, side="right") - 1
                inside = starts + K <= w.offsets[owner + 1]
                starts, owner, code = starts[inside], owner[inside], code[whole][inside]
                ends = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                at = pa.ListArray.from_arrays(ends, pa.array((starts - w.offsets[owner]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(w.counts), at, pa.ListArray.from_arrays(ends, pa.array(code))], ["key", "n_words", "at", "hash"])

    return keyed.select("key", "text").mapInArrow(run, "key bigint, n_words bigint, at array<int>, hash array<bigint>")


def hits(grams: DataFrame) -> DataFrame:
    """Distinct (key, template, label, base, grams, place, at, diagonal) of all k-grams that a template has."""
    rolling = grams.select("key", F.explode(F.arrays_zip("at", "hash")).alias("g")).select("key", "g.at", "g.hash")
    found = rolling.join(F.broadcast(template_table(grams.sparkSession)), "hash")
    return found.select("key", "template", "label", "base", "grams", "place", "at", (F.col("at") - F.col("place")).alias("diagonal")).distinct()


def matches(grams: DataFrame) -> DataFrame:
    """(key, template, label, base, first, last, cover): verified matches."""
    votes = hits(grams).groupBy("key", "template", "label", "base", "grams", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    own = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > NEIGHBOURS).cast("int"), F.lit(1))
    base = votes.where("base AND votes = grams").select("key", "template", "label", "base", F.col("diagonal").alias("first"), F.col("last"), F.lit(1.0).alias("cover"))
    merged = votes.where("NOT base").withColumn("run", apart)
    merged = merged.withColumn("run", F.sum("run").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("key", "template", "label", "base", "grams", "run").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    enough = merged.withColumn("cover", F.least(F.lit(1.0), F.col("votes") / F.col("grams"))).where(F.col("cover") >= COVER)
    return base.unionByName(enough.select(*base.columns))


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs with _c_n_words, _c_n_base, _c_first, _c_last, _c_base_labels, _c_labels, _c_score."""
    key = row_key(id_column, text)
    grams = checkpoint(gram_table(docs.select(key.alias("key"), F.col(text).alias("text"))))
    counted = grams.groupBy("key").agg(F.first("n_words").alias("_c_n_words")).join(_per_row(grams), "key", "left")
    out = docs.withColumn("_c_key", key).join(counted.withColumnRenamed("key", "_c_key"), "_c_key").drop("_c_key")
    return out.fillna({"_c_n_base": 0, "_c_base_labels": "", "_c_labels": "", "_c_score": 0.0})


def _per_row(grams: DataFrame) -> DataFrame:
    """What was found in each row of grams that has a match."""
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    start = F.when(F.col("base"), F.col("first")).cast("bigint")
    return (
        matches(grams)
        .groupBy("key")
        .agg(
            F.count_if("base").alias("_c_n_base"),
            F.min(start).alias("_c_first"),
            F.max(start).alias("_c_last"),
            labels(F.when(F.col("base"), F.col("label"))).alias("_c_base_labels"),
            labels("label").alias("_c_labels"),
            F.max("cover").alias("_c_score"),
        )
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = {"n_words": "_c_n_words", "n_base": "_c_n_base", "first_word": "_c_first", "last_word": "_c_last", "base_labels": "_c_base_labels", "labels": "_c_labels", "score": "_c_score"}
    return scan(docs).select("doc_id", *[F.col(c).alias(k) for k, c in names.items()])


def _oracle() -> str:
    values = ", ".join(f"({n}, '{label}', '{gram}', {i}, {m}, {str(base).lower()})" for n, label, gram, i, m, base in template_rows())
    return rf"""
WITH tpl(template, label, gram, place, grams, base) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAPS}'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT k, unnest(range(0, len(w) - {K - 1})) AS pos, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM d WHERE len(w) >= {K}),
v AS (SELECT k, template, label, base, grams, pos - place AS diagonal, count(*) AS votes, min(pos) AS f, max(pos) AS l FROM g JOIN tpl USING (gram) GROUP BY ALL),
r AS (SELECT *, sum(far) OVER (PARTITION BY k, template ORDER BY diagonal) AS run FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY k, template ORDER BY diagonal) <= {NEIGHBOURS} THEN 0 ELSE 1 END AS far FROM v WHERE NOT base)),
m AS (SELECT k, label, true AS base, diagonal AS first, 1.0::DOUBLE AS cover FROM v WHERE base AND votes = grams
  UNION ALL SELECT k, label, false, min(f), least(1.0, sum(votes)::DOUBLE / grams) FROM r GROUP BY k, template, label, grams, run HAVING sum(votes)::DOUBLE / grams >= {COVER}),
p AS (SELECT k, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM m GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN p USING (k)"""


ORACLE_SQL = _oracle()
