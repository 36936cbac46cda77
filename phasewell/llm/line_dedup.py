r"""Operator 2, line dedup: content-defined chunks of lines, repeated chunks removed.

Lines are split at ``\n``. A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk
where it falls under a fixed share, so that an inserted line moves boundaries near it only. Chunks
of two lines or more (with at least one word) whose hash occurs again anywhere are compared byte
for byte with their first occurrence (by doc_id, then row, then line); equal ones are removed from
all places but the first.

Everything is DataFrame functions. Counting works on narrow rows (hash, place) with map-side
combining; only texts of chunks that do repeat are gathered for the byte comparison, and whole
texts move twice: to look up these chunks, and to be rewritten. A hot chunk's members stay spread:
counts are combined before the shuffle, joins have one row per hash on the other side, and Spark
can split their large partitions.

Edge cases: a null text has no chunk and stays null; a text of one line never changes; a text whose
chunks are all removed stays as an empty text; rows equal in doc_id and text count as one document
and are treated alike; null doc_ids come first in the order; extra columns are carried along
(generated columns start with ``_l_``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import checkpoint, row_key, table

#: Lines that the rolling hash covers.
WINDOW = 2
#: A chunk ends where the first hex digit of the rolling hash is below this one: 5 of 16.
CUT_BELOW = "5"
#: Lines of a chunk that may be removed.
MIN_LINES = 2


def with_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _l_lines and _l_chunks: array<struct<start, end>> of lines from 1, ends included."""
    hashes = docs.withColumn("_l_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).withColumn("_l_hashes", F.expr("transform(_l_lines, x -> md5(x))"))
    window = "concat(" + ", ".join(f"coalesce(get(_l_hashes, i - {WINDOW - j}), '')" for j in range(WINDOW)) + ")"
    ends = hashes.withColumn("_l_ends", F.expr(f"filter(sequence(1, size(_l_lines)), i -> i = size(_l_lines) OR md5({window}) < '{CUT_BELOW}')"))
    return ends.withColumn("_l_chunks", F.expr("transform(_l_ends, (e, j) -> struct(if(j = 0, 1, get(_l_ends, j - 1) + 1) AS start, e AS end))")).drop("_l_hashes", "_l_ends")


def _text_of(chunk: str) -> str:
    return f"array_join(slice(_l_lines, {chunk}.start, {chunk}.end - {chunk}.start + 1), '\\n')"


def _places(keyed: DataFrame, text: str) -> DataFrame:
    """Narrow rows of all chunks that may be removed: _l_key, _l_id, start, end, hash."""
    listed = f"filter(transform(_l_chunks, c -> struct(c.start AS start, c.end AS end, {_text_of('c')} AS body)), c -> c.end - c.start + 1 >= {MIN_LINES} AND c.body rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    hashed = f"transform({listed}, c -> struct(c.start AS start, c.end AS end, md5(c.body) AS hash))"
    return with_chunks(keyed.select("_l_key", "_l_id", F.col(text).alias("_l_text")), "_l_text").select("_l_key", "_l_id", F.inline(F.expr(hashed)))


def removals(keyed: DataFrame, text: str) -> DataFrame:
    """(_l_key, _l_removed): the first lines of the chunks to remove from a row."""
    places = _places(keyed, text)
    place = F.struct("_l_id", "_l_key", "start").alias("place")
    first = places.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("latest")).where("first <> latest").select("hash", "first", F.col("first._l_key").alias("first_key"), F.col("first.start").alias("first_start"))
    again = places.join(first.select("hash", "first_key", "first_start"), "hash").select("_l_key", "start", "end", "hash", F.expr("_l_key = first_key AND start = first_start").alias("is_first"))
    needed = again.groupBy("_l_key").agg(F.collect_set(F.struct("start", "end", "hash", "is_first")).alias("_l_needed"))
    bodies = keyed.select("_l_key", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("_l_lines")).join(needed, "_l_key")
    bodies = checkpoint(bodies.select("_l_key", F.inline(F.expr(f"transform(_l_needed, c -> struct(c.start AS start, c.hash AS hash, c.is_first AS is_first, {_text_of('c')} AS body))"))))
    originals = bodies.where("is_first").select("hash", F.col("body").alias("first_body")).dropDuplicates(["hash"])
    same = bodies.where("NOT is_first").join(originals, "hash").where("body = first_body")
    return same.groupBy("_l_key").agg(F.collect_set("start").alias("_l_removed"))


def dedup(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs with the text rewritten, and _l_n_lines, _l_n_chunks and _l_gone (removed chunks)."""
    keyed = docs.withColumn("_l_key", row_key(id_column, text)).withColumn("_l_id", F.col(id_column))
    marked = with_chunks(keyed.join(removals(keyed, text), "_l_key", "left"), text)
    marked = marked.withColumn("_l_gone", F.expr("filter(_l_chunks, c -> coalesce(array_contains(_l_removed, c.start), false))"))
    left = "transform(filter(_l_chunks, c -> NOT coalesce(array_contains(_l_removed, c.start), false)), c -> " + _text_of("c") + ")"
    return (
        marked.withColumn(text, F.when(F.size("_l_gone") > 0, F.expr(f"array_join({left}, '\\n')")).otherwise(F.col(text)))
        .withColumn("_l_n_lines", F.size("_l_lines").cast("bigint"))
        .withColumn("_l_n_chunks", F.size("_l_chunks").cast("bigint"))
        .drop("_l_key", "_l_id", "_l_removed", "_l_lines", "_l_chunks")
    )


def rewritten(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs' own columns with the text rewritten (and n_chars made to fit, where there is one)."""
    out = dedup(docs, text, id_column)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_l_gone") > 0, F.char_length(text).cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_l_n_lines").alias("n_lines"),
        F.col("_l_n_chunks").alias("n_chunks"),
        F.size("_l_gone").cast("bigint").alias("n_removed_chunks"),
        F.expr("aggregate(_l_gone, 0L, (n, c) -> n + c.end - c.start + 1)").alias("n_removed_lines"),
        F.expr("array_join(transform(_l_gone, c -> concat(c.start, '-', c.end)), ',')").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = f"""
WITH a AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
b AS (SELECT *, list_transform(ls, lambda x: md5(x)) AS hs FROM a),
c AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR md5(CASE WHEN i > 1 THEN hs[i - 1] ELSE '' END || hs[i]) < '{CUT_BELOW}') AS es FROM b),
d AS (SELECT doc_id, text, ls, list_transform(range(1, len(es) + 1), lambda j: {{'s': CASE WHEN j = 1 THEN 1 ELSE es[j - 1] + 1 END, 'e': es[j]}}) AS cs FROM c),
p AS (SELECT doc_id, text, u.s AS s, u.e AS e, array_to_string(ls[u.s:u.e], chr(10)) AS body FROM (SELECT doc_id, text, ls, unnest(cs) AS u FROM d)),
q AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, s) AS r FROM p WHERE e - s + 1 >= {MIN_LINES} AND regexp_matches(body, '[^\\x20\\x09-\\x0D]')),
g AS (SELECT p.doc_id, p.text, p.s, p.e, p.body, coalesce(q.r, 1) > 1 AS gone FROM p LEFT JOIN q ON p.doc_id IS NOT DISTINCT FROM q.doc_id AND p.text = q.text AND p.s = q.s),
k AS (SELECT doc_id, text, count(*) FILTER (gone) AS n_removed_chunks, coalesce(sum(e - s + 1) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  coalesce(string_agg(s || '-' || e, ',' ORDER BY s) FILTER (gone), '') AS removed_lines, count(*) AS n_chunks, coalesce(string_agg(body, chr(10) ORDER BY s) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id, text)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, n_chunks, n_removed_chunks, n_removed_lines, removed_lines, sha256(kept) AS kept_sha256
FROM documents d JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND coalesce(d.text, '') = k.text"""
