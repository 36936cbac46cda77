r"""Operator 3, document fingerprints: threshold-scaled sketches.

A document's sketch keeps every 5-word shingle whose hash lies below a fixed fraction of the hash
range, whatever the document's length. Sketches of parts merge by union, and because the same
hashes are kept in every document, containment of a short text in a very long one is estimated as
well as likeness of equals. Texts of fewer than five words are one shingle.

A fingerprint is ``<first 8 hex digits of the text's md5>:<kept hashes, sorted, comma-joined>``.
Likeness is intersection over union of the kept hashes; where neither text has any, it is 1 for
equal fingerprints and else 0.

Everything is DataFrame functions; shingles never leave their row, sketches move with their texts,
and the only wide step is the one that pairs a document with the next one. It sorts texts once, in many id ranges: quantiles of the
ids, each cut evenly, so that a range holds about ``RANGE_ROWS`` rows; null ids are cut by row
hash. A narrow table with the first row of each range links the ranges.

Edge cases: a null text counts as empty; rows equal in doc_id and text count as one document in
the order and give as many equal rows; rows equal in doc_id are ordered by row hash, null ids come last; a document that
is alone is its own next; extra columns are left aside, whatever
their names; ids are numbers; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import checkpoint, row_key, table

SHINGLE = 5
#: The hash of a kept shingle starts with a hex digit below this: a fraction of 2 in 16.
KEEP_BELOW = "2"
#: Hex digits of a kept hash.
DIGITS = 16
RANGE_ROWS = 20_000
QUANTILES = 64


def sketch(text: Column) -> Column:
    """Sorted distinct kept hashes of a text (not null)."""
    words = F.array(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))

    def shingles(w: Column) -> Column:
        last = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))
        hashed = F.transform(F.sequence(F.lit(1), last), lambda i: F.md5(F.array_join(F.slice(w, i, SHINGLE), " ")))
        return F.when(F.size(w) > 0, hashed).otherwise(F.array().cast("array<string>"))

    kept = F.filter(F.element_at(F.transform(words, shingles), 1), lambda h: h < KEEP_BELOW)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda h: F.substring(h, 1, DIGITS))))


def fingerprint(text: Column, kept: Column) -> Column:
    return F.concat(F.substring(F.md5(text), 1, 8), F.lit(":"), F.array_join(kept, ","))


def likeness(a: Column, b: Column, print_a: Column, print_b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.when(print_a == print_b, 1.0).otherwise(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a keeps none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column) -> Column:
    """The sketch of the union of several texts (an array of sketches)."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def _range_of(ids: DataFrame) -> Column:
    """A number for the id range of a row, rising as ids fall; from one pass over the narrow ids."""
    cuts = [i / QUANTILES for i in range(1, QUANTILES)]
    stats = ids.agg(F.count(F.lit(1)).alias("n"), F.min("_f_id").alias("lo"), F.max("_f_id").alias("hi"), F.percentile_approx("_f_id", cuts, 10_000).alias("q")).first()
    each = max(1, stats["n"] // (QUANTILES * RANGE_ROWS) + 1)
    null_ranges = max(1, stats["n"] // RANGE_ROWS)
    null_part = F.lit(QUANTILES * each) + F.least(F.floor((F.lit(2.0**63) - F.col("_f_key").cast("double")) / 2.0**64 * null_ranges), F.lit(null_ranges - 1))
    if stats["lo"] is None or stats["n"] <= RANGE_ROWS // 8:
        return F.when(F.col("_f_id").isNull(), null_part).otherwise(F.lit(0)).cast("bigint")
    bounds = sorted({stats["lo"], stats["hi"] + 1, *(stats["q"] or [])})

    def inside(lo: int, hi: int) -> Column:
        """Quantile interval by halving, then its even cut."""
        if hi - lo == 1:
            a, b = bounds[lo], bounds[hi]
            up = F.lit(lo * each) + F.floor((F.col("_f_id") - F.lit(a)) / F.lit(float(b - a)) * each)
            return F.least(up, F.lit(lo * each + each - 1))
        mid = (lo + hi) // 2
        return F.when(F.col("_f_id") < F.lit(bounds[mid]), inside(lo, mid)).otherwise(inside(mid, hi))

    top = (len(bounds) - 1) * each
    return F.when(F.col("_f_id").isNull(), null_part).otherwise(F.lit(top) - inside(0, len(bounds) - 1)).cast("bigint")


def with_next(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Distinct (_f_id, _f_text, _f_own) with _f_next and _f_next_own: the text that follows by
    descending id, in a ring, and _f_copies, the number of rows that are equal to this one. _f_own is
    the text's sketch, made once and moved along with it."""
    rows = docs.select(F.col(id_column).alias("_f_id"), F.coalesce(F.col(text), F.lit("")).alias("_f_text")).withColumn("_f_key", row_key("_f_id", "_f_text"))
    ids = checkpoint(rows.select("_f_id", "_f_key").groupBy("_f_id", "_f_key").count())
    own = _range_of(ids)
    order = [F.col("_f_id").desc_nulls_last(), F.col("_f_key").desc()]
    place = F.struct(F.col("_f_id").isNotNull().alias("has"), F.col("_f_id").alias("id"), F.col("_f_key").alias("key"))
    heads = ids.withColumn("_f_range", own).groupBy("_f_range").agg(F.max(place).alias("head"))
    ranks = Window.orderBy("_f_range")  # one narrow row for each range
    ring = heads.select("_f_range", F.coalesce(F.lead("head.key").over(ranks), F.first("head.key").over(ranks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_f_key"))
    first_texts = rows.join(F.broadcast(ring) if ids.count() <= 10_000 * RANGE_ROWS else ring, "_f_key").groupBy("_f_range").agg(F.first("_f_text").alias("_f_head")).withColumn("_f_head_own", sketch(F.col("_f_head")))
    inside = Window.partitionBy("_f_range").orderBy(*order)
    # equal rows stand side by side, and look past each other
    pairs = rows.withColumn("_f_own", sketch(F.col("_f_text"))).withColumn("_f_range", own).withColumn("_f_copies", F.count(F.lit(1)).over(inside.rangeBetween(Window.currentRow, Window.currentRow))).withColumn("_f_copy", F.row_number().over(inside) - F.rank().over(inside)).where("_f_copy = 0").withColumn("_f_lead", F.lead("_f_text").over(inside)).withColumn("_f_lead_own", F.lead("_f_own").over(inside))
    return pairs.join(first_texts, "_f_range", "left").select("_f_id", "_f_key", "_f_text", "_f_own", "_f_copies", F.coalesce("_f_lead", "_f_head").alias("_f_next"), F.coalesce("_f_lead_own", "_f_head_own").alias("_f_next_own"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.char_length("_f_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_f_text"), F.lit(1), n - half), F.substring(F.col("_f_next"), F.lit(1), half))
    rows = with_next(docs).withColumn("_f_edited", edited)
    rows = rows.withColumn("a", F.col("_f_own")).withColumn("b", sketch(F.col("_f_edited"))).withColumn("c", F.col("_f_next_own"))
    rows = rows.withColumn("pa", fingerprint(F.col("_f_text"), F.col("a"))).withColumn("pb", fingerprint(F.col("_f_edited"), F.col("b"))).withColumn("pc", fingerprint(F.col("_f_next"), F.col("c")))
    near = lambda x: likeness(F.col("a"), F.col(x), F.col("pa"), F.col(f"p{x}"))
    done = rows.select(
        F.col("_f_id").alias("doc_id"),
        n.cast("bigint").alias("n_chars"),
        F.sha2("_f_edited", 256).alias("edited_sha256"),
        F.col("pa").alias("fingerprint"),
        F.col("pb").alias("edited_fingerprint"),
        near("b").alias("near_edited"),
        near("c").alias("near_next"),
        F.expr("sequence(1L, _f_copies)").alias("_f_copies"),
    )
    # a finished row is repeated for each row that it stands for
    return done.select(*[c for c in done.columns if c != "_f_copies"], F.explode("_f_copies").alias("_f_copy")).drop("_f_copy")


def _sketch_sql(text: str) -> str:
    words = f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    hashes = f"list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: md5(array_to_string(w[i:i+{SHINGLE - 1}], ' ')))"
    return f"(SELECT CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(list_filter({hashes}, lambda h: h < '{KEEP_BELOW}'), lambda h: h[1:{DIGITS}]))) END FROM (SELECT {words} AS w))"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx, length(t) AS len FROM d),
e AS (SELECT *, t[1:len - len // 2] || nx[1:len // 2] AS ed FROM n),
s AS (SELECT *, {_sketch_sql('t')} AS a, {_sketch_sql('ed')} AS b, {_sketch_sql('nx')} AS c FROM e),
f AS (SELECT *, md5(t)[1:8] || ':' || array_to_string(a, ',') AS pa, md5(ed)[1:8] || ':' || array_to_string(b, ',') AS pb, md5(nx)[1:8] || ':' || array_to_string(c, ',') AS pc FROM s)
SELECT doc_id, len::BIGINT AS n_chars, sha256(ed) AS edited_sha256, pa AS fingerprint, pb AS edited_fingerprint,
  CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) WHEN pa = pb THEN 1.0 ELSE 0.0 END::DOUBLE AS near_edited,
  CASE WHEN len(a) + len(c) > 0 THEN len(list_intersect(a, c))::DOUBLE / len(list_distinct(list_concat(a, c))) WHEN pa = pc THEN 1.0 ELSE 0.0 END::DOUBLE AS near_next
FROM f"""
