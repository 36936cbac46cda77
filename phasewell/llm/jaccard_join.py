"""Operator 4, n-gram Jaccard join: universe partition with pigeonhole keys.

A document is the set of its 5-word shingles; two documents link at Jaccard 0.8. Sets are put in
size bands (each 1.25 times as wide as the one before); a set is indexed in its own band and in the
one below, so that a pair meets in the smaller set's band. The band bounds the number H of elements
in which linked sets differ. Shingles are hashed into m segments; segment i gets an
allowance of 1 (equal subsets share a key) or 2 (also subsets that differ by one element share one:
each set adds keys for its one-deletion neighbourhood). If the allowances sum to H + 1 + g, linked
sets agree on segments worth g + 1 at least. ``allocation`` picks the number of segments of each
kind by their cost: keys written, and chance agreements of small segments.

The surplus g pays for keys that are not worth following: empty segments, and *hot* keys with more
than ``HOT`` sets behind them. A set whose skipped keys are worth at most g still meets every
partner at another key. Sets that skip more (near copies by the thousand, texts made mostly of
common passages) keep their hot keys, and meet each other there: a pair of two such sets has no
other way, any other pair has one. So nothing is capped and no link is lost.

Candidates that share a key are compared in rounds (``components.link_rounds``) and verified
exactly on their whole texts.

Scale: two narrow passes over the texts (sets' digests and sizes; keys); keys are combined on the
map side, and each task writes equal texts once. Texts move once, and only those of candidates stay.
Sets are told apart by a 64-bit digest, shingles by a 64-bit hash.

Edge cases: without words (null, empty) a document is its own component; with fewer than five words
the whole sequence is one shingle; equal rows and copies are one class; a component's id is its
smallest doc_id (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import PARITIES, PARITY_SCHEMA, digests, link_rounds, may_link, packed, parities, shingle_sets, verified
from .text import checkpoint, filled, mix, row_key, slices, table

#: Sets behind a key beyond which it is skipped where the surplus allows it.
HOT = 48
#: Digests that a task remembers, to write equal texts once.
SEEN = 200_000
#: Estimated share of shingles that are common, for the cost of chance agreements.
COMMON = 0.2


def band_starts(largest: int) -> np.ndarray:
    """Smallest size of each band up to the one after that of ``largest``."""
    starts = [1]
    while starts[-1] <= largest * 1.25 + 2:
        starts.append(starts[-1] * 5 // 4 + 1)
    return np.array(starts, np.int64)


@lru_cache(maxsize=4096)
def allocation(largest: int) -> tuple[int, int, int]:
    """(segments of allowance 2, of allowance 1, surplus g) for pairs whose smaller set has up to
    this size: with sizes x <= y <= 1.25 x they differ in (x + y) / 9 <= x / 4 elements at most."""
    need = largest // 4 + 1
    surplus = 3 + need // 16
    total = need + surplus
    best = None
    for two in range(total // 2 + 1):
        one = total - 2 * two
        m = one + two
        each = largest / m
        cost = m + two * each + HOT * m * COMMON**each + 4 * m * math.exp(-each)
        if best is None or cost < best[0]:
            best = (cost, two, one)
        if two > 40 and two > best[1] + 20:
            break
    return best[1], best[2], surplus


def keys_of(values: np.ndarray, offsets: np.ndarray, band: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sets in the given band each: (key, number of the set, allowance left)."""
    plan = {int(b): allocation(int(starts[b + 1] - 1)) for b in np.unique(band)}
    two = np.array([plan[int(b)][0] for b in band], np.int64)
    segments = two + np.array([plan[int(b)][1] for b in band], np.int64)
    surplus = np.array([plan[int(b)][2] for b in band], np.int64)
    n = len(band)
    base = np.concatenate([[0], np.cumsum(segments)])
    owner = np.repeat(np.arange(n), np.diff(offsets))
    salt = mix(band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(17))
    with np.errstate(over="ignore"):
        segment = (mix(values ^ salt[owner]) % segments.astype(np.uint64)[owner]).astype(np.int64)
        slot = base[owner] + segment
        order = np.argsort(slot, kind="stable")
        sorted_slot = slot[order]
        content = mix(values * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(3))[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_slot[1:] != sorted_slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        filled_slot = sorted_slot[first]
        sums = np.add.reduceat(content, first) if len(first) else np.zeros(0, np.uint64)
        size = np.zeros(base[-1], np.int64)
        size[filled_slot] = np.diff(np.concatenate([first, [len(slot)]]))
        of_slot = np.repeat(np.arange(n), segments)
        number = np.arange(base[-1]) - base[:-1][of_slot]
        double = number < two[of_slot]
        # what empty segments, and one-deletions to an empty one, would have been worth
        lost = np.bincount(of_slot, weights=np.where(size == 0, 1 + double, (size == 1) & double), minlength=n).astype(np.int64)
        shown = lost > surplus  # such sets keep these keys too
        left = np.where(shown, surplus, surplus - lost)
        slot_salt = mix(salt[of_slot] + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        total = np.zeros(base[-1], np.uint64)
        total[filled_slot] = sums
        exact = np.flatnonzero((size > 0) | shown[of_slot])
        keys, sets = [mix(total[exact] + slot_salt[exact])], [of_slot[exact]]
        member = double[sorted_slot] & ((size[sorted_slot] > 1) | shown[of_slot[sorted_slot]])
        at = sorted_slot[member]
        keys.append(mix(total[at] - content[member] + slot_salt[at]))
        sets.append(of_slot[at])
    sets_all = np.concatenate(sets)
    return np.concatenate(keys).view(np.int64), sets_all, left[sets_all]


def set_table(keyed: DataFrame) -> DataFrame:
    """(row, d, n, parities) of each row of keyed (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(filled(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(digests(values, at)), pa.array(np.diff(at)), *parities(values, at)], ["row", "d", "n", *[p for p, *_ in PARITIES]])

    return keyed.select("row", "text").mapInArrow(run, "row bigint, d bigint, n bigint, " + PARITY_SCHEMA)


def key_table(keyed: DataFrame) -> DataFrame:
    """(key, d, way): way is the band and the allowance left of the set in it, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                if len(seen) > SEEN:  # forgetting costs repeated rows, no results
                    seen.clear()
                values, at = shingle_sets(filled(part.column("text")))
                d, n = digests(values, at), np.diff(at)
                new = np.zeros(len(d), bool)
                for i in np.flatnonzero(n).tolist():
                    x = int(d[i])
                    new[i] = x not in seen
                    seen.add(x)
                pick = np.flatnonzero(new)
                if not len(pick):
                    continue
                inside = np.repeat(new, n)
                values, at, d = values[inside], np.concatenate([[0], np.cumsum(n[pick])]), d[pick]
                starts = band_starts(int(n[pick].max()))
                own = np.searchsorted(starts, n[pick], side="right") - 1
                for band in (own, np.maximum(own - 1, 0)):
                    key, sets, left = keys_of(values, at, band, starts)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(d[sets]), pa.array((band[sets] * 100_000 + left).astype(np.int32))], ["key", "d", "way"])

    return keyed.select("row", "text").mapInArrow(run, "key bigint, d bigint, way int")


def classes_of(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(sets, labels): sets has a row per row of docs (id, row, d, n ...); labels (d, c) those with a link."""
    keyed = docs.select(row_key(id_column, text).alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sets = checkpoint(set_table(keyed))
    classes = checkpoint(sets.where("n > 0").groupBy("d").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", *[p for p, *_ in PARITIES])]))
    # dealt out once, for the counts and for the rows: both read the same exchange
    keys = key_table(keyed).repartition("key")
    shared = keys.groupBy("key").agg(F.count("way").alias("sets"), F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 <> d1").select("key", "sets")
    rows = checkpoint(keys.join(shared, "key").distinct())
    hot = rows.where(f"sets > {HOT}")
    over = hot.groupBy("d", "way").agg(F.count(F.lit(1)).alias("skipped")).where("skipped > way % 100000").select("d", "way")
    followed = rows.where(f"sets <= {HOT}").selectExpr("key", "d", "false as hot").unionByName(hot.join(over, ["d", "way"], "left_semi").selectExpr("key", "d", "true as hot"))
    # rows carry the bounds on links with them, in hot buckets the wider ones too
    own = classes.selectExpr("d", "n", *[f"p4[{i}] as w{i}" for i in range(4)], "p16")
    followed = checkpoint(followed.distinct().join(own, "d").select("key", "d", "n", *[f"w{i}" for i in range(4)], F.when(F.col("hot"), F.col("p16")).alias("p16")))
    wanted = followed.select("d").distinct().join(classes.select("d", "row"), "d")
    texts = checkpoint(packed(keyed).join(wanted, "row").groupBy("row", "d").agg(F.first("text").alias("text")).select("d", "text"))
    wide = [p for p, *_ in PARITIES[1:]]
    side = lambda x: classes.select(F.col("d").alias(x), F.struct("n", *wide).alias(f"s{x}"))

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(wide, "sa", "sb")).select("a", "b")
        return verified(near, texts)

    return sets, link_rounds(followed, verify)


def join_rows(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of docs: id, row (hash), n_shingles, class (digest, null without words), component id."""
    sets, labels = classes_of(docs, text, id_column)
    ids = docs.select(F.col(id_column).alias("id"), row_key(id_column, text).alias("row"))
    per_row = ids.join(sets.groupBy("row").agg(F.first("d").alias("d"), F.first("n").alias("n")), "row")
    per_class = per_row.where("n > 0").groupBy("d").agg(F.min("id").alias("id0"))
    named = per_class.join(labels, "d", "left").select("d", "id0", F.coalesce("c", "d").alias("c"))
    first = named.groupBy("c").agg(F.min("id0").alias("component_id"))
    of_class = named.join(first, "c").select("d", "c", "component_id")
    out = per_row.join(of_class, "d", "left")
    return out.select("id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).alias("class"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_per_group(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs with one row of each component: the smallest id, then the smallest row hash.

    Rows without words are all kept.
    """
    found = join_rows(docs, text, id_column)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    keep = found.where("n_shingles > 0").groupBy("class").agg(F.min(place).alias("kept")).selectExpr("kept.row as _j_row", "true as _j_one")
    bare = found.where("n_shingles = 0").selectExpr("row as _j_row", "false as _j_one").distinct()
    kept = docs.withColumn("_j_row", row_key(id_column, text)).join(keep.unionByName(bare), "_j_row")
    once = kept.where("_j_one").dropDuplicates(["_j_row"])
    return once.unionByName(kept.where("NOT _j_one")).select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join_rows(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.b AS d, r.c FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.d = w.doc_id"""
