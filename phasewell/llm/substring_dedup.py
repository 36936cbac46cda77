r"""Operator 10, substring dedup: paragraph MinHash banding, and passages across paragraphs.

Paragraphs are the lines of a text (split at ``\n``) with ``MIN_WORDS`` words or more. Each has a MinHash
signature over its 5-word shingles, cut into bands whose number and width ``bands`` tunes for a recall of
0.999 at the threshold. Paragraphs that share a band are compared in rounds and verified by exact Jaccard
(0.8) on their words; components of links are clusters.

A passage may also stand inside a longer line, or over lines of any length. So each text is read a second
way, in *windows* of ``WINDOW`` successive words, whatever its line breaks, whose starts are content-defined:
of ``PASSAGE - WINDOW + 1`` successive places, the one with the lowest 3-word hash starts one. Every passage
of ``PASSAGE`` words or more then holds, in each text in which it stands, the same window from its first to
its last word. Windows with the same words are a cluster. (In so short a window one changed word costs up to
five of twenty shingles, so that windows at Jaccard 0.8 differ in the outer two words at most: banding them
would find little more than equality, and takes three times the shuffle.)

A cluster with places in two documents or more is repeated; all its places but those in the first document
(by doc_id, then row hash) are to be removed. Overlapping places of one document with the same verdict are
merged into a span. Words are ``[^\x20\x09-\x0D]+``, with A-Z in lower case.

Scale: three narrow passes over the texts. Equal paragraphs are one class, written once per task, so that a
passage that is everywhere costs one row per task; texts move once, and only paragraphs that share a band
with another one stay. Joins on hot clusters have one row per cluster on the other side, so that Spark can
split them.

Edge cases: null and empty texts have no paragraph and no window; a text of one long line is one paragraph;
in a loop of the same few words one window starts per ``PASSAGE - WINDOW`` words or two; what repeats inside
one document alone is no repeat across documents (``within`` counts it too); rows equal in doc_id and text
count as one document and are listed once; null doc_ids come last in the order; a very long text is handled
whole, by one task; extra columns, whatever their names, are kept by ``remove``; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import PARITIES, PARITY_SCHEMA, digests, link_rounds, may_link, parities, shingle_sets, verified
from .text import Words, checkpoint, filled, mix, row_key, slices, table

#: A line of fewer words is no paragraph; what it shares is found by windows.
MIN_WORDS = 40
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 128
#: Words of a window.
WINDOW = 24
#: Words of a passage that is sure to hold one.
PASSAGE = 51
#: Places for a start, of which one is taken.
REACH = PASSAGE - WINDOW + 1
#: Digests that a task remembers, to write equal paragraphs once.
SEEN = 200_000
#: Bits of a place in the keys that a minimum is taken of.
PLACE_BITS = np.uint64(28)
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows of each): the widest rows that still reach the recall at the threshold."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        for n in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** n >= recall:
                best = (n, rows)
                break
    return best


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k successive words, texts' ends not heeded."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * ODD + hashes[j : j + len(out)] + np.uint64(j + 1))
    return out


def starts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where paragraphs start, as numbers into the words of all texts."""
    ways = np.maximum(np.diff(offsets) - WINDOW + 1, 0)  # places for a start in each text
    if not ways.any():
        return np.zeros(0, np.int64)
    gram = rolled(hashes, 3)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    lowest = (gram & ~low) | (np.arange(len(gram), dtype=np.uint64) & low)
    span = 1
    least = lowest
    while span < REACH:  # minima of ever wider runs of places
        step = min(span, REACH - span)
        least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
        span += step
    long, short = np.flatnonzero(ways >= REACH), np.flatnonzero((ways > 0) & (ways < REACH))
    runs = ways[long] - REACH + 1
    first = np.repeat(offsets[:-1][long] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    # the low bits of a place are told from the run it lies in
    near = [first + (((least[first] & low).astype(np.int64) - first) & int(low))]
    if len(short):
        edges = np.stack([offsets[:-1][short], offsets[:-1][short] + ways[short]], 1).ravel()
        own = np.minimum.reduceat(np.append(lowest, ~np.uint64(0)), edges)[::2]
        near.append(offsets[:-1][short] + (((own & low).astype(np.int64) - offsets[:-1][short]) & int(low)))
    at = np.unique(np.concatenate(near))
    # in loops of words equal minima follow each other: one start per REACH words stays of them
    owner = np.searchsorted(offsets, at, side="right")
    fresh = np.concatenate([[True], (gram[at[1:]] != gram[at[:-1]]) | (owner[1:] != owner[:-1]) | (np.diff(at) >= REACH)])
    began = at[fresh][np.cumsum(fresh) - 1]
    part = (at - began) // REACH
    return at[fresh | np.concatenate([[True], part[1:] != part[:-1]])]


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, digest) of each window."""
    w = Words(texts)
    hashes = w.hashes(w.lowered())
    begin = starts(hashes, w.offsets)
    owner = np.searchsorted(w.offsets, begin, side="right") - 1
    acc = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            acc = mix(acc * ODD + hashes[begin + j])
    return owner, begin - w.offsets[owner], acc.view(np.int64)


def window_table(keyed: DataFrame) -> DataFrame:
    """(row, first, d) of each window of keyed (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, first, d = windows_of(filled(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(owner)), pa.array(first.astype(np.int32)), pa.array(d)], ["row", "first", "d"])

    return keyed.select("row", "text").mapInArrow(run, "row bigint, first int, d bigint")


def long_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text number, number of the line, first word, words, the line) of each line of MIN_WORDS words."""
    lists = pc.split_pattern(texts, "\n")
    at = np.asarray(lists.offsets, np.int64)
    at = at - at[0]
    lines = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    split = pc.ascii_split_whitespace(lines)
    off = np.asarray(split.offsets, np.int64)
    real = np.concatenate([[0], np.cumsum(pc.greater(pc.binary_length(split.flatten()), 0).to_numpy(zero_copy_only=False))])
    ends = real[off - off[0]]
    words = np.diff(ends)
    pick = np.flatnonzero(words >= MIN_WORDS)
    return owner[pick], pick - at[:-1][owner[pick]], ends[pick] - ends[at[:-1][owner[pick]]], words[pick], lines.take(pa.array(pick))


def band_keys(values: np.ndarray, offsets: np.ndarray, n: int, rows: int) -> np.ndarray:
    """Keys (sets x bands) of the MinHash signatures of non-empty sets."""
    out = np.zeros((len(offsets) - 1, n), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(n):
            acc = np.full(len(offsets) - 1, np.uint64(b + 1))
            for r in range(rows):
                seed = mix(np.array([b * 1000 + r + 1], np.uint64))[0]
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((values ^ seed) * (seed | np.uint64(1)), offsets[:-1]))
            out[:, b] = acc
    return out.view(np.int64)


def paragraph_table(keyed: DataFrame) -> DataFrame:
    """(row, paragraph, first, words, d, n, parities) of each paragraph of keyed (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, number, first, words, lines = long_lines(filled(part.column("text")))
                values, at = shingle_sets(lines)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(owner)), *[pa.array(x.astype(np.int32)) for x in (number, first, words)], pa.array(digests(values, at)), pa.array(np.diff(at)), *parities(values, at)],
                    ["row", "paragraph", "first", "words", "d", "n", *[p for p, *_ in PARITIES]],
                )

    return keyed.select("row", "text").mapInArrow(run, "row bigint, paragraph int, first int, words int, d bigint, n bigint, " + PARITY_SCHEMA)


def key_table(keyed: DataFrame) -> DataFrame:
    """(key, d) of each distinct paragraph of a task."""
    n, rows = bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                if len(seen) > SEEN:  # forgetting costs repeated rows, no results
                    seen.clear()
                *_, lines = long_lines(filled(part.column("text")))
                values, at = shingle_sets(lines)
                d = digests(values, at)
                new = np.zeros(len(d), bool)
                for i, x in enumerate(d.tolist()):
                    new[i] = x not in seen
                    seen.add(x)
                if not new.any():
                    continue
                size = np.diff(at)
                values, at = values[np.repeat(new, size)], np.concatenate([[0], np.cumsum(size[new])])
                keys = band_keys(values, at, n, rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(d[new], n))], ["key", "d"])

    return keyed.select("row", "text").mapInArrow(run, "key bigint, d bigint")


def texts_of(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(d, text) of the wanted (row, paragraph, d)."""
    lines = F.split("text", "\n", -1)
    listed = wanted.groupBy("row").agg(F.collect_set(F.struct("paragraph", "d")).alias("w"))
    found = keyed.select("row", "text").join(listed, "row").select(lines.alias("l"), F.explode("w").alias("w"))
    return found.groupBy("w.d").agg(F.first(F.get(F.col("l"), F.col("w.paragraph").cast("int"))).alias("text"))


def similar(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(d, c) of the classes of paragraphs that link with another one."""
    classes = checkpoint(lines.groupBy("d").agg(F.min(F.struct("row", "paragraph")).alias("at"), *[F.first(c).alias(c) for c in ("n", *[p for p, *_ in PARITIES])]))
    # what joins ask of keys stands here for all readers, so that one exchange serves them
    keys = key_table(keyed).where("key IS NOT NULL AND d IS NOT NULL").repartition("key")
    shared = keys.groupBy("key").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 <> d1").select("key")
    own = classes.selectExpr("d", "n", *[f"p4[{i}] as w{i}" for i in range(4)])
    rows = checkpoint(keys.join(shared, "key").distinct().join(own, "d"))
    wanted = rows.select("d").distinct().join(classes.select("d", "at.row", "at.paragraph"), "d")
    texts = checkpoint(texts_of(keyed, wanted))
    wide = [p for p, *_ in PARITIES[1:]]
    side = lambda x: classes.select(F.col("d").alias(x), F.struct("n", *wide).alias(f"s{x}"))

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(wide, "sa", "sb")).select("a", "b")
        return verified(near, texts)

    return link_rounds(rows, verify)


def places(docs: DataFrame, text: str = "text", id_column: str = "doc_id", within: bool = False) -> DataFrame:
    """A row per place of a repeated paragraph or window: id, row (hash), first and end (words, end
    exclusive), c (cluster), kept_id, kept_row, documents (that have the cluster), removed."""
    keyed = docs.select(row_key(id_column, text).alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = checkpoint(paragraph_table(keyed))
    labels = similar(keyed, lines)
    of_lines = lines.join(labels, "d", "left").select("row", "first", (F.col("first") + F.col("words")).alias("end"), F.coalesce("c", "d").alias("c"))
    dealt = checkpoint(window_table(keyed))
    many = F.min("row") != F.max("row")
    if within:
        many = many | (F.max("first") - F.min("first") >= WINDOW)
    again = dealt.groupBy("d").agg(many.alias("many")).where("many").select("d")
    of_windows = dealt.join(again, "d").select("row", "first", (F.col("first") + WINDOW).alias("end"), F.col("d").alias("c"))
    per_row = of_lines.unionByName(of_windows).groupBy("c", "row").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("ats"))
    per_row = checkpoint(per_row.join(keyed.select("row", "id").distinct(), "row"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    repeated = F.col("documents") > 1
    if within:
        repeated = repeated | F.col("apart")
    apart = F.bool_or(F.element_at("ats", -1)["first"] >= F.get("ats", F.lit(0))["end"])
    of = per_row.groupBy("c").agg(F.count(F.lit(1)).alias("documents"), F.min(place).alias("kept"), apart.alias("apart")).where(repeated).select("c", "documents", "kept")
    out = per_row.join(of, "c").select("id", "row", "c", F.posexplode("ats").alias("nth", "at"), "kept", "documents")
    gone = (F.col("row") != F.col("kept.row")) | (F.lit(within) & (F.col("nth") > 0))
    return out.select("id", "row", "at.first", "at.end", "c", F.col("kept.id").alias("kept_id"), F.col("kept.row").alias("kept_row"), "documents", gone.alias("removed"))


def spans(docs: DataFrame, text: str = "text", id_column: str = "doc_id", within: bool = False) -> DataFrame:
    """Repeated spans: id, row, first_word, end_word (exclusive), kept_id and documents (of the span's
    first place), removed."""
    order = Window.partitionBy("row", "removed").orderBy("first", "end", "c")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    island = places(docs, text, id_column, within).withColumn("_new", F.coalesce((F.col("first") > F.max("end").over(before)).cast("int"), F.lit(1)))
    island = island.withColumn("_nth", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.min(F.struct("first", "end", "c", "kept_id", "documents"))
    merged = island.groupBy("row", "removed", "_nth").agg(F.first("id").alias("id"), F.min("first").alias("first_word"), F.max("end").alias("end_word"), head.alias("f"))
    return merged.select("id", "row", "first_word", "end_word", F.col("f.kept_id").alias("kept_id"), F.col("f.documents").alias("documents"), "removed")


WORD = re.compile("[^\x20\x09-\x0d]+")


def cut(text: str, gone: list[dict]) -> str:
    """text without the words of the spans, and without the white space before each of them."""
    ends = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = [], 0
    for first, end in sorted((s["first_word"], s["end_word"]) for s in gone):
        before = ends[first - 1][1] if first else 0
        out.append(text[at : max(before, at)])
        at = max(at, ends[end - 1][1])
    return "".join(out) + text[at:]


def remove(docs: DataFrame, text: str = "text", id_column: str = "doc_id", within: bool = False) -> DataFrame:
    """docs with the repeated spans taken out of their texts; the rest of a text stays as it is."""

    @F.arrow_udf("string")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([cut(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True)], pa.string())

    gone = spans(docs, text, id_column, within).where("removed").groupBy("row").agg(F.collect_list(F.struct("first_word", "end_word")).alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(id_column, text).alias("row"))
    joined = whole.join(gone, "row", "left")
    cut_ones = joined.where("gone IS NOT NULL").withColumn("new", without.asNondeterministic()(F.col("doc")[text], F.col("gone")))
    new = cut_ones.select([(F.col("new") if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
    return new.unionByName(joined.where("gone IS NULL").select([F.col("doc")[c].alias(c) for c in docs.columns]))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated spans only: documents without a passage that another document has too have no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans(docs).select(F.col("id").alias("doc_id"), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), F.col("kept_id").alias("kept_doc_id"), "documents", "removed")
