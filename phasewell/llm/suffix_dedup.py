"""Operator 12, suffix-array dedup: bytes of strings of ``WIDTH`` bytes that start at two places or more.

Equal strings of ``WIDTH`` bytes hold the same least hash of ``GRAM`` bytes, their anchor, at the same
place. Windows of a text in a row with one anchor form a context (``WIDTH`` - 1 bytes and one for each
window), and only contexts with equal anchors can share a window. So:

1. Texts that are the same byte by byte stand once, with their number, in a table of buckets by key.
2. Every context gives one row (anchor, digest of the context, text, place). Anchors that occur once are
   done. Contexts of an anchor that are all the same are repeated whole.
3. Other anchors bring one copy of each context together. Their bytes form one string, whose
   Burrows-Wheeler transform is extended backward breadth-first from the empty string: each interval of
   suffixes that share w gives the intervals of cw, and where one ends at a border without a value, |w|
   is the common prefix there. Values come by increasing size and the search stops at ``WIDTH``; suffixes
   between borders without a value share ``WIDTH`` bytes or more. Every border gets a value once, so the
   work follows the string, not ``WIDTH``.
4. Windows found go back to their texts, whose bytes are cut.

Scale: texts are shuffled once, by key, after copies have met within each task; later joins read the
buckets in place. An anchor with more than ``HOT`` rows (a passage that stands in very many texts, at
its edges) isn't brought into one task: its windows are counted by 128-bit digests, with partial
aggregation, which gives the same result. A task works on about ``SLICE`` bytes of contexts, or one anchor's
``HOT`` contexts. Texts above ``PIECE`` bytes go through in overlapping pieces.

Edge cases: a null text counts as empty; texts below ``WIDTH`` bytes lose nothing; equal rows are copies
of each other, so each loses all it has if it has ``WIDTH`` bytes; removed strings are judged on the
input, so all places of a string go; an empty table gives an empty one; extra columns are kept by
``remove``. Two texts with equal 64-bit hash and length would count as copies, two contexts with equal
anchor and 64-bit digest as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import checkpoint, checkpoint_folder, table

#: Least length in bytes of a repeated string.
WIDTH = 200
#: Bytes of an anchor.
GRAM = 32
#: Context rows of one anchor that a task takes.
HOT = 4096
#: Bytes of contexts in one transform.
SLICE = 1 << 20
#: Windows that are looked at together while anchors are chosen; places must fit into ``_PLACE``.
PIECE = 1 << 22
_PLACE = np.uint64((1 << 23) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Separator of contexts and end of the string: bytes that UTF-8 never has.
GAP, END = 0xFF, 0xFE


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of each ``GRAM`` (4 words of 8) bytes in a row."""
    words = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    one = words * _A
    one ^= one >> np.uint64(32)
    two = one[:-8] * _B + one[8:]
    two ^= two >> np.uint64(29)
    four = two[:-16] * _C + two[16:]
    four ^= four >> np.uint64(32)
    four *= _A
    return four ^ (four >> np.uint64(29))


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, anchor) of each context; text i is data[offsets[i]:offsets[i + 1]]."""
    if len(data) < WIDTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, wanted = 1, WIDTH - GRAM + 1
    while span < wanted:
        step = min(span, wanted - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least & _PLACE).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    long = np.diff(offsets) >= WIDTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - WIDTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(anchor)])
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]])
    head = np.flatnonzero(new)
    start = at[head]
    return np.searchsorted(offsets, start, "right") - 1, start, np.diff([*head, len(at)]).astype(np.int64), hashes[anchor[start]]


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text, place in it) of pieces of texts, which overlap so that each window is in one."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts: list[tuple[int, int, int]] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner, lo, hi = np.array(parts).T
        return np.concatenate([data[a:b] for a, b in zip(lo, hi, strict=True)]), np.concatenate([[0], np.cumsum(hi - lo)]), owner, lo - at[owner]

    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for a in range(lo, hi - WIDTH + 1, PIECE):
            b = min(a + PIECE + WIDTH - 1, hi)
            if parts and size + b - a > PIECE + WIDTH:
                yield made()
                parts, size = [], 0
            parts.append((i, a, b))
            size += b - a
    if parts:
        yield made()


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, offsets, text, place in pieces(batch.column("text")):
            part, start, windows, anchor = contexts(data, offsets)
            view = memoryview(data)
            digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + windows + WIDTH - 1).tolist(), strict=True)), np.uint64, len(start))
            rows = pa.array(text[part])
            own = [batch.column(c).take(rows) for c in ("key", "size", "copies")]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), *own, pa.array(place[part] + start - offsets[part]), pa.array(windows)], ["anchor", "context", "key", "size", "copies", "start", "windows"])


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the values, and their stable order."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return rank, order


def suffixes(string: np.ndarray) -> np.ndarray:
    """Starts of the suffixes by their first ``WIDTH`` bytes or more; the last byte occurs once."""
    padded = np.concatenate([string, np.zeros(8, np.uint8)])
    rank, order = ranked(np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(string),), (1,)).astype(np.uint64))
    step = 8
    while step < WIDTH and rank[order[-1]] < len(string) - 1:
        after = np.zeros(len(string), np.int64)
        after[:-step] = rank[step:] + 1
        rank, order = ranked(rank * (len(string) + 1) + after)
        step *= 2
    return order


def classes(string: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each suffix in order: the same for those that share ``WIDTH`` bytes.

    Breadth-first backward extension on the Burrows-Wheeler transform of the string.
    """
    n = len(string)
    before = string[starts - 1]
    order = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one byte longer stands
    step[order] = np.arange(n)
    last, following = np.full(n, -1), np.full(n, n)  # the places before and after with the same byte
    same = before[order[1:]] == before[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    following[order[:-1][same]] = order[1:][same]
    common = np.full(n + 1, -1, np.int16)
    common[0] = 0
    low, high = np.array([0]), np.array([n])
    for value in range(WIDTH):
        one = high - low == 1
        down = [step[low[one]]]
        up = [down[0] + 1]
        low, high = low[~one], high[~one]
        if len(low):
            size = high - low
            at = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
            # intervals one byte longer are disjoint, so their ends sort alike
            down.append(np.sort(step[at[last[at] < np.repeat(low, size)]]))
            up.append(np.sort(step[at[following[at] >= np.repeat(high, size)]]) + 1)
        low, high = np.concatenate(down), np.concatenate(up)
        fresh = common[high] < 0
        low, high = low[fresh], high[fresh]
        common[high] = value
        if not len(low):
            break
    return np.cumsum(common[:-1] >= 0)


def repeated_windows(texts: list[bytes], weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context, (first, number) of windows in a row that occur twice, counted with weights."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    string = np.frombuffer(b"".join(t + bytes([GAP]) for t in texts) + bytes([END]), np.uint8)
    windows = sizes - WIDTH + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(windows.sum()) + np.repeat(begin[:-1] - np.cumsum(windows) + windows, windows)
    starts = suffixes(string)
    of = np.empty(len(string), np.int64)
    of[starts] = classes(string, starts)
    mine = of[at]
    twice = np.bincount(mine, weights[owner])[mine] >= 2
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    edge = np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8))
    # contexts end a row of windows as well
    cut = np.cumsum(windows)[:-1]
    both = cut[twice[cut - 1] & twice[np.minimum(cut, len(twice) - 1)]] if len(cut) else cut
    first, end = np.sort(np.concatenate([np.flatnonzero(edge == 1), both])), np.sort(np.concatenate([np.flatnonzero(edge == -1), both]))
    for i, a, b in zip(owner[first].tolist(), (at[first] - begin[owner[first]]).tolist(), (end - first).tolist(), strict=True):
        found[i].append((a, b))
    return found


def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, first, number) of repeated windows; rows come by anchor."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows], float))
        out = [(r[0], r[1], a, b) for r, spans in zip(rows, found, strict=True) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], ["anchor", "context", "first", "number"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "context", "copies", "bytes")], strict=True):
            if size >= SLICE and row[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield done(rows)


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(anchor, context, copies, bytes) of the contexts asked for in each text of a batch."""
    for text, rows in zip(batch.column("text").cast(pa.large_binary()), batch.column("wanted").to_pylist(), strict=True):
        data = text.as_py()
        for r in rows:
            yield r["anchor"], r["context"], r["copies"], data[r["start"] : r["start"] + r["windows"] + WIDTH - 1]


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "context", "copies", "bytes"]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = list(zip(*_wanted(batch.slice(i, 256)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, [pa.int64()] * 3 + [pa.binary()], strict=True)], names)


def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, copies, first, high, low): a 128-bit digest of every window of the contexts."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            columns: list[list] = [[], [], [], [], [], []]
            for anchor, context, copies, data in _wanted(batch.slice(i, 64)):
                for first in range(len(data) - WIDTH + 1):
                    x = xxhash.xxh3_128_intdigest(data[first : first + WIDTH])
                    for column, v in zip(columns, (anchor, context, copies, first, (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "context", "copies", "first", "high", "low"])


TEXT = ["key", "size"]
CONTEXT = ["anchor", "context"]


def text_key(text: str) -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("key"), F.octet_length(t).cast("bigint").alias("size")]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, size, text, copies), in buckets by key and size, so that later joins leave the texts in place."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    one = docs.select(*text_key(text), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy(*TEXT).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one.write.bucketBy(buckets, *TEXT).option("path", f"{checkpoint_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def joined(spans: Column) -> Column:
    """Spans (first, number) in order, with those that follow each other as one; a context has few."""
    none = F.array().cast("array<struct<first:bigint,number:bigint>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), (last["number"] + x["number"]).alias("number"))
        return F.when(last["first"] + last["number"] == x["first"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, none, step)


def repeated_places(texts: DataFrame) -> DataFrame:
    """(key, size, start, windows): windows of texts without copies that occur elsewhere as well."""
    rows = checkpoint(texts.where(F.col("size") >= WIDTH).select(*TEXT, "copies", "text").mapInArrow(context_rows, "anchor bigint, context bigint, key bigint, size bigint, copies bigint, start bigint, windows bigint"))
    anchors = rows.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"), (F.min("context") != F.max("context")).alias("mixed")).where("total > 1")
    kind = F.when(~F.col("mixed"), "same").when(F.col("rows") > HOT, "hot").otherwise("mixed")
    anchors = checkpoint(anchors.select("anchor", kind.alias("kind")))
    found = checkpoint(rows.join(anchors, "anchor"))
    first = found.groupBy(*CONTEXT, "kind").agg(F.min(F.struct(*TEXT, "start", "windows")).alias("at"), F.sum("copies").alias("copies"))

    def asked(kind: str) -> DataFrame:
        wanted = first.where(F.col("kind") == kind).groupBy("at.key", "at.size").agg(F.collect_list(F.struct(*CONTEXT, "copies", "at.start", "at.windows")).alias("wanted"))
        return texts.join(wanted, TEXT).select("text", "wanted")

    own = "anchor bigint, context bigint, copies bigint"
    together = asked("mixed").mapInArrow(cut_contexts, f"{own}, bytes binary").repartition("anchor").sortWithinPartitions("anchor")
    twice = together.mapInArrow(transformed, "anchor bigint, context bigint, first bigint, number bigint")
    each = checkpoint(asked("hot").mapInArrow(cut_windows, f"{own}, first bigint, high bigint, low bigint"))
    window = ["anchor", "high", "low"]
    often = checkpoint(each.groupBy(*window).agg(F.sum("copies").alias("n")).where("n > 1").drop("n"))
    hot = each.join(often, window).select(*CONTEXT, "first", F.lit(1).cast("bigint").alias("number"))
    spans = checkpoint(twice.unionByName(hot).groupBy(*CONTEXT).agg(joined(F.array_sort(F.collect_list(F.struct("first", "number")))).alias("spans")))
    alone = found.where("copies = 1")
    parts = alone.where("kind <> 'same'").join(spans, CONTEXT).select(*TEXT, "start", F.explode("spans").alias("s"))
    return alone.where("kind = 'same'").select(*TEXT, "start", "windows").unionByName(parts.select(*TEXT, (F.col("start") + F.col("s.first")).alias("start"), F.col("s.number").alias("windows")))


def covered(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["windows"] + WIDTH - 1) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, copies, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = text.as_py()
            ranges = ([(0, len(data))] if len(data) >= WIDTH else []) if copies > 1 else covered(spans or [])
            removed.append([{"start": a, "end": b} for a, b in ranges])
            kept.append(b"".join(data[a:b] for a, b in zip([0, *[b for _, b in ranges]], [*[a for a, _ in ranges], len(data)], strict=True)))
        ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("size"), pa.array(removed, ranges_type), pa.array(kept, pa.binary())], ["key", "size", "removed", "kept"])


def judged_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, size, removed, kept) of each distinct text: the byte ranges that go, and the bytes that stay."""
    texts = distinct_texts(docs, text)
    spans = repeated_places(texts).groupBy(*TEXT).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return texts.join(spans, TEXT, "left").select(*TEXT, "copies", "text", "spans").mapInArrow(kept_bytes, "key bigint, size bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the kept bytes as text; a character that is cut through becomes U+FFFD. Null stays null."""
    key, size, kept = (f"_{c}_{uuid.uuid4().hex}" for c in ("key", "size", "kept"))
    judged = judged_texts(docs, text).select(F.col("key").alias(key), F.col("size").alias(size), F.decode("kept", "UTF-8").alias(kept))
    own = docs.withColumns(dict(zip((key, size), text_key(text), strict=True)))
    return own.join(judged, [key, size]).withColumn(text, F.when(F.col(text).isNotNull(), F.col(kept))).select(*docs.columns)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    digests = judged_texts(docs).select(*TEXT, length.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_key("text")).join(digests, TEXT).select("doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT k, p, md5_number(substr(x, 2 * p + 1, {2 * WIDTH})) AS v FROM (SELECT k, x, unnest(range(0, length(x) // 2 - {WIDTH - 1})) AS p FROM d)),
r AS (SELECT k, p FROM w WHERE v IN (SELECT v FROM w GROUP BY v HAVING count(*) > 1)),
g AS (SELECT k, p, sum(far) OVER (PARTITION BY k ORDER BY p) AS run FROM (SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= {WIDTH} THEN 0 ELSE 1 END AS far FROM r)),
s AS (SELECT k, min(p) AS lo, max(p) + {WIDTH} AS hi FROM g GROUP BY k, run),
q AS (SELECT k, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY k ORDER BY lo) AS frm, lead(lo) OVER (PARTITION BY k ORDER BY lo) AS nxt FROM s),
t AS (SELECT k, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * frm + 1, 2 * (lo - frm)) || CASE WHEN nxt IS NULL THEN substr(x, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS kept FROM q JOIN d USING (k) GROUP BY k)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (k)"""
