"""Shared by operators 4 and 10: links between texts that share keys, and connected components.

A *class* is a set of equal texts and has a 64-bit digest ``d``. Candidate classes share a key.
Linking inside a key's bucket goes in three rounds: every class meets the pivot with which it shares
most keys, then the few pivots of each bucket that are in most buckets, then all members that still
lie in different components. Real links merge components before the next round, and a pair leaves a
join only if its sizes and parities allow a link: the bounds are part of the join's condition, so
what a join emits follows the links and not the square of a bucket. No link between components is
lost: a pair of a bucket has been compared, or excluded by a bound, or lies in one component.

What is not linear: in the last round the bounds are evaluated (some nanoseconds each, nothing is
emitted) for members of one bucket that lie in different components.

All tables are narrow and distributed; nothing but counts reaches the driver, and each round ends
in a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import Words, checkpoint, distinct_sets, filled, mix, slices, windows

SHINGLE = 5
#: Two sets link when 100 * intersection >= LINK * union.
LINK = 80
#: Pivots of a bucket in the second round.
PIVOTS = 8


def shingle_sets(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text, and offsets."""
    w = Words(texts)
    grams, offsets = windows(w.hashes(w.lowered() if lower else None), w.offsets, SHINGLE)
    return distinct_sets(grams, offsets)


def digests(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A signed 64-bit digest of each set (the order of its values doesn't matter)."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    with np.errstate(over="ignore"):
        if full.any():
            out[full] = np.add.reduceat(mix(values * np.uint64(0xC2B2AE3D27D4EB4F)), offsets[:-1][full])
        return mix(out + n.astype(np.uint64)).view(np.int64)


#: Names of the parity columns, their 64-bit words, and the sizes above which a set has them.
PARITIES = (("p4", 4, 0), ("p16", 16, 60), ("p64", 64, 600))
PARITY_SCHEMA = ", ".join(f"{name} array<bigint>" for name, *_ in PARITIES)


def parities(values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Parity bits of each set, wider ones for larger sets (null for sets too small to need them).

    Two sets' parities differ in at most as many bits as the sets differ in elements. Values are
    sorted within a set, so that the word of a value, its leading bits, changes in order.
    """
    n, out = np.diff(offsets), []
    bit = np.uint64(1) << (mix(values ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(63))
    for _, words, above in PARITIES:
        has = (n > above) | (above == 0)
        inside = np.repeat(has, n)
        owner = np.repeat(np.cumsum(has) - 1, n)[inside]
        slot = owner * words + (values[inside] >> np.uint64(64 - words.bit_length() + 1)).astype(np.int64)
        flat = np.zeros(int(has.sum()) * words, np.uint64)
        if len(slot):
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            flat[slot[first]] = np.bitwise_xor.reduceat(bit[inside], first)
        ends = np.concatenate([[0], np.cumsum(np.where(has, words, 0))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)), mask=pa.array(~has)))
    return out


def may_link(columns: list[str], a: str = "a", b: str = "b") -> str:
    """SQL test that no linked pair fails: sizes, and the parities' bound on the difference.

    Of sizes x and y, linked sets differ in at most (x + y) / 9 elements. ``columns`` names the
    parities of the rows: single words (``w0``, ``w1`` ...), tested together and first, and arrays.
    """
    words = [c for c in columns if c[0] == "w"]
    tests = [f"100 * least({a}.n, {b}.n) >= {LINK} * greatest({a}.n, {b}.n)"]
    if words:
        tests.append("9 * (" + " + ".join(f"bit_count({a}.{w} ^ {b}.{w})" for w in words) + f") <= {a}.n + {b}.n")
    for p in (c for c in columns if c[0] == "p"):
        tests.append(f"coalesce(9 * aggregate(zip_with({a}.{p}, {b}.{p}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v) <= {a}.n + {b}.n, true)")
    return " AND ".join(tests)


def packed(keyed: DataFrame) -> DataFrame:
    """keyed (row, text) with each text compressed, for texts that move between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                small = [pack(x) for x in filled(part.column("text")).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(small, pa.binary())], ["row", "text"])

    return keyed.select("row", "text").mapInArrow(run, "row bigint, text binary")


def unpacked(texts: pa.Array) -> pa.Array:
    """Texts, compressed by ``packed`` or plain."""
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        unpack = zstandard.ZstdDecompressor().decompress
        return pa.array([unpack(x) for x in texts.to_pylist()], pa.large_binary()).cast(pa.large_string())
    return texts.cast(pa.large_string())


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose shingle sets link; texts has (d, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                ids, first, where = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
                both = pa.concat_arrays([part.column("ta"), part.column("tb")]).take(pa.array(first))
                values, at = shingle_sets(unpacked(both))
                keep = linked(values, at, where[: len(a)], where[len(a) :])
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    left = pairs.join(texts.selectExpr("d as a", "text as ta"), "a")
    return left.join(texts.selectExpr("d as b", "text as tb"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def linked(values: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets number a[i] and b[i] link, counted exactly."""
    size = np.diff(at)
    out = np.zeros(len(a), bool)
    step = 256
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step], b[lo : lo + step]
        n = size[x] + size[y]
        ends = np.concatenate([[0], np.cumsum(n)])
        pick = np.concatenate([np.concatenate([values[at[i] : at[i + 1]], values[at[j] : at[j + 1]]]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]) if len(x) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(x)), n).astype(np.uint16)
        order = np.argsort(pick, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        v, o = pick[order], owner[order]
        same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
        both = np.bincount(o[1:][same], minlength=len(x))
        union = np.diff(ends) - both
        out[lo : lo + step] = (100 * both >= LINK * union) & (union > 0)
    return out


def components(links: DataFrame) -> DataFrame:
    """(d, c) for every end of links (a, b): c is the smallest d of its component.

    Alternating large and small stars; each round is a checkpoint, the number of rounds grows with
    the logarithm of the longest path.
    """
    def mark(edges: DataFrame) -> tuple:
        """Number and two 64-bit digests of distinct edges, from one narrow pass."""
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = checkpoint(links.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").selectExpr("explode(array(struct(u, m), struct(v as u, m))) as e").selectExpr("e.u as u", "e.m as v").where("u <> v").distinct()
        edges = checkpoint(small)
        now = mark(edges)
        same, before = now == before, now
        if same:
            return edges.groupBy("u").agg(F.min("v").alias("c")).selectExpr("u as d", "c").unionByName(edges.selectExpr("v as d", "v as c").distinct()).groupBy("d").agg(F.min("c").alias("c"))


def link_rounds(rows: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(d, c) of all classes with a link. rows: (key, d, n, parities), distinct.

    ``verify`` takes distinct (a, b) that may link and gives those that do. Pivots of a bucket are
    its classes with most keys: in a group of near copies, those that were edited least.
    """
    bounds = [c for c in rows.columns if c not in ("key", "d")]
    test = may_link([c for c in bounds if c != "n"])
    degree = rows.groupBy("d").agg(F.count(F.lit(1)).alias("k"))
    left = checkpoint(rows.join(degree, "d"))

    def compared(met: DataFrame) -> DataFrame:
        return checkpoint(verify(met.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()))

    def labelled(known: DataFrame) -> DataFrame:
        """Members of buckets with several components, with their component c."""
        nonlocal labels
        if not known.isEmpty():
            labels = checkpoint(components(known))
        tagged = left.withColumn("c", F.col("d")) if labels is None else left.join(labels, "d", "left").withColumn("c", F.coalesce("c", "d"))
        mixed = tagged.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
        return checkpoint(tagged.join(mixed, "key").select(*left.columns, "c"))

    labels: DataFrame | None = None
    first = left.groupBy("key").agg(F.max(F.struct("k", "d", *bounds)).alias("m")).select("key", "m.*")
    shares = left.alias("a").join(first.alias("b"), F.expr(f"a.key = b.key AND a.d <> b.d AND {test}")).groupBy(F.expr("a.d as a"), F.expr("b.d as b")).agg(F.count(F.lit(1)).alias("k"))
    best = shares.groupBy("a").agg(F.max(F.struct("k", "b")).alias("m")).selectExpr("a", "m.b as b")
    known = compared(best)
    tagged = labelled(known)
    if not tagged.isEmpty():
        ranks = Window.partitionBy("key").orderBy(F.col("k").desc(), "d")
        pivots = tagged.withColumn("r", F.row_number().over(ranks)).where(f"r <= {PIVOTS}").drop("r")
        met = tagged.alias("a").join(pivots.alias("b"), F.expr(f"a.key = b.key AND a.c <> b.c AND {test}"))
        known = known.unionByName(compared(met.selectExpr("a.d as a", "b.d as b")))
        tagged = labelled(known)
    if not tagged.isEmpty():
        met = tagged.alias("a").join(tagged.alias("b"), F.expr(f"a.key = b.key AND a.d < b.d AND a.c <> b.c AND {test}"))
        known = known.unionByName(compared(met.selectExpr("a.d as a", "b.d as b")))
        labels = None if known.isEmpty() else checkpoint(components(known))
    return labels if labels is not None else rows.sparkSession.createDataFrame([], "d bigint, c bigint")
