"""Operator 5, best-fit packing: a configuration linear program over the length histogram.

A configuration says how many pieces of each length share a sequence. The linear program (cover
every length's count with the least number of configurations) is solved by column generation: a
knapsack dynamic program finds the best configurations at the present prices of lengths, simplex
steps take them into the basis, until the gap to the prices' bound is met. The solution (at most
one configuration per length) is rounded down, and what rounding leaves, less than one sequence of
each configuration, goes through best-fit decreasing.

Scale: tokenising and cutting happen where rows are read; only narrow piece rows are kept (in a
reliable checkpoint, so that ranks stay the same if a task is run again). The driver sees the
histogram and the plan, both bounded by the sequence length and not by the corpus. Pieces are
numbered within their length by partition offsets (counts per partition and length, then a window
over those counts), so no length, however frequent, is gathered in one task.

Edge cases: a null text counts as empty (one piece, the end mark alone); texts longer than a
sequence are cut from the end, so that only the first piece may be short; repeated rows and null
doc_ids are packed like any other row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, ragged
from .text import checkpoint, filled, slices, table

SEQUENCE = 1024
END = 2
#: The linear program is solved when it is proven to be within this share of its bound.
GAP = 1e-4
#: Pricings that must together save more than ``GAP`` of the bound, else the tail is left to the rounding.
STALL = 40
#: Columns that may enter the basis between two pricings.
ENTER = 60
#: How far prices are drawn towards length / size, pricing by pricing.
PULLS = (0.9, 0.6, 0.3, 0.0)

SPACE = "\\t-\\r \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: A space beside other white space: such texts are tokenised whole.
BESIDE = f" [{SPACE}]|[{SPACE}] "


class ByteBpe:
    """Byte-level BPE of a tokenizer file, encoding each distinct chunk of a part once.

    A single space between two words always starts a new pre-token, so texts are split there;
    texts with wider gaps or added tokens are encoded whole by the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        # fixed value: the pre-token pattern of byte-level files
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec["added_tokens"]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text's."""
        odd = pc.match_substring_regex(texts, BESIDE)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(odd_at) else texts
        lists = pc.split_pattern(plain, " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(coded.dictionary)
        first = np.zeros(len(ids), bool)
        first[offsets[:-1]] = True
        # chunk c of the dictionary stands for " c" after a space, and for "c" at the start (number n + c)
        code = np.where(first, ids + n, ids)
        chunks = coded.dictionary.to_pylist()
        starting = np.unique(ids[first])
        encoded: list[list[int]] = [self.fast(" " + c) for c in chunks]
        rest: list[list[int]] = [[] for _ in range(n)]
        for c in starting.tolist():
            rest[c] = self.fast(chunks[c])
        encoded += rest
        sizes = np.fromiter(map(len, encoded), np.int64, 2 * n)
        flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(sizes.sum()))
        out, at = ragged(flat, np.concatenate([[0], np.cumsum(sizes)]), code)
        at = at[offsets - offsets[0]]
        if len(odd_at):
            parts = [out[at[i] : at[i + 1]] for i in range(len(texts))]
            for i in odd_at.tolist():
                parts[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            out = np.concatenate(parts)
        return out, at


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text), with the piece's number among those
    of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for some in slices(batch, "text"):
                ids, at = bpe.encode(filled(some.column("text")))
                n = len(at) - 1
                ids = np.insert(ids, at[1:], np.uint32(end)).astype("<u4")
                at = at + np.arange(n + 1)
                total = np.diff(at)
                count = -(-total // size)
                owner = np.repeat(np.arange(n), count)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                head = total - (count - 1) * size
                start = np.where(nth == 0, 0, head[owner] + (nth - 1) * size)
                length = np.where(nth == 0, head[owner], size)
                lo = at[:-1][owner] + start
                crc = [zlib.crc32(ids[a : a + b]) for a, b in zip(lo.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                own = np.zeros(len(by), np.int64)
                if len(by):
                    new = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
                    own[order] = np.arange(len(by)) - np.repeat(new, np.diff([*new, len(by)]))
                rank = seen[length] + own
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(owner)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part), pa.int32()), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_configuration(prices: np.ndarray, size: int) -> tuple[float, list[int]]:
    """The lengths (with repeats) of most worth that fit: unbounded knapsack by dynamic program.

    prices[l] is the worth of length l, 0 where there is none.
    """
    worth = np.zeros(size + 1)
    taken = np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        with_last = worth[room - 1 :: -1][:room] + prices[1 : room + 1]
        k = int(np.argmax(with_last))
        if with_last[k] > worth[room - 1] + 1e-15:
            worth[room], taken[room] = with_last[k], k + 1
        else:
            worth[room] = worth[room - 1]
    out, room = [], size
    while room:
        if taken[room]:
            out.append(int(taken[room]))
            room -= int(taken[room])
        else:
            room -= 1
    return float(worth[size]), out


def columns(prices: np.ndarray, size: int) -> tuple[float, list[tuple[float, dict[int, int]]]]:
    """Worth of the best configuration, and for each priced length the best one that holds it."""
    worth = np.zeros(size + 1)
    taken = np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        with_last = worth[room - 1 :: -1][:room] + prices[1 : room + 1]
        k = int(np.argmax(with_last))
        if with_last[k] > worth[room - 1] + 1e-15:
            worth[room], taken[room] = with_last[k], k + 1
        else:
            worth[room] = worth[room - 1]
    out = []
    for length in np.flatnonzero(prices > 0).tolist():
        config, room = Counter([length]), size - length
        while room:
            if taken[room]:
                config[int(taken[room])] += 1
            room -= int(taken[room]) or 1
        out.append((float(prices[length] + worth[size - length]), dict(config)))
    return float(worth[size]), out


def first_basis(need: np.ndarray, lengths: np.ndarray, size: int) -> list[dict[int, int]]:
    """As many configurations as lengths, which cover all of them: each uses up one length.

    The longest that is left is filled up with the longest that fit, in fractions of sequences.
    Each configuration holds a length that no later one has, so they are independent.
    """
    left = {int(n): float(x) for n, x in zip(lengths, need, strict=True)}
    order = sorted(left, reverse=True)
    out = []
    while order:
        config: dict[int, int] = {}
        room = size
        for n in order:
            k = min(room // n, max(1, int(left[n])))
            if k:
                config[n] = k
                room -= k * n
        step, gone = min((left[n] / k, n) for n, k in config.items())
        for n, k in config.items():
            left[n] = max(0.0, left[n] - step * k)
        order.remove(gone)
        out.append(config)
    return out


def solve(counts: np.ndarray, size: int, gap: float = GAP) -> tuple[dict[tuple[int, ...], float], float]:
    """(configuration -> how often to use it, lower bound): every length is covered (fractional).

    Column generation with the simplex method. Every length is covered from the start
    (``first_basis``) on, and the rounds end when the sequences used exceed
    the bound of the prices (their worth of all pieces over the best configuration's worth) by no
    more than two or ``gap`` of the bound. Prices are drawn by turns towards length / size, where
    every full configuration is worth one; undrawn ones tell the optimum.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    m = len(lengths)
    if not m:
        return {}, 0.0
    need = counts[lengths].astype(float)
    at = {int(n): i for i, n in enumerate(lengths)}
    basis: list[dict[int, int] | int] = [*first_basis(need, lengths, size)]
    even = lengths / size
    bound, turn, pivots = float(need @ even), 0, 0

    def matrix() -> np.ndarray:
        out = np.zeros((m, m))
        for k, c in enumerate(basis):
            if isinstance(c, int):
                out[c, k] = -1.0
            else:
                out[[at[n] for n in c], k] = list(c.values())
        return out

    def afresh() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inverse = np.linalg.inv(matrix())
        price = np.array([0.0 if isinstance(c, int) else 1.0 for c in basis]) @ inverse
        return inverse, np.maximum(inverse @ need, 0.0), price

    inverse, used, price = afresh()
    singular = False

    def enter(column: dict[int, int] | int) -> bool:
        """Take a configuration (or the surplus of a length) into the basis, if that saves sequences."""
        nonlocal pivots, price, inverse, used, singular
        if isinstance(column, int):
            saved, way = -price[column], -inverse[:, column]
        else:
            own, n = [at[x] for x in column], np.array(list(column.values()), float)
            saved, way = price[own] @ n - 1.0, inverse[:, own] @ n
        if saved <= 1e-9:
            return False
        some = np.flatnonzero(way > 1e-9)
        ratio = used[some] / way[some]
        low = some[ratio <= ratio.min() + 1e-12]
        out = int(low[np.argmax(way[low])])
        step = used[out] / way[out]
        used -= step * way
        used[out] = step
        np.maximum(used, 0.0, out=used)
        row = inverse[out] / way[out]
        price = price - saved * row
        rows, cols = np.flatnonzero(way), np.flatnonzero(row)
        if len(rows) * len(cols) < m * m // 4:
            inverse[np.ix_(rows, cols)] -= np.outer(way[rows], row[cols])
        else:
            inverse -= np.outer(way, row)
        inverse[out] = row
        basis[out] = column
        pivots += 1
        if pivots % 100 == 0:  # against rounding errors
            try:
                inverse, used, price = afresh()
            except np.linalg.LinAlgError:
                singular = True  # the columns of a program with few pieces can come too close: what is reached so far stands
        return True

    values: list[float] = []
    while (value := float(used[[not isinstance(c, int) for c in basis]].sum())) > bound + max(2.0, gap * bound):
        values.append(value)
        if len(values) > STALL and values[-STALL - 1] - value < max(2.0, gap * bound):
            break
        pull = PULLS[turn % len(PULLS)]
        turn += 1
        # no price is above that of a sequence shared by copies of its length alone
        drawn = pull * even + (1 - pull) * np.clip(price, 0.0, 1.0 / (size // lengths))
        prices = np.zeros(size + 1)
        prices[lengths] = drawn
        top, found = columns(prices, size)
        bound = max(bound, float(need @ drawn) / top)
        gains = sorted(((sum(price[at[n]] * c for n, c in x.items()) - 1.0, k) for k, (_, x) in enumerate(found)), reverse=True)
        entered = sum(enter(found[k][1]) for gain, k in gains[:ENTER] if gain > 1e-9 and not singular)
        for i in np.flatnonzero(price < -1e-9).tolist():
            entered += not singular and enter(i)
        if singular or not entered and pull == 0.0:
            break  # no column saves anything: optimal
    out: Counter = Counter()
    for c, x in zip(basis, used.tolist(), strict=True):
        if not isinstance(c, int) and x > 0:
            out[tuple(sorted((n for n, k in c.items() for _ in range(k)), reverse=True))] += x
    return dict(out), bound


def best_fit(counts: np.ndarray, size: int) -> Counter:
    """Best-fit decreasing of what is left, on counts: configuration -> number of sequences."""
    rooms: dict[int, Counter] = {size: Counter()}

    def put(room: int, config: tuple[int, ...], n: int) -> None:
        if n:
            rooms.setdefault(room, Counter())[config] += n

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in rooms if r >= length and rooms[r]), default=size)
            config, n = next(iter(rooms[room].items()), ((), left))
            each = min(room // length, left)  # the fullest sequence stays the fullest until it is full
            times = min(n, left // each)
            if config:
                rooms[room][config] -= times
                if not rooms[room][config]:
                    del rooms[room][config]
            put(room - each * length, config + (length,) * each, times)
            left -= each * times
    return sum(rooms.values(), Counter())


def plan(counts: np.ndarray, size: int = SEQUENCE) -> Counter:
    """Configuration -> number of sequences, for all pieces of the histogram.

    Rounded linear program and best fit of the residue, at every size. Where the program ended above its
    gap, best fit of all pieces is made as well, and the plan with fewer sequences counts.
    """
    counts = counts.astype(np.int64).copy()
    out: Counter = Counter()
    if counts[size]:
        out[(size,)] = int(counts[size])
        counts[size] = 0
    left = counts.copy()
    chosen: Counter = Counter()
    used, bound = solve(counts, size)
    ended_early = sum(used.values()) > bound + max(2.0, GAP * bound)
    for config, x in sorted(used.items(), key=lambda kv: (-kv[1], kv[0])):
        times = int(x + 1e-6)
        for length, c in Counter(config).items():
            times = min(times, int(left[length]) // c)
        if times > 0:
            chosen[config] += times
            for length in config:
                left[length] -= times
    chosen.update(best_fit(left, size))
    alone = best_fit(counts, size) if ended_early else chosen
    out.update(min(chosen, alone, key=lambda c: sum(c.values())))
    return out


class Places:
    """For each length, ranges of ranks and where they go: bounded by the plan, not the corpus."""

    def __init__(self, sequences: Counter, size: int):
        first: list[list[int]] = [[] for _ in range(size + 1)]
        base: list[list[int]] = [[] for _ in range(size + 1)]
        offset: list[list[int]] = [[] for _ in range(size + 1)]
        given = np.zeros(size + 1, np.int64)
        sequence = 0
        for config in sorted(sequences, reverse=True):
            n, place = sequences[config], 0
            for length in config:
                first[length].append(int(given[length]))
                base[length].append(sequence)
                offset[length].append(place)
                given[length] += n
                place += length
            sequence += n
        as_array = lambda x: np.array(x, np.int64)
        self.of: dict[int, Any] = {n: (as_array(first[n]), as_array(base[n]), as_array(offset[n])) for n in range(1, size + 1) if first[n]}

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, offset = self.of[length]
        k = np.searchsorted(first, rank, side="right") - 1
        return base[k] + rank - first[k], offset[k]


OUT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text) with their sequence and place in it."""
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, path, size, end))
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = np.zeros(size + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length at most
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(Places(plan(counts, size), size))
    ranked = cut.join(bases.select("length", "part", "base"), ["length", "part"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "base + nth as rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            order = np.argsort(length, kind="stable")
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    sequence[own], offset[own] = places.value.find(int(length[own[0]]), rank[own])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], OUT_NAMES)

    return ranked.mapInArrow(run, OUT)


OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def op5_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), path)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, path)
