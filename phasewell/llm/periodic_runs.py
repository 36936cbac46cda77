"""Operator 11, periodic run detection: the linear tandem-repeat method of Gusfield and Stoye over words.

A run of at least ``least`` words with period q <= length / 2 equals itself q words on, at ``least / 2`` or
more places in a row, so windows of half that many words that stand twice in a document cover it whole.
Stretches of words that no such window covers hold no run and are passed over (two windows that only
share a hash cost work, never a run). The other stretches of a slice of texts become one string, each
ended by a separator of its own, and three phases find all of its runs:

1. Lempel-Ziv blocks, by the suffix tree; for each pair of neighbouring blocks, extensions around every
   period give squares that cover leftmost ones of each kind. Squares of a repeated root are left out.
2. From each of them, suffix links lead to the square rotated by one word, if it stands anywhere; walking
   until nothing or a known square follows completes the vocabulary of squares.
3. Leaves below a square's place in the tree are where it stands. Places in a row with one period merge
   into one run, and since roots are not repeated, that is its smallest period.

Scale: no shuffle; a task works on one slice of texts (``text.SLICE_BYTES``), with names of substrings for
each power of two up to the longest repeat. A single longer text is taken whole: about 300 bytes a word of
its stretches.

Edge cases: a null text counts as empty and has no runs; ties for the longest run go to the smallest start,
then period; repeated rows give equal rows; an empty table gives none; extra columns are kept (those named
``runs`` and ``collapsed`` are replaced); a null id leaves the text of ``with_tails`` as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Words, filled, slices, table

LEAST = 12
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Names:
    """Ranks of the substrings of length 1, 2, 4 ... of a string, and what they tell."""

    def __init__(self, s: np.ndarray):
        """s ends in, and is cut by, symbols that occur once."""
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.n, self.of = len(s), [rank]
        while rank.max() < self.n - 1:
            step = 1 << (len(self.of) - 1)
            after = np.zeros(self.n, np.int64)
            after[:-step] = rank[step:] + 1
            rank = np.unique(rank * (self.n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.of.append(rank)
        self.suffixes = np.empty(self.n, np.int64)
        self.suffixes[rank] = np.arange(self.n)
        self.rank = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j (not the same) share."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            out += (self.of[k][i + out] == self.of[k][j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the prefixes up to and with i and j share."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            out += ((a >= 0) & (b >= 0) & (self.of[k][np.maximum(a, 0)] == self.of[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out


class Tree:
    """Suffix tree of a string: leaves 0..n-1 in rank order, then inner nodes."""

    def __init__(self, s: np.ndarray, names: Names):
        n = names.n
        self.symbols, self.leaf, self.suffixes = s.tolist(), names.rank.tolist(), names.suffixes.tolist()
        common = names.ahead(names.suffixes[:-1], names.suffixes[1:]).tolist()
        self.depth = [n - i for i in self.suffixes]
        self.low, self.high = list(range(n)), list(range(n))
        up = [-1] * n
        self._add(up, 0, 0)
        path = [(0, n)]  # (depth, node) of the open nodes from the root on, which is node n
        for leaf in range(n):
            shared = common[leaf - 1] if leaf else 0
            below = -1
            while path[-1][0] > shared:
                below = path.pop()[1]
                self.high[below] = leaf - 1
                if path[-1][0] >= shared:
                    up[below] = path[-1][1]
            if below >= 0 and path[-1][0] < shared:
                path.append((shared, self._add(up, shared, self.low[below])))
                up[below] = path[-1][1]
            path.append((self.depth[leaf], leaf))
        while len(path) > 1:
            below = path.pop()[1]
            self.high[below] = n - 1
            up[below] = path[-1][1]
        self.high[n] = n - 1
        up[n] = n
        self.up = [np.array(up)]
        while True:  # ancestors 1, 2, 4 ... up
            higher = self.up[-1][self.up[-1]]
            if (higher == n).all():
                break
            self.up.append(higher)
        #: smallest start of a suffix below each node
        self.first = [*self.suffixes, *[n] * (len(up) - n)]
        for v in np.argsort(-np.array(self.depth), kind="stable").tolist():
            self.first[up[v]] = min(self.first[up[v]], self.first[v])
        self.lift = [u.tolist() for u in reversed(self.up)]
        parent = self.up[0].tolist()
        self.edge = {(parent[v], self.symbols[self.suffixes[self.low[v]] + self.depth[parent[v]]]): v for v in range(len(parent)) if v != n}

    def _add(self, up: list[int], depth: int, low: int) -> int:
        self.depth.append(depth)
        self.low.append(low)
        self.high.append(low)
        up.append(-1)
        return len(up) - 1

    def place(self, at: int, length: int) -> int:
        """The highest node whose string starts with the ``length`` symbols at ``at``."""
        v = self.leaf[at]
        for up in self.lift:
            if self.depth[up[v]] >= length:
                v = up[v]
        return v

    def earlier(self, at: int) -> int:
        """Length of the longest prefix of the suffix at ``at`` that also starts before it."""
        v = self.leaf[at]
        for up in self.lift:
            if self.first[up[v]] >= at:
                v = up[v]
        return self.depth[self.lift[-1][v]]


def blocks(tree: Tree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the string's end."""
    starts, at = [], 0
    while at < len(tree.symbols):
        starts.append(at)
        at += max(1, tree.earlier(at))
    return np.array([*starts, at], np.int64)


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, n[i] times: i, and 1..n[i]."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)


def leftmost_squares(names: Names, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares that cover the leftmost one of every kind, roots not repeated."""
    start, end, beyond = cuts[:-2], cuts[1:-1], cuts[2:]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the block's end lies in the right half
    i, k = counted(end - start)
    at, q = end[i], end[i] - k
    more, less = names.ahead(at, q), names.behind(at - 1, q - 1)
    ok = (more > 0) & (more + less >= k)
    found = [(np.maximum(q - less, q - k + 1)[ok], k[ok])]
    # the block's start lies in the left half
    i, k = counted(beyond - start)
    at, q = start[i], np.minimum(start[i] + k, names.n - 1)
    more, less = names.ahead(at, q), names.behind(at - 1, q - 1)
    s = np.maximum(at - less, at - k + 1)
    ok = (more > 0) & (less > 0) & (more + less >= k) & (s + k <= end[i])
    found.append((s[ok], k[ok]))
    s, k = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.ones(len(s), bool)
    for root in np.unique(k).tolist():
        rows = np.flatnonzero(k == root) if root > 1 else np.zeros(0, np.int64)
        for p in prime_factors(root) if len(rows) else ():
            keep[rows] &= names.ahead(s[rows], s[rows] + root // p) < 2 * root - root // p
    return s[keep], k[keep]


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def vocabulary(tree: Tree, squares: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root length) of every square, by suffix links from those that are given."""
    known: set[tuple[int, int]] = set()
    for at, k in squares:
        node = tree.place(at, 2 * k)
        while node is not None and (node, k) not in known:
            known.add((node, k))
            turned, link = tree.symbols[at], tree.place(at + 1, 2 * k - 1)
            if tree.depth[link] == 2 * k - 1:
                node = tree.edge.get((link, turned))
            else:
                node = link if tree.symbols[tree.first[link] + 2 * k - 1] == turned else None
            at = tree.first[node] if node is not None else 0
    return list(known)


def runs_of_string(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs, by start and period."""
    names = Names(s)
    tree = Tree(s, names)
    start, root = leftmost_squares(names, blocks(tree))
    kinds = vocabulary(tree, list(zip(start.tolist(), root.tolist(), strict=True)))
    if not kinds:
        return (np.zeros(0, np.int64),) * 3
    node, k = np.array(kinds).T
    low = np.array(tree.low)[node]
    i, nth = counted(np.array(tree.high)[node] - low + 1)
    at, k = names.suffixes[low[i] + nth - 1], k[i]
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    start, period, length = at[head], k[head], np.diff([*head, len(at)]) - 1 + 2 * k[head]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeated(ids: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Which words are in a window of ``width`` words that its text has more than once."""
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= width:
        with np.errstate(over="ignore"):
            mixed = ((ids + 1).astype(np.uint64) * _ODD[0]) ^ ((ids + 1).astype(np.uint64) >> np.uint64(7))
            value = mixed[: len(ids) - width + 1].copy()
            for j in range(1, width):
                value = (value ^ (value >> np.uint64(29))) * _ODD[1] + mixed[j : len(ids) - width + 1 + j]
            value = value * _ODD[0] + owner[: len(value)].astype(np.uint64) * _ODD[1]
        at = np.flatnonzero(owner[: len(value)] == owner[width - 1 :])
        order = at[np.argsort(value[at], kind="stable")]
        same = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
    return np.cumsum(covered[:-1]) > 0


def runs_of_texts(words: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of each run of ``least`` words or more, by text, start and period."""
    ids, owner = words.ids, words.owner
    there = np.flatnonzero(repeated(ids, owner, (least + 1) // 2))
    if not len(there):
        return (np.zeros(0, np.int64),) * 4
    fresh = np.ones(len(there), bool)
    fresh[1:] = (np.diff(there) > 1) | (owner[there[1:]] != owner[there[:-1]])
    # a separator before each stretch and one at the end
    to = np.arange(len(there)) + np.cumsum(fresh)
    s = np.empty(len(there) + fresh.sum() + 1, np.int64)
    s[to] = ids[there]
    gaps = np.ones(len(s), bool)
    gaps[to] = False
    s[gaps] = len(words.words) + np.arange(gaps.sum())
    start, length, period = runs_of_string(s)
    long = length >= least
    back = np.zeros(len(s), np.int64)
    back[to] = there
    at, length, period = back[start[long]], length[long], period[long]
    text = owner[at]
    return text, at - words.offsets[text], length, period


def analysed(texts: pa.Array, least: int = LEAST) -> pa.StructArray:
    """struct<runs, collapsed> of each text."""
    words = Words(texts)
    text, start, length, period = runs_of_texts(words, least)
    n = len(words.offsets) - 1
    covered = np.zeros(len(words.ids) + 1, np.int64)
    head = words.offsets[text] + start
    np.add.at(covered, head + period, 1)
    np.add.at(covered, head + length, -1)
    keep = np.cumsum(covered[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.words.take(pa.array(words.ids[keep])))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]), pa.int32()), found)
    return pa.StructArray.from_arrays([runs, collapsed.cast(pa.string())], ["runs", "collapsed"])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with runs (by start and period) and collapsed, the text without repetitions of a run's first period."""

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def analyse(texts: pa.Array) -> pa.Array:
        parts = [analysed(filled(p.column("t")), least) for p in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
        return pa.concat_arrays(parts) if parts else analysed(pa.array([], pa.large_string()), least)

    found = docs.withColumn("runs", analyse(F.col(text)))
    return found.withColumns({"collapsed": F.col("runs.collapsed"), "runs": F.col("runs.runs")})


def with_tails(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs in which one id of ten has the end of its text replaced by repetitions of a part of it."""
    h = F.crc32(F.col(id_column).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    both = docs.withColumn(text, F.struct(F.col(text).alias("t"), F.when(h % 10 == 0, words).alias("w")))
    t, w = F.col(f"`{text}`.t"), F.col(f"`{text}`.w")
    n, g = F.size(w), F.floor(h / 10).cast("bigint")
    a = g % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
    tail = F.transform(F.sequence(F.lit(0), n - 1), lambda i: w[F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")])
    return both.withColumn(text, F.when(n > 0, F.array_join(tail, " ")).otherwise(t))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.reduce("runs", F.lit(None).cast(RUNS[6:-1]), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", longest)
    best = {c: F.col(f"longest.{c}") for c in ("start", "length", "period")}
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[c.alias(k) for k, c in best.items()],
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = rf"""
WITH RECURSIVE step(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS crc_of FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, crc_of[xor(a & 255, x) + 1]))) AS h FROM documents, crc),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
t AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
x AS (SELECT k, unnest(range(n)) AS i, unnest(w) AS v FROM t),
pair AS (SELECT x.k, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.k = y.k AND x.v = y.v AND y.i > x.i),
isle AS (SELECT k, q, min(i) AS s, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS z FROM pair) GROUP BY k, q, z),
per AS (SELECT k, s, q + c AS l, q FROM isle WHERE c >= q),
run AS (SELECT k, s, l, q FROM per a WHERE l >= {LEAST} AND NOT EXISTS (FROM per b WHERE b.k = a.k AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
best AS (SELECT k, count(*) AS n_runs, arg_min({{'s': s, 'l': l, 'q': q}}, [-l, s, q]) AS r, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT k, string_agg(v, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, r.s::BIGINT AS start, r.l::BIGINT AS length, r.q::BIGINT AS period, (1000 * r.l // r.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256 FROM t LEFT JOIN best USING (k) LEFT JOIN kept USING (k)"""
