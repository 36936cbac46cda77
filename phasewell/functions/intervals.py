"""Column builders for genomic intervals: arrays of struct<s, e>, 0-based and half-open.

P2-P4 (CIGAR blocks, introns, overlaps), P10 (repeats), P17 (event
judgement), P19 (sequence context), P24 (merging).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = "array<struct<s:bigint,e:bigint>>"
#: CIGAR operations by number: M I D N S H P = X.
ADVANCING = (0, 2, 3, 7, 8)
ALIGNED = (0, 7, 8)
SKIP = 3
#: Fixed values of the event judgement, in bases.
EVENT_OVERLAP = 20
EVENT_SHARE = 0.3
JUNCTION_SLACK = 20
JUNCTION_FLANK = 20


def _spans(cigar: Column, pos: Column, ops: tuple[int, ...]) -> Column:
    start = F.struct(pos.cast("bigint").alias("p"), F.array().cast(INTERVALS).alias("iv"))

    def step(state: Column, x: Column) -> Column:
        after = F.when(x["op"].isin(*ADVANCING), state["p"] + x["len"]).otherwise(state["p"])
        span = F.struct(state["p"].alias("s"), after.alias("e"))
        return F.struct(after.alias("p"), F.when(x["op"].isin(*ops), F.concat(state["iv"], F.array(span))).otherwise(state["iv"]).alias("iv"))

    return F.aggregate(cigar, start, step, lambda s: s["iv"])


def intron_spans(cigar: Column, pos: Column) -> Column:
    """Reference spans of skipped regions of an alignment."""
    return _spans(cigar, pos, (SKIP,))


def aligned_blocks(cigar: Column, pos: Column) -> Column:
    """Reference spans of aligned bases of an alignment."""
    return _spans(cigar, pos, ALIGNED)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases that two intervals share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_bp(start: Column, end: Column, intervals: Column) -> Column:
    """Bases that an interval shares with disjoint intervals."""
    return F.aggregate(intervals, F.lit(0).cast("bigint"), lambda a, x: a + overlap(start, end, x["s"], x["e"]))


def total_bp(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])


def merge_intervals(intervals: Column, gap: int = 0) -> Column:
    """Distinct non-empty intervals in order, those at most ``gap`` apart joined."""
    clean = F.array_sort(F.array_distinct(F.filter(intervals, lambda x: x["e"] > x["s"])))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        one = F.array(F.struct(x["s"].cast("bigint").alias("s"), x["e"].cast("bigint").alias("e")))
        return F.when((F.size(done) > 0) & (x["s"] <= F.try_element_at(done, F.lit(-1))["e"] + gap), joined).otherwise(F.concat(done, one))

    return F.aggregate(clean, F.array().cast(INTERVALS), step)


def judge_event(kind: Column, start: Column, end: Column, blocks: Column, introns: Column) -> Column:
    """'include', 'skip' or 'unobserved': what a read's alignment says of an event."""
    first = F.array_min(F.transform(blocks, lambda x: x["s"]))
    last = F.array_max(F.transform(blocks, lambda x: x["e"]))
    length = end - start
    need = F.greatest(F.lit(1), F.least(F.lit(EVENT_OVERLAP), F.floor(length * EVENT_SHARE)))
    swallowed = F.exists(introns, lambda x: (x["s"] <= start) & (x["e"] >= end))
    exon = F.when(overlap_bp(start, end, blocks) >= need, "include").when((first >= start) | (last <= end), "unobserved").when(swallowed, "skip").otherwise("unobserved")
    left = overlap_bp(start - JUNCTION_FLANK, start, blocks)
    right = overlap_bp(end, end + JUNCTION_FLANK, blocks)
    matched = F.exists(introns, lambda x: (F.abs(x["s"] - start) <= JUNCTION_SLACK) & (F.abs(x["e"] - end) <= JUNCTION_SLACK))
    junction = F.when((left < JUNCTION_FLANK) | (right < JUNCTION_FLANK), "unobserved").when(matched, "include").otherwise("skip")
    known = blocks.isNotNull() & (F.size(blocks) > 0)
    return F.when(~known, "unobserved").when(kind == "exon", exon).otherwise(junction)


def covering_repeat(window: Column, at: Column, unit: int, times: int) -> Column:
    """Whether a run of at least ``times`` copies of a ``unit``-letter word covers a position.

    window is a short sequence around the site and ``at`` the site's place in it, from 0 (P10).
    """
    span = unit * times
    starts = F.sequence(F.greatest(F.lit(0), at - (span - 1)), F.least(at, F.char_length(window) - span))
    same = lambda i: F.substring(window, i + 1, F.lit(span)) == F.repeat(F.substring(window, i + 1, F.lit(unit)), F.lit(times))
    possible = (F.char_length(window) >= span) & (F.least(at, F.char_length(window) - span) >= F.greatest(F.lit(0), at - (span - 1)))
    return F.when(possible, F.exists(starts, same)).otherwise(F.lit(False))


def in_repeat(window: Column, at: Column, kmer: int = 1, run: int = 5) -> Column:
    """Homopolymer of ``run`` letters, or (by kmer) three copies of a 2- or 3-letter word (P10)."""
    tests = [covering_repeat(window, at, k, run if k == 1 else 3) for k in range(1, kmer + 1)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def gc_share(window: Column) -> Column:
    """Share of G and C in a sequence."""
    return (F.char_length(window) - F.char_length(F.translate(F.upper(window), "GC", ""))) / F.nullif(F.char_length(window), F.lit(0))


def longest_run(window: Column) -> Column:
    """Length of the longest run of one letter."""
    state = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("m"))

    def step(s: Column, c: Column) -> Column:
        n = F.when(c == s["c"], s["n"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("c"), n.alias("n"), F.greatest(s["m"], n).alias("m"))

    return F.aggregate(F.filter(F.split(window, ""), lambda c: c != ""), state, step, lambda s: s["m"])


def is_transition(ref: Column, alt: Column) -> Column:
    """A<->G or C<->T."""
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")
