"""Expectation-maximisation of haplotypes per gene.

The numerical loop is a grouped-map kernel on one gene's observations; a gene's table stays sparse, names
become numbers as batches come in. Its E-step and likelihood also exist as plain aggregations, for checks
and for frozen parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import site_probability, softmax

FLOOR = 1e-300
#: Up to so many steering sites their co-occurrence is a table, sites x sites; above, only its products with vectors are taken.
DENSE = 2048
#: Vectors held by the search for the leading split, and those it begins anew with.
HELD, AGAIN = 48, 12
#: Rows in a batch that leaves a task.
BATCH = 65536


def quality_het_posterior(codes: DataFrame, site: list[str], priors: tuple[float, float, float] = (0.6, 0.1, 0.3)) -> DataFrame:
    """Per-read-quality genotype posterior of sites (A9); priors: hom-ref, het, hom-alt."""
    e = F.least(F.lit(0.5), F.greatest(F.lit(0.001), F.col("pi")))
    ref, alt = F.log(1 - e), F.log(e)
    own = codes.where("r IN (0, 1)")
    sums = own.groupBy(*site).agg(
        F.sum(F.when(F.col("r") == 0, ref).otherwise(alt)).alias("l0"),
        (F.count(F.lit(1)) * F.log(F.lit(0.5))).alias("l1"),
        F.sum(F.when(F.col("r") == 0, alt).otherwise(ref)).alias("l2"),
    )
    post = softmax([F.col(f"l{k}") + F.log(F.lit(p)) for k, p in enumerate(priors)])
    return sums.select(*site, post[1].alias("het_prob"))


def coverage_het_posterior(codes: DataFrame, site: list[str], gene: list[str], factor: float = 1.0, priors: tuple[float, float, float] = (0.4, 0.2, 0.4)) -> DataFrame:
    """Genotype posterior with the likelihood shrunk by the site's share of reads (A10)."""
    reads = codes.groupBy(*gene).agg(F.countDistinct("Read").alias("n_reads"))
    e = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col("pi")))
    ref, alt = F.log(1 - e), F.log(e)
    sums = codes.where("r IN (0, 1)").groupBy(*site).agg(
        F.count(F.lit(1)).alias("depth"),
        F.sum(F.when(F.col("r") == 0, ref).otherwise(alt)).alias("l0"),
        F.sum(F.when(F.col("r") == 1, ref).otherwise(alt)).alias("l2"),
    )
    joined = sums.join(reads, gene)
    shrink = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(1e-4), F.col("depth") / F.col("n_reads"))), F.lit(factor))
    logs = [F.col("l0"), F.col("depth") * F.log(F.lit(0.5)), F.col("l2")]
    post = softmax([shrink * x + F.log(F.lit(p)) for x, p in zip(logs, priors, strict=True)])
    return joined.select(*site, post[1].alias("p_het"))


def missing_share(codes: DataFrame, gene: list[str]) -> DataFrame:
    """Share of empty cells of the reads x sites table of a gene."""
    n = codes.groupBy(*gene).agg(F.count(F.lit(1)).alias("seen"), F.countDistinct("Read").alias("n_reads"), F.countDistinct("snv_id").alias("n_snvs"))
    return n.withColumn("gamma", 1 - F.col("seen") / (F.col("n_reads") * F.col("n_snvs")))


def _log_sides(codes: DataFrame, sites: DataFrame, gene: list[str]) -> DataFrame:
    joined = codes.join(sites.select(*gene, "snv_id", "h_A", "h_m"), [*gene, "snv_id"])
    log = lambda side: F.log(site_probability(F.col("r"), F.col("pi"), F.col("h_A"), F.col("h_m"), side))
    return joined.groupBy(*gene, "Read").agg(F.sum(log(1)).alias("l1"), F.sum(log(0)).alias("l0"))


def read_posterior(codes: DataFrame, sites: DataFrame, alpha: Column, gene: list[str]) -> DataFrame:
    """E-step for reads with fixed sites (M3): hat_I, the probability of haplotype A."""
    post = softmax([F.col("l1") + F.log(alpha), F.col("l0") + F.log(1 - alpha)])
    return _log_sides(codes, sites, gene).select(*gene, "Read", post[0].alias("hat_I"))


def observed_loglik(codes: DataFrame, sites: DataFrame, alpha: Column, gene: list[str]) -> DataFrame:
    """Log-likelihood of a gene's reads (M8)."""
    a, b = F.col("l1") + F.log(alpha), F.col("l0") + F.log(1 - alpha)
    top = F.greatest(a, b)
    return _log_sides(codes, sites, gene).groupBy(*gene).agg(F.sum(top + F.log(F.exp(a - top) + F.exp(b - top))).alias("loglik"))


def _within(scores: np.ndarray, keep: np.ndarray, least: int, most: int | None) -> np.ndarray:
    """keep, or the best sites where it has too many or too few."""
    order = np.argsort(-scores, kind="stable")
    size = int(keep.sum())
    size = size if most is None else min(size, most)
    size = max(size, min(least, len(scores)))
    if size == keep.sum():
        return keep
    out = np.zeros(len(scores), bool)
    out[order[:size]] = True
    return out


def _above_gap(scores: np.ndarray, tau: float) -> np.ndarray | None:
    """Sites above the middle of the widest gap of scores, None if it is narrower than tau."""
    s = np.sort(scores)[::-1]
    gaps = s[:-1] - s[1:]
    if not len(gaps) or gaps.max() < tau:
        return None
    k = int(gaps.argmax())
    return scores >= (s[k] + s[k + 1]) / 2


def keep_mask(scores: np.ndarray, high: float = 0.9, tau: float = 0.1, min_keep: int = 4, max_keep: int | None = None) -> np.ndarray:
    """Sites that steer the phasing (F14): sure ones, else above the widest gap, else the upper half.

    At least ``min_keep`` and at most ``max_keep`` of them, whichever rule chose.
    """
    if not len(scores):
        return np.zeros(0, bool)
    keep = scores >= high
    if not keep.any():
        gap = _above_gap(scores, tau)
        keep = scores >= np.median(scores) if gap is None else gap
    return _within(scores, keep, min_keep, max_keep)


def gap_mask(scores: np.ndarray, tau: float = 0.1, min_keep: int = 4) -> np.ndarray:
    """Sites above the widest gap, or all: for scores that a scoring step has pruned before."""
    gap = _above_gap(scores, tau) if len(scores) > min_keep else None
    return np.ones(len(scores), bool) if gap is None else _within(scores, gap, min_keep, None)


def steering(scores: np.ndarray, scored: bool = False) -> np.ndarray:
    """Sites that a gene's phase is fitted on: all up to five, else by ``gap_mask`` if ``scored``, or ``keep_mask``."""
    if len(scores) <= 5:
        return np.ones(len(scores), bool)
    return gap_mask(scores) if scored else keep_mask(scores)


def _two_means(x: np.ndarray) -> np.ndarray:
    """The split of numbers into two groups with the least sum of squares, found among all sorted cuts."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    n, k = len(s), np.arange(1, len(s))
    low = np.cumsum(s)[:-1]
    between = low**2 / k + (s.sum() - low) ** 2 / (n - k)  # largest where the inner squares are least
    out = np.zeros(n, bool)
    out[order[int(between.argmax()) + 1 :]] = True
    return out


def _together(read: np.ndarray, site: np.ndarray, n: int, m: int, at_once: int = 2048) -> np.ndarray:
    """How many reads show the alternative allele at both sites; blocks of reads are dense at a time."""
    out = np.zeros((m, m))
    order = np.argsort(read, kind="stable")
    read, site = read[order], site[order]
    cuts = np.searchsorted(read, np.arange(0, n + at_once, at_once))
    for k in range(len(cuts) - 1):
        block = np.zeros((at_once, m), np.float32)
        part = slice(cuts[k], cuts[k + 1])
        block[read[part] - k * at_once, site[part]] = 1
        out += block.T @ block
    return out


def _first_phase(together: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two groups of sites from the leading split of their co-occurrence (M2): spectral clustering."""
    m = len(together)
    if m == 1:
        return np.ones(1)
    np.fill_diagonal(together, 0.0)
    degree = together.sum(1)
    scale = 1 / np.sqrt(np.where(degree > 0, degree, 1.0))
    _, vectors = np.linalg.eigh(np.eye(m) - scale[:, None] * together * scale[None, :])
    group = _two_means(vectors[:, 1] * scale)
    return _started(group, lambda x: together @ x, rng)


def _started(group: np.ndarray, times: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Shares to start from: the side of each site whose mean link inside its group isn't below the median."""
    size = np.where(group, group.sum(), (~group).sum())
    link = np.where(group, times(group.astype(float)), times((~group).astype(float))) / np.maximum(1, size - 1)
    return np.where(link >= np.median(link), np.where(group, 0.9, 0.1), 0.5 + rng.uniform(-1e-3, 1e-3, len(group)))


def first_phase_linked(row: np.ndarray, site: np.ndarray, weight: np.ndarray, m: int, rng: np.random.Generator) -> np.ndarray:
    """``_first_phase`` without the table: each row (a read, or a pair of sites) links its sites with its weight.

    Memory follows the rows' entries. Where sites fall into pieces without links, any numbers of the
    pieces are a leading split; fixed random ones are taken.
    """
    use = np.bincount(row, minlength=len(weight))[row] > 1
    row, site = row[use], site[use]
    alone = np.bincount(site, weight[row], m)
    times = lambda x: np.bincount(site, (weight * np.bincount(row, x[site], len(weight)))[row], m) - alone * x
    degree = np.round(times(np.ones(m)))
    if not len(row):
        return _started(np.arange(m) == 1, times, rng)
    piece = _linked_pieces(row, site, len(weight), m)[degree > 0]
    split = np.zeros(m)
    if piece.max() > 0:
        numbers = np.random.default_rng(0).standard_normal(piece.max() + 1)
        split[degree > 0] = numbers[piece] - np.average(numbers[piece], weights=degree[degree > 0])
    else:
        scale = 1 / np.sqrt(np.where(degree > 0, degree, 1.0))
        split = _second_vector(lambda x: scale * times(scale * x), np.sqrt(degree)) * scale
    return _started(_two_means(split), times, rng)


def _linked_pieces(row: np.ndarray, site: np.ndarray, n: int, m: int) -> np.ndarray:
    """The number of each site's connected piece, linked pieces first and in the order of their first sites."""
    own = np.arange(m)
    while True:
        least, new = np.full(n, m), own.copy()
        np.minimum.at(least, row, own[site])
        np.minimum.at(new, own[site], least[row])  # the piece's first site follows too, so that pieces join whole
        np.minimum.at(new, site, least[row])
        while (new[new] != new).any():
            new = new[new]
        if (new == own).all():
            break
        own = new
    linked = np.zeros(m, bool)
    linked[site] = True
    place = np.zeros(m, int)
    firsts = np.unique(own[linked])
    place[firsts] = np.arange(len(firsts))
    return np.where(linked, place[own], len(firsts))


def _second_vector(times: Callable[[np.ndarray], np.ndarray], first: np.ndarray) -> np.ndarray:
    """The eigenvector of the largest eigenvalue beside ``first``: Lanczos with full orthogonalisation, begun anew from its best vectors.

    It ends when the residual is small against the gap to the next eigenvalue, not after some number of steps.
    """
    m = len(first)
    first = first / np.linalg.norm(first)
    held, image, size = np.zeros((HELD, m)), np.zeros((HELD, m)), 0
    new, r, least = np.random.default_rng(0).standard_normal(m), np.random.default_rng(1), np.inf
    for step in range(10**9):
        for _ in range(2):
            new = new - first * (first @ new)
            new = new - held[:size].T @ (held[:size] @ new)
        long = np.linalg.norm(new)
        if long < 1e-13:  # all that the start can reach is held
            new = r.standard_normal(m)
            continue
        held[size] = new / long
        image[size] = times(held[size])
        size += 1
        values, turn = np.linalg.eigh(held[:size] @ image[:size].T)
        best = held[:size].T @ turn[:, -1]
        new = image[:size].T @ turn[:, -1] - values[-1] * best
        new = new - first * (first @ new)
        rest, gap = np.linalg.norm(new), values[-1] - values[-2] if size > 1 else 0.0
        if size >= min(m - 1, AGAIN) and rest <= max(1e-3 * gap, 1e-12):
            break
        if size == min(m - 1, HELD):
            if size == m - 1:
                break
            keep = turn[:, -AGAIN:].T
            held[:AGAIN], image[:AGAIN], size = keep @ held[:size], keep @ image[:size], AGAIN
    return best * np.sign(best[np.abs(best).argmax()])


@dataclass
class Phased:
    alpha: float
    h: np.ndarray
    marker: np.ndarray
    hat: np.ndarray
    phasable: np.ndarray
    loglik: float
    rounds: int


def phase(code: np.ndarray, error: np.ndarray, score: np.ndarray, **options) -> Phased:
    """``phase_observed`` on a matrix: code is reads x sites, -1 for missing."""
    read, site = np.nonzero(code >= 0)
    return phase_observed(read, site, code[read, site], error[read, site], len(code), score, **options)


def phase_observed(read: np.ndarray, site: np.ndarray, code: np.ndarray, error: np.ndarray, n: int, score: np.ndarray, *, max_iter: int = 50, tol: float = 1e-3, seed: int = 42, fixed_alpha: float | None = None, frozen: tuple[np.ndarray, np.ndarray] | None = None, filter_sites: bool = True, scored: bool = False, start: np.ndarray | None = None) -> Phased:
    """EM on one gene (M4-M7, M9): one entry per observation, so memory follows the observations.

    The site update minimises a convex function on [0, 1]. ``scored`` says that the scores come from a
    scoring step that has pruned sites before (F15). Rounds end when parameters or the expected
    log-likelihood stand still (M5); the observed one is that of the last parameters. ``start`` has the
    shares of ``first_shares``, where they are known.
    """
    m = len(score)
    keep = frozen[1] > 0 if frozen is not None else steering(score, scored) if filter_sites else np.ones(m, bool)
    use = keep[site]
    read, site, code, error = read[use], site[use], code[use], error[use]
    phasable = np.bincount(read, minlength=n) > 0
    if frozen is not None:
        h, marker = frozen[0].copy(), frozen[1].copy()
    else:
        h = first_shares(read, site, code, n, keep, seed) if start is None else start.copy()
        marker = np.where(keep, np.clip(score, 1e-6, 1 - 1e-6), 0.0)
    alpha = 0.5 if fixed_alpha is None else fixed_alpha
    if not phasable.any():
        return Phased(float("nan"), h, marker, np.full(n, 0.5), phasable, float("nan"), 0)
    read = (np.cumsum(phasable) - 1)[read]  # reads without a kept site take no part
    before, k = np.inf, int(phasable.sum())
    # on haplotype A a code has probability base1 + slope h, on B base0 - slope h
    ref, alt = code == 0, code == 1
    low, up, other = error / 3, 1 - error, 2 * error / 3
    noise = np.where(ref, up, np.where(alt, low, other))
    base1, base0 = noise, np.where(alt, up, np.where(ref, low, other))
    slope = np.where(ref | alt, (1 - 4 * error / 3) * np.where(alt, 1.0, -1.0), 0.0)
    del ref, alt, low, up, other, code, error, use
    log_noise = np.log(np.maximum(FLOOR, noise)) if frozen is None else None
    per_read = lambda x: np.bincount(read, x, k)
    per_site = lambda x: np.bincount(site, x, m)

    def sides() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a code has on either haplotype, and the log-likelihoods of reads there."""
        step, sure = slope * h[site], 0.5 * marker[site]
        e1, e0, off = base1 + step, base0 - step, (1 - 2 * sure) * noise
        return e1, e0, per_read(np.log(np.maximum(FLOOR, sure * e1 + off))), per_read(np.log(np.maximum(FLOOR, sure * e0 + off)))

    rounds, own = 0, sides()
    for rounds in range(1, max_iter + 1):
        e1, e0, l1, l0 = own
        apart = l0 + np.log(max(1 - alpha, FLOOR)) - l1 - np.log(max(alpha, FLOOR))
        hat = 1 / (1 + np.exp(np.clip(apart, -700, 700)))
        old = np.concatenate([[alpha], h, marker])
        if fixed_alpha is None:
            alpha = float(hat.mean())
        share = hat[read]
        if frozen is None:
            mixed = np.maximum(FLOOR, share * e1 + (1 - share) * e0)
            del e1, e0, own
            prior = np.log(np.maximum(FLOOR, marker)) - np.log(np.maximum(FLOOR, 1 - marker))
            odds = per_site(np.log(0.5 * mixed) - log_noise) + prior
            marker = np.where(keep, 1 / (1 + np.exp(-np.clip(odds, -700, 700))), 0.0)
            del mixed
        sure = marker[site] if frozen is None else (marker[site] > 0.5).astype(float)
        fixed, rising = 0.5 * sure * (share * base1 + (1 - share) * base0) + (1 - sure) * noise, 0.5 * sure * slope * (2 * share - 1)
        if frozen is None:
            h = np.where(keep, _best_h(site, fixed, rising, m), 0.5)
        expected = -float(np.log(np.maximum(FLOOR, fixed + rising * h[site])).sum())
        moved = np.abs(np.concatenate([[alpha], h, marker]) - old).max()
        own = sides() if frozen is None else own
        if moved < tol or abs(before - expected) < tol:
            break
        before = expected
    loglik = float(np.logaddexp(own[2] + np.log(max(alpha, FLOOR)), own[3] + np.log(max(1 - alpha, FLOOR))).sum())
    whole = np.full(n, hat.mean())
    whole[phasable] = hat
    return Phased(alpha, h, marker, whole, phasable, loglik, rounds)


def first_shares(read: np.ndarray, site: np.ndarray, code: np.ndarray, n: int, keep: np.ndarray, seed: int = 42) -> np.ndarray:
    """Shares that a gene's rounds start from: one half where a site isn't kept."""
    h, place, m = np.full(len(keep), 0.5), np.cumsum(keep) - 1, int(keep.sum())
    use = keep[site] & (code == 1)
    read, site = read[use], place[site[use]]
    h[keep] = _first_phase(_together(read, site, n, m), np.random.default_rng(seed)) if m <= DENSE else first_phase_linked(read, site, np.ones(n), m, np.random.default_rng(seed))
    return h


def _best_h(site: np.ndarray, fixed: np.ndarray, rising: np.ndarray, m: int) -> np.ndarray:
    """Where the sum of log(fixed + rising h) of each site is largest on [0, 1] (M4): the zero of its derivative, which falls.

    Newton's steps on all sites that have it inside, halving where they leave its bracket or close in too slowly.
    """
    part = lambda at: rising / np.maximum(FLOOR, fixed + rising * at)
    up, down = np.bincount(site, part(0.0), m) > 0, np.bincount(site, part(1.0), m) < 0
    out = np.where(up, 1.0, 0.0)
    inside = np.flatnonzero(up & down)
    lo, hi, h = np.zeros(len(inside)), np.ones(len(inside)), np.full(len(inside), 0.5)
    place = np.full(m, -1)
    place[inside] = np.arange(len(inside))
    use = place[site] >= 0
    own, fixed, rising = place[site[use]], fixed[use], rising[use]
    k = 0
    while len(inside):
        q = part(h[own])
        slope = np.bincount(own, q, len(h))
        lo, hi = np.where(slope > 0, h, lo), np.where(slope > 0, hi, h)
        with np.errstate(all="ignore"):
            step = h + slope / np.bincount(own, q * q, len(h))
        found = np.abs(step - h) < 1e-13
        done = found | (hi - lo < 1e-13)
        h = np.where(found | (step > lo) & (step < hi) & (k % 4 != 3), step, (lo + hi) / 2)
        out[inside[done]] = h[done]
        k += 1
        if done.any() and (done.mean() > 0.3 or done.all()):
            place = np.cumsum(~done) - 1
            use = ~done[own]
            own, fixed, rising = place[own[use]], fixed[use], rising[use]
            inside, lo, hi, h = inside[~done], lo[~done], hi[~done], h[~done]
    return out


def gathered(batches: Iterator[pa.RecordBatch], names: list[str], rest: list[str]) -> tuple[list[tuple[np.ndarray, pa.Array]], list[pa.Array]]:
    """([(numbers, distinct names) of each column of names], the other columns) of a group, batch by batch."""
    kept = [b.select([*names, *rest]) for b in batches]
    whole = pa.Table.from_batches(kept)
    del kept
    numbered = []
    for c in names:
        x = pc.fill_null(whole.column(c), "None").dictionary_encode().combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        numbered.append((x.indices.to_numpy().astype(np.int64), x.dictionary))
    return numbered, [whole.column(c).combine_chunks() for c in rest]


def last_codes(i: np.ndarray, j: np.ndarray, code: np.ndarray, error: np.ndarray, m: int) -> np.ndarray:
    """Places of one observation per read and site that has a code: the largest code, then error."""
    order = np.lexsort((error, code, i * m + j))
    key = (i * m + j)[order]
    return order[np.append(key[1:] != key[:-1], True) & (code[order] >= 0)]


def in_batches(key: tuple[pa.Scalar, ...], by: list[str], columns: dict[str, pa.Array], common: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """A group's rows: its key, columns, and values that all rows share."""
    for part in pa.table(columns).to_batches(max_chunksize=BATCH):
        same = [pa.repeat(x, part.num_rows) for x in (*key, *common.values())]
        yield pa.RecordBatch.from_arrays([*same[: len(by)], *part.columns, *same[len(by) :]], [*by, *columns, *common])


def key_kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def with_names(codes: DataFrame, by: list[str], *rest: str) -> DataFrame:
    return codes.select(*by, *[F.col(c).cast("string").alias(c) for c in ("Read", "snv_id")], "r", "pi", *rest)


def floats(x: pa.Array) -> np.ndarray:
    return pc.cast(x, pa.float64()).to_numpy(zero_copy_only=False)


def phased(codes: DataFrame, gene: list[str], kind: str, max_iter: int = 50, tol: float = 1e-3, seed: int = 42) -> DataFrame:
    """Rows of each gene's fit by kind: "read" (a, b: hat and its rest), "site" (h_A, h_m) or "gene".

    Columns: gene, id, told, a, b, alpha, ll_alt, ll_null, rounds. told: whether observations at steering
    sites speak of the read or site. A gene that fails stops the query, with its name.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {c: k.as_py() for c, k in zip(gene, key, strict=True)}
        try:
            ((i, reads), (j, sites)), (code, error, told) = gathered(batches, ["Read", "snv_id"], ["r", "pi", "score"])
            by_name = pc.array_sort_indices(sites).to_numpy()
            place = np.empty(len(sites), np.int64)
            place[by_name] = np.arange(len(sites))
            j, sites = place[j], sites.take(pa.array(by_name))
            score = np.zeros(len(sites))
            score[j] = floats(told)
            code, error = pc.fill_null(code, -1).to_numpy(zero_copy_only=False), floats(error)
            del told
            use = last_codes(i, j, code, error, len(sites))
            observed = (i[use], j[use], code[use], error[use], len(reads), score)
            del i, j, code, error, use
            keep = steering(score)
            start = first_shares(*observed[:3], len(reads), keep, seed)
            full = phase_observed(*observed, max_iter=max_iter, tol=tol, seed=seed, start=start)
            null = phase_observed(*observed, max_iter=max_iter, tol=tol, seed=seed, fixed_alpha=0.5, start=start)
        except Exception as e:
            raise RuntimeError(f"phasing of {own} failed: {e!r}") from e
        if kind == "read":
            values = (reads, full.phasable, full.hat, 1 - full.hat)
        elif kind == "site":
            values = (sites, keep & (np.bincount(observed[1], minlength=len(sites)) > 0), full.h, full.marker)
        else:
            values = (pa.nulls(1, pa.string()), np.array([full.phasable.any()]), np.zeros(1), np.zeros(1))
        columns = dict(zip(("id", "told", "a", "b"), (values[0], *map(pa.array, values[1:])), strict=True))
        yield from in_batches(key, gene, columns, {"alpha": full.alpha, "ll_alt": full.loglik, "ll_null": null.loglik, "rounds": full.rounds})

    schema = f"{key_kinds(codes, gene)}, id string, told boolean, a double, b double, alpha double, ll_alt double, ll_null double, rounds bigint"
    return with_names(codes, gene, "score").groupBy(*gene).applyInArrow(run, schema)


def phase_genes(codes: DataFrame, gene: list[str], max_iter: int = 50, tol: float = 1e-3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(reads, sites) of all genes (C5, M6, M10): two views of one grouped-map kernel.

    Reads: gene, Read, reads_phasable, hat_I, hat_I_B. Sites: gene, snv_id, h_A, h_m, alpha_hat,
    ll_alt, ll_null, lrt. A gene that fails stops the query, with its name: no gene is left out.
    codes: gene, Read, snv_id, r, pi and score.
    """
    of = lambda kind: phased(codes, gene, kind, max_iter, tol, seed)
    none = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    reads = of("read").select(*gene, F.col("id").alias("Read"), F.col("told").cast("int").alias("reads_phasable"), F.bround("a", 3).alias("hat_I"), F.bround("b", 3).alias("hat_I_B"))
    ll_alt, ll_null = none(F.col("ll_alt")), none(F.col("ll_null"))
    sites = of("site").select(*gene, F.col("id").alias("snv_id"), F.col("a").alias("h_A"), F.col("b").alias("h_m"), none(least_side("alpha")).alias("alpha_hat"), ll_alt.alias("ll_alt"), ll_null.alias("ll_null"), F.greatest(F.lit(0.0), 2 * (ll_alt - ll_null)).alias("lrt"))
    return reads, sites


def least_side(alpha: str) -> Column:
    return F.least(F.col(alpha), 1 - F.col(alpha))


def frozen_shares(codes: DataFrame, by: list[str], kind: str, max_iter: int = 50, tol: float = 1e-3) -> DataFrame:
    """Groups fitted with their sites held (M7), a group in a task: rows by kind "read" (hat is a) or "gene".

    codes: the group, Read, snv_id, r, pi, h_A, h_m. Columns: the group, id, a, alpha, ll_alt, ll_null, rounds.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {c: k.as_py() for c, k in zip(by, key, strict=True)}
        try:
            ((i, reads), (j, sites)), (code, error, *held) = gathered(batches, ["Read", "snv_id"], ["r", "pi", "h_A", "h_m"])
            frozen = (np.zeros(len(sites)), np.zeros(len(sites)))
            for to, x in zip(frozen, held, strict=True):
                to[j] = floats(x)
            del held, x
            code, error = pc.fill_null(code, -1).to_numpy(zero_copy_only=False), floats(error)
            use = last_codes(i, j, code, error, len(sites))
            observed = (i[use], j[use], code[use], error[use], len(reads), np.zeros(len(sites)))
            del i, j, code, error, use
            full = phase_observed(*observed, max_iter=max_iter, tol=tol, frozen=frozen)
            null = phase_observed(*observed, max_iter=1, fixed_alpha=0.5, frozen=frozen)
        except Exception as e:
            raise RuntimeError(f"fit of {own} failed: {e!r}") from e
        if kind == "read":
            columns = {"id": reads.filter(pa.array(full.phasable)), "a": pa.array(full.hat[full.phasable])}
        else:
            columns = {"id": pa.nulls(1, pa.string()), "a": pa.array(np.zeros(1))}
        if full.phasable.any():
            yield from in_batches(key, by, columns, {"alpha": full.alpha, "ll_alt": full.loglik, "ll_null": null.loglik, "rounds": full.rounds})

    schema = f"{key_kinds(codes, by)}, id string, a double, alpha double, ll_alt double, ll_null double, rounds bigint"
    return with_names(codes, by, "h_A", "h_m").groupBy(*by).applyInArrow(run, schema)
