"""Column builders for reads, bases and allele posteriors.

Every function takes and returns Columns, so that calls stay inside code generation and compose
with any DataFrame. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Likelihoods are floored here, so that their logarithms stay finite.
FLOOR = 1e-300


def canonical_read_name(name: Column) -> Column:
    """Drop a trailing ``_<digits>`` that follows ``/ccs``."""
    return F.regexp_replace(name, r"(/ccs)_\d+$", "$1")


def phred_error(quality: Column) -> Column:
    """Error probability of a Phred quality, 0.25 if the quality is missing (P5)."""
    q = quality.cast("double")
    return F.when(q.isNull() | F.isnan(q), F.lit(0.25)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(F.lit(10.0), -q / 10))))


def het_posterior(depth: Column, alt: Column, error: float = 0.01, priors: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> Column:
    """Posterior of a heterozygous site from counts (P6); priors: het, hom-ref, hom-alt.

    The binomial coefficient is common to all three and cancels.
    """
    ref = depth - alt
    het = F.lit(priors[0]) * F.pow(F.lit(0.5), depth.cast("double"))
    terms = [
        F.log(F.lit(priors[0])) + depth * F.log(F.lit(0.5)),
        F.log(F.lit(priors[1])) + ref * F.log(F.lit(1 - error)) + alt * F.log(F.lit(error)),
        F.log(F.lit(priors[2])) + ref * F.log(F.lit(error)) + alt * F.log(F.lit(1 - error)),
    ]
    del het
    return softmax(terms)[0]


def softmax(logs: list[Column]) -> list[Column]:
    """Normalised probabilities of log weights, without overflow."""
    top = F.greatest(*logs)
    weights = [F.exp(x - top) for x in logs]
    total = reduce(lambda a, b: a + b, weights)
    return [w / total for w in weights]


def noise_probability(code: Column, error: Column) -> Column:
    """Probability of an observed allele at a site without variation (P8): 0 ref, 1 alt, 2 other."""
    return F.when(code == 0, 1 - error).when(code == 1, error / 3).when(code == 2, 2 * error / 3)


def emission(code: Column, error: Column, h: Column, haplotype: int) -> Column:
    """Probability of an observed allele given the read's haplotype.

    h is the probability that haplotype 1 carries the alternative allele; haplotype 0 carries it
    with 1 - h.
    """
    carries_ref = h if haplotype == 1 else 1 - h
    ref = carries_ref * error / 3 + (1 - carries_ref) * (1 - error)
    alt = carries_ref * (1 - error) + (1 - carries_ref) * error / 3
    return F.when(code == 0, ref).when(code == 1, alt).when(code == 2, 2 * error / 3)


def site_probability(code: Column, error: Column, h: Column, marker: Column, haplotype: int) -> Column:
    """Emission mixed with noise by the site's marker probability."""
    return F.greatest(F.lit(FLOOR), marker * 0.5 * emission(code, error, h, haplotype) + (1 - marker) * noise_probability(code, error))


def entropy(p: Column) -> Column:
    """Binary entropy in bits, 0 at the ends."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def refined_marker(marker: Column, h: Column) -> Column:
    """Marker probability discounted by the entropy of the phase, two digits."""
    return F.bround(marker * (1 - entropy(h)), 2)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL for a zero denominator."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def strand_odds_ratio(ref_fwd: Column, ref_rev: Column, alt_fwd: Column, alt_rev: Column) -> Column:
    """Symmetric strand odds ratio with one pseudocount in each cell."""
    a, b, c, d = (x.cast("double") + 1 for x in (ref_fwd, ref_rev, alt_fwd, alt_rev))
    odds = a * d / (b * c)
    return F.log(odds + 1 / odds) + F.log(F.least(a, b) / F.greatest(a, b)) - F.log(F.least(c, d) / F.greatest(c, d))


def file_label(name: Column) -> Column:
    """A cell type's name as a path part."""
    return F.translate(name, "/ ", "__")


def snv_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """``chrom:pos:ref:alt``, NULL if a part is."""
    c = F.lit(":")
    return F.concat(chrom, c, pos.cast("string"), c, ref, c, alt)


def event_id(kind: Column, start: Column, end: Column) -> Column:
    """``type:start-end``, NULL if a part is."""
    return F.concat(kind, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def snv_key(chrom: Column, pos: Column, ref: Column) -> Column:
    """``chrom_pos_ref``."""
    return F.concat_ws("_", chrom, pos.cast("string"), ref)


def ase_call(p_adjusted: Column, alpha_high: Column, level: float = 0.05) -> Column:
    """1 imbalanced under every phasing, -1 balanced, 0 open."""
    return F.when((alpha_high < 0.5) & (p_adjusted <= level), 1).when(p_adjusted > level, -1).otherwise(0)


def astu_call(p_high: Column, p_low: Column, level: float = 0.05) -> Column:
    """1 if the upper p is significant, -1 if the lower one isn't, else 0."""
    return F.when(p_high <= level, 1).when(p_low > level, -1).otherwise(0)


def snv_haplotype(h: Column) -> Column:
    """The haplotype that carries the alternative allele; ambiguous sites go to B."""
    return F.when(h.isNotNull(), F.when(h > 0.5, "A").otherwise("B"))


def direction(snv_hap: Column, major_hap: Column) -> Column:
    """``+`` if the allele lies on the haplotype that is expressed more, else ``-``."""
    return F.when(snv_hap.isNotNull() & major_hap.isNotNull(), F.when(snv_hap == major_hap, "+").otherwise("-"))


def event_preference(share_a: Column, share_b: Column) -> Column:
    """The haplotype that uses an event more; ties go to B."""
    return F.when(share_a.isNotNull() & share_b.isNotNull(), F.when(share_a > share_b, "A").otherwise("B"))


def legacy_text(value: Column) -> Column:
    """Trimmed lower-case text, '' for NULL."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def transcript_id(text: Column) -> Column:
    """The first Ensembl transcript id in a text, NULL without one."""
    return F.nullif(F.regexp_extract(text, r"(ENST\d+)", 1), F.lit(""))
