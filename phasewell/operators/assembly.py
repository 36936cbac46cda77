"""The table of events with their variants, tests and gene context.

A chain of four left joins in which missing keys meet missing keys; contexts are made unique first, so that an
event has one row for each of its variants, and one if it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = ["geneID", "event_type", "event_start", "event_end"]
VARIANT = ["snv_pos", "snv_ref", "snv_alt"]
#: Fixed columns of the parts and of the result, with their types.
PAIR = {"snv_hap": "string", "h_A": "double", "hat_Z_prob_revised": "double", "exonic_distance": "bigint", "genomic_distance": "bigint"}
RAW = {"raw_ref_present": "bigint", "raw_ref_absent": "bigint", "raw_alt_present": "bigint", "raw_alt_absent": "bigint", "raw_chi2": "double", "raw_p_value": "double", "raw_p_value_adj": "double", "raw_test_type": "string"}
GENE = {
    "n_reads": "bigint", "n_reads_phasable": "bigint", "gene_n_snvs_called": "bigint", "gene_major_hap": "string", "shrinkage_k": "double", "es_ase": "double", "es_astu": "double",
    "ASE_call": "string", "ASTU_call": "string", "dominant_isoform_overall": "string", "top_isoform_hap_major": "string", "top_isoform_hap_minor": "string",
}
CONTEXT = {"snvID": "string", "snv_expr_direction": "string", "snv_astu_direction": "string"}
COLUMNS = {
    "Sample": "string", "CellType": "string", "geneID": "string", "geneName": "string", "geneChr": "string", **GENE, "eventID": "string",
    "event_type": "string", "event_start": "bigint", "event_end": "bigint", "event_length": "bigint",
    "hapA_present": "double", "hapA_absent": "double", "hapB_present": "double", "hapB_absent": "double",
    "obs_hapA_include": "double", "obs_hapA_skip": "double", "obs_hapA_unobserved": "double", "obs_hapB_include": "double", "obs_hapB_skip": "double", "obs_hapB_unobserved": "double",
    "obs_chi2": "double", "obs_p_value": "double", "obs_p_value_adj": "double", "obs_test_type": "string", "event_inclusion_frac_A": "double", "event_inclusion_frac_B": "double",
    "event_pref_hap": "string", "event_pref_major_minor": "string", "event_chi2": "double", "event_p_value": "double", "event_p_value_adj": "double",
    "has_linked_snv": "boolean", "linked_snv_count": "bigint", "is_nearest_snv_for_event": "boolean", "snvID": "string", "snv_pos": "bigint", "snv_ref": "string", "snv_alt": "string",
    "snv_hap": "string", "h_A": "double", "hat_Z_prob_revised": "double", "exonic_distance": "bigint", "genomic_distance": "bigint",
    "snv_expr_direction": "string", "snv_astu_direction": "string", "snv_event_direction": "string", "raw_validation_available": "boolean",
    "raw_ref_present": "bigint", "raw_ref_absent": "bigint", "raw_alt_present": "bigint", "raw_alt_absent": "bigint", "raw_total_reads": "bigint",
    "raw_chi2": "double", "raw_p_value": "double", "raw_p_value_adj": "double", "raw_test_type": "string",
}


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which NULL keys meet NULL keys; the left side's keys stay."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    return left.alias("l").join(right.alias("r"), on, "left").select("l.*", *[f"r.{c}" for c in right.columns if c not in keys])


def snv_id(chrom: str = "geneChr") -> Column:
    """chrom:pos:ref:alt, NULL if a part is missing."""
    return F.concat(chrom, F.lit(":"), F.col("snv_pos").cast("string"), F.lit(":"), "snv_ref", F.lit(":"), "snv_alt")


def event_snv(events: DataFrame, pairs: DataFrame | None, raw: DataFrame | None, gene_snv: DataFrame | None, sample: str, cell_type: str) -> DataFrame:
    """The 68 columns of event_snv.

    events: EVENT, geneName, geneChr, haplotype weights, chi2, p_value, p_value_adj and obs_*; pairs: EVENT, VARIANT
    and PAIR; raw: EVENT, VARIANT and RAW; gene_snv: geneID, VARIANT, GENE and CONTEXT. Parts that are None, and
    columns that a part lacks, give NULLs.
    """
    nothing = lambda df, kinds: df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    own = lambda df, keys, kinds: df.select(*keys, *[c for c in kinds if c in df.columns])
    out = events
    if pairs is None:
        out = nothing(out, {"snv_pos": "bigint", "snv_ref": "string", "snv_alt": "string", **PAIR})
    else:
        out = left_join(out, own(pairs, [*EVENT, *VARIANT], PAIR).distinct(), EVENT)
    out = nothing(out, RAW) if raw is None else left_join(out, own(raw, [*EVENT, *VARIANT], RAW).distinct(), [*EVENT, *VARIANT])
    if gene_snv is None:
        out = nothing(out, {**GENE, **CONTEXT})
    else:
        out = left_join(out, own(gene_snv, ["geneID"], GENE).dropDuplicates(["geneID"]), ["geneID"])
        out = left_join(out, own(gene_snv, ["geneID", *VARIANT], CONTEXT).distinct(), ["geneID", *VARIANT])
    missing = {c: t for c, t in COLUMNS.items() if c not in out.columns and (c.startswith("obs_") or c in CONTEXT or c in GENE or c in PAIR or c in RAW)}
    out = nothing(out, missing)
    share = lambda h: F.bround(F.try_divide(F.col(f"hap{h}_present"), F.col(f"hap{h}_present") + F.col(f"hap{h}_absent")), 4)
    out = out.withColumns({"event_inclusion_frac_A": share("A"), "event_inclusion_frac_B": share("B")})
    pref = F.when(F.col("event_inclusion_frac_A") > F.col("event_inclusion_frac_B"), "A").when(F.col("event_inclusion_frac_A") <= F.col("event_inclusion_frac_B"), "B")
    out = out.withColumn("event_pref_hap", pref)
    same = lambda a, b, yes, no: F.when(F.col(a) == F.col(b), yes).when(F.col(a) != F.col(b), no)
    group = Window.partitionBy(*EVENT)
    ranked = Window.partitionBy(*EVENT, F.col("snv_pos").isNull()).orderBy(*[F.col(c).asc_nulls_last() for c in ("exonic_distance", "genomic_distance", "snv_pos", "snv_ref", "snv_alt")])
    counts = [F.col(c) for c in list(RAW)[:4]]
    total = F.coalesce(*counts) * 0 + sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0))
    out = out.withColumns(
        {
            "Sample": F.lit(sample), "CellType": F.lit(cell_type), "snvID": F.coalesce("snvID", snv_id()),
            "eventID": F.concat("event_type", F.lit(":"), F.col("event_start").cast("string"), F.lit("-"), F.col("event_end").cast("string")),
            "event_length": F.col("event_end") - F.col("event_start"),
            "event_pref_major_minor": same("event_pref_hap", "gene_major_hap", "major", "minor"), "snv_event_direction": same("snv_hap", "event_pref_hap", "promotes_event", "reduces_event"),
            "linked_snv_count": F.count("snv_pos").over(group), "is_nearest_snv_for_event": F.col("snv_pos").isNotNull() & (F.row_number().over(ranked) == 1),
            "raw_validation_available": F.col("raw_ref_present").isNotNull(), "raw_total_reads": total,
            "event_chi2": F.col("chi2"), "event_p_value": F.col("p_value"), "event_p_value_adj": F.col("p_value_adj"),
        }
    ).withColumn("has_linked_snv", F.col("linked_snv_count") > 0)
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])


#: Fixed columns of what a gene's effects give to its variants, and of the result.
EFFECT = {
    "n_reads": "bigint", "n_reads_phasable": "bigint", "gene_n_snvs": "bigint", "gene_n_snvs_called": "bigint", "gene_alpha_hat": "double", "gene_alpha_hat_low": "double", "gene_alpha_hat_high": "double",
    "gene_alpha_hat_major": "double", "gene_alpha_hat_major_low": "double", "gene_alpha_hat_major_high": "double", "gene_major_hap": "string", "gene_minor_hap": "string", "gene_p_value": "double", "gene_p_value_adj": "double",
    "ASE_call": "string", "ASTU_call": "string", "dominant_isoform_overall": "string", "top_isoform_hap_major": "string", "top_isoform_hap_minor": "string", "top_isoform_hap_major_frac": "double", "top_isoform_hap_minor_frac": "double",
    "isoform_p_value": "double", "isoform_p_value_high": "double", "isoform_p_value_low": "double", "isoform_p_value_adj": "double", "isoform_p_value_adj_high": "double", "isoform_p_value_adj_low": "double",
    "shrinkage_k": "double", "es_ase": "double", "es_astu": "double", "astu_source": "string",
}
GENE_SNV = {
    "Sample": "string", "CellType": "string", "geneID": "string", "geneName": "string", "geneChr": "string", **EFFECT, "snvID": "string", "snv_pos": "bigint", "snv_ref": "string", "snv_alt": "string",
    "snv_depth_bulk": "bigint", "snv_alt_count_bulk": "bigint", "snv_alt_frac_bulk": "double", "h_A": "double", "hat_Z_prob_revised": "double", "snv_hap": "string", "snv_on_minor_hap": "boolean",
    "snv_expr_direction": "string", "snv_es_ase_signed": "double", "dominant_isoform_pref_hap": "string", "snv_astu_direction": "string", "snv_es_astu_signed": "double",
}


def signed_effects(rows: DataFrame) -> DataFrame:
    """The haplotype of each alternative allele, and the gene's effects seen from it.

    An unphased allele counts to B. Directions and signs are NULL where the gene has no major haplotype, or
    its dominant isoform prefers none.
    """
    toward = lambda c, yes, no: F.when(F.col(c).isin("A", "B"), F.when(F.col("snv_hap") == F.col(c), yes).otherwise(no))
    out = rows.withColumn("snv_hap", F.when(F.col("h_A") > 0.5, "A").otherwise("B"))
    return out.withColumns(
        {
            "snv_on_minor_hap": toward("gene_major_hap", F.lit(False), F.lit(True)), "snv_expr_direction": toward("gene_major_hap", "+", "-"), "snv_es_ase_signed": toward("gene_major_hap", F.col("es_ase"), -F.col("es_ase")),
            "snv_astu_direction": toward("dominant_isoform_pref_hap", "+", "-"), "snv_es_astu_signed": toward("dominant_isoform_pref_hap", F.col("es_astu"), -F.col("es_astu")),
        }
    )


def gene_snv(variants: DataFrame, effects: DataFrame, sample: str, cell_type: str) -> DataFrame:
    """The 52 columns of gene_snv (C14, J9): every variant with its gene's effects, variants without them too.

    variants: geneID, geneName, chrom, pos, ref, alt, depth, alt_count, alt_frac, h_A, hat_Z_prob_revised; effects: one
    row per gene, geneID and columns of EFFECT, dominant_isoform_pref_hap among them. Lacking columns give NULLs.
    """
    kinds = {**EFFECT, "dominant_isoform_pref_hap": "string"}
    out = left_join(variants, effects.select("geneID", *[c for c in kinds if c in effects.columns]).dropDuplicates(["geneID"]), ["geneID"])
    names = {"chrom": "geneChr", "pos": "snv_pos", "ref": "snv_ref", "alt": "snv_alt", "depth": "snv_depth_bulk", "alt_count": "snv_alt_count_bulk", "alt_frac": "snv_alt_frac_bulk"}
    renamed = out.withColumnsRenamed(names)
    out = renamed.withColumns({c: F.lit(None).cast(t) for c, t in {**GENE_SNV, **kinds}.items() if c not in renamed.columns})
    out = signed_effects(out).withColumns({"Sample": F.lit(sample), "CellType": F.lit(cell_type), "snvID": snv_id()})
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in GENE_SNV.items()])
