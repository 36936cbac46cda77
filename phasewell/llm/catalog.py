"""The queries of this subpackage and their SQL, for registration in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fill_middle, fingerprints, jaccard_join, licenses, line_dedup, packing, periodic_runs, quality_rules, secrets, substring_dedup, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_packing": packing.op5_packing,
    "op6_licenses": licenses.op6_licenses,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op1_secrets": secrets.ORACLE_SQL,
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op3_fingerprints": fingerprints.ORACLE_SQL,
    "op4_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_licenses": licenses.ORACLE_SQL,
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op12_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
}
