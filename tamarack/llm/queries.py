"""The registered queries of this subpackage and, where SQL can say it, their DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, divergence, neardup, quality, sampling, sharding, substring, tokens, toxicity, urlfilter, vectordup, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compact_window_passages": substring.op1_compact_window_passages,
    "op2_whole_token_counts": tokens.op2_whole_token_counts,
    "op3_template_decontamination": decontaminate.op3_template_decontamination,
    "op4_path_template_tree": urlfilter.op4_path_template_tree,
    "op5_collision_counting_search": ann.op5_collision_counting_search,
    "op6_minmax_near_dedup": neardup.op6_minmax_near_dedup,
    "op7_crf_toxicity": toxicity.op7_crf_toxicity,
    "op8_gumbel_segmentations": sampling.op8_gumbel_segmentations,
    "op9_balanced_label_shards": sharding.op9_balanced_label_shards,
    "op10_kneser_ney_quality": quality.op10_kneser_ney_quality,
    "op11_source_divergence_audit": divergence.op11_source_divergence_audit,
    "op12_randomised_whitening": whitening.op12_randomised_whitening,
    "op13_pstable_near_dedup": vectordup.op13_pstable_near_dedup,
}

ORACLE_SQL: dict[str, str] = {"op4_path_template_tree": urlfilter.ORACLE, "op6_minmax_near_dedup": neardup.ORACLE, "op11_source_divergence_audit": divergence.ORACLE, "op13_pstable_near_dedup": vectordup.ORACLE}
