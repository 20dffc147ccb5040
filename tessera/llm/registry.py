"""Query names of the training-data operators and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import covertree, jaccard, langid, mixing, ogg, packing, records, suffix, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_warc": warc.op2_warc,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_ogg": ogg.op5_ogg,
        "op6_mixing": mixing.op6_mixing,
        "op7_suffix_dedup": suffix.op7_suffix_dedup,
        "op8_dual_tree": covertree.op8_dual_tree,
        "op9_binary_records": records.op9_binary_records,
        "op10_ppm_language": langid.op10_ppm_language,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op2_warc": warc.OP2_SQL, "op3_jaccard_join": jaccard.OP3_SQL, "op7_suffix_dedup": suffix.OP7_SQL, "op8_dual_tree": covertree.OP8_SQL}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
