"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet and read again. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import shared, stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("suffix_array_dedup", stages.drop_repeats),
    ("source_mixing", stages.mix_sources),
    ("best_fit_packing", stages.pack_sequences),
]

#: Trained scores, hashes and token ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.stage(docs, name)
    return docs
