"""The operators as stages of the corpus pipeline.

All but the last keep the columns of their input, whatever these are called.
Nulls are treated as the operators say; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, mixing, packing, shared, suffix, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, train_rows: int = 16_000) -> DataFrame:
    """Keeps the rows that are not predicted toxic, all columns unchanged. The
    model is learned as in op1, from labelled rows of ``docs``."""
    labels = shared.table(spark, sf_dir, "labels")
    model = spark.sparkContext.broadcast(toxicity.train(toxicity.labelled_sample(docs, labels, train_rows)))  # at most 2 ** bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = toxicity.Scorer(*model.value)
        for b in batches:
            keep = [scorer.score(t.as_py()) < 0.5 for t in b.column("text")]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest
    doc_id (null last, ties by position)."""
    rid, keep = shared.helper(docs, "row"), shared.helper(docs, "keep")
    docs = shared.stage(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    first = jaccard.classes(docs, rid=rid).filter("first").select(F.col("rid").alias(keep))
    return docs.join(first, F.col(rid) == F.col(keep), "left_semi").drop(rid)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 400, words: int = 51) -> DataFrame:
    """Cuts out of each text what suffix-array dedup marks: strings of ``width``
    bytes, and of ``words`` words, that start elsewhere too. A character of which
    a byte goes is dropped whole; n_chars follows the text. Rows stay, with
    unchanged texts where nothing is marked, and so do null texts."""
    key, spans, passages = (shared.helper(docs, c) for c in ("key", "spans", "passages"))
    found = suffix.marked(docs, suffix.byte_strings(width), suffix.word_strings(words))
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("passages").alias(passages))
    some, rest = shared.sieve(docs.withColumn(key, shared.text_key()), found, key)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, *marks in zip(b.column(at), b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                strings, passages = (suffix.ranges(m.as_py()) for m in marks)
                if not strings and not passages:
                    texts.append(text.as_py())
                    continue
                raw = text.as_py().encode()
                cut = suffix.merge(strings + suffix.word_spans(raw, passages))
                texts.append(suffix.kept_bytes(raw, cut).decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[: len(schema)])

    some = some.join(found, key, "left").select(*docs.columns, spans, passages).mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(schema["n_chars"].dataType))
        some = some.withColumn("n_chars", n)
    return rest.select(*docs.columns).union(some.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix does: not at all, or up to three times."""
    rid, taken, times, copy = (shared.helper(docs, c) for c in ("row", "taken", "times", "copy"))
    docs = shared.stage(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    mixed = mixing.mix(docs, rid=rid).filter("repeats > 0")
    mixed = mixed.select(F.col("rid").alias(taken), F.col("repeats").cast("int").alias(times))
    rows = docs.join(mixed, F.col(rid) == F.col(taken))
    return rows.select(*[c for c in docs.columns if c != rid], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return packing.pack(docs)
