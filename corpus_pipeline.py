"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
``run`` writes what a stage returns as Parquet on shared storage and hands the reread table to the next one.

Cases: nulls, empty and repeated rows are treated as each operator states. Columns beside doc_id, text, lang and source are carried
along, whatever their names, as far as the last stage. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, language_id, mixing, ngram_join, sharding
from foliant.llm.common import discard, fresh_names, materialise, table

#: Documents whose best language is less likely than this, given the learned ones, are rejected.
MIN_LANGUAGE_SCORE = 0.5
#: So are those whose code is longer than this many times what is usual in their language, and by ``COST_SLACK`` bits more: a short
#: text with an address or a number in it costs as much by the byte as one of another script.
MAX_LANGUAGE_COST = 2.0
COST_SLACK = 128.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, of no clear language, or of none that the labelled documents teach, go."""
    sample = language_id.training_sample(docs)
    model = language_id.learn_usual(sample, language_id.train(sample))
    discard(sample)
    (name,) = fresh_names(docs.columns, "language")
    found = language_id.identify(docs, model, out=name)
    usual = F.create_map(*[F.lit(x) for lang, bits in sorted(model.usual.items()) for x in (lang, bits)]) if model.usual else None
    clear = (F.col(name).lang_pred != "und") & (F.col(name).score >= MIN_LANGUAGE_SCORE)
    if usual is not None:
        per_byte = F.coalesce(F.try_element_at(usual, F.col(name).lang_pred) * MAX_LANGUAGE_COST, F.lit(8.0))
        size = F.octet_length("text")
        clear &= F.col(name).bits_per_byte * size <= per_byte * size + COST_SLACK
    return found.where(clear).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to the repetition limit; every document is used once at least."""
    return mixing.draw_mix(docs, max_epochs=mixing.MAX_EPOCHS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near equal size, and each document's slot in its shard."""
    return sharding.shard_documents(docs, keep=("text", "lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: Byte statistics, set similarity and bin packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
