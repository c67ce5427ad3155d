"""From raw documents to packed training sequences, a stage at a time.

Every stage takes all rows its predecessor kept and is written as Parquet before the next one reads it; all but the last
return the columns of ``documents``. Stages: quality rules (rejected documents go), line dedup by source (boilerplate lines
go), n-gram Jaccard join (one document of each group of near copies stays), benchmark decontamination (documents with a
benchmark passage go), packing into sequences.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import decontam, line_dedup, ngram_join, packing, quality
from rulewright.llm.queries import table, tokenizer_path
from rulewright.llm.scratch import Scratch


_LAST: list[Scratch] = []


def stage(f):
    """A stage that first deletes the scratch tables of the one before: what that returned has been written by now."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LAST:
            _LAST.pop().clear()
        before = len(Scratch.made)
        out = f(spark, docs, sf_dir)
        _LAST.extend(Scratch.made[before:])
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


@stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_lines(docs, F.col("source"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("packing", packing_stage),
]

#: Expectation-maximisation and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        before, docs = docs, work.save(step(spark, docs, sf_dir), name)
        if k:
            work.drop(before)
    return docs
