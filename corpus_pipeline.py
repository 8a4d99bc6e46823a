"""A corpus pipeline: five operators of marquee.llm, one after another.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of
documents; the last adds how often the mix takes each row. Every stage is written as Parquet to
the shared folder and reread as the next one's input, so no stage runs twice and a lost executor
costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import cut
from marquee.llm.decontamination import decontaminated
from marquee.llm.exact_dedup import drop_copies
from marquee.llm.mixing import mixed
from marquee.llm.ngram_join import one_of_each
from marquee.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier, learned from docs and labels, calls toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, Jaccard similarity of 0.8) the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a passage of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix of sources takes, with size, source_size, target and taken (words,
    repeats counted). Rows without words add nothing to a mix and are not taken."""
    return mixed(docs).filter(F.col("taken") > 0)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: A classifier and an edit distance within text regions have no SQL form.
ORACLE_SQL = None
