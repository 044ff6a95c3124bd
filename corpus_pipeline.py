"""The corpus pipeline: five stages over ``documents``, each by one operator.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its
predecessor kept; its result is written as Parquet in the shared folder and read back
as the next stage's input. All stages but the last return the columns of ``docs``.

Defined cases. Null and empty texts: kept by every stage that filters (they score the empty text's
toxicity, hold no line and no shingle, and no benchmark window), of size 0 in the mix, where they follow their source's rate.
Null ids: rows of their own; near copies among them are told apart by a row key. Ties: a boilerplate line and a group of near copies
stay with the smallest id. Repeated rows: one stays after the near copies' stage, as many as there are before it.
Texts of any length go through every stage whole. Empty tables give empty results. Other columns pass through, and
helper columns never clash with them.

A stage returns a plan that runs when it is written, so the bound on Arrow batches is set for the session and left there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from framequery.llm.queries import MIN_SITES, toxicity_model
from framequery.plans.runtime import spill


#: Rows of an Arrow batch: whole texts go to Python, and back into its batches.
BATCH_ROWS = 1000


def _whole_texts(spark: SparkSession) -> None:
    """The pipeline is the application and sets its session: Arrow batches of few rows. Operators leave it alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    _whole_texts(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity_model(docs, labels))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all documents but their first; a document left without any line goes.

    ``n_chars`` follows the text where lines went.
    """
    cleaned = line_dedup.remove_boilerplate(docs, min_sites=MIN_SITES)
    changed, rest = F.col(cleaned.columns[-1]) > 0, F.length(F.trim("text"))
    out = cleaned.where(~changed | (rest > 0))
    return out.select(*[F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, one stays."""
    _whole_texts(spark)
    return ngram_join.keep_one(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    _whole_texts(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target shares; ``mix_copy`` numbers the copies."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: The classifier and the components have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
