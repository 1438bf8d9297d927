"""A training-corpus pipeline over ``documents``: each stage applies one operator of ``marquee.llm``.

A stage takes all that its predecessor kept and returns the columns of documents, the last one packed pieces. In
``run`` every stage's result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import hyperminhash, linerun, mixing, packing, ppm
from marquee.llm.common import written

#: Not to be expressed in SQL (code lengths, token ids, packing); tests compare with plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in which no language is at least as likely as all others together, go."""
    return ppm.identified(docs, least=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs (two lines and more, or one of ten words) go; so do documents of which nothing is
    left."""
    counter = "_removed"
    while counter in docs.columns:
        counter += "_"
    done = linerun.deduplicated(docs, counter=counter).where((F.col(counter) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(counter) > 0, F.length("text")).otherwise(F.col("n_chars"))
                               .cast(docs.schema["n_chars"].dataType))
    return done.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their shingles of five words, the one with the smallest doc_id stays."""
    return hyperminhash.one_of_each(docs, percent=80, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, up to three times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("mixing", mix),
          ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
