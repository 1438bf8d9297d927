"""Shared helpers: scratch tables in the cluster's shared folder, ranks, components, text batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a ``local[...]`` session (tests, bench) gets a folder of its own where the setting is missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = tempfile.mkdtemp(prefix="marquee-llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor. Each call takes a new folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no result and no later step reads."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ordinal(df: DataFrame, *order, name: str = "ordinal") -> DataFrame:
    """Number the rows 0.. in a global order without a one-task window: range sort, then partition offsets.

    Only the offsets (one row per partition) pass through a single window.
    """
    placed = written(
        df.orderBy(*order).select("*", F.spark_partition_id().alias("_pid"),
                                  F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "sorted")
    per = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
                        .alias("_before"))
    return (placed.join(before, "_pid")
            .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_at")).drop("_pid", "_at", "_before"))


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, component)``, component the smallest id reachable.

    Alternates large-star and small-star steps, each a partial ``min`` per node joined back on the node, so that
    a node with very many neighbours is neither collected nor expanded to pairs. Every round is a written table;
    the loop ends when a round changes nothing.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "edges")
    seen, rounds = None, 0
    while max_rounds is None or rounds < max_rounds:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        told = Observation(f"round{rounds}")
        now = written(step.observe(told, F.count(F.lit(1)).alias("n"),
                                   F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "star")
        rounds += 1
        state = (told.get["n"], told.get["h"])
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
