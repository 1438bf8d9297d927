"""Structured Streaming forms of the activity-log reductions.

The log reductions are incremental by nature: toggles are a running count
(parity), history is a running max, and the rating upsert with deletions is a
fold of per-batch summaries (last deletion, first and last write after it).
Each query writes the changed keys of every micro-batch to a changelog table
(parquet, a ``batch`` folder each); the current state is the last changelog row
per key, or for ratings the fold of all of them. Checkpoints and tables live under the shared folder
named by ``spark.checkpoint.dir``.

Order: events of one key are assumed to arrive in log order across
micro-batches (an append-only log); within a micro-batch they are sorted by
the log order (ts, src, k1, k2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVITY_SCHEMA = ("user_id long, item_id string, kind string, score int, ts timestamp, src int, "
                   "k1 long, k2 long")


def _source(spark: SparkSession, source: str, files: int | None) -> DataFrame:
    """The log as a stream; ``files`` limits the files of a micro-batch."""
    r = spark.readStream.schema(ACTIVITY_SCHEMA)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(source)


def _run(query_df: DataFrame, out_path: str, ckpt: str, mode: str = "update", transform=None) -> None:
    def sink(batch: DataFrame, batch_id: int) -> None:
        # a folder per batch, overwritten: a batch that is run again replaces its rows
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = (query_df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def current_from_changelog(spark: SparkSession, out_path: str, keys: list[str], cols: list[str]) -> DataFrame:
    """The newest changelog row per key (one aggregate, no sort)."""
    log = spark.read.parquet(out_path)
    packed = F.struct(*[F.col(c) for c in cols])
    g = log.groupBy(*keys).agg(F.max_by(packed, F.col("batch")).alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def stream_toggles(spark: SparkSession, source: str, kind: str, out_path: str, ckpt: str,
                   files: int | None = None) -> DataFrame:
    """U2/U3 as a stream: running toggle count per (user, film); on when odd."""
    s = _source(spark, source, files)
    agg = (s.filter(F.col("kind") == kind).groupBy("user_id", "item_id")
           .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("created_at")))
    _run(agg, out_path, ckpt)
    cur = current_from_changelog(spark, out_path, ["user_id", "item_id"], ["n", "created_at"])
    return cur.filter(F.col("n") % 2 == 1).select("user_id", "item_id", "created_at")


def stream_history(spark: SparkSession, source: str, out_path: str, ckpt: str, files: int | None = None) -> DataFrame:
    """U6 as a stream: latest view per (user, film)."""
    s = _source(spark, source, files)
    agg = s.filter(F.col("kind") == "view").groupBy("user_id", "item_id").agg(F.max("ts").alias("viewed_at"))
    _run(agg, out_path, ckpt)
    return current_from_changelog(spark, out_path, ["user_id", "item_id"], ["viewed_at"])


def _rating_changes(batch: DataFrame) -> DataFrame:
    """What a micro-batch says of each (user, film): its last deletion, and the
    first and last write after it (log order). Built-in aggregates only."""
    o = F.struct("ts", "src", "k1", "k2")
    dels = (batch.filter(F.col("kind") == "unrate").groupBy("user_id", "item_id").agg(F.max(o).alias("last_del")))
    writes = (batch.filter(F.col("kind") == "rate").withColumn("o", o).join(dels, ["user_id", "item_id"], "left")
              .filter(F.col("last_del").isNull() | (F.col("o") > F.col("last_del")))
              .groupBy("user_id", "item_id").agg(F.min("o").alias("first"), F.max(F.struct("o", "score")).alias("last")))
    return writes.join(dels, ["user_id", "item_id"], "full")


def ratings_from_changes(log: DataFrame) -> DataFrame:
    """The current ratings: of the writes after a key's last deletion the first
    gives created_at, the last the score and updated_at. Events of one key
    come in log order, so a batch's writes lie on one side of any deletion of
    another batch."""
    dels = log.groupBy("user_id", "item_id").agg(F.max("last_del").alias("d")).filter("d is not null")
    live = (log.filter("first is not null").join(dels, ["user_id", "item_id"], "left")
            .filter(F.col("d").isNull() | (F.col("first") > F.col("d"))))
    return (live.groupBy("user_id", "item_id").agg(F.min("first").alias("f"), F.max("last").alias("l"))
            .select("user_id", "item_id", F.col("l.score").alias("score"), F.col("f.ts").alias("created_at"),
                    F.col("l.o.ts").alias("updated_at")))


def stream_ratings(spark: SparkSession, source: str, out_path: str, ckpt: str, files: int | None = None) -> DataFrame:
    """U1 + U7 as a stream: each micro-batch is reduced to one row per key and
    appended; the state is a fold of those rows."""
    s = _source(spark, source, files).filter(F.col("kind").isin("rate", "unrate"))
    _run(s, out_path, ckpt, "append", _rating_changes)
    return ratings_from_changes(spark.read.parquet(out_path))
