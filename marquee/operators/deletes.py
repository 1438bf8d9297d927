"""Deletion with owner and admin rights, and its way down the foreign keys.

All nine tables of the application are one log ``LOG``: a row inserts (or
toggles) a record or asks for its deletion, in the total order (ts, src, k1, k2).
A record lives from its first insertion after its last death. It dies by a
deletion whose actor may ask for it (``TABLES``: the owner, an admin, or either),
or with its parent; so it needs every parent alive at its insertion and ever
since. A parent that is inserted again starts a new life without its old
children. Tables are reduced in the order of their foreign keys: per table one
join per parent, one move to the deletions, one aggregate.

``surviving`` reduces a whole log; ``stream_deletes`` the same as a stream, whose
state is the surviving rows: a micro-batch's deletions and its parents' deaths
remove rows of that state, and what died before is no longer in it.

A record's rows move once to its requests; the order columns move plain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = ("entity string, op string, record string, user_id long, review_id long, actor long, value string, "
       "ts timestamp, src int, k1 long, k2 long")
ORDER = ("ts", "src", "k1", "k2")


@dataclass(frozen=True)
class Table:
    """``parents`` are columns that name a parent's record; ``may`` says who may delete."""

    name: str
    parents: tuple[tuple[str, str], ...] = ()
    may: tuple[str, ...] = ()
    toggle: bool = False


USER = (("user_id", "user"),)
TABLES = (
    Table("user", (), ("admin",)),
    Table("rating", USER, ("owner",)),
    Table("review", USER, ("owner", "admin")),
    Table("like", USER, toggle=True),
    Table("favorite", USER, toggle=True),
    Table("history", USER, ("owner",)),
    Table("liked_person", USER, toggle=True),
    Table("review_like", (*USER, ("review_id", "review")), toggle=True),
    Table("reply", (*USER, ("review_id", "review")), ("owner",)),
)


def _order():
    return F.struct(*ORDER)


def surviving_rows(log: DataFrame, admins: DataFrame) -> dict[str, DataFrame]:
    """Per table the insertions (toggles) that are part of a living record.
    ``admins(actor)`` are the users with that role."""
    lives: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    admin = admins.select("actor").distinct().withColumn("_admin", F.lit(True))
    for table in TABLES:
        mine = log.filter(F.col("entity") == table.name)
        rows = mine.filter(F.col("op") != "delete").drop("entity")
        for column, parent in table.parents:
            life = lives[parent].select(F.col("record").alias("_p"), F.col("since").alias("_since"))
            rows = (rows.join(life, F.col(column).cast("string") == F.col("_p")).filter(_order() > F.col("_since"))
                    .drop("_p", "_since"))
        if table.may:
            # a record's rows and the requests for it meet once: its owner, then its death, are found where they lie
            asked = (mine.filter((F.col("op") == "delete") & F.col("record").isNotNull()).select("record", "actor", *ORDER)
                     .join(admin, "actor", "left").withColumn("_asks", F.lit(True)))
            by_record = Window.partitionBy("record")
            right = F.lit(False)
            if "owner" in table.may:
                right = right | (F.col("actor") == F.col("_owner"))
            if "admin" in table.may:
                own = F.lit(False) if table.name != "user" else F.col("actor").cast("string") == F.col("record")
                right = right | (F.coalesce("_admin", F.lit(False)) & ~own)
            first = F.min(F.when(F.col("_asks").isNull(), F.struct(*ORDER, "user_id"))).over(by_record)
            rows = (rows.unionByName(asked, allowMissingColumns=True).withColumn("_owner", first["user_id"])
                    .withColumn("_death", F.max(F.when(F.col("_asks") & right, _order())).over(by_record))
                    .filter(F.col("_asks").isNull() & (F.col("_death").isNull() | (_order() > F.col("_death"))))
                    .drop("_asks", "_admin", "_owner", "_death"))
        out[table.name] = rows.withColumn("entity", F.lit(table.name))
        lives[table.name] = rows.groupBy("record").agg(F.min(_order()).alias("since"))
    return out


def states(rows: dict[str, DataFrame]) -> DataFrame:
    """``entity, record, user_id, review_id, value, since, last``: the living
    records; a toggled one lives after an odd number of toggles."""
    out = None
    for table in TABLES:
        g = rows[table.name].groupBy("record").agg(
            F.max(F.struct(*ORDER, "user_id", "review_id", "value")).alias("_last"), F.min("ts").alias("since"), F.count(F.lit(1)).alias("_n"))
        if table.toggle:
            g = g.filter(F.col("_n") % 2 == 1)
        g = g.select(F.lit(table.name).alias("entity"), "record", "_last.user_id", "_last.review_id", "_last.value", "since",
                     F.col("_last.ts").alias("last"))
        out = g if out is None else out.unionByName(g)
    return out


def surviving(log: DataFrame, admins: DataFrame) -> DataFrame:
    """The living records of all tables after a whole log."""
    return states(surviving_rows(log, admins))


def _latest(spark: SparkSession, path: str) -> int:
    """The newest complete version of the state, 0 for none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = hadoop(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(base)] if fs.exists(base) else []
    done = [int(n.split("=")[1]) for n in found if n.startswith("version=") and fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))]
    return max(done, default=0)


def stream_deletes(spark: SparkSession, source: str, admins: DataFrame, out_path: str, ckpt: str,
                   files: int | None = None) -> DataFrame:
    """The same as a stream over ``source`` (Parquet of ``LOG``): state version
    n + 1 is version n and micro-batch n reduced together, in a folder of its own,
    so that a batch that runs again writes the same version. Events come in log
    order across micro-batches."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        if batch_id:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{out_path}/version={batch_id}").select(*columns))
        rows = surviving_rows(batch, admins)
        state = None
        for df in rows.values():
            state = df.select(*columns) if state is None else state.unionByName(df.select(*columns))
        state.write.mode("overwrite").parquet(f"{out_path}/version={batch_id + 1}")

    r = spark.readStream.schema(LOG)
    stream = (r.option("maxFilesPerTrigger", files) if files else r).parquet(source)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    version = _latest(spark, out_path)
    state = spark.read.schema(LOG).parquet(f"{out_path}/version={version}") if version else spark.createDataFrame([], LOG)
    return states({t.name: state.filter(F.col("entity") == t.name) for t in TABLES})
