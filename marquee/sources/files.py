"""File sources and sinks.

Readers declare their schema (no inference pass over the data). Film files
get a file ordinal ``ord`` (needed for "last record wins" lookups):
``monotonically_increasing_id`` is increasing in file order within a file and
across the files of a listing, and costs no shuffle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 17 fields of an ingest record, in their fixed order.
ITEM_FIELDS = ("id", "title", "cover", "rating", "director", "screenwriter", "cast", "genre", "country",
               "language", "release_date", "runtime", "imdb", "aka", "summary", "hot_comments",
               "poster_local_path")
ITEM_SCHEMA = T.StructType([
    T.StructField(f, T.ArrayType(T.StringType()) if f == "hot_comments" else T.StringType(), True)
    for f in ITEM_FIELDS])
PERSON_FIELDS = ("name", "name_en", "avatar_url", "avatar_local_path", "gender", "birth_date", "birthplace",
                 "profession", "biography", "douban_id", "personage_id", "_no_avatar", "_scrape_failed",
                 "_scraped_at")
PERSON_STRUCT = ("struct<" + ",".join(
    f"`{f}`:{'boolean' if f in ('_no_avatar', '_scrape_failed') else 'string'}" for f in PERSON_FIELDS[1:]) + ">")
BOM = "﻿"
ACTIVITY_SCHEMAS = {
    "users": "id long, username string, email string, role string, avatar string, created_at timestamp, "
             "is_active boolean",
    "ratings": "user_id long, movie_id string, score int, created_at timestamp, updated_at timestamp",
    "reviews": "id long, user_id long, movie_id string, content string, created_at timestamp",
    "user_likes": "user_id long, movie_id string, created_at timestamp",
    "user_favorites": "user_id long, movie_id string, created_at timestamp",
    "browsing_history": "id long, user_id long, movie_id string, viewed_at timestamp",
    "review_likes": "user_id long, review_id long, created_at timestamp",
    "review_replies": "id long, review_id long, user_id long, content string, created_at timestamp",
    "user_liked_persons": "user_id long, person_name string, person_type string, created_at timestamp",
}


def _with_ord(df: DataFrame) -> DataFrame:
    """Number the rows 0.. in the order of file names and, in a file, of its
    rows. Spark packs files into tasks by size, so the row's place in its file
    block is counted from the block's first id, and the blocks before it (one
    row each) are added up by file name and offset."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))
    blocks = placed.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file", "_block")) - F.col("_rows")
    blocks = blocks.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    return (placed.join(blocks, ["_file", "_block"]).withColumn("ord", F.col("_id") + F.col("_shift"))
            .drop("_file", "_block", "_id", "_shift"))


def read_items_json(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """Film records from JSON (an array file, or JSON lines with
    ``json_array=False``) with the declared 17-field schema. ``hot_comments``
    may be a list or a plain string in the input."""
    reader = spark.read.schema(T.StructType([T.StructField(f, T.StringType(), True) for f in ITEM_FIELDS]))
    df = _with_ord(reader.option("multiLine", json_array).json(path))
    hot = F.coalesce(F.from_json(F.col("hot_comments"), "array<string>"),
                     F.when(F.col("hot_comments").isNotNull(), F.array(F.col("hot_comments"))))
    return df.withColumn("hot_comments", hot)


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (a UTF-8 BOM before the first name is
    tolerated), projected to the 17 fields; absent columns become ''.
    Quoted line breaks are kept (the multi-line CSV parser)."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("encoding", "UTF-8").csv(path))
    df = _with_ord(df)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f)
            for f in ITEM_FIELDS if f != "hot_comments"]
    hot = F.col("hot_comments").cast("string") if "hot_comments" in df.columns else F.lit("")
    return df.select(*cols, F.array(hot).alias("hot_comments"), "ord")


def import_items(spark: SparkSession, path: str, out_path: str) -> int:
    """S3: dispatch on the file extension (.json / .csv, anything else is
    rejected), overwrite the ``items`` table and return the row count,
    observed while writing (no second pass)."""
    from pyspark.sql import Observation
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".json":
        # an uploaded file holds one JSON array; a folder written by Spark holds JSON lines
        df = read_items_json(spark, path, json_array=not _is_dir(spark, path))
    elif ext == ".csv":
        df = read_items_csv(spark, path)
    else:
        raise ValueError(f"unsupported file type: {ext or '(none)'}")
    obs = Observation("import")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out_path)
    return int(obs.get["rows"])


def write_items_json(df: DataFrame, path: str) -> None:
    """Write records as JSON lines (one object per line, splittable)."""
    df.drop("ord").write.mode("overwrite").json(path)


def read_persons_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object name -> record. The object is one document, so each
    file is parsed by one task; large directories should be converted once to
    JSON lines or Parquet with ``write_persons``.
    File order and repeated names are kept (``ord``)."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"map<string,{PERSON_STRUCT}>").alias("m"))
    e = parsed.select(F.posexplode(F.map_entries("m")).alias("ord", "kv"))
    return e.select(F.col("ord").cast("long").alias("ord"), F.col("kv.key").alias("name"),
                    *[F.col(f"kv.value.`{f}`").alias(f) for f in PERSON_FIELDS[1:]])


def write_persons(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the (cleaned) person directory as parquet or JSON lines."""
    w = df.write.mode("overwrite")
    (w.parquet(path) if fmt == "parquet" else w.json(path))


def scan_activity(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The nine activity tables as parquet with declared schemas."""
    return {name: spark.read.schema(schema).parquet(f"{base}/{name}") for name, schema in ACTIVITY_SCHEMAS.items()}


def artifact_dir(spark: SparkSession, name: str) -> str:
    """A folder for derived tables under the shared checkpoint folder (the
    cluster's ``spark.checkpoint.dir``), never a machine-local path."""
    from marquee.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/marquee-artifacts/{name}"


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def load_or_build(spark: SparkSession, path: str, build, version: str | None = None) -> DataFrame:
    """Read an artifact when a complete copy (``_SUCCESS``) for this input
    ``version`` exists, else build it, write it and read it back."""
    target = f"{path}/v={version}" if version else path
    if not _exists(spark, target):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
