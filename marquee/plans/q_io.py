"""Registered source / sink / streaming queries (S1-S4, S8, S9, streaming U1-U6).

Each query writes a canonical table derived from the driver tables to a
fresh folder under the shared checkpoint folder, reads it back through the
engine's reader (or a Structured Streaming query) and returns the result, so
the round trip is checked against the same SQL oracle as the batch form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marquee.operators import catalogue as C
from marquee.plans import q_persons  # noqa: F401  (the oracle of clean_persons)
from marquee.plans.q_activity import APPLY_DELETES
from marquee.plans.registry import ORACLES, register
from marquee.plans.sqlviews import with_views
from marquee.sources import files as FS

NORMALIZED_COLS = ("id", "title", "rating", "year", "runtime", "language")
_NORM_SQL = with_views("SELECT id, title, rating, year, runtime, language, "
                       "array_to_string(genres, '|') AS genres, array_to_string(all_actors, '|') AS all_actors "
                       "FROM items")


def _fresh(cat, name: str) -> str:
    return FS.artifact_dir(cat.spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _norm_out(items):
    return items.select(*NORMALIZED_COLS, F.array_join("genres", "|").alias("genres"),
                        F.array_join("all_actors", "|").alias("all_actors"))


@register("items_json_roundtrip", _NORM_SQL)
def q_items_json_roundtrip(cat):
    """S4 -> S1 -> P1: films written as JSON lines, read back, normalised."""
    path = _fresh(cat, "items-json")
    FS.write_items_json(cat.items_raw, path)
    back = FS.read_items_json(cat.spark, path, json_array=False)
    return _norm_out(C.normalize_items(back))


@register("items_csv_roundtrip", _NORM_SQL)
def q_items_csv_roundtrip(cat):
    """Films written as CSV with a header, read back, normalised."""
    path = _fresh(cat, "items-csv")
    raw = cat.items_raw.drop("ord").withColumn("hot_comments", F.lit(""))
    raw.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    back = FS.read_items_csv(cat.spark, path)
    return _norm_out(C.normalize_items(back))


@register("import_items", with_views("SELECT count(*) AS n_rows FROM items_raw"))
def q_import_items(cat):
    """S3: import dispatch by extension; the written row count."""
    src = _fresh(cat, "import-src") + ".json"
    FS.write_items_json(cat.items_raw, src)
    n = FS.import_items(cat.spark, src, _fresh(cat, "import-out"))
    return cat.spark.createDataFrame([(n,)], "n_rows long")


@register("load_or_build_edges", with_views("SELECT src, dst, relation, weight, pos FROM gedges"))
def q_load_or_build_edges(cat):
    """The graph edges as a versioned artifact (built once, then read)."""
    from marquee.operators import graph as G
    base = _fresh(cat, "artifacts")
    build = lambda: G.graph_edges(cat.items)
    FS.load_or_build(cat.spark, f"{base}/edges", build, version="1")
    return FS.load_or_build(cat.spark, f"{base}/edges", build, version="1")


_STORED = ("items", "graph_edges", "graph_nodes", "tfidf", "ratings", "liked_persons")


@register("stored_tables", with_views("UNION ALL".join(f"""
SELECT '{name}' AS name, count(*) AS n_rows FROM {source}
""" for name, source in zip(_STORED, ("items", "gedges", "gnodes", "cvec", "ratings", "liked_persons")))))
def q_stored_tables(cat):
    """Derived tables as the store's manifest names them, read back, with their rows."""
    for name in _STORED:
        getattr(cat, name)
    out = None
    for name in _STORED:
        n = cat.store.read(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


@register("persons_roundtrip", ORACLES["clean_persons"])
def q_persons_roundtrip(cat):
    """The cleaned person directory written as Parquet and read back."""
    from marquee.operators import persons as P
    path = _fresh(cat, "persons")
    FS.write_persons(P.clean_persons(cat.persons_raw), path)
    return cat.spark.read.parquet(path).select("ord", "name", "douban_id", "personage_id", "avatar_url", "biography", "avatar_local_path")


_SCANNED = {"users": "users", "ratings": "ratings", "reviews": "reviews", "user_likes": "likes", "user_favorites": "favorites",
            "browsing_history": "history", "review_likes": "review_likes", "review_replies": "review_replies",
            "user_liked_persons": "liked_persons"}


@register("activity_scan", with_views("UNION ALL".join(f"""
SELECT '{name}' AS name, count(*) AS n_rows, count(DISTINCT {"id" if name == "users" else "user_id"}) AS n_users FROM {source}
""" for name, source in _SCANNED.items())))
def q_activity_scan(cat):
    """The nine activity tables written in their declared schemas and scanned again."""
    base, out = _fresh(cat, "activity-tables"), None
    for name, source in _SCANNED.items():
        schema = FS.ACTIVITY_SCHEMAS[name]
        df = getattr(cat, source)
        df = df.withColumnRenamed("item_id", "movie_id") if "item_id" in df.columns else df
        if name == "browsing_history":
            df = df.withColumn("id", F.xxhash64("user_id", "movie_id"))
        columns = [c.strip().split(" ") for c in schema.split(",")]
        df.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns]).write.parquet(f"{base}/{name}")
    for name, df in FS.scan_activity(cat.spark, base).items():
        user = F.col("id" if name == "users" else "user_id")
        n = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(user).alias("n_users")).select(F.lit(name).alias("name"), "n_rows", "n_users")
        out = n if out is None else out.unionByName(n)
    return out


STREAM_FILES = 6


def _log_source(cat) -> str:
    """The log as several files; two of them make a micro-batch."""
    path = _fresh(cat, "activity-log")
    cat.activity.repartition(STREAM_FILES).write.mode("overwrite").parquet(path)
    return path


@register("stream_likes_current")
def q_stream_likes_current(cat):
    """U2 as Structured Streaming (availableNow, three micro-batches) over the activity log."""
    from marquee.streaming import activity_stream as ST
    return ST.stream_toggles(cat.spark, _log_source(cat), "like", _fresh(cat, "likes-out"), _fresh(cat, "likes-ckpt"), 2)


@register("stream_favorites_current")
def q_stream_favorites_current(cat):
    """U3 as Structured Streaming."""
    from marquee.streaming import activity_stream as ST
    return ST.stream_toggles(cat.spark, _log_source(cat), "favorite", _fresh(cat, "fav-out"), _fresh(cat, "fav-ckpt"), 2)


@register("stream_history_current")
def q_stream_history_current(cat):
    """U6 as Structured Streaming."""
    from marquee.streaming import activity_stream as ST
    return ST.stream_history(cat.spark, _log_source(cat), _fresh(cat, "hist-out"), _fresh(cat, "hist-ckpt"), 2)


@register("stream_ratings_current")
def q_stream_ratings_current(cat):
    """U1 + U7 as Structured Streaming: the log arrives in three slices of time, and the query starts again for
    each from its checkpoint."""
    from marquee.streaming import activity_stream as ST
    src, out, ckpt = _fresh(cat, "rate-log"), _fresh(cat, "rate-out"), _fresh(cat, "rate-ckpt")
    at = F.unix_timestamp("ts")
    cut = cat.activity.agg(F.percentile_approx(at, F.array(F.lit(1 / 3), F.lit(2 / 3)), 1000)).first()[0] or [0, 0]
    for low, high in ((None, cut[0]), (cut[0], cut[1]), (cut[1], None)):
        part = cat.activity
        if low is not None:
            part = part.filter(at > low)
        if high is not None:
            part = part.filter(at <= high)
        part.write.mode("append").parquet(src)
        state = ST.stream_ratings(cat.spark, src, out, ckpt)
    return state


@register("stream_deletes")
def q_stream_deletes(cat):
    """U7 / U8 as Structured Streaming: the application's log in three slices of time."""
    from marquee.operators import deletes as D
    from marquee.plans.q_activity import _admins
    src, out, ckpt = _fresh(cat, "app-log"), _fresh(cat, "app-out"), _fresh(cat, "app-ckpt")
    log, at = cat.application_log, F.unix_timestamp("ts")
    cut = log.agg(F.percentile_approx(at, F.array(F.lit(0.3), F.lit(0.9)), 1000)).first()[0] or [0, 0]
    for low, high in ((None, cut[0]), (cut[0], cut[1]), (cut[1], None)):
        part = log
        if low is not None:
            part = part.filter(at > low)
        if high is not None:
            part = part.filter(at <= high)
        part.write.mode("append").parquet(src)
        state = D.stream_deletes(cat.spark, src, _admins(cat), out, ckpt)
    return state


ORACLES["stream_likes_current"] = with_views("SELECT user_id, item_id, created_at FROM likes")
ORACLES["stream_favorites_current"] = with_views("SELECT user_id, item_id, created_at FROM favorites")
ORACLES["stream_history_current"] = with_views("SELECT user_id, item_id, viewed_at FROM history")
ORACLES["stream_ratings_current"] = with_views(
    "SELECT user_id, item_id, score, created_at, updated_at FROM ratings")
ORACLES["stream_deletes"] = APPLY_DELETES
