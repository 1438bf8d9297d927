"""Catalogue normalisation: raw ingest records -> canonical films.

``normalize_items`` is one projection + filter (no shuffle); ``items_by_id``
keeps the last record per id (one aggregate on ``id``); ``credits`` and
``tags`` are the exploded long forms every person / tag operator joins on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import text as T

TOP_ACTORS = 5
RAW_TEXT_FIELDS = ("id", "title", "cover", "rating", "director", "screenwriter", "cast", "genre", "country",
                   "language", "release_date", "runtime", "imdb", "aka", "summary", "poster_local_path")


def valid_item(raw: DataFrame) -> "F.Column":
    """Both title and id truthy (integer id 0 is falsy; blank-only title
    is truthy)."""
    idc = F.col("id").cast("string")
    return (F.col("title").isNotNull() & (F.col("title").cast("string") != "")
            & idc.isNotNull() & (idc != "") & (idc != "0" if _id_is_numeric(raw) else F.lit(True)))


def _id_is_numeric(raw: DataFrame) -> bool:
    return dict(raw.dtypes).get("id") in ("int", "bigint", "smallint", "tinyint", "double", "float")


def normalize_items(raw: DataFrame) -> DataFrame:
    """Raw ingest record -> normalised film (keeps duplicates; ``ord``).
    Fields absent from the input count as empty."""
    for f in RAW_TEXT_FIELDS:
        if f not in raw.columns:
            raw = raw.withColumn(f, F.lit(None).cast("string"))
    actors = T.split_multi("cast")
    rating = T.parse_rating("rating")
    out = raw.filter(valid_item(raw)).select(
        F.col("ord"),
        F.col("id").cast("string").alias("id"),
        T.ustrip(F.col("title").cast("string")).alias("title"),
        rating.alias("rating"),
        T.rating_hundredths(rating).alias("rating_c"),
        T.split_multi("genre").alias("genres"),
        T.split_multi("country").alias("countries"),
        T.parse_year("release_date").alias("year"),
        T.parse_runtime("runtime").alias("runtime"),
        T.split_multi("director").alias("directors"),
        F.slice(actors, 1, TOP_ACTORS).alias("top_actors"),
        actors.alias("all_actors"),
        T.text_or_empty("language").alias("language"),
        T.text_or_empty("country").alias("country_raw"),
        T.text_or_empty("genre").alias("genre_raw"),
        T.text_or_empty("director").alias("director_raw"),
        T.text_or_empty("cast").alias("cast_raw"),
        T.text_or_empty("release_date").alias("release_date"),
        T.text_or_empty("runtime").alias("runtime_raw"),
        T.text_or_empty("summary").alias("summary"),
        T.text_or_empty("cover").alias("cover"),
        T.text_or_empty("poster_local_path").alias("poster_local_path"),
    )
    return out


def items_by_id(items: DataFrame) -> DataFrame:
    """Lookup view: the last record (highest ``ord``) per id wins.

    One hash aggregate on ``id`` with map-side partial ``max_by``; no sort."""
    cols = [c for c in items.columns if c != "id"]
    packed = F.struct(*[F.col(c) for c in cols])
    agg = items.groupBy("id").agg(F.max_by(packed, F.col("ord")).alias("r"))
    return agg.select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def item_cards(items: DataFrame) -> DataFrame:
    """Presentation card of a film."""
    return items.select(
        "id", "title", "cover", "rating",
        F.col("genre_raw").alias("genre"), "genres",
        F.col("director_raw").alias("director"), F.col("cast_raw").alias("cast"),
        "release_date", "poster_local_path", F.col("runtime_raw").alias("runtime"),
        "summary", "countries", "year",
    )


def credits(items: DataFrame) -> DataFrame:
    """Long form of people per film: (item_id, person, role, pos).

    ``pos`` is the 1-based position in the film's list (directors and actors
    numbered separately); repeats are kept."""
    d = items.select("id", "ord", F.posexplode("directors").alias("p", "person")).withColumn(
        "role", F.lit("director"))
    a = items.select("id", "ord", F.posexplode("all_actors").alias("p", "person")).withColumn(
        "role", F.lit("actor"))
    return d.unionByName(a).select(F.col("id").alias("item_id"), "ord", "person", "role",
                                   (F.col("p") + 1).alias("pos"))
