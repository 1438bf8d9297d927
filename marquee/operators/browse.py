"""Rankings, hero samples, genre charts, faceted browse and paging.

Top-k lists are ``row_number() <= k`` filters: Spark plans them as a
per-task WindowGroupLimit followed by one small exchange, so only k rows per
task move. "Random" picks are repeatable hash orders (md5 of seed and key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.agg import mean_hundredths, top_k
from marquee.functions.text import hash_order, round_half_up

# Browse parameters of the catalogue's pages.
HIGH_RATING = 8.0
NEW_FROM_YEAR = 2020
OLD_BEFORE_YEAR = 2000
PAGE_SIZE = 24
# Period chips: (label, first year, last year); the last one is open below.
PERIODS = (
    ("2020s", 2020, 2029),
    ("2010s", 2010, 2019),
    ("2000s", 2000, 2009),
    ("1990s", 1990, 1999),
    ("1980s", 1980, 1989),
    ("1970s及更早", 0, 1979),
)

def by_rating():
    return [F.col("rating").desc(), F.col("id").asc(), F.col("ord").asc()]


def top_items(items: DataFrame, n: int = 10) -> DataFrame:
    """K1: best rated films (unrated included at the bottom)."""
    return top_k(items.select("id", "title", "rating", "year", "ord"), n, by_rating()).drop("ord")


def new_items(items: DataFrame, n: int = 10) -> DataFrame:
    """K2: films from 2020 on, best rated first."""
    return top_items(items.filter(F.col("year") >= NEW_FROM_YEAR), n)


def old_items(items: DataFrame, n: int = 10) -> DataFrame:
    """K2: films before 2000, best rated first."""
    return top_items(items.filter(F.col("year") < OLD_BEFORE_YEAR), n)


def daily_items(items: DataFrame, day: str, n: int = 10) -> DataFrame:
    """K3: highly rated films in an order that changes once per day."""
    hi = items.filter(F.col("rating") >= HIGH_RATING).select(
        "id", "title", "rating", "ord", hash_order(day, F.col("id")).alias("_h"))
    return top_k(hi, n, [F.col("_h").asc(), F.col("ord").asc()]).drop("_h", "ord")


def person_pool(items: DataFrame, role: str) -> DataFrame:
    """Distinct names credited in highly rated films (role: director/actor)."""
    col = "directors" if role == "director" else "all_actors"
    return (items.filter(F.col("rating") >= HIGH_RATING)
            .select(F.explode(col).alias("name")).distinct())


def sample_persons(items: DataFrame, persons_dir: DataFrame, role: str, seed: str, n: int = 10) -> DataFrame:
    """K4 / K5: ``n`` repeatable random names from the pool, with profile."""
    from marquee.operators.persons import directory_by_name
    pool = person_pool(items, role).withColumn("_h", hash_order(seed, F.col("name")))
    pick = top_k(pool, n, [F.col("_h").asc(), F.col("name").asc()]).drop("_h")
    d = directory_by_name(persons_dir).select("name", "avatar_local_path", "profession")
    return pick.join(d, "name", "left").select(
        "rk", "name", F.coalesce("avatar_local_path", F.lit("")).alias("avatar"),
        F.coalesce("profession", F.lit("")).alias("profession"))


def genre_chart(items: DataFrame, n: int = 10) -> DataFrame:
    """K6 / W1 for every genre at once: each genre's film count (a film
    counted once per genre) and its ``n`` best rated films."""
    e = items.select("id", "title", "rating", "ord", F.explode(F.array_distinct("genres")).alias("genre"))
    totals = e.groupBy("genre").agg(F.count(F.lit(1)).alias("genre_total"))  # partial aggregate
    return top_k(e, n, by_rating(), partition=["genre"]).drop("ord").join(totals, "genre")


def genre_list(items: DataFrame) -> DataFrame:
    """Genres by number of films (desc), ranked."""
    e = items.select("id", F.explode(F.array_distinct("genres")).alias("genre"))
    g = e.groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    return top_k(g, None, [F.col("n").desc(), F.col("genre").asc()])


# ---------------------------------------------------------------------------
# K7 / K8 persons by count and by rating
# ---------------------------------------------------------------------------
def person_credits_rated(items: DataFrame) -> DataFrame:
    """Rated films; each name once per film, and a name seen as director is
    not counted again as actor in the same film."""
    rated = items.filter(F.col("rating") > 0)
    d = rated.select("rating_c", F.explode(F.array_distinct("directors")).alias("name"),
                     F.lit("director").alias("role"))
    a = rated.select("rating_c", F.explode(F.array_except("all_actors", "directors")).alias("name"),
                     F.lit("actor").alias("role"))
    return d.unionByName(a)


def persons_by_count(items: DataFrame, persons_dir: DataFrame, n: int = 10) -> DataFrame:
    """K7: per role, top ``n`` names by rated film count, with mean rating."""
    from marquee.operators.persons import directory_by_name
    g = person_credits_rated(items).groupBy("role", "name").agg(
        F.count(F.lit(1)).alias("n"), round_half_up(mean_hundredths("rating_c"), 1).alias("avg_rating"))
    t = top_k(g, n, [F.col("n").desc(), F.col("name").asc()], partition=["role"])
    d = directory_by_name(persons_dir).select("name", "name_en", "profession")
    return t.join(d, "name", "left").select(
        "role", "rk", "name", "n", "avg_rating", F.coalesce("name_en", F.lit("")).alias("name_en"),
        F.coalesce("profession", F.lit("")).alias("profession"))


def persons_by_rating(items: DataFrame, n: int = 10, min_movies: int = 3) -> DataFrame:
    """K8: per role, names with >= ``min_movies`` rated films by mean (1 place), count."""
    g = (person_credits_rated(items).groupBy("role", "name")
         .agg(F.count(F.lit(1)).alias("n"), round_half_up(mean_hundredths("rating_c"), 1).alias("avg_rating"))
         .filter(F.col("n") >= min_movies))
    return top_k(g, n, [F.col("avg_rating").desc(), F.col("n").desc(), F.col("name").asc()], partition=["role"])


# ---------------------------------------------------------------------------
# F1-F5 facets, K10 sort, K11 paging
# ---------------------------------------------------------------------------
def period_of(year) -> "F.Column":
    """period label of a year (null year, 0 or >= 2030 -> none)."""
    y = F.col(year) if isinstance(year, str) else year
    expr = None
    for label, lo, hi in PERIODS:
        cond = y.isNotNull() & (y != 0) & y.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def _period_bounds(period: str):
    for label, lo, hi in PERIODS:
        if label == period:
            return lo, hi
    return None


def facet_flags(items: DataFrame, genre: str = "", country: str = "", period: str = "") -> DataFrame:
    """one pass computing the three selection flags; an empty or unknown
    selection is no filter."""
    pg = F.array_contains("genres", genre) if genre else F.lit(True)
    pc = F.array_contains("countries", country) if country else F.lit(True)
    b = _period_bounds(period) if period else None
    pp = (F.col("year").isNotNull() & (F.col("year") != 0) & F.col("year").between(*b)) if b else F.lit(True)
    return items.select("*", pg.alias("pg"), pc.alias("pc"), pp.alias("pp"))


def facet_filter(items: DataFrame, genre: str = "", country: str = "", period: str = "") -> DataFrame:
    """films matching all three selections."""
    f = facet_flags(items, genre, country, period)
    return f.filter(F.col("pg") & F.col("pc") & F.col("pp")).drop("pg", "pc", "pp")


def facet_counts(items: DataFrame, genre: str = "", country: str = "", period: str = "") -> DataFrame:
    """per genre under (country, period), per country under (genre,
    period), per period under (genre, country); each film once per value;
    values with zero films are kept."""
    f = facet_flags(items, genre, country, period)
    g = (f.select(F.explode(F.array_distinct("genres")).alias("value"), (F.col("pc") & F.col("pp")).alias("hit"))
         .groupBy("value").agg(F.count_if("hit").alias("n")).select(F.lit("genre").alias("facet"), "value", "n"))
    c = (f.select(F.explode(F.array_distinct("countries")).alias("value"), (F.col("pg") & F.col("pp")).alias("hit"))
         .groupBy("value").agg(F.count_if("hit").alias("n")).select(F.lit("country").alias("facet"), "value", "n"))
    per = f.select(period_of("year").alias("value"), (F.col("pg") & F.col("pc")).alias("hit"))
    pc = per.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count_if("hit").alias("n"))
    labels = items.sparkSession.createDataFrame([(p[0],) for p in PERIODS], "value string")  # 6 fixed rows
    p = F.broadcast(labels).join(pc, "value", "left").select(
        F.lit("period").alias("facet"), "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return g.unionByName(c).unionByName(p)


def facet_totals(items: DataFrame, genre: str = "", country: str = "", period: str = "") -> DataFrame:
    """size of each facet's base (the "all" chip) and of the selection."""
    f = facet_flags(items, genre, country, period)
    return f.agg(F.count_if(F.col("pc") & F.col("pp")).alias("total_for_genre_all"),
                 F.count_if(F.col("pg") & F.col("pp")).alias("total_for_country_all"),
                 F.count_if(F.col("pg") & F.col("pc")).alias("total_for_period_all"),
                 F.count_if(F.col("pg") & F.col("pc") & F.col("pp")).alias("total"))


def facet_values(items: DataFrame) -> DataFrame:
    """all genres and countries by unfiltered film count (desc)."""
    out = None
    for facet, col in (("genre", "genres"), ("country", "countries")):
        e = items.select("id", F.explode(F.array_distinct(col)).alias("value"))
        g = e.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        g = top_k(g, None, [F.col("n").desc(), F.col("value").asc()]).withColumn("facet", F.lit(facet))
        out = g if out is None else out.unionByName(g)
    return out


SORTS = {"rating": "rating", "date": "release_date", "runtime": "runtime"}


PAGE_COLUMNS = ("id", "title", "rating", "release_date", "runtime", "year", "ord")
PAGE_BUCKET = 1 << 16  # rows of a folder of the page index


def _page_order(sort: str, seed: str) -> list:
    first = F.col(SORTS[sort]).desc() if sort in SORTS else hash_order(seed, F.col("id")).asc()
    return [first, F.col("id").asc(), F.col("ord").asc()]


def page_index(items: DataFrame, path: str, genre: str = "", country: str = "", period: str = "", sort: str = "random",
               seed: str = "0", bucket: int = PAGE_BUCKET) -> int:
    """K10 / K11 for deep pages: the filtered list in its order, numbered by a
    range sort and the partitions' row counts, as folders of ``bucket`` rows
    under ``path``. Returns the number of rows."""
    from marquee.functions.agg import dense_ids
    f = facet_filter(items, genre, country, period).select(*PAGE_COLUMNS)
    numbered = dense_ids(f, _page_order(sort, seed), "_row").select(
        *PAGE_COLUMNS, (F.col("_row") + 1).alias("rk"), F.floor(F.col("_row") / bucket).cast("long").alias("bucket"))
    numbered.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return f.sparkSession.read.parquet(path).count()


def indexed_page(spark, path: str, total: int, page: int, page_size: int = PAGE_SIZE, bucket: int = PAGE_BUCKET) -> DataFrame:
    """One page of a ``page_index``, like ``browse_page``: it reads the one or two
    folders that hold it, whatever the page's number."""
    lo, hi = (page - 1) * page_size, page * page_size
    index = spark.read.option("basePath", path).parquet(path)
    here = index.filter(F.col("bucket").between(lo // bucket, (hi - 1) // bucket) & F.col("rk").between(lo + 1, hi))
    return here.select("rk", "id", "title", "rating", "release_date", "runtime", F.lit(total).cast("long").alias("total"),
                       F.lit(max(1, -(-total // page_size))).cast("long").alias("total_pages"))


def browse_page(items: DataFrame, genre: str = "", country: str = "", period: str = "",
                sort: str = "random", page: int = 1, seed: str = "0", page_size: int = PAGE_SIZE) -> DataFrame:
    """F1 + K10 + K11: one page of the filtered list with paging totals.

    ``total`` is a window count over the filtered set; the page is rows
    ``(page-1)*size+1 .. page*size`` of a total order (ties by id, ord)."""
    f = facet_filter(items, genre, country, period).select(*PAGE_COLUMNS)
    order = _page_order(sort, seed)
    lo, hi = (page - 1) * page_size + 1, page * page_size
    ranked = top_k(f, hi, order).filter(F.col("rk") >= lo)
    total = f.select(F.count(F.lit(1))).scalar()
    return ranked.select("rk", "id", "title", "rating", "release_date", "runtime",
                         total.alias("total"),
                         F.greatest(F.lit(1), F.ceil(total / F.lit(page_size))).cast("bigint").alias("total_pages"))
