"""Descriptive reports over normalised films.

Each report is one scan of ``items`` pruned to the 2-3 columns it needs, an
``explode`` where the report is per tag/person, one partial+final hash
aggregate, and a top-k planned as a per-task group limit. Histograms join
their counts to a generated bin table of at most a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.agg import mean_hundredths, rated_mean, top_k, zero_fill
from marquee.functions.text import round_half_up

# Fixed report parameters (defaults of the catalogue's dashboard).
RATING_BINS = 10
YEAR_START, YEAR_END = 1950, 2026
RUNTIME_CAP = 400
RUNTIME_BIN = 30
SCATTER_SAMPLE = 1000
SCATTER_SEED = 42


def _rated():
    return F.col("rating") > 0


# ---------------------------------------------------------------------------
# A1 rating distribution
# ---------------------------------------------------------------------------
def rating_distribution(items: DataFrame) -> DataFrame:
    """Unit bins [0,1) .. [9,10] over rated films (the last bin is closed,
    ratings above 10 fall in none); zero-filled."""
    r = items.filter(_rated() & (F.col("rating") <= RATING_BINS)).select(
        F.least(F.floor("rating"), F.lit(RATING_BINS - 1)).cast("int").alias("bin"))
    counts = r.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = items.sparkSession.range(RATING_BINS).select(F.col("id").cast("int").alias("bin"))
    out = zero_fill(bins, counts, "bin")
    return out.select("bin", F.concat(F.col("bin").cast("string"), F.lit("-"),
                                      (F.col("bin") + 1).cast("string")).alias("label"), "n")


def rating_summary(items: DataFrame) -> DataFrame:
    """A1 statistics over rated films: mean, exact median, population std
    (all 2 places), min, max. Mean and std come from exact integer sums of
    hundredths so that any engine reproduces them bit for bit."""
    r = items.filter(_rated())
    x = F.col("rating_c").cast("double")
    n = F.count(F.lit(1)).cast("double")
    s = F.sum(x)
    ss = F.sum(x * x)
    var_c = F.try_divide(n * ss - s * s, n * n)
    return r.agg(
        F.count(F.lit(1)).alias("n_rated"),
        round_half_up(F.try_divide(s, n) / 100.0, 2).alias("avg"),
        round_half_up(F.median("rating_c") / 100.0, 2).alias("median"),
        round_half_up(F.sqrt(F.greatest(var_c, F.lit(0.0))) / 100.0, 2).alias("std"),
        F.min("rating").alias("min"),
        F.max("rating").alias("max"),
    )


# ---------------------------------------------------------------------------
# A2 / A3 / A7 / A8 / A9 tag and person counts
# ---------------------------------------------------------------------------
def _count_report(items: DataFrame, array_col: str, name: str, top_n: int | None,
                  with_rating: bool = True) -> DataFrame:
    e = items.select(F.explode(array_col).alias(name), "rating", "rating_c")
    aggs = [F.count(F.lit(1)).alias("n")]
    if with_rating:
        aggs.append(rated_mean(2).alias("avg_rating"))
    g = e.groupBy(name).agg(*aggs)
    return top_k(g, top_n, [F.col("n").desc(), F.col(name).asc()])


def genre_distribution(items: DataFrame, top_n: int = 20) -> DataFrame:
    """A2: films per genre (repeats in one film count twice) with the mean
    of rated films (null when none is rated)."""
    return _count_report(items, "genres", "genre", top_n)


def country_distribution(items: DataFrame, top_n: int = 15) -> DataFrame:
    """A3."""
    return _count_report(items, "countries", "country", top_n)


def language_distribution(items: DataFrame, top_n: int = 15) -> DataFrame:
    """Languages are split like every multi-valued field."""
    from marquee.functions.text import split_multi
    e = items.select(split_multi("language").alias("langs"), "rating", "rating_c")
    return _count_report(e, "langs", "language", top_n, with_rating=False)


def director_ranking(items: DataFrame, top_n: int = 20) -> DataFrame:
    """Films per director (unrated included), mean of rated."""
    return _count_report(items, "directors", "director", top_n)


def actor_ranking(items: DataFrame, top_n: int = 20) -> DataFrame:
    """Same over the first five actors of each film."""
    return _count_report(items, "top_actors", "actor", top_n)


# ---------------------------------------------------------------------------
# A4 / A5 / A6
# ---------------------------------------------------------------------------
def year_trend(items: DataFrame, start: int = YEAR_START, end: int = YEAR_END) -> DataFrame:
    """A4: per year in [start, end]: all films, mean of rated (0 if none)."""
    y = items.filter(F.col("year").isNotNull() & (F.col("year") != 0)
                     & F.col("year").between(start, end))
    return y.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(rated_mean(2), F.lit(0.0)).alias("avg_rating"))


def _runtimes(items: DataFrame) -> DataFrame:
    return items.filter((F.col("runtime") > 0) & (F.col("runtime") < RUNTIME_CAP))


def runtime_distribution(items: DataFrame) -> DataFrame:
    """A5: 30-minute bins from 0 to past the longest film, zero-filled."""
    rt = _runtimes(items).select((F.floor(F.col("runtime") / RUNTIME_BIN)).cast("int").alias("bin"))
    counts = rt.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # bin table: 0..max bin, generated from a one-row aggregate (<= 14 rows)
    bins = counts.agg(F.max("bin").alias("mx")).select(
        F.explode(F.sequence(F.lit(0), F.col("mx"))).alias("bin"))
    out = zero_fill(bins, counts, "bin")
    lo = F.col("bin") * RUNTIME_BIN
    return out.select("bin", F.concat(lo.cast("string"), F.lit("-"), (lo + RUNTIME_BIN).cast("string")).alias("label"),
                      "n")


def runtime_summary(items: DataFrame) -> DataFrame:
    """A5 statistics: mean (1 place), min, max of runtimes in (0, 400)."""
    return _runtimes(items).agg(
        F.count(F.lit(1)).alias("n"),
        round_half_up(F.avg("runtime"), 1).alias("avg"),
        F.min("runtime").alias("min"), F.max("runtime").alias("max"))


def rating_vs_runtime(items: DataFrame, sample: int = SCATTER_SAMPLE, seed: int = SCATTER_SEED) -> DataFrame:
    """(runtime, rating, title, first genre) of rated films with a known
    runtime; above ``sample`` points a repeatable hash-ordered sample (the
    sample size is the feature of this report)."""
    from marquee.functions.text import first_or_empty, hash_order
    p = _runtimes(items).filter(_rated()).select(
        "id", F.col("runtime").alias("x"), F.col("rating").alias("y"), "title",
        first_or_empty("genres").alias("genre"), hash_order(seed, F.col("id")).alias("_h"), "ord")
    return top_k(p, sample, [F.col("_h").asc(), F.col("ord").asc()]).drop("_h", "ord", "rk")


# ---------------------------------------------------------------------------
# A10 - A14
# ---------------------------------------------------------------------------
def top_rated_by_genre(items: DataFrame, top_n: int = 10, genre: str | None = None) -> DataFrame:
    """Best rated films of each genre (or of one genre)."""
    e = items.filter(_rated()).select("id", "title", "rating", "year", "ord",
                                      F.explode(F.array_distinct("genres")).alias("genre"))
    if genre is not None:
        e = e.filter(F.col("genre") == genre)
    return top_k(e, top_n, [F.col("rating").desc(), F.col("id").asc(), F.col("ord").asc()],
                 partition=["genre"]).drop("ord")


def _rating_ranking(items: DataFrame, array_col: str, name: str, top_n: int, min_movies: int) -> DataFrame:
    e = items.filter(_rated()).select(F.explode(array_col).alias(name), "rating_c")
    g = (e.groupBy(name)
         .agg(round_half_up(mean_hundredths("rating_c"), 1).alias("avg_rating"),
              F.count(F.lit(1)).alias("n"))
         .filter(F.col("n") >= min_movies))
    return top_k(g, top_n, [F.col("avg_rating").desc(), F.col("n").desc(), F.col(name).asc()])


def director_rating_ranking(items: DataFrame, top_n: int = 10, min_movies: int = 3) -> DataFrame:
    """Rated films only; ordered by mean rounded to 1 place, then count."""
    return _rating_ranking(items, "directors", "director", top_n, min_movies)


def actor_rating_ranking(items: DataFrame, top_n: int = 10, min_movies: int = 5) -> DataFrame:
    """Same over all actors."""
    return _rating_ranking(items, "all_actors", "actor", top_n, min_movies)


def person_stats(items: DataFrame) -> DataFrame:
    """Distinct directors / actors and their overlap, from one
    aggregate over (name -> is_director, is_actor) flags."""
    d = items.select(F.explode("directors").alias("name"), F.lit(1).alias("d"), F.lit(0).alias("a"))
    a = items.select(F.explode("all_actors").alias("name"), F.lit(0).alias("d"), F.lit(1).alias("a"))
    flags = d.unionByName(a).groupBy("name").agg(F.max("d").alias("d"), F.max("a").alias("a"))
    return flags.agg(
        F.sum("d").cast("bigint").alias("total_directors"),
        F.sum("a").cast("bigint").alias("total_actors"),
        F.count_if((F.col("d") == 1) & (F.col("a") == 1)).alias("both"),
        F.count_if((F.col("d") == 1) & (F.col("a") == 0)).alias("director_only"),
        F.count_if((F.col("d") == 0) & (F.col("a") == 1)).alias("actor_only"))


def summary_stats(items: DataFrame) -> DataFrame:
    """One row of catalogue totals. Distinct tag counts are computed by
    a grouped pre-aggregation (exact) instead of a global distinct set."""
    base = items.agg(
        F.count(F.lit(1)).alias("total_movies"),
        round_half_up(mean_hundredths("rating_c", _rated()), 2).alias("avg_rating"),
        round_half_up(F.median(F.when(_rated(), F.col("rating_c"))) / 100.0, 2).alias("median_rating"),
        F.max(F.when(_rated(), F.col("rating"))).alias("max_rating"),
        F.min(F.when(_rated(), F.col("rating"))).alias("min_rating"),
        round_half_up(F.avg(F.when(F.col("runtime") > 0, F.col("runtime"))), 1).alias("avg_runtime"),
        F.concat(F.min(F.when(F.col("year") != 0, F.col("year"))).cast("string"), F.lit("-"),
                 F.max(F.when(F.col("year") != 0, F.col("year"))).cast("string")).alias("year_range"),
    )
    std = rating_summary(items).select("std").scalar()
    n_genres = items.select(F.explode("genres").alias("g")).groupBy("g").count().select(
        F.count(F.lit(1))).scalar()
    n_countries = items.select(F.explode("countries").alias("c")).groupBy("c").count().select(
        F.count(F.lit(1))).scalar()
    return base.select("*", std.alias("std_rating"), n_genres.alias("genre_count"),
                       n_countries.alias("country_count"))


# ---------------------------------------------------------------------------
# A15 / A16
# ---------------------------------------------------------------------------
REPORTS = {
    "rating_distribution": lambda it: rating_distribution(it).select(
        "label", F.col("n").cast("double").alias("value"), F.lit(None).cast("double").alias("extra")),
    "genre_distribution": lambda it: genre_distribution(it).select(
        F.col("genre").alias("label"), F.col("n").cast("double").alias("value"), F.col("avg_rating").alias("extra")),
    "country_distribution": lambda it: country_distribution(it).select(
        F.col("country").alias("label"), F.col("n").cast("double").alias("value"), F.col("avg_rating").alias("extra")),
    "year_trend": lambda it: year_trend(it).select(
        F.col("year").cast("string").alias("label"), F.col("n").cast("double").alias("value"),
        F.col("avg_rating").alias("extra")),
    "runtime_distribution": lambda it: runtime_distribution(it).select(
        "label", F.col("n").cast("double").alias("value"), F.lit(None).cast("double").alias("extra")),
    "rating_vs_runtime": lambda it: rating_vs_runtime(it).select(
        F.col("id").alias("label"), F.col("x").cast("double").alias("value"), F.col("y").alias("extra")),
    "language_distribution": lambda it: language_distribution(it).select(
        F.col("language").alias("label"), F.col("n").cast("double").alias("value"),
        F.lit(None).cast("double").alias("extra")),
    "director_ranking": lambda it: director_ranking(it).select(
        F.col("director").alias("label"), F.col("n").cast("double").alias("value"), F.col("avg_rating").alias("extra")),
    "actor_ranking": lambda it: actor_ranking(it).select(
        F.col("actor").alias("label"), F.col("n").cast("double").alias("value"), F.col("avg_rating").alias("extra")),
    "director_rating_ranking": lambda it: director_rating_ranking(it).select(
        F.col("director").alias("label"), F.col("avg_rating").alias("value"), F.col("n").cast("double").alias("extra")),
    "actor_rating_ranking": lambda it: actor_rating_ranking(it).select(
        F.col("actor").alias("label"), F.col("avg_rating").alias("value"), F.col("n").cast("double").alias("extra")),
    "person_stats": lambda it: person_stats(it).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("label"), F.col(k).cast("double").alias("value"),
                 F.lit(None).cast("double").alias("extra"))
        for k in ("total_directors", "total_actors", "both", "director_only", "actor_only")])).alias("s")).select("s.*"),
}


def report_by_name(items: DataFrame, name: str) -> DataFrame:
    """One report by name in the long (label, value, extra) form;
    unknown names raise ``KeyError`` (the web layer's 404)."""
    if name not in REPORTS:
        raise KeyError(f"unknown report: {name}")
    return REPORTS[name](items)


def full_report(items: DataFrame) -> DataFrame:
    """All twelve reports as one long table (report, label, value, extra).
    ``items`` should be cached (or an artifact table) by the caller: twelve
    aggregates read it."""
    out = None
    for name in REPORTS:
        part = report_by_name(items, name).select(F.lit(name).alias("report"), "*")
        out = part if out is None else out.unionByName(part)
    return out
