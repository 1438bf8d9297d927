"""Registered report queries (A1-A15) and their SQL oracles."""

from __future__ import annotations

from marquee.operators import catalogue as C
from marquee.operators import reports as R
from marquee.plans.registry import register
from marquee.plans.sqlviews import mean_c, rhu, split_multi, with_views

RATED_MEAN_2 = rhu(mean_c("rating_c", "rating > 0"), 2)


def _count_body(array_expr: str, name: str, top_n: int, with_rating: bool = True) -> str:
    avg = f", {RATED_MEAN_2} AS avg_rating" if with_rating else ""
    return f"""
SELECT * FROM (
  SELECT {name}, count(*) AS n{avg},
    row_number() OVER (ORDER BY count(*) DESC, {name} ASC) AS rk
  FROM (SELECT unnest({array_expr}) AS {name}, rating, rating_c FROM items) e
  GROUP BY {name}
) t WHERE rk <= {top_n}
"""


def _count_sql(array_expr: str, name: str, top_n: int, with_rating: bool = True) -> str:
    return with_views(_count_body(array_expr, name, top_n, with_rating))


@register("normalize_items", with_views("""
SELECT id, title, rating, rating_c, array_to_string(genres, '|') AS genres, array_to_string(countries, '|') AS countries,
  year, runtime, array_to_string(directors, '|') AS directors, array_to_string(top_actors, '|') AS top_actors,
  array_to_string(all_actors, '|') AS all_actors, language
FROM items
"""))
def q_normalize_items(cat):
    """The normalised catalogue (lists shown '|'-joined)."""
    from pyspark.sql import functions as F
    it = cat.items
    return it.select("id", "title", "rating", "rating_c",
                     *[F.array_join(c, "|").alias(c) for c in ("genres", "countries")],
                     "year", "runtime",
                     *[F.array_join(c, "|").alias(c) for c in ("directors", "top_actors", "all_actors")],
                     "language")


@register("rating_distribution", with_views("""
SELECT b.bin, CAST(b.bin AS VARCHAR) || '-' || CAST(b.bin + 1 AS VARCHAR) AS label, coalesce(c.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b
LEFT JOIN (SELECT CAST(least(floor(rating), 9) AS INTEGER) AS bin, count(*) AS n
           FROM items WHERE rating > 0 AND rating <= 10 GROUP BY 1) c ON c.bin = b.bin
"""))
def q_rating_distribution(cat):
    return R.rating_distribution(cat.items)


_N = "CAST(count(*) AS DOUBLE)"
_S = "sum(CAST(rating_c AS DOUBLE))"
_SS = "sum(CAST(rating_c AS DOUBLE) * CAST(rating_c AS DOUBLE))"
STD_SQL = rhu(f"sqrt(greatest(({_N} * {_SS} - {_S} * {_S}) / ({_N} * {_N}), 0.0)) / 100.0", 2)


@register("rating_summary", with_views(f"""
SELECT count(*) AS n_rated, {rhu(f"{_S} / {_N} / 100.0", 2)} AS avg,
  {rhu("median(rating_c) / 100.0", 2)} AS median, {STD_SQL} AS std,
  min(rating) AS min, max(rating) AS max
FROM items WHERE rating > 0
"""))
def q_rating_summary(cat):
    return R.rating_summary(cat.items)


@register("genre_distribution", _count_sql("genres", "genre", 20))
def q_genre_distribution(cat):
    return R.genre_distribution(cat.items)


@register("country_distribution", _count_sql("countries", "country", 15))
def q_country_distribution(cat):
    return R.country_distribution(cat.items)


@register("language_distribution", _count_sql(split_multi("language"), "language", 15, with_rating=False))
def q_language_distribution(cat):
    return R.language_distribution(cat.items)


@register("director_ranking", _count_sql("directors", "director", 20))
def q_director_ranking(cat):
    return R.director_ranking(cat.items)


@register("actor_ranking", _count_sql("top_actors", "actor", 20))
def q_actor_ranking(cat):
    return R.actor_ranking(cat.items)


@register("year_trend", with_views(f"""
SELECT year, count(*) AS n, coalesce({RATED_MEAN_2}, 0.0) AS avg_rating
FROM items WHERE year IS NOT NULL AND year <> 0 AND year BETWEEN 1950 AND 2026 GROUP BY year
"""))
def q_year_trend(cat):
    return R.year_trend(cat.items)


@register("runtime_distribution", with_views("""
SELECT b.bin, CAST(b.bin * 30 AS VARCHAR) || '-' || CAST(b.bin * 30 + 30 AS VARCHAR) AS label, coalesce(rc.n, 0) AS n
FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(bin) FROM rc))) AS INTEGER) AS bin) b
LEFT JOIN rc ON rc.bin = b.bin
""", {"rc": "SELECT CAST(floor(runtime / 30) AS INTEGER) AS bin, count(*) AS n FROM items "
            "WHERE runtime > 0 AND runtime < 400 GROUP BY 1"}))
def q_runtime_distribution(cat):
    return R.runtime_distribution(cat.items)


@register("runtime_summary", with_views(f"""
SELECT count(*) AS n, {rhu("avg(runtime)", 1)} AS avg, min(runtime) AS min, max(runtime) AS max
FROM items WHERE runtime > 0 AND runtime < 400
"""))
def q_runtime_summary(cat):
    return R.runtime_summary(cat.items)


@register("rating_vs_runtime", with_views("""
SELECT id, runtime AS x, rating AS y, title, coalesce(genres[1], '') AS genre FROM items
WHERE runtime > 0 AND runtime < 400 AND rating > 0
QUALIFY row_number() OVER (ORDER BY md5('42-' || id), ord) <= 1000
"""))
def q_rating_vs_runtime(cat):
    return R.rating_vs_runtime(cat.items)


@register("top_rated_by_genre", with_views("""
SELECT id, title, rating, year, genre, rk FROM (
  SELECT id, title, rating, year, genre,
    row_number() OVER (PARTITION BY genre ORDER BY rating DESC, id ASC, ord ASC) AS rk
  FROM (SELECT id, title, rating, year, ord, unnest(list_distinct(genres)) AS genre FROM items WHERE rating > 0) e
) t WHERE rk <= 10
"""))
def q_top_rated_by_genre(cat):
    return R.top_rated_by_genre(cat.items)


def _rating_rank_body(array_col: str, name: str, top_n: int, min_movies: int) -> str:
    m = rhu(mean_c("rating_c"), 1)
    return f"""
SELECT * FROM (
  SELECT {name}, {m} AS avg_rating, count(*) AS n,
    row_number() OVER (ORDER BY {m} DESC, count(*) DESC, {name} ASC) AS rk
  FROM (SELECT unnest({array_col}) AS {name}, rating_c FROM items WHERE rating > 0) e
  GROUP BY {name} HAVING count(*) >= {min_movies}
) t WHERE rk <= {top_n}
"""


def _rating_rank_sql(array_col: str, name: str, top_n: int, min_movies: int) -> str:
    return with_views(_rating_rank_body(array_col, name, top_n, min_movies))


@register("director_rating_ranking", _rating_rank_sql("directors", "director", 10, 3))
def q_director_rating_ranking(cat):
    return R.director_rating_ranking(cat.items)


@register("actor_rating_ranking", _rating_rank_sql("all_actors", "actor", 10, 5))
def q_actor_rating_ranking(cat):
    return R.actor_rating_ranking(cat.items)


PERSON_STATS_BODY = """
SELECT CAST(sum(d) AS BIGINT) AS total_directors, CAST(sum(a) AS BIGINT) AS total_actors,
  count(*) FILTER (WHERE d = 1 AND a = 1) AS both,
  count(*) FILTER (WHERE d = 1 AND a = 0) AS director_only,
  count(*) FILTER (WHERE d = 0 AND a = 1) AS actor_only
FROM (
  SELECT name, max(d) AS d, max(a) AS a FROM (
    SELECT unnest(directors) AS name, 1 AS d, 0 AS a FROM items
    UNION ALL SELECT unnest(all_actors) AS name, 0 AS d, 1 AS a FROM items
  ) u GROUP BY name
) f
"""
PERSON_STATS_SQL = with_views(PERSON_STATS_BODY)


@register("person_stats", PERSON_STATS_SQL)
def q_person_stats(cat):
    return R.person_stats(cat.items)


@register("summary_stats", with_views(f"""
SELECT count(*) AS total_movies,
  {rhu(mean_c("rating_c", "rating > 0"), 2)} AS avg_rating,
  {rhu("median(CASE WHEN rating > 0 THEN rating_c END) / 100.0", 2)} AS median_rating,
  max(CASE WHEN rating > 0 THEN rating END) AS max_rating,
  min(CASE WHEN rating > 0 THEN rating END) AS min_rating,
  {rhu("avg(CASE WHEN runtime > 0 THEN runtime END)", 1)} AS avg_runtime,
  CAST(min(CASE WHEN year <> 0 THEN year END) AS VARCHAR) || '-' || CAST(max(CASE WHEN year <> 0 THEN year END) AS VARCHAR) AS year_range,
  (SELECT {STD_SQL} FROM items WHERE rating > 0) AS std_rating,
  (SELECT count(DISTINCT g) FROM (SELECT unnest(genres) AS g FROM items) x) AS genre_count,
  (SELECT count(DISTINCT c) FROM (SELECT unnest(countries) AS c FROM items) y) AS country_count
FROM items
"""))
def q_summary_stats(cat):
    return R.summary_stats(cat.items)


_FULL_PARTS = {
    "r_rating": """SELECT b.bin, CAST(b.bin AS VARCHAR) || '-' || CAST(b.bin + 1 AS VARCHAR) AS label, coalesce(c.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b
LEFT JOIN (SELECT CAST(least(floor(rating), 9) AS INTEGER) AS bin, count(*) AS n
           FROM items WHERE rating > 0 AND rating <= 10 GROUP BY 1) c ON c.bin = b.bin""",
    "r_genre": _count_body("genres", "genre", 20),
    "r_country": _count_body("countries", "country", 15),
    "r_year": f"""SELECT year, count(*) AS n, coalesce({RATED_MEAN_2}, 0.0) AS avg_rating
FROM items WHERE year IS NOT NULL AND year <> 0 AND year BETWEEN 1950 AND 2026 GROUP BY year""",
    "rc": "SELECT CAST(floor(runtime / 30) AS INTEGER) AS bin, count(*) AS n FROM items "
          "WHERE runtime > 0 AND runtime < 400 GROUP BY 1",
    "r_runtime": """SELECT CAST(b.bin * 30 AS VARCHAR) || '-' || CAST(b.bin * 30 + 30 AS VARCHAR) AS label, coalesce(rc.n, 0) AS n
FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(bin) FROM rc))) AS INTEGER) AS bin) b LEFT JOIN rc ON rc.bin = b.bin""",
    "r_scatter": """SELECT id, runtime AS x, rating AS y FROM items WHERE runtime > 0 AND runtime < 400 AND rating > 0
QUALIFY row_number() OVER (ORDER BY md5('42-' || id), ord) <= 1000""",
    "r_lang": _count_body(split_multi("language"), "language", 15, with_rating=False),
    "r_dir": _count_body("directors", "director", 20),
    "r_act": _count_body("top_actors", "actor", 20),
    "r_dir_rt": _rating_rank_body("directors", "director", 10, 3),
    "r_act_rt": _rating_rank_body("all_actors", "actor", 10, 5),
}


@register("full_report", with_views("""
SELECT 'rating_distribution' AS report, label, CAST(n AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS extra FROM r_rating
UNION ALL SELECT 'genre_distribution', genre, CAST(n AS DOUBLE), avg_rating FROM r_genre
UNION ALL SELECT 'country_distribution', country, CAST(n AS DOUBLE), avg_rating FROM r_country
UNION ALL SELECT 'year_trend', CAST(year AS VARCHAR), CAST(n AS DOUBLE), avg_rating FROM r_year
UNION ALL SELECT 'runtime_distribution', label, CAST(n AS DOUBLE), CAST(NULL AS DOUBLE) FROM r_runtime
UNION ALL SELECT 'rating_vs_runtime', id, CAST(x AS DOUBLE), y FROM r_scatter
UNION ALL SELECT 'language_distribution', language, CAST(n AS DOUBLE), CAST(NULL AS DOUBLE) FROM r_lang
UNION ALL SELECT 'director_ranking', director, CAST(n AS DOUBLE), avg_rating FROM r_dir
UNION ALL SELECT 'actor_ranking', actor, CAST(n AS DOUBLE), avg_rating FROM r_act
UNION ALL SELECT 'director_rating_ranking', director, avg_rating, CAST(n AS DOUBLE) FROM r_dir_rt
UNION ALL SELECT 'actor_rating_ranking', actor, avg_rating, CAST(n AS DOUBLE) FROM r_act_rt
UNION ALL SELECT 'person_stats', k, CAST(v AS DOUBLE), CAST(NULL AS DOUBLE) FROM (
  SELECT unnest(['total_directors', 'total_actors', 'both', 'director_only', 'actor_only']) AS k,
         unnest([total_directors, total_actors, "both", director_only, actor_only]) AS v FROM r_persons) p
""", {**_FULL_PARTS, "r_persons": PERSON_STATS_BODY}))
def q_full_report(cat):
    """The twelve dashboard reports as one long table."""
    return R.full_report(cat.items)


@register("item_cards", with_views("""
SELECT id, title, rating, genre_raw AS genre, array_to_string(genres, '|') AS genres,
  director_raw AS director, cast_raw AS "cast", release_date, runtime_raw AS runtime,
  array_to_string(countries, '|') AS countries, year
FROM items
"""))
def q_item_cards(cat):
    """Film cards."""
    from pyspark.sql import functions as F
    c = C.item_cards(cat.items)
    return c.select("id", "title", "rating", "genre", F.array_join("genres", "|").alias("genres"),
                    "director", "cast", "release_date", "runtime",
                    F.array_join("countries", "|").alias("countries"), "year")


@register("report_by_name", with_views(f"""
SELECT genre AS label, CAST(n AS DOUBLE) AS value, avg_rating AS extra FROM (
  SELECT genre, count(*) AS n, {RATED_MEAN_2} AS avg_rating,
    row_number() OVER (ORDER BY count(*) DESC, genre ASC) AS rk
  FROM (SELECT unnest(genres) AS genre, rating, rating_c FROM items) e
  GROUP BY genre
) t WHERE rk <= 20
"""))
def q_report_by_name(cat):
    """A dashboard report looked up by name (genre distribution)."""
    return R.report_by_name(cat.items, "genre_distribution")
