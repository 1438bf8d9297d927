"""Registered rankings / browse / facets / search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marquee.operators import browse as B
from marquee.operators import search as S
from marquee.plans.registry import register
from marquee.plans.sqlviews import hash_order, mean_c, rhu, with_views

# Parameters of the registered browse queries (the page's request arguments).
DAY = "2024-01-01"
FACET = {"genre": "ECONOMY", "country": "NATION_1", "period": "1990s"}
SEARCH_Q = "red"
API_Q = "ring"
SUGGEST_Q = "bl"
PERSON_Q = "supplier#00000001"


def _top_sql(where: str, n: int = 10) -> str:
    return with_views(f"""
SELECT id, title, rating, year, row_number() OVER (ORDER BY rating DESC, id ASC, ord ASC) AS rk
FROM items {where} QUALIFY rk <= {n}
""")


@register("top_items", _top_sql(""))
def q_top_items(cat):
    """K1."""
    return B.top_items(cat.items)


@register("new_items", _top_sql("WHERE year >= 2020"))
def q_new_items(cat):
    """K2 (new)."""
    return B.new_items(cat.items)


@register("old_items", _top_sql("WHERE year < 2000"))
def q_old_items(cat):
    """K2 (old)."""
    return B.old_items(cat.items)


@register("daily_items", with_views(f"""
SELECT id, title, rating, row_number() OVER (ORDER BY md5('{DAY}-' || id), ord) AS rk
FROM items WHERE rating >= 8.0 QUALIFY rk <= 10
"""))
def q_daily_items(cat):
    """K3."""
    return B.daily_items(cat.items, DAY)


def _sample_sql(col: str, n: int) -> str:
    return with_views(f"""
SELECT s.rk, s.name, coalesce(p.avatar_local_path, '') AS avatar, coalesce(p.profession, '') AS profession
FROM (SELECT name, row_number() OVER (ORDER BY md5('{DAY}-' || name), name) AS rk
      FROM (SELECT DISTINCT unnest({col}) AS name FROM items WHERE rating >= 8.0) d QUALIFY rk <= {n}) s
LEFT JOIN persons_by_name p ON p.name = s.name
""")


@register("sample_actors", _sample_sql("all_actors", 10))
def q_sample_actors(cat):
    """K4 (actors)."""
    return B.sample_persons(cat.items, cat.persons, "actor", DAY)


@register("sample_directors", _sample_sql("directors", 10))
def q_sample_directors(cat):
    """K4 (directors)."""
    return B.sample_persons(cat.items, cat.persons, "director", DAY)


@register("hero_pick", with_views(f"""
SELECT 'actor' AS role, name FROM (SELECT DISTINCT unnest(all_actors) AS name FROM items WHERE rating >= 8.0) a
QUALIFY row_number() OVER (ORDER BY md5('{DAY}-' || name), name) = 1
UNION ALL
SELECT 'director' AS role, name FROM (SELECT DISTINCT unnest(directors) AS name FROM items WHERE rating >= 8.0) d
QUALIFY row_number() OVER (ORDER BY md5('{DAY}-' || name), name) = 1
"""))
def q_hero_pick(cat):
    """K5: one actor and one director of the day."""
    a = B.sample_persons(cat.items, cat.persons, "actor", DAY, 1).select(F.lit("actor").alias("role"), "name")
    d = B.sample_persons(cat.items, cat.persons, "director", DAY, 1).select(F.lit("director").alias("role"), "name")
    return a.unionByName(d)


@register("genre_chart", with_views("""
SELECT id, title, rating, genre, genre_total, rk FROM (
  SELECT id, title, rating, genre, count(*) OVER (PARTITION BY genre) AS genre_total,
    row_number() OVER (PARTITION BY genre ORDER BY rating DESC, id ASC, ord ASC) AS rk
  FROM (SELECT id, title, rating, ord, unnest(list_distinct(genres)) AS genre FROM items) e
) t WHERE rk <= 10
"""))
def q_genre_chart(cat):
    """Top 10 of every genre with the genre's total."""
    return B.genre_chart(cat.items)


@register("genre_list", with_views("""
SELECT genre, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, genre ASC) AS rk
FROM (SELECT id, unnest(list_distinct(genres)) AS genre FROM items) e GROUP BY genre
"""))
def q_genre_list(cat):
    """K6: genres by film count."""
    return B.genre_list(cat.items)


PCR = {"pcr": """
SELECT rating_c, unnest(list_distinct(directors)) AS name, 'director' AS role FROM items WHERE rating > 0
UNION ALL
SELECT rating_c, unnest(list_distinct(list_filter(all_actors, lambda a: NOT list_contains(directors, a)))) AS name,
  'actor' AS role FROM items WHERE rating > 0
"""}


@register("persons_by_count", with_views(f"""
SELECT t.role, t.rk, t.name, t.n, t.avg_rating, coalesce(p.name_en, '') AS name_en,
  coalesce(p.profession, '') AS profession
FROM (SELECT role, name, count(*) AS n, {rhu(mean_c("rating_c"), 1)} AS avg_rating,
        row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, name ASC) AS rk
      FROM pcr GROUP BY role, name QUALIFY rk <= 10) t
LEFT JOIN persons_by_name p ON p.name = t.name
""", PCR))
def q_persons_by_count(cat):
    """K7."""
    return B.persons_by_count(cat.items, cat.persons)


@register("persons_by_rating", with_views(f"""
SELECT role, name, n, avg_rating, rk FROM (
  SELECT role, name, count(*) AS n, {rhu(mean_c("rating_c"), 1)} AS avg_rating,
    row_number() OVER (PARTITION BY role ORDER BY {rhu(mean_c("rating_c"), 1)} DESC, count(*) DESC, name ASC) AS rk
  FROM pcr GROUP BY role, name HAVING count(*) >= 3
) t WHERE rk <= 10
""", PCR))
def q_persons_by_rating(cat):
    """K8."""
    return B.persons_by_rating(cat.items)


_PG = f"list_contains(genres, '{FACET['genre']}')"
_PC = f"list_contains(countries, '{FACET['country']}')"
_PP = "(year IS NOT NULL AND year <> 0 AND year BETWEEN 1990 AND 1999)"
_PERIOD = ("CASE WHEN year IS NULL OR year = 0 THEN NULL WHEN year BETWEEN 2020 AND 2029 THEN '2020s' "
           "WHEN year BETWEEN 2010 AND 2019 THEN '2010s' WHEN year BETWEEN 2000 AND 2009 THEN '2000s' "
           "WHEN year BETWEEN 1990 AND 1999 THEN '1990s' WHEN year BETWEEN 1980 AND 1989 THEN '1980s' "
           "WHEN year BETWEEN 0 AND 1979 THEN '1970s及更早' END")


@register("facet_counts", with_views(f"""
SELECT 'genre' AS facet, value, count(*) FILTER (WHERE hit) AS n
FROM (SELECT unnest(list_distinct(genres)) AS value, ({_PC} AND {_PP}) AS hit FROM items) g GROUP BY value
UNION ALL
SELECT 'country' AS facet, value, count(*) FILTER (WHERE hit) AS n
FROM (SELECT unnest(list_distinct(countries)) AS value, ({_PG} AND {_PP}) AS hit FROM items) c GROUP BY value
UNION ALL
SELECT 'period' AS facet, l.value, coalesce(p.n, 0) AS n
FROM (VALUES ('2020s'), ('2010s'), ('2000s'), ('1990s'), ('1980s'), ('1970s及更早')) l(value)
LEFT JOIN (SELECT {_PERIOD} AS value, count(*) FILTER (WHERE {_PG} AND {_PC}) AS n FROM items GROUP BY 1) p
  ON p.value = l.value
"""))
def q_facet_counts(cat):
    """F2 (and F5 period bins)."""
    return B.facet_counts(cat.items, **FACET)


@register("facet_totals", with_views(f"""
SELECT count(*) FILTER (WHERE {_PC} AND {_PP}) AS total_for_genre_all,
  count(*) FILTER (WHERE {_PG} AND {_PP}) AS total_for_country_all,
  count(*) FILTER (WHERE {_PG} AND {_PC}) AS total_for_period_all,
  count(*) FILTER (WHERE {_PG} AND {_PC} AND {_PP}) AS total
FROM items
"""))
def q_facet_totals(cat):
    """F3."""
    return B.facet_totals(cat.items, **FACET)


@register("facet_filter", with_views(f"SELECT id, title, year FROM items WHERE {_PG} AND {_PC} AND {_PP}"))
def q_facet_filter(cat):
    """F1."""
    return B.facet_filter(cat.items, **FACET).select("id", "title", "year")


@register("facet_values", with_views("""
SELECT value, n, rk, facet FROM (
  SELECT 'genre' AS facet, value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value ASC) AS rk
  FROM (SELECT id, unnest(list_distinct(genres)) AS value FROM items) g GROUP BY value
) a
UNION ALL
SELECT value, n, rk, facet FROM (
  SELECT 'country' AS facet, value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value ASC) AS rk
  FROM (SELECT id, unnest(list_distinct(countries)) AS value FROM items) c GROUP BY value
) b
"""))
def q_facet_values(cat):
    """F4."""
    return B.facet_values(cat.items)


@register("period_bins", with_views(f"SELECT id, {_PERIOD} AS period FROM items"))
def q_period_bins(cat):
    """F5."""
    return cat.items.select("id", B.period_of("year").alias("period"))


@register("browse_page", with_views(f"""
SELECT rk, id, title, rating, release_date, runtime, total, greatest(1, CAST(ceil(total / 24) AS BIGINT)) AS total_pages
FROM (
  SELECT id, title, rating, release_date, runtime,
    row_number() OVER (ORDER BY rating DESC, id ASC, ord ASC) AS rk, count(*) OVER () AS total
  FROM items WHERE {_PG}
) t WHERE rk BETWEEN 25 AND 48
"""))
def q_browse_page(cat):
    """F1 + K10 + K11: page 2 of a genre, by rating."""
    return B.browse_page(cat.items, genre=FACET["genre"], sort="rating", page=2)


def _sorted_page_sql(order: str, where: str) -> str:
    return with_views(f"""
SELECT rk, id, title, rating, release_date, runtime, total, greatest(1, CAST(ceil(total / 24) AS BIGINT)) AS total_pages
FROM (
  SELECT id, title, rating, release_date, runtime,
    row_number() OVER (ORDER BY {order}, id ASC, ord ASC) AS rk, count(*) OVER () AS total FROM items
) t WHERE {where}
""")


_RANDOM_ORDER = hash_order("7", "id")
_LAST_PAGE = "rk > (greatest(1, CAST(ceil(total / 24) AS BIGINT)) - 1) * 24"


@register("browse_page_date", _sorted_page_sql("release_date DESC", "rk BETWEEN 25 AND 48"))
def q_browse_page_date(cat):
    """The whole list by release date, page 2."""
    return B.browse_page(cat.items, sort="date", page=2)


@register("browse_page_runtime", _sorted_page_sql("runtime DESC", "rk BETWEEN 1 AND 24"))
def q_browse_page_runtime(cat):
    """The whole list by runtime, page 1."""
    return B.browse_page(cat.items, sort="runtime", page=1)


@register("browse_page_random", _sorted_page_sql(_RANDOM_ORDER, "rk BETWEEN 49 AND 72"))
def q_browse_page_random(cat):
    """The whole list in a seeded random order, page 3."""
    return B.browse_page(cat.items, sort="random", seed="7", page=3)


def _last_page(cat, sort: str, **more):
    from marquee.sources.files import artifact_dir
    path = artifact_dir(cat.spark, f"pages-{uuid.uuid4().hex[:12]}")
    total = B.page_index(cat.items, path, sort=sort, **more)
    return B.indexed_page(cat.spark, path, total, max(1, -(-total // 24)))


@register("browse_deep_rating", _sorted_page_sql("rating DESC", _LAST_PAGE))
def q_browse_deep_rating(cat):
    """The last page by rating, read from the page index."""
    return _last_page(cat, "rating")


@register("browse_deep_random", _sorted_page_sql(_RANDOM_ORDER, _LAST_PAGE))
def q_browse_deep_random(cat):
    """The last page of a seeded random order, read from the page index."""
    return _last_page(cat, "random", seed="7")


def _search_sql(q: str, n: int) -> str:
    score = " + ".join(f"CASE WHEN contains(lower({c}), '{q}') THEN {w} ELSE 0 END" for c, w in S.FIELD_WEIGHTS)
    return with_views(f"""
SELECT id, title, score, rk, hits FROM (
  SELECT id, title, score, row_number() OVER (ORDER BY score DESC, ord ASC, id ASC) AS rk,
    count(*) OVER () AS hits
  FROM (SELECT id, title, ord, {score} AS score FROM items) s WHERE score > 0
) t WHERE rk <= {n}
""")


@register("search_items", _search_sql(SEARCH_Q, 30))
def q_search_items(cat):
    """Q1."""
    return S.search_items(cat.items, SEARCH_Q)


@register("search_items_api", _search_sql(API_Q, 20))
def q_search_items_api(cat):
    """Q2."""
    return S.search_items(cat.items, API_Q, S.API_ROWS)


@register("autocomplete", _search_sql(SUGGEST_Q, 8))
def q_autocomplete(cat):
    """Q4."""
    return S.autocomplete(cat.items, SUGGEST_Q)


@register("search_persons", with_views(f"""
SELECT n.name, coalesce(d.avatar_local_path, '') AS avatar, coalesce(d.name_en, '') AS name_en, coalesce(d.profession, '') AS profession,
  coalesce(p.total_movies, 0) AS total_movies, coalesce(p.top_films, '') AS top_films
FROM hit_names n LEFT JOIN persons_by_name d ON d.name = n.name LEFT JOIN (
  SELECT name, total_movies, string_agg(item_id, ',' ORDER BY frk) AS top_films
  FROM (SELECT f.name, f.item_id, count(*) OVER (PARTITION BY f.name) AS total_movies,
          row_number() OVER (PARTITION BY f.name ORDER BY i.rating DESC, i.ord ASC, f.item_id ASC) AS frk
        FROM (SELECT DISTINCT person AS name, item_id FROM credits WHERE person IN (SELECT name FROM hit_names)) f
        JOIN items i ON i.id = f.item_id) r
  WHERE frk <= 6 GROUP BY name, total_movies
) p ON p.name = n.name
""", {"hit_names": f"""
SELECT name FROM persons WHERE contains(lower(coalesce(name, '')), '{PERSON_Q}')
  OR contains(lower(coalesce(name_en, '')), '{PERSON_Q}')
UNION SELECT person AS name FROM credits WHERE contains(lower(person), '{PERSON_Q}')
"""}))
def q_search_persons(cat):
    """Q3."""
    return S.search_persons(cat.items, cat.credits, cat.persons, PERSON_Q)


def title_word_queries(items):
    """Query table for batch search: every distinct lower-cased title word."""
    w = items.select(F.explode(F.split(F.lower("title"), " ")).alias("q")).filter(F.col("q") != "").distinct()
    return w.select(F.col("q").alias("qid"), "q")


_BATCH_SCORE = " + ".join(f"CASE WHEN contains(lower({c}), q.q) THEN {w} ELSE 0 END" for c, w in S.FIELD_WEIGHTS)


@register("batch_search", with_views(f"""
SELECT qid, id, title, score, rk FROM (
  SELECT qid, id, title, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord ASC, id ASC) AS rk
  FROM (SELECT q.qid, i.id, i.title, i.ord, {_BATCH_SCORE} AS score
        FROM (SELECT DISTINCT w AS qid, w AS q FROM (SELECT unnest(string_split(lower(title), ' ')) AS w FROM items) x
              WHERE w <> '') q, items i) s
  WHERE score > 0
) t WHERE rk <= 30
"""))
def q_batch_search(cat):
    """Q5: every title word searched against the whole catalogue."""
    return S.batch_search(cat.items, title_word_queries(cat.items))
