"""Registered profile / viewing-report / ALS / hybrid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import profiles as H
from marquee.operators import viewing as V
from marquee.plans.registry import register
from marquee.plans.sqlviews import rhu, view, with_views
from marquee.session import ensure_checkpoint_dir

# --- SQL views of the profile inputs ----------------------------------------
view("psignals", """
SELECT user_id, 'rating' AS signal, item_id AS key, score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, item_id DESC) AS rk FROM ratings) a
WHERE rk <= 100
UNION ALL
SELECT user_id, 'favorite', item_id, CAST(NULL AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item_id DESC) AS rk FROM favorites) b
WHERE rk <= 100
UNION ALL
SELECT user_id, 'like', item_id, CAST(NULL AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item_id DESC) AS rk FROM likes) c
WHERE rk <= 100
UNION ALL
SELECT user_id, 'browse', item_id, CAST(NULL AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, item_id DESC) AS rk FROM history) d
WHERE rk <= 100
UNION ALL
SELECT user_id, person_type, person_name, CAST(NULL AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, person_type ORDER BY created_at DESC, person_name DESC) AS rk
  FROM liked_persons) e
WHERE rk <= 30
""")

view("pcontrib", """
SELECT user_id, key AS item_id, signal AS kind,
  CAST(CASE WHEN signal = 'rating' THEN CASE WHEN score >= 4 THEN 10000 WHEN score = 3 THEN 5000 ELSE 1000 END
            WHEN signal = 'favorite' THEN 8000 WHEN signal = 'like' THEN 6000 ELSE 2000 END AS BIGINT) AS w
FROM psignals WHERE signal IN ('rating', 'favorite', 'like', 'browse')
UNION ALL
SELECT s.user_id, c.item_id, s.signal,
  CAST(CASE WHEN s.signal = 'director' THEN CASE WHEN i.rating > 0 THEN i.rating_c * 7 ELSE 3500 END
            ELSE CASE WHEN i.rating > 0 THEN i.rating_c * 5 ELSE 2500 END END AS BIGINT)
FROM psignals s
JOIN (SELECT DISTINCT person, role, item_id, ord FROM credits) c ON c.person = s.key AND c.role = s.signal
JOIN items_by_id i ON i.id = c.item_id
WHERE s.signal IN ('director', 'actor')
""")

view("pweights", """
SELECT user_id, item_id, CAST(sum(w) AS BIGINT) AS w_raw,
  CAST(sum(w) AS BIGINT) / max(CAST(sum(w) AS BIGINT)) OVER (PARTITION BY user_id) AS weight
FROM pcontrib GROUP BY user_id, item_id
""")


def _prof(cat):
    if not hasattr(cat, "_prof"):
        info = H.movie_info(cat.items_by_id)
        sig = H.user_signals(cat.ratings, cat.likes, cat.favorites, cat.history, cat.liked_persons)
        cat._prof = (info, sig)
    return cat._prof


@register("user_signals", with_views("SELECT user_id, signal, key, score FROM psignals"))
def q_user_signals(cat):
    """H1."""
    return _prof(cat)[1]


@register("user_item_weights", with_views("SELECT user_id, item_id, w_raw, weight FROM pweights"))
def q_user_item_weights(cat):
    """H2."""
    return H.normalized_weights(cat.user_weights)


@register("user_genre_prefs", with_views("""
SELECT user_id, genre, CAST(g AS DOUBLE) / CAST(100000 AS DOUBLE) AS weight, rk FROM (
  SELECT user_id, genre, CAST(sum(g) AS BIGINT) AS g,
    row_number() OVER (PARTITION BY user_id ORDER BY sum(g) DESC, genre ASC) AS rk
  FROM (SELECT c.user_id, unnest(i.genres) AS genre,
          c.w * CASE c.kind WHEN 'rating' THEN 10 WHEN 'favorite' THEN 10 WHEN 'like' THEN 10
                            WHEN 'browse' THEN 5 WHEN 'director' THEN 4 ELSE 3 END AS g
        FROM pcontrib c JOIN items_by_id i ON i.id = c.item_id) e
  GROUP BY user_id, genre
) t WHERE rk <= 10
"""))
def q_user_genre_prefs(cat):
    """H3."""
    info, sig = _prof(cat)
    return H.user_genre_prefs(sig, cat.credits_by_id, info)


@register("user_country_prefs", with_views("""
SELECT user_id, country, CAST(g AS DOUBLE) / CAST(100000 AS DOUBLE) AS weight, rk FROM (
  SELECT user_id, country, CAST(sum(g) AS BIGINT) AS g,
    row_number() OVER (PARTITION BY user_id ORDER BY sum(g) DESC, country ASC) AS rk
  FROM (SELECT c.user_id, i.country_raw AS country, c.w * 3 AS g
        FROM pcontrib c JOIN items_by_id i ON i.id = c.item_id
        WHERE c.kind IN ('rating', 'favorite', 'like') AND i.country_raw <> '') e
  GROUP BY user_id, country
) t WHERE rk <= 5
"""))
def q_user_country_prefs(cat):
    """H4."""
    info, sig = _prof(cat)
    return H.user_country_prefs(sig, cat.credits_by_id, info)


view("prow", f"""
SELECT u.id AS user_id, coalesce(p.n_rating, 0) AS n_rating, coalesce(p.n_favorite, 0) AS n_favorite,
  coalesce(p.n_like, 0) AS n_like, coalesce(p.n_browse, 0) AS n_browse, coalesce(p.n_director, 0) AS n_director,
  coalesce(p.n_actor, 0) AS n_actor, coalesce({rhu("p.a", 1)}, 0.0) AS avg_rating,
  coalesce(p.n_rating, 0) + coalesce(p.n_favorite, 0) + coalesce(p.n_like, 0) + coalesce(p.n_browse, 0)
    AS total_interactions
FROM users u LEFT JOIN (
  SELECT user_id, count(*) FILTER (WHERE signal = 'rating') AS n_rating,
    count(*) FILTER (WHERE signal = 'favorite') AS n_favorite, count(*) FILTER (WHERE signal = 'like') AS n_like,
    count(*) FILTER (WHERE signal = 'browse') AS n_browse, count(*) FILTER (WHERE signal = 'director') AS n_director,
    count(*) FILTER (WHERE signal = 'actor') AS n_actor, avg(CASE WHEN signal = 'rating' THEN score END) AS a
  FROM psignals GROUP BY user_id
) p ON p.user_id = u.id
""")

PROFILE_ROW_SQL = with_views("SELECT * FROM prow")


@register("user_profile_row", PROFILE_ROW_SQL)
def q_user_profile_row(cat):
    """H5."""
    info, sig = _prof(cat)
    return H.user_profile_row(cat.users, sig)


@register("profile_decades", with_views("""
SELECT user_id, CAST(d AS VARCHAR) || 's' AS decade, n, rk FROM (
  SELECT w.user_id, CAST(floor(i.year / 10) * 10 AS INTEGER) AS d, count(*) AS n,
    row_number() OVER (PARTITION BY w.user_id ORDER BY count(*) DESC, CAST(floor(i.year / 10) * 10 AS INTEGER) ASC) AS rk
  FROM pweights w JOIN items_by_id i ON i.id = w.item_id WHERE i.year IS NOT NULL
  GROUP BY w.user_id, CAST(floor(i.year / 10) * 10 AS INTEGER)
) t WHERE rk <= 5
"""))
def q_profile_decades(cat):
    """Top decades of every user's preferred films."""
    info, sig = _prof(cat)
    return H.profile_decades(H.normalized_weights(cat.user_weights), info)


@register("cold_users", with_views("""
SELECT u.id AS user_id FROM users u
WHERE coalesce((SELECT count(*) FROM psignals s WHERE s.user_id = u.id
                AND s.signal IN ('rating', 'favorite', 'like', 'browse')), 0) = 0
"""))
def q_cold_users(cat):
    """Users served the cold-start list."""
    info, sig = _prof(cat)
    return H.cold_users(cat.users, H.user_profile_row(cat.users, sig))


@register("cold_start", with_views("""
SELECT item_id, title, rating, score, rk FROM (
  SELECT id AS item_id, title, rating, rating / 10.0 AS score,
    row_number() OVER (ORDER BY rating / 10.0 DESC, id ASC) AS rk
  FROM items_by_id WHERE rating >= 7.0
) t WHERE rk <= 24
"""))
def q_cold_start(cat):
    """H11 (catalogue variant: rated >= 7 by rating)."""
    info, sig = _prof(cat)
    return H.cold_start(cat.items, info, None)


# --- channels and fusion for a table of requesting users ---------------------
def requests(cat):
    """The users that ask for recommendations: all administrators."""
    return cat.users.filter(F.col("role") == "admin").select(F.col("id").alias("user_id"))


def _user_weights(cat):
    """Film weights of the requesting users, written once: loops and lists start from them."""
    if not hasattr(cat, "_request_weights"):
        ensure_checkpoint_dir(cat.spark)
        w = H.normalized_weights(cat.user_weights.join(requests(cat), "user_id", "left_semi"))
        cat._request_weights = w.checkpoint()
    return cat._request_weights


def _user_prefs(cat):
    if not hasattr(cat, "_request_prefs"):
        ensure_checkpoint_dir(cat.spark)
        info, sig = _prof(cat)
        cat._request_prefs = H.user_genre_prefs(sig.join(requests(cat), "user_id", "left_semi"), cat.credits_by_id, info).checkpoint()
    return cat._request_prefs


view("padmin", "SELECT id AS user_id FROM users WHERE role = 'admin'")


@register("channel_genre", with_views(f"""
SELECT p.user_id, i.id AS item_id, {rhu("sum(p.gw) / greatest(1, len(i.genres))", 9)} AS s
FROM (SELECT user_id, genre, weight / max(weight) OVER (PARTITION BY user_id) AS gw FROM (
        SELECT user_id, genre, CAST(g AS DOUBLE) / CAST(100000 AS DOUBLE) AS weight FROM (
          SELECT user_id, genre, CAST(sum(g) AS BIGINT) AS g,
            row_number() OVER (PARTITION BY user_id ORDER BY sum(g) DESC, genre ASC) AS rk
          FROM (SELECT c.user_id, unnest(i.genres) AS genre,
                  c.w * CASE c.kind WHEN 'rating' THEN 10 WHEN 'favorite' THEN 10 WHEN 'like' THEN 10
                                    WHEN 'browse' THEN 5 WHEN 'director' THEN 4 ELSE 3 END AS g
                FROM pcontrib c JOIN items_by_id i ON i.id = c.item_id
                WHERE c.user_id IN (SELECT user_id FROM padmin)) e
          GROUP BY user_id, genre) t WHERE rk <= 10) q) p
JOIN (SELECT id, genres, unnest(genres) AS genre FROM items_by_id) i ON i.genre = p.genre
GROUP BY p.user_id, i.id, i.genres HAVING sum(p.gw) > 0
"""))
def q_channel_genre(cat):
    """H9 for the requesting users: every film with a score."""
    return H.channel_genre(_user_prefs(cat), H.movie_info(cat.items_by_id)).select(
        "user_id", "item_id", H.round_half_up("s", 9).alias("s"))


@register("channel_content", with_views(f"""
SELECT user_id, item_id, {rhu("s / max(s) OVER (PARTITION BY user_id)", 6)} AS s FROM (
  SELECT p.user_id, d.id AS item_id, sum(n.sim * p.weight) AS s
  FROM pcseeds p
  JOIN (SELECT id, max(doc) AS doc FROM cdocs GROUP BY id) l ON l.id = p.seed
  JOIN (SELECT a.doc AS target, b.doc, sum(a.w * b.w) AS sim
        FROM cvec a JOIN cvec b ON b.term = a.term
        WHERE a.doc IN (SELECT max(x.doc) FROM cdocs x JOIN pcseeds q ON q.seed = x.id GROUP BY x.id)
        GROUP BY a.doc, b.doc HAVING sum(a.w * b.w) > 0.15) n ON n.target = l.doc
  JOIN cdocs d ON d.doc = n.doc
  GROUP BY p.user_id, d.id) t
""", {"pcseeds": """
SELECT user_id, item_id AS seed, weight FROM (
  SELECT user_id, item_id, weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, item_id ASC) AS rk
  FROM pweights WHERE user_id IN (SELECT user_id FROM padmin)) x WHERE rk <= 10
"""}))
def q_channel_content(cat):
    """H8 for the requesting users: every film with a score."""
    return H.channel_content(_user_weights(cat), cat.items, cat.tfidf).select("user_id", "item_id", H.round_half_up("s", 6).alias("s"))


@register("als_model_info")
def q_als_model_info(cat):
    """Train ALS and report the model (RMSE on the 20 % hold-out)."""
    from marquee.operators import als as AL
    model, rmse, ntr, nte = cat.als
    return AL.model_info(model, rmse, ntr, nte)


@register("als_similar_items")
def q_als_similar_items(cat):
    """C7 for the best rated film."""
    from marquee.operators import als as AL
    from marquee.operators import graph as G
    return AL.als_similar_items(cat.item_factors, G.seed_film(cat.items), cat.items_by_id)


@register("als_recommend_users")
def q_als_recommend_users(cat):
    """Top 12 films of every user by predicted score."""
    from marquee.operators import als as AL
    return AL.als_recommend_users(cat.als[0])


@register("channel_als")
def q_channel_als(cat):
    """H6 for the requesting users: every film with a score."""
    from marquee.operators import als as AL
    return H.channel_als(_user_weights(cat), cat.item_factors)


@register("recommend_all")
def q_recommend_all(cat):
    """Content and ALS lists of the best rated film."""
    from marquee.operators import als as AL
    from marquee.operators import content as CT
    from marquee.operators import graph as G
    seeds = G.seed_film(cat.items)
    c = CT.content_recommend(cat.items, cat.items_by_id, seeds, 12, vec=cat.tfidf)
    a = AL.als_similar_items(cat.item_factors, seeds, cat.items_by_id)
    return AL.recommend_all(c, a)


@register("similar_for_movie")
def q_similar_for_movie(cat):
    """ALS sims > 0.15 and 0.8 x PPR top 10 of the best rated film,
    best score per film, top 12."""
    from marquee.operators import als as AL
    from marquee.operators import graph as G
    from marquee.plans.q_graph import _graph
    seeds = G.seed_film(cat.items)
    nodes, edges = _graph(cat)
    return H.similar_for_movie(AL.factor_cosine(cat.item_factors, seeds, min_sim=H.SIMILAR_MIN),
                               G.ppr_recommend(cat.items_by_id, G.personalized_pagerank(nodes, edges, seeds), 10), cat.items_by_id)


def _graph_channel(cat):
    if not hasattr(cat, "_graph_channel"):
        from marquee.plans.q_graph import _graph
        nodes, edges = _graph(cat)
        cat._graph_channel = H.channel_graph(_user_weights(cat), _user_prefs(cat), cat.items, cat.items_by_id, nodes, edges,
                                             cat.pagerank).checkpoint()
    return cat._graph_channel


@register("channel_graph")
def q_channel_graph(cat):
    """H7 for the requesting users."""
    return _graph_channel(cat)


@register("hybrid_recommend")
def q_hybrid_recommend(cat):
    """The four-channel recommendation of the requesting users."""
    from marquee.operators import als as AL
    from marquee.operators import recommend as R
    src = R.sources(cat.items, cat.items_by_id, cat.item_factors, cat.tfidf)
    return R.hybrid_for_users(src, _user_weights(cat), _user_prefs(cat), _graph_channel(cat))


# --- viewing report (all users) ---------------------------------------------
def _report(cat):
    if not hasattr(cat, "_report"):
        r, f, lk, h, lp, rv = V.report_inputs(cat.ratings, cat.likes, cat.favorites, cat.history,
                                              cat.liked_persons, cat.reviews)
        cat._report = (cat.report_weights, r, f, lk, h, lp, rv)
    return cat._report


view("vin_r", """SELECT user_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY updated_at DESC, item_id DESC) AS rk FROM ratings) x WHERE rk <= 500""")
view("vin_f", """SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, item_id DESC) AS rk FROM favorites) x WHERE rk <= 500""")
view("vin_l", """SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, item_id DESC) AS rk FROM likes) x WHERE rk <= 500""")
view("vin_h", """SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY viewed_at DESC, item_id DESC) AS rk FROM history) x WHERE rk <= 500""")
view("vin_p", """SELECT user_id, person_name, person_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id,
  person_type ORDER BY created_at DESC, person_name DESC) AS rk FROM liked_persons) x WHERE rk <= 50""")
view("vin_v", """SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, id DESC) AS rk FROM reviews) x WHERE rk <= 500""")
view("vweights", """
SELECT user_id, item_id, CAST(sum(w) AS BIGINT) AS w_c FROM (
  SELECT user_id, item_id, CASE WHEN score >= 4 THEN 100 WHEN score >= 2 THEN 50 ELSE 30 END AS w FROM vin_r
  UNION ALL SELECT user_id, item_id, 120 FROM vin_f
  UNION ALL SELECT user_id, item_id, 80 FROM vin_l
  UNION ALL SELECT h.user_id, h.item_id, 15 FROM vin_h h
    WHERE NOT EXISTS (SELECT 1 FROM vin_r r WHERE r.user_id = h.user_id AND r.item_id = h.item_id)
      AND NOT EXISTS (SELECT 1 FROM vin_f r WHERE r.user_id = h.user_id AND r.item_id = h.item_id)
      AND NOT EXISTS (SELECT 1 FROM vin_l r WHERE r.user_id = h.user_id AND r.item_id = h.item_id)
  UNION ALL SELECT user_id, id, 60 FROM (
    SELECT DISTINCT p.user_id, i.id, i.ord FROM vin_p p
    JOIN (SELECT id, ord, unnest(list_distinct(directors)) AS name FROM items) i ON i.name = p.person_name
    WHERE p.person_type = 'director') d
  UNION ALL SELECT user_id, id, 40 FROM (
    SELECT DISTINCT p.user_id, i.id, i.ord FROM vin_p p
    JOIN (SELECT id, ord, unnest(list_distinct(all_actors)) AS name FROM items) i ON i.name = p.person_name
    WHERE p.person_type = 'actor') a
) u GROUP BY user_id, item_id
""")

view("vrec", """
SELECT w.user_id, w.item_id, w.w_c, i.ord, i.genres, i.country_raw, i.year, i.directors, i.all_actors
FROM vweights w JOIN items i ON i.id = w.item_id
""")


@register("report_item_weights", with_views("SELECT user_id, item_id, w_c FROM vweights"))
def q_report_item_weights(cat):
    """V1."""
    _, r, f, lk, h, lp, _ = _report(cat)
    return V.report_item_weights(cat.items, r, f, lk, h, lp)


@register("report_overview", with_views(f"""
SELECT u.id AS user_id, coalesce(r.n, 0) AS total_ratings, coalesce(v.n, 0) AS total_reviews,
  coalesce(l.n, 0) AS total_likes, coalesce(f.n, 0) AS total_favorites, coalesce(h.n, 0) AS total_history,
  coalesce(pd.n, 0) AS total_liked_directors, coalesce(pa.n, 0) AS total_liked_actors,
  coalesce(ud.n, 0) AS unique_directors, coalesce(ua.n, 0) AS unique_actors,
  coalesce({rhu("r.a", 1)}, 0.0) AS avg_user_rating
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n, avg(score) AS a FROM vin_r GROUP BY user_id) r ON r.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM vin_v GROUP BY user_id) v ON v.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM vin_l GROUP BY user_id) l ON l.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM vin_f GROUP BY user_id) f ON f.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM vin_h GROUP BY user_id) h ON h.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM vin_p WHERE person_type = 'director' GROUP BY user_id) pd ON pd.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM vin_p WHERE person_type = 'actor' GROUP BY user_id) pa ON pa.user_id = u.id
LEFT JOIN (SELECT user_id, count(DISTINCT n) AS n FROM (SELECT user_id, unnest(directors) AS n FROM vrec) x
           GROUP BY user_id) ud ON ud.user_id = u.id
LEFT JOIN (SELECT user_id, count(DISTINCT n) AS n FROM (SELECT user_id, unnest(all_actors) AS n FROM vrec) x
           GROUP BY user_id) ua ON ua.user_id = u.id
"""))
def q_report_overview(cat):
    """V2."""
    w, r, f, lk, h, lp, rv = _report(cat)
    return V.report_overview(cat.users, cat.items, w, r, f, lk, h, lp, rv)


@register("report_rating_dist", with_views("""
SELECT b.user_id, b.score, coalesce(c.n, 0) AS n
FROM (SELECT id AS user_id, CAST(unnest(generate_series(1, 10)) AS INTEGER) AS score FROM users) b
LEFT JOIN (SELECT user_id, score, count(*) AS n FROM vin_r GROUP BY user_id, score) c
  ON c.user_id = b.user_id AND c.score = b.score
"""))
def q_report_rating_dist(cat):
    """V3."""
    w, r, *_ = _report(cat)
    return V.report_rating_dist(cat.users, r)


def _wtop_sql(expr: str, key: str, where: str = "") -> str:
    return with_views(f"""
SELECT user_id, {key}, CAST(w AS DOUBLE) / 100.0 AS weight, rk FROM (
  SELECT user_id, {key}, CAST(sum(w_c) AS BIGINT) AS w,
    row_number() OVER (PARTITION BY user_id ORDER BY sum(w_c) DESC, {key} ASC) AS rk
  FROM (SELECT user_id, w_c, {expr} AS {key} FROM vrec {where}) e GROUP BY user_id, {key}
) t WHERE rk <= 10
""")


@register("report_genres", _wtop_sql("unnest(genres)", "genre"))
def q_report_genres(cat):
    """V4."""
    return V.report_genres(cat.items, _report(cat)[0])


@register("report_countries", _wtop_sql("country_raw", "country", "WHERE country_raw <> ''"))
def q_report_countries(cat):
    """V7."""
    return V.report_countries(cat.items, _report(cat)[0])


@register("report_decades", with_views(f"""
SELECT user_id, CAST(d AS VARCHAR) || 's' AS decade, CAST(sum(w_c) AS DOUBLE) / 100.0 AS weight,
  coalesce({rhu("avg(score)", 1)}, 0.0) AS avg_score
FROM (SELECT v.user_id, CAST(floor(v.year / 10) * 10 AS INTEGER) AS d, v.w_c, r.score
      FROM vrec v LEFT JOIN vin_r r ON r.user_id = v.user_id AND r.item_id = v.item_id
      WHERE v.year IS NOT NULL AND v.year <> 0) x
GROUP BY user_id, d
"""))
def q_report_decades(cat):
    """V5."""
    w, r, *_ = _report(cat)
    return V.report_decades(cat.items, w, r)


def _people_sql(col: str, role: str) -> str:
    return with_views(f"""
SELECT user_id, name, {rhu("w_c / 100.0", 1)} AS weight, liked, rk FROM (
  SELECT g.user_id, g.name, g.w_c, coalesce(l.liked, 0) AS liked,
    row_number() OVER (PARTITION BY g.user_id ORDER BY coalesce(l.liked, 0) DESC, g.w_c DESC, g.name ASC) AS rk
  FROM (SELECT user_id, name, CAST(sum(w_c) AS BIGINT) AS w_c,
          row_number() OVER (PARTITION BY user_id ORDER BY sum(w_c) DESC, name ASC) AS prk
        FROM (SELECT user_id, w_c, unnest({col}) AS name FROM vrec) e GROUP BY user_id, name) g
  LEFT JOIN (SELECT user_id, person_name AS name, 1 AS liked FROM vin_p WHERE person_type = '{role}') l
    ON l.user_id = g.user_id AND l.name = g.name
  WHERE l.liked = 1 OR g.prk <= 30
) t WHERE rk <= 10
""")


@register("report_directors", _people_sql("directors", "director"))
def q_report_directors(cat):
    """V6 (directors)."""
    w, r, f, lk, h, lp, rv = _report(cat)
    return V.report_people(cat.items, w, lp, "director")


@register("report_actors", _people_sql("all_actors", "actor"))
def q_report_actors(cat):
    """V6 (actors)."""
    w, r, f, lk, h, lp, rv = _report(cat)
    return V.report_people(cat.items, w, lp, "actor")


@register("report_top_rated", with_views("""
SELECT user_id, item_id, score, rk FROM (
  SELECT v.user_id, v.item_id, r.score,
    row_number() OVER (PARTITION BY v.user_id ORDER BY r.score DESC, v.ord ASC) AS rk
  FROM vrec v JOIN vin_r r ON r.user_id = v.user_id AND r.item_id = v.item_id WHERE r.score > 0
) t WHERE rk <= 10
"""))
def q_report_top_rated(cat):
    """V8."""
    w, r, *_ = _report(cat)
    return V.report_top_rated(cat.items, w, r)


@register("content_recommend")
def q_content_recommend(cat):
    """C5 for the best rated film."""
    from marquee.operators import content as CT
    from marquee.operators import graph as G
    return CT.content_recommend(cat.items, cat.items_by_id, G.seed_film(cat.items), vec=cat.tfidf)


@register("content_similarity")
def q_content_similarity(cat):
    """C4 for all films (rows > 0.15 plus the top 12 of each)."""
    from marquee.operators import content as CT
    return CT.content_similarity(cat.items, vec=cat.tfidf)


@register("tfidf_vocabulary")
def q_tfidf_vocabulary(cat):
    """The TF-IDF vocabulary (terms with df >= 2, top 3000 by count)."""
    from marquee.operators import content as CT
    tf = CT.char_wb_ngrams(CT.content_text(cat.items))
    return CT.vocabulary(tf)


@register("preferred_by_person", with_views("""
SELECT s.user_id, c.item_id, s.signal AS role, count(*) AS n_persons
FROM psignals s
JOIN (SELECT DISTINCT person, role, item_id, ord FROM credits) c ON c.person = s.key AND c.role = s.signal
WHERE s.signal IN ('director', 'actor')
GROUP BY s.user_id, c.item_id, s.signal
"""))
def q_preferred_by_person(cat):
    """Films reached through each user's liked directors / actors (number
    of liked persons per film and role)."""
    info, sig = _prof(cat)
    p = sig.filter(F.col("signal").isin("director", "actor"))
    cr = cat.credits.select(F.col("person").alias("key"), F.col("role").alias("signal"), "item_id", "ord").distinct()
    return (p.join(cr, ["key", "signal"]).groupBy("user_id", "item_id", F.col("signal").alias("role"))
            .agg(F.count(F.lit(1)).alias("n_persons")))
