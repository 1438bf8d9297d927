"""Registered activity-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import activity as A
from marquee.plans import q_content, q_graph  # noqa: F401  (views)
from marquee.plans.registry import register
from marquee.plans.sqlviews import rhu, view, with_views


@register("ratings_current", with_views("SELECT user_id, item_id, score, created_at, updated_at FROM ratings"))
def q_ratings_current(cat):
    """U1 (+U7 tombstones): current rating per (user, film)."""
    return A.ratings_current(cat.activity)


def _log_part(entity, op, record, ts, src, k1, k2="0", user="NULL", review="NULL", actor="NULL", value="NULL", source=""):
    return f"""
SELECT '{entity}' AS entity, '{op}' AS op, CAST({record} AS VARCHAR) AS record, CAST({user} AS BIGINT) AS user_id,
  CAST({review} AS BIGINT) AS review_id, CAST({actor} AS BIGINT) AS actor, CAST({value} AS VARCHAR) AS value,
  {{'ts': CAST({ts} AS TIMESTAMP), 'src': CAST({src} AS INTEGER), 'k1': CAST({k1} AS BIGINT), 'k2': CAST({k2} AS BIGINT)}} AS o
FROM {source}"""


_K = """regexp_extract(e.props, '"k": ([0-9]+)', 1)"""
_FILM = "a.user_id || ':' || a.item_id"
view("alog", "\nUNION ALL".join([
    _log_part("user", "put", "u.id", "'1970-01-01'", -1, 0, user="u.id", value="u.username", source="users u"),
    _log_part("user", "put", "e.user_id", "e.ts", 1, "e.event_id", user="e.user_id", value="u.username",
              source="events e JOIN users u ON u.id = e.user_id WHERE e.event_type = 'signup'"),
    _log_part("user", "delete", _K, "e.ts", 1, "e.event_id", actor="e.user_id",
              source=f"events e WHERE e.event_type = 'signup' AND {_K} <> ''"),
    *[_log_part(entity, op, _FILM, "a.ts", "a.src", "a.k1", "a.k2", user="a.user_id", value="a.score",
                source=f"activity a WHERE a.kind = '{kind}'")
      for kind, entity, op in (("rate", "rating", "put"), ("like", "like", "toggle"), ("favorite", "favorite", "toggle"), ("view", "history", "put"))],
    *[_log_part(entity, "delete", _FILM, "a.ts", "a.src", "a.k1", "a.k2", actor="a.user_id", source="activity a WHERE a.kind = 'unrate'")
      for entity in ("rating", "history")],
    _log_part("review", "put", "r.id", "r.created_at", 2, "r.id", user="r.user_id", value="r.movie_id", source="reviews r"),
    _log_part("reply", "put", "p.id", "p.created_at", 2, "p.id", user="p.user_id", review="p.review_id", source="review_replies p"),
    _log_part("review", "delete", "r.id", "a.ts", 1, "a.k1", actor="a.user_id",
              source="reviews r JOIN activity a ON a.kind = 'unrate' AND a.item_id = r.movie_id"),
    _log_part("reply", "delete", "p.id", "a.ts", 1, "a.k1", actor="a.user_id",
              source="review_replies p JOIN reviews r ON r.id = p.review_id JOIN activity a ON a.kind = 'unrate' AND a.item_id = r.movie_id"),
    _log_part("review_like", "toggle", "l.user_id || ':' || l.review_id", "l.ts", 2, "l.seq", user="l.user_id", review="l.review_id",
              source="review_like_log l"),
    _log_part("liked_person", "toggle", "l.user_id || ':' || l.person_name", "l.ts", 3, "l.seq", user="l.user_id", value="l.person_type",
              source="person_like_log l"),
]))
_ADMIN = "d.actor IN (SELECT id FROM users WHERE role = 'admin')"
_DELETE_RULES = {"user": f"{_ADMIN} AND CAST(d.actor AS VARCHAR) <> d.record", "rating": "d.actor = w.owner", "history": "d.actor = w.owner",
                 "review": f"(d.actor = w.owner OR {_ADMIN})", "reply": "d.actor = w.owner"}
_CHILDREN = {"user": (), "rating": ("user",), "review": ("user",), "like": ("user",), "favorite": ("user",), "history": ("user",),
             "liked_person": ("user",), "review_like": ("user", "review"), "reply": ("user", "review")}
for _e, _parents in _CHILDREN.items():
    _joins = "".join(f" JOIN alive_{p} l{p} ON l{p}.record = CAST(a.{p}_id AS VARCHAR) AND a.o > l{p}.since" for p in _parents)
    view(f"offered_{_e}", f"SELECT a.* FROM alog a{_joins} WHERE a.entity = '{_e}' AND a.op <> 'delete'")
    if _e in _DELETE_RULES:
        view(f"living_{_e}", f"""
SELECT a.* FROM offered_{_e} a LEFT JOIN (
  SELECT d.record, max(d.o) AS death FROM alog d
  JOIN (SELECT record, arg_min(user_id, o) AS owner FROM offered_{_e} GROUP BY record) w ON w.record = d.record
  WHERE d.entity = '{_e}' AND d.op = 'delete' AND {_DELETE_RULES[_e]} GROUP BY d.record) x ON x.record = a.record
WHERE x.death IS NULL OR a.o > x.death""")
    else:
        view(f"living_{_e}", f"SELECT * FROM offered_{_e}")
    view(f"alive_{_e}", f"SELECT record, min(o) AS since FROM living_{_e} GROUP BY record")
APPLY_DELETES = with_views("UNION ALL".join(f"""
SELECT entity, record, arg_max(user_id, o) AS user_id, arg_max(review_id, o) AS review_id, arg_max(value, o) AS value,
  (min(o)).ts AS since, (max(o)).ts AS last
FROM living_{e} GROUP BY entity, record{" HAVING count(*) % 2 = 1" if e in ("like", "favorite", "liked_person", "review_like") else ""}
""" for e in _CHILDREN))


def _admins(cat):
    return cat.users.filter(F.col("role") == "admin").select(F.col("id").alias("actor"))


@register("apply_deletes", APPLY_DELETES)
def q_apply_deletes(cat):
    """The living records of all nine tables after every insertion and
    deletion of the log: owners and admins delete, children go with their parents."""
    from marquee.operators import deletes as D
    return D.surviving(cat.application_log, _admins(cat))


@register("likes_current", with_views("SELECT user_id, item_id, created_at FROM likes"))
def q_likes_current(cat):
    """U2."""
    return A.toggles_current(cat.activity, "like")


@register("favorites_current", with_views("SELECT user_id, item_id, created_at FROM favorites"))
def q_favorites_current(cat):
    """U3."""
    return A.toggles_current(cat.activity, "favorite")


@register("person_likes_current", with_views(
    "SELECT user_id, person_name, person_type, created_at FROM liked_persons"))
def q_person_likes_current(cat):
    """U4."""
    return A.person_likes_current(cat.person_like_log)


@register("review_likes_current", with_views("SELECT user_id, review_id, created_at FROM review_likes"))
def q_review_likes_current(cat):
    """U5."""
    return cat.review_likes


@register("history_current", with_views("SELECT user_id, item_id, viewed_at FROM history"))
def q_history_current(cat):
    """U6."""
    return A.history_current(cat.activity)


_CASCADE = {"rating": ("ratings", "t.user_id || ':' || t.item_id", ("user_id",)), "like": ("likes", "t.user_id || ':' || t.item_id", ("user_id",)),
            "favorite": ("favorites", "t.user_id || ':' || t.item_id", ("user_id",)),
            "history": ("history", "t.user_id || ':' || t.item_id", ("user_id",)),
            "liked_person": ("liked_persons", "t.user_id || ':' || t.person_name", ("user_id",)),
            "review": ("reviews", "t.id", ("user_id",)), "review_like": ("review_likes", "t.user_id || ':' || t.review_id", ("user_id", "review_id")),
            "reply": ("review_replies", "t.id", ("user_id", "review_id"))}
_KEPT = {"user_id": "t.user_id IN (SELECT id FROM users WHERE is_active)",
         "review_id": "t.review_id IN (SELECT r.id FROM reviews r WHERE r.user_id IN (SELECT id FROM users WHERE is_active))"}


@register("cascade_deletes", with_views("UNION ALL".join(f"""
SELECT '{e}' AS entity, CAST({record} AS VARCHAR) AS record FROM {table} t WHERE {" AND ".join(_KEPT[k] for k in keys)}
""" for e, (table, record, keys) in _CASCADE.items())))
def q_cascade_deletes(cat):
    """U8: deleting inactive users takes their rows in all eight child tables,
    and a deleted review its likes and replies (parents first)."""
    live = cat.users.filter(F.col("is_active"))
    reviews = A.cascade_deletes(cat.reviews, live, "user_id")
    tables = {"rating": cat.ratings, "like": cat.likes, "favorite": cat.favorites, "history": cat.history,
              "liked_person": cat.liked_persons, "review": cat.reviews, "review_like": cat.review_likes, "reply": cat.review_replies}
    out = None
    for entity, df in tables.items():
        kept = A.cascade_deletes(df, live, "user_id")
        if "review_id" in df.columns:
            kept = A.cascade_deletes(kept, reviews, "review_id")
        key = ["id"] if "id" in df.columns else ["user_id", next(c for c in ("review_id", "item_id", "person_name") if c in df.columns)]
        part = kept.select(F.lit(entity).alias("entity"), F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


@register("users_current", with_views("""
SELECT u.id, coalesce(g.u_email, u.email) AS email, u.username, u.role,
  CASE WHEN coalesce(g.flips, 0) % 2 = 1 THEN NOT u.is_active ELSE u.is_active END AS is_active
FROM users u LEFT JOIN (
  SELECT user_id,
    arg_max(CASE WHEN event_type = 'signup' THEN 'u' || CAST(user_id AS VARCHAR) || '+' || CAST(event_id AS VARCHAR) || '@example.com' END,
            {'ts': ts, 'seq': event_id}) FILTER (WHERE event_type = 'signup') AS u_email,
    count(*) FILTER (WHERE event_type = 'error') AS flips
  FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id
) g ON g.user_id = u.id
"""))
def q_users_current(cat):
    """Partial profile updates and active-flag flips from the event log."""
    upd = A.user_update_log(cat.t.events)
    return A.users_current(cat.users, upd).select("id", "email", "username", "role", "is_active")


_STRIPPED = "length(regexp_replace(coalesce(content, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"


def _twice(entity, table, keys, reason):
    record = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"""
SELECT '{entity}', {record}, '{reason}' FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)}) AS n FROM {table}) WHERE n > 1"""


def _orphan(entity, table, keys, column, parent, reason):
    record = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"""
SELECT '{entity}', {record}, '{reason}' FROM {table} WHERE {column} NOT IN (SELECT id FROM {parent})"""


_UI, _UR, _UP = ("user_id", "item_id"), ("user_id", "review_id"), ("user_id", "person_name")
_LOGGED = {k: f"(SELECT * FROM activity WHERE kind = '{k}')" for k in ("rate", "like", "favorite", "view")}


@register("constraint_violations", with_views(f"""
SELECT 'user' AS entity, CAST(id AS VARCHAR) AS record_id, 'username_too_short' AS reason FROM users WHERE length(coalesce(username, '')) < 2
UNION ALL SELECT 'user', CAST(id AS VARCHAR), 'username_too_long' FROM users WHERE length(username) > 20
UNION ALL SELECT 'user', CAST(id AS VARCHAR), 'username_taken' FROM users u
  WHERE EXISTS (SELECT 1 FROM users o WHERE o.username = u.username AND o.id < u.id)
UNION ALL SELECT 'user', CAST(id AS VARCHAR), 'role_domain' FROM users WHERE coalesce(role, '') NOT IN ('user', 'admin')
UNION ALL SELECT 'rating', CAST(user_id AS VARCHAR) || ':' || item_id, 'score_out_of_range' FROM {_LOGGED["rate"]}
  WHERE score IS NULL OR score NOT BETWEEN 1 AND 10
UNION ALL SELECT 'review', CAST(id AS VARCHAR), 'review_too_short' FROM reviews WHERE {_STRIPPED} < 2
UNION ALL SELECT 'review', CAST(id AS VARCHAR), 'review_too_long' FROM reviews WHERE {_STRIPPED} > 500
UNION ALL SELECT 'reply', CAST(id AS VARCHAR), 'reply_empty' FROM review_replies WHERE {_STRIPPED} < 1
UNION ALL SELECT 'liked_person', CAST(user_id AS VARCHAR) || ':' || person_name, 'person_type_domain'
  FROM person_like_log WHERE coalesce(person_type, '') NOT IN ('director', 'actor')
UNION ALL """ + " UNION ALL ".join([
    _twice("rating", _LOGGED["rate"], _UI, "rated_twice"), _twice("like", _LOGGED["like"], _UI, "liked_twice"),
    _twice("favorite", _LOGGED["favorite"], _UI, "favorited_twice"), _twice("review_like", "review_like_log", _UR, "liked_twice"),
    _twice("liked_person", "person_like_log", _UP, "liked_twice"),
    *[_orphan(e, _LOGGED[k], _UI, "user_id", "users", "unknown_user")
      for e, k in (("rating", "rate"), ("like", "like"), ("favorite", "favorite"), ("history", "view"))],
    _orphan("review", "reviews", ("id",), "user_id", "users", "unknown_user"),
    _orphan("review_like", "review_like_log", _UR, "user_id", "users", "unknown_user"),
    _orphan("review_like", "review_like_log", _UR, "review_id", "reviews", "unknown_review"),
    _orphan("reply", "review_replies", ("id",), "user_id", "users", "unknown_user"),
    _orphan("reply", "review_replies", ("id",), "review_id", "reviews", "unknown_review"),
    _orphan("liked_person", "person_like_log", _UP, "user_id", "users", "unknown_user"),
])))
def q_constraint_violations(cat):
    """Every rule on the tables as logged, so a second rating, like or
    favourite of a film is what the unique keys reject."""
    from marquee.operators import constraints as CN
    of = lambda kind: cat.activity.filter(F.col("kind") == kind)
    return CN.violations({
        "user": cat.users, "rating": of("rate"), "review": cat.reviews, "like": of("like"), "favorite": of("favorite"),
        "history": of("view"), "review_like": cat.review_like_log, "reply": cat.review_replies, "liked_person": cat.person_like_log})


@register("movie_avg_rating", with_views(f"""
SELECT item_id, {rhu("avg(score)", 1)} AS avg_score, count(*) AS n_ratings FROM ratings GROUP BY item_id
"""))
def q_movie_avg_rating(cat):
    """A17."""
    return A.movie_avg_rating(cat.ratings)


@register("user_stats", with_views(f"""
SELECT u.id AS user_id, u.username,
  coalesce(r.rating_count, 0) AS rating_count, coalesce(v.review_count, 0) AS review_count,
  coalesce(l.like_count, 0) AS like_count, coalesce(f.favorite_count, 0) AS favorite_count,
  coalesce({rhu("r.a", 1)}, 0.0) AS avg_score
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS rating_count, avg(score) AS a FROM ratings GROUP BY user_id) r ON r.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS review_count FROM reviews GROUP BY user_id) v ON v.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS like_count FROM likes GROUP BY user_id) l ON l.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS favorite_count FROM favorites GROUP BY user_id) f ON f.user_id = u.id
"""))
def q_user_stats(cat):
    """A18."""
    return A.user_stats(cat.users, cat.ratings, cat.reviews, cat.likes, cat.favorites)


@register("system_totals", with_views(f"""
SELECT count(*) AS total_users, count(*) FILTER (WHERE is_active) AS active_users,
  (SELECT count(*) FROM ratings) AS total_ratings,
  (SELECT coalesce({rhu("avg(score)", 1)}, 0.0) FROM ratings) AS avg_rating,
  (SELECT count(*) FROM reviews) AS total_reviews
FROM users
"""))
def q_system_totals(cat):
    """A19 totals."""
    return A.system_totals(cat.users, cat.ratings, cat.reviews)


@register("newest_users", with_views("""
SELECT id, username, email, role, created_at, is_active,
  row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS rk
FROM users QUALIFY rk <= 5
"""))
def q_newest_users(cat):
    """Five newest users."""
    return A.newest_users(cat.users)


@register("newest_reviews", with_views("""
SELECT r.rk, r.id, r.user_id, u.username, r.movie_id, r.content, r.created_at
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rk FROM reviews QUALIFY rk <= 10) r
LEFT JOIN users u ON u.id = r.user_id
"""))
def q_newest_reviews(cat):
    """Ten newest reviews with author."""
    return A.newest_reviews(cat.reviews, cat.users)


@register("list_users", with_views("SELECT id, username, email, role, created_at, is_active FROM users"))
def q_list_users(cat):
    """All users, newest first (a distributed range sort), no credentials."""
    return cat.users.select("id", "username", "email", "role", "created_at", "is_active").orderBy(
        F.col("created_at").desc_nulls_last(), F.col("id").desc())


@register("review_like_count", with_views(
    "SELECT review_id, count(*) AS like_count FROM review_likes GROUP BY review_id"))
def q_review_like_count(cat):
    """A20."""
    return A.review_like_count(cat.review_likes)


@register("item_like_count", with_views("SELECT item_id, count(*) AS n_likes FROM likes GROUP BY item_id"))
def q_item_like_count(cat):
    """A21 (likes)."""
    return A.item_user_count(cat.likes, "n_likes")


@register("item_fav_count", with_views(
    "SELECT item_id, count(*) AS n_favorites FROM favorites GROUP BY item_id"))
def q_item_fav_count(cat):
    """A21 (favourites)."""
    return A.item_user_count(cat.favorites, "n_favorites")


@register("recent_ratings", with_views("""
SELECT user_id, item_id, score, updated_at,
  row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, item_id DESC) AS rk
FROM ratings QUALIFY rk <= 50
"""))
def q_recent_ratings(cat):
    """K9: newest 50 ratings of every user."""
    return A.recent_by_user(cat.ratings, "updated_at", 50, "item_id").select(
        "user_id", "item_id", "score", "updated_at", "rk")


@register("recent_history", with_views("""
SELECT user_id, item_id, viewed_at,
  row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, item_id DESC) AS rk
FROM history QUALIFY rk <= 50
"""))
def q_recent_history(cat):
    """K9: newest 50 history entries of every user."""
    return A.recent_by_user(cat.history, "viewed_at", 50, "item_id")


def _recent_sql(table: str, cols: str, ts: str, key: str) -> str:
    return with_views(f"""
SELECT {cols}, {ts},
  row_number() OVER (PARTITION BY user_id ORDER BY {ts} DESC, {key} DESC) AS rk
FROM {table} QUALIFY rk <= 50
""")


@register("recent_reviews", _recent_sql("reviews", "user_id, id, movie_id, content", "created_at", "id"))
def q_recent_reviews(cat):
    """K9: newest 50 reviews of every user."""
    return A.recent_by_user(cat.reviews, "created_at", 50, "id")


@register("recent_likes", _recent_sql("likes", "user_id, item_id", "created_at", "item_id"))
def q_recent_likes(cat):
    """K9: newest 50 likes of every user."""
    return A.recent_by_user(cat.likes, "created_at", 50, "item_id")


@register("recent_favorites", _recent_sql("favorites", "user_id, item_id", "created_at", "item_id"))
def q_recent_favorites(cat):
    """K9: newest 50 favourites of every user."""
    return A.recent_by_user(cat.favorites, "created_at", 50, "item_id")


@register("recent_liked_persons", _recent_sql("liked_persons", "user_id, person_name, person_type", "created_at", "person_name"))
def q_recent_liked_persons(cat):
    """K9: newest 50 liked persons of every user."""
    return A.recent_by_user(cat.liked_persons, "created_at", 50, "person_name")


@register("movie_reviews", with_views("""
SELECT r.id, r.user_id, r.movie_id, r.content, r.created_at, r.rk, u.username, u.avatar AS user_avatar
FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY created_at DESC, id DESC) AS rk
      FROM reviews QUALIFY rk <= 20) r
JOIN users u ON u.id = r.user_id
"""))
def q_movie_reviews(cat):
    """Newest 20 reviews per film with author."""
    return A.movie_reviews(cat.reviews, cat.users)


@register("review_replies", with_views("""
SELECT p.id, p.review_id, p.user_id, p.content, p.created_at, u.username
FROM review_replies p JOIN users u ON u.id = p.user_id
"""))
def q_review_replies(cat):
    """Replies with author, oldest first."""
    return A.review_replies_view(cat.review_replies, cat.users)


@register("review_thread", with_views(f"""
SELECT p.movie_id, 'film' AS part, CAST(NULL AS BIGINT) AS review_id, CAST(NULL AS BIGINT) AS reply_id, CAST(NULL AS BIGINT) AS user_id,
  CAST(NULL AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS TIMESTAMP) AS created_at,
  coalesce(s.n, 0) AS number, coalesce(s.a, 0.0) AS score
FROM (SELECT DISTINCT movie_id FROM rtop) p
LEFT JOIN (SELECT item_id, count(*) AS n, {rhu("avg(score)", 1)} AS a FROM ratings GROUP BY item_id) s ON s.item_id = p.movie_id
UNION ALL
SELECT r.movie_id, 'review', r.id, NULL, r.user_id, u.username, r.content, r.created_at,
  (SELECT count(*) FROM review_likes l WHERE l.review_id = r.id), NULL
FROM rtop r JOIN users u ON u.id = r.user_id
UNION ALL
SELECT r.movie_id, 'reply', p.review_id, p.id, p.user_id, u.username, p.content, p.created_at, NULL, NULL
FROM review_replies p JOIN rtop r ON r.id = p.review_id JOIN users u ON u.id = p.user_id
UNION ALL
SELECT r.movie_id, 'liked', l.review_id, NULL, l.user_id, NULL, NULL, NULL, NULL, NULL FROM review_likes l JOIN rtop r ON r.id = l.review_id
UNION ALL
SELECT m.item_id, 'score', NULL, NULL, m.user_id, NULL, NULL, NULL, NULL, CAST(m.score AS DOUBLE)
FROM ratings m WHERE m.item_id IN (SELECT movie_id FROM rtop)
""", {"rtop": "SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY created_at DESC, id DESC) <= 20"}))
def q_review_thread(cat):
    """The threads of all films, line by line."""
    return A.review_thread(cat.reviews, cat.review_replies, cat.review_likes, cat.ratings, cat.users)


@register("enrich_ratings", with_views("""
SELECT r.user_id, r.item_id, r.score, coalesce(i.title, '未知电影') AS title, coalesce(i.cover, '') AS cover,
  coalesce(i.rating, 0.0) AS rating
FROM ratings r LEFT JOIN items_by_id i ON i.id = r.item_id
"""))
def q_enrich_ratings(cat):
    """Ratings with film title / cover / catalogue rating (missing film -> fixed title)."""
    return A.enrich_items(cat.ratings.select("user_id", "item_id", "score"), cat.items_by_id)


@register("enrich_persons", with_views("""
SELECT l.user_id, l.person_name, l.person_type, coalesce(p.avatar_url, '') AS avatar_url,
  coalesce(p.name_en, '') AS name_en, coalesce(p.profession, '') AS profession
FROM liked_persons l LEFT JOIN persons_by_name p ON p.name = l.person_name
"""))
def q_enrich_persons(cat):
    """Liked persons with their directory profile."""
    return A.enrich_persons(cat.liked_persons.select("user_id", "person_name", "person_type"), cat.persons)


@register("user_item_flags", with_views("""
SELECT t.user_id, t.item_id, r.score AS my_score, l.user_id IS NOT NULL AS liked, f.user_id IS NOT NULL AS favorited
FROM (SELECT user_id, item_id FROM ratings UNION SELECT user_id, item_id FROM likes
      UNION SELECT user_id, item_id FROM favorites UNION SELECT user_id, item_id FROM history) t
LEFT JOIN ratings r ON r.user_id = t.user_id AND r.item_id = t.item_id
LEFT JOIN likes l ON l.user_id = t.user_id AND l.item_id = t.item_id
LEFT JOIN favorites f ON f.user_id = t.user_id AND f.item_id = t.item_id
"""))
def q_user_item_flags(cat):
    """J6."""
    return A.user_item_flags(cat.ratings, cat.likes, cat.favorites, cat.history)


@register("profile_page", with_views("""
SELECT r.user_id, r.item_id, r.score, r.rk, coalesce(i.title, '未知电影') AS title, coalesce(i.rating, 0.0) AS rating
FROM (SELECT user_id, item_id, score,
        row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, item_id DESC) AS rk
      FROM ratings QUALIFY rk <= 50) r
LEFT JOIN items_by_id i ON i.id = r.item_id
"""))
def q_profile_page(cat):
    """Every user's newest 50 ratings with film title and catalogue
    rating (K9 through J4; the other lists compose the same way)."""
    recent = A.recent_by_user(cat.ratings, "updated_at", 50, "item_id").select("user_id", "item_id", "score", "rk")
    return A.enrich_items(recent, cat.items_by_id).select("user_id", "item_id", "score", "rk", "title", "rating")


_LISTS = (("rating", "ratings", "item_id", "updated_at", "item_id", "score", "true"),
          ("review", "reviews", "movie_id", "created_at", "id", "NULL", "true"),
          ("like", "likes", "item_id", "created_at", "item_id", "NULL", "true"),
          ("favorite", "favorites", "item_id", "created_at", "item_id", "NULL", "true"),
          ("history", "history", "item_id", "viewed_at", "item_id", "NULL", "true"),
          ("director", "liked_persons", "person_name", "created_at", "person_name", "NULL", "person_type = 'director'"),
          ("actor", "liked_persons", "person_name", "created_at", "person_name", "NULL", "person_type = 'actor'"))


@register("profile_lists", with_views("""
SELECT l.user_id, l.list, l.rk, l.key, l.score,
  CASE WHEN l.list IN ('director', 'actor') THEN '' ELSE coalesce(i.title, '未知电影') END AS title, coalesce(i.rating, 0.0) AS rating,
  coalesce(i.genre_raw, '') AS genre, coalesce(i.poster_local_path, '') AS poster,
  coalesce(d.name_en, '') AS name_en, coalesce(d.profession, '') AS profession, coalesce(d.avatar_local_path, '') AS avatar
FROM (""" + " UNION ALL ".join(f"""
  SELECT user_id, '{name}' AS list, {key} AS key, CAST({score} AS INTEGER) AS score,
    row_number() OVER (PARTITION BY user_id ORDER BY {ts} DESC, {tie} DESC) AS rk
  FROM {table} WHERE {where} QUALIFY rk <= 50""" for name, table, key, ts, tie, score, where in _LISTS) + f"""
) l LEFT JOIN items_by_id i ON i.id = l.key AND l.list NOT IN ('director', 'actor')
LEFT JOIN persons_by_name d ON d.name = l.key AND l.list IN ('director', 'actor')
UNION ALL
SELECT u.id, 'stats', s.rk, s.key, CAST(CASE s.rk WHEN 1 THEN (SELECT count(*) FROM ratings x WHERE x.user_id = u.id)
    WHEN 2 THEN (SELECT count(*) FROM reviews x WHERE x.user_id = u.id) WHEN 3 THEN (SELECT count(*) FROM likes x WHERE x.user_id = u.id)
    ELSE (SELECT count(*) FROM favorites x WHERE x.user_id = u.id) END AS INTEGER), '',
  CASE WHEN s.rk = 1 THEN coalesce((SELECT {rhu("avg(x.score)", 1)} FROM ratings x WHERE x.user_id = u.id), 0.0) ELSE 0.0 END, '', '', '', '', ''
FROM users u, (VALUES (1, 'rating_count'), (2, 'review_count'), (3, 'like_count'), (4, 'favorite_count')) s(rk, key)
"""))
def q_profile_lists(cat):
    """Every user's page in long form: seven lists of the newest 50 with films and profiles, and the statistics."""
    return A.profile_lists(cat.users, cat.ratings, cat.reviews, cat.likes, cat.favorites, cat.history, cat.liked_persons, cat.items_by_id,
                           cat.persons)


view("visit", "SELECT h.user_id, h.item_id, h.viewed_at AS ts FROM history h JOIN users u ON u.id = h.user_id AND u.role = 'admin'"
              " JOIN items_by_id i ON i.id = h.item_id")


@register("item_detail", with_views(f"""
SELECT v.user_id, v.item_id, 'card' AS part, 0 AS rk, '' AS key, i.title AS text, i.rating AS score, CAST(NULL AS BIGINT) AS number
FROM visit v JOIN items_by_id i ON i.id = v.item_id
UNION ALL
SELECT v.user_id, v.item_id, 'stats', 0, '', '', coalesce(s.a, 0.0), coalesce(s.n, 0)
FROM visit v LEFT JOIN (SELECT item_id, count(*) AS n, {rhu("avg(score)", 1)} AS a FROM ratings GROUP BY item_id) s ON s.item_id = v.item_id
UNION ALL
SELECT v.user_id, v.item_id, 'flags', 0, '', '', CAST(r.score AS DOUBLE),
  CASE WHEN l.user_id IS NULL THEN 0 ELSE 1 END + CASE WHEN f.user_id IS NULL THEN 0 ELSE 2 END
FROM visit v LEFT JOIN ratings r ON r.user_id = v.user_id AND r.item_id = v.item_id
LEFT JOIN likes l ON l.user_id = v.user_id AND l.item_id = v.item_id LEFT JOIN favorites f ON f.user_id = v.user_id AND f.item_id = v.item_id
UNION ALL
SELECT v.user_id, v.item_id, 'review', r.rk, CAST(r.id AS VARCHAR), u.username, NULL, NULL
FROM visit v JOIN (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY created_at DESC, id DESC) AS rk FROM reviews) r
  ON r.movie_id = v.item_id AND r.rk <= 20 JOIN users u ON u.id = r.user_id
UNION ALL
SELECT v.user_id, v.item_id, 'similar', n.rk, n.id, i.title, {rhu("n.sim", 3)}, NULL
FROM visit v JOIN (
  SELECT t.id AS seed, d.id, s.sim, row_number() OVER (PARTITION BY t.id ORDER BY {rhu("s.sim", 9)} DESC, s.doc ASC) AS rk
  FROM (SELECT id, max(doc) AS doc FROM cdocs WHERE id IN (SELECT item_id FROM visit) GROUP BY id) t
  JOIN (SELECT a.doc AS target, b.doc, sum(a.w * b.w) AS sim FROM cvec a JOIN cvec b ON b.term = a.term
        WHERE a.doc IN (SELECT max(doc) FROM cdocs WHERE id IN (SELECT item_id FROM visit) GROUP BY id) GROUP BY a.doc, b.doc) s ON s.target = t.doc
  JOIN cdocs d ON d.doc = s.doc WHERE d.id <> t.id QUALIFY rk <= 6) n ON n.seed = v.item_id
JOIN items_by_id i ON i.id = n.id
UNION ALL
SELECT v.user_id, v.item_id, 'view', 0, strftime(v.ts, '%Y-%m-%d %H:%M:%S.%f'), '', NULL, NULL FROM visit v
"""))
def q_item_detail(cat):
    """The film pages that administrators have visited, line by line."""
    from marquee.operators import content as CT
    admins = cat.users.filter(F.col("role") == "admin").select(F.col("id").alias("user_id"))
    requests = cat.history.join(admins, "user_id", "left_semi").select("user_id", "item_id", F.col("viewed_at").alias("ts"))
    seeds = requests.select(F.col("item_id").alias("seed")).distinct()
    return A.item_details(requests, cat.items_by_id, cat.ratings, cat.likes, cat.favorites, cat.reviews, cat.users,
                          CT.content_recommend(cat.items, cat.items_by_id, seeds, vec=cat.tfidf))
