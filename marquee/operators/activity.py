"""Activity logs -> current state, and the reports / joins over that state.

The catalogue's web application edited one row per request (upserts,
toggles, deletes). Here the same rules are reductions of append-only logs,
each a single hash aggregate on the entity key (map-side partial aggregation,
one exchange), so they also run unchanged as Structured Streaming updates.

Log order: every log carries a total order. For ``activity`` it is the
struct ``(ts, src, k1, k2)``; ties on ``ts`` (second resolution) are common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.agg import round_half_up, top_k

UNKNOWN_TITLE = "未知电影"  # fixed: title shown for films missing from the catalogue


def order_key(df: DataFrame) -> "F.Column":
    return F.struct(*[F.col(c) for c in ("ts", "src", "k1", "k2")])


# ---------------------------------------------------------------------------
# Log reductions
# ---------------------------------------------------------------------------
def apply_tombstones(log: DataFrame, keys: list[str], live_kind: str, delete_kind: str) -> DataFrame:
    """Keep the ``live_kind`` rows that come after the last
    ``delete_kind`` row of their key (a delete then re-insert restarts the
    entity). Tombstones are aggregated first (one row per deleted key) and
    joined back on the key."""
    o = order_key(log)
    live = log.filter(F.col("kind") == live_kind).withColumn("_o", o)
    dels = (log.filter(F.col("kind") == delete_kind).groupBy(*keys)
            .agg(F.max(o).alias("_last_del")))
    j = live.join(dels, keys, "left")
    return j.filter(F.col("_last_del").isNull() | (F.col("_o") > F.col("_last_del"))).drop("_last_del")


def ratings_current(log: DataFrame, delete_kind: str = "unrate") -> DataFrame:
    """Upsert on (user, film); score and updated_at from the last write,
    created_at from the first write after the last delete."""
    rows = apply_tombstones(log, ["user_id", "item_id"], "rate", delete_kind)
    return (rows.groupBy("user_id", "item_id")
            .agg(F.max_by("score", "_o").alias("score"),
                 F.min("ts").alias("created_at"),
                 F.max("ts").alias("updated_at")))


def toggles_current(log: DataFrame, kind: str, keys=("user_id", "item_id")) -> DataFrame:
    """An odd number of toggles means on; created_at = last toggle."""
    keys = list(keys)
    g = (log.filter(F.col("kind") == kind).groupBy(*keys)
         .agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("created_at")))
    return g.filter(F.col("_n") % 2 == 1).drop("_n")


def person_likes_current(log: DataFrame) -> DataFrame:
    """U4: toggle keyed by (user, person) ignoring the type; the type is the
    one of the last toggle."""
    g = (log.groupBy("user_id", "person_name")
         .agg(F.count(F.lit(1)).alias("_n"),
              F.max_by("person_type", F.struct("ts", "seq")).alias("person_type"),
              F.max("ts").alias("created_at")))
    return g.filter(F.col("_n") % 2 == 1).drop("_n")


def review_likes_current(log: DataFrame) -> DataFrame:
    """Toggle on (user, review)."""
    g = (log.groupBy("user_id", "review_id")
         .agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("created_at")))
    return g.filter(F.col("_n") % 2 == 1).drop("_n")


def history_current(log: DataFrame) -> DataFrame:
    """One row per (user, film) with the latest view time."""
    return (log.filter(F.col("kind") == "view").groupBy("user_id", "item_id")
            .agg(F.max("ts").alias("viewed_at")))


def cascade_deletes(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """U8: keep children whose parent survives (ON DELETE CASCADE)."""
    p = parents.select(F.col(parent_key).alias(child_key))
    return children.join(p, child_key, "left_semi")


def users_current(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial profile updates. Columns of ``updates``: user_id, ts, seq,
    username (applied only when non-empty), email / avatar (when not null),
    role (when not null), toggle_active (boolean flips)."""
    o = F.struct("ts", "seq")
    g = updates.groupBy("user_id").agg(
        F.max_by(F.col("username"), F.when(F.coalesce(F.col("username"), F.lit("")) != "", o)).alias("u_username"),
        F.max_by(F.col("email"), F.when(F.col("email").isNotNull(), o)).alias("u_email"),
        F.max_by(F.col("avatar"), F.when(F.col("avatar").isNotNull(), o)).alias("u_avatar"),
        F.max_by(F.col("role"), F.when(F.col("role").isNotNull(), o)).alias("u_role"),
        F.sum(F.when(F.col("toggle_active"), 1).otherwise(0)).alias("u_flips"),
    )
    j = users.join(g, users.id == g.user_id, "left")
    return j.select(
        "id",
        F.coalesce(F.col("u_username"), F.col("username")).alias("username"),
        F.coalesce(F.col("u_email"), F.col("email")).alias("email"),
        F.coalesce(F.col("u_role"), F.col("role")).alias("role"),
        F.coalesce(F.col("u_avatar"), F.col("avatar")).alias("avatar"),
        "created_at",
        F.when(F.coalesce(F.col("u_flips"), F.lit(0)) % 2 == 1, ~F.col("is_active"))
        .otherwise(F.col("is_active")).alias("is_active"),
    )


def user_update_log(events: DataFrame) -> DataFrame:
    """Profile-update log derived from events: sign-ups set a new e-mail,
    errors flip the active flag."""
    e = events.filter(F.col("event_type").isin("signup", "error"))
    return e.select(
        F.col("user_id"), F.col("ts"), F.col("event_id").alias("seq"),
        F.lit(None).cast("string").alias("username"),
        F.when(F.col("event_type") == "signup",
               F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("+"),
                        F.col("event_id").cast("string"), F.lit("@example.com"))).alias("email"),
        F.lit(None).cast("string").alias("avatar"),
        F.lit(None).cast("string").alias("role"),
        (F.col("event_type") == "error").alias("toggle_active"),
    )


# ---------------------------------------------------------------------------
# Reports over current state
# ---------------------------------------------------------------------------
def movie_avg_rating(ratings: DataFrame) -> DataFrame:
    """Mean score (1 place) and count per film."""
    return ratings.groupBy("item_id").agg(
        round_half_up(F.avg("score"), 1).alias("avg_score"),
        F.count(F.lit(1)).alias("n_ratings"))


def user_stats(users: DataFrame, ratings: DataFrame, reviews: DataFrame, likes: DataFrame,
               favorites: DataFrame) -> DataFrame:
    """Per-user counts; each side pre-aggregated on user before the
    joins (never join then aggregate: that fans out)."""
    r = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("rating_count"),
                                       F.avg("score").alias("_avg"))
    v = reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("review_count"))
    lk = likes.groupBy("user_id").agg(F.count(F.lit(1)).alias("like_count"))
    fv = favorites.groupBy("user_id").agg(F.count(F.lit(1)).alias("favorite_count"))
    u = users.select(F.col("id").alias("user_id"), "username")
    j = u.join(r, "user_id", "left").join(v, "user_id", "left").join(lk, "user_id", "left").join(fv, "user_id", "left")
    return j.select(
        "user_id", "username",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
          for c in ("rating_count", "review_count", "like_count", "favorite_count")],
        F.coalesce(round_half_up(F.col("_avg"), 1), F.lit(0.0)).alias("avg_score"))


def system_totals(users: DataFrame, ratings: DataFrame, reviews: DataFrame) -> DataFrame:
    """A19 (totals): one row."""
    n_ratings = ratings.select(F.count(F.lit(1))).scalar()
    avg_rating = ratings.select(F.coalesce(round_half_up(F.avg("score"), 1), F.lit(0.0))).scalar()
    n_reviews = reviews.select(F.count(F.lit(1))).scalar()
    return users.agg(F.count(F.lit(1)).alias("total_users"),
                     F.count_if(F.col("is_active")).alias("active_users")).select(
        "total_users", "active_users", n_ratings.alias("total_ratings"),
        avg_rating.alias("avg_rating"), n_reviews.alias("total_reviews"))


def newest_users(users: DataFrame, n: int = 5) -> DataFrame:
    """Newest users first, without credentials."""
    return top_k(users.select("id", "username", "email", "role", "created_at", "is_active"), n,
                 [F.col("created_at").desc_nulls_last(), F.col("id").desc()])


def newest_reviews(reviews: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """Newest reviews with their author."""
    u = users.select(F.col("id").alias("user_id"), "username")
    r = top_k(reviews, n, [F.col("created_at").desc(), F.col("id").desc()])
    return r.join(u, "user_id", "left").select("rk", "id", "user_id", "username", "movie_id", "content", "created_at")


def review_like_count(review_likes: DataFrame) -> DataFrame:
    """A20."""
    return review_likes.groupBy("review_id").agg(F.count(F.lit(1)).alias("like_count"))


def item_user_count(state: DataFrame, name: str) -> DataFrame:
    """Users per film on current like / favourite state."""
    return state.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))


# ---------------------------------------------------------------------------
# K9 / J1-J6
# ---------------------------------------------------------------------------
def recent_by_user(df: DataFrame, ts_col: str, n: int, tiebreak: str) -> DataFrame:
    """K9: newest ``n`` rows per user (row_number per user; planned as a
    per-partition group limit before the exchange)."""
    return top_k(df, n, [F.col(ts_col).desc(), F.col(tiebreak).desc()], partition=["user_id"])


def profile_lists(users: DataFrame, ratings: DataFrame, reviews: DataFrame, likes: DataFrame, favorites: DataFrame, history: DataFrame,
                  liked_persons: DataFrame, items_by_id: DataFrame, persons_dir: DataFrame, n: int | None = 50) -> DataFrame:
    """J14 in long form: (user_id, list, rk, key, score, title, rating, genre,
    poster, name_en, profession, avatar): each user's newest ``n`` (None: all)
    ratings, reviews, likes, favourites and views with their films (J4: a film
    that is missing shows the fixed title), directors and actors with their
    profiles (J5), and the statistics (A18; list ``stats``, a row each, the
    value in ``score`` and the mean score in ``rating``)."""
    from marquee.operators.persons import directory_by_name

    def lines(name: str, df: DataFrame, key: str, ts: str, tie: str, score=None) -> DataFrame:
        return recent_by_user(df, ts, n, tie).select(
            "user_id", F.lit(name).alias("list"), "rk", F.col(key).alias("key"),
            (F.col(score) if score else F.lit(None)).cast("int").alias("score"))

    films = (lines("rating", ratings, "item_id", "updated_at", "item_id", "score")
             .unionByName(lines("review", reviews, "movie_id", "created_at", "id"))
             .unionByName(lines("like", likes, "item_id", "created_at", "item_id"))
             .unionByName(lines("favorite", favorites, "item_id", "created_at", "item_id"))
             .unionByName(lines("history", history, "item_id", "viewed_at", "item_id")))
    info = items_by_id.select(F.col("id").alias("key"), "title", "rating", F.col("genre_raw").alias("genre"),
                              F.col("poster_local_path").alias("poster"))
    empty = F.lit("")
    shown = films.join(info, "key", "left").select(
        *films.columns, F.coalesce("title", F.lit(UNKNOWN_TITLE)).alias("title"), F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("genre", empty).alias("genre"), F.coalesce("poster", empty).alias("poster"),
        empty.alias("name_en"), empty.alias("profession"), empty.alias("avatar"))
    d = directory_by_name(persons_dir).select(F.col("name").alias("key"), "name_en", "profession", F.col("avatar_local_path").alias("avatar"))
    for role in ("director", "actor"):
        own = lines(role, liked_persons.filter(F.col("person_type") == role), "person_name", "created_at", "person_name")
        shown = shown.unionByName(own.join(d, "key", "left").select(
            *own.columns, empty.alias("title"), F.lit(0.0).alias("rating"), empty.alias("genre"), empty.alias("poster"),
            *[F.coalesce(c, empty).alias(c) for c in ("name_en", "profession", "avatar")]))
    stats = user_stats(users, ratings, reviews, likes, favorites)
    counts = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("int").alias("score"))
                       for c in ("rating_count", "review_count", "like_count", "favorite_count")])
    rows = stats.select("user_id", F.posexplode(counts).alias("p", "c"), "avg_score")
    return shown.unionByName(rows.select(
        "user_id", F.lit("stats").alias("list"), (F.col("p") + 1).cast("long").alias("rk"), F.col("c.key").alias("key"),
        F.col("c.score").alias("score"), empty.alias("title"), F.when(F.col("p") == 0, F.col("avg_score")).otherwise(0.0).alias("rating"),
        *[empty.alias(c) for c in ("genre", "poster", "name_en", "profession", "avatar")]))


def movie_reviews(reviews: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """Reviews with author, newest ``n`` per film."""
    u = users.select(F.col("id").alias("user_id"), "username", F.col("avatar").alias("user_avatar"))
    r = top_k(reviews, n, [F.col("created_at").desc(), F.col("id").desc()], partition=["movie_id"])
    return r.join(u, "user_id")


def review_replies_view(replies: DataFrame, users: DataFrame) -> DataFrame:
    """Replies with author, oldest first within a review (a distributed
    range sort; no per-review numbering, so a hot review is not one task)."""
    u = users.select(F.col("id").alias("user_id"), "username")
    return replies.join(u, "user_id").orderBy("review_id", "created_at", "id")


def review_thread(reviews: DataFrame, replies: DataFrame, review_likes: DataFrame,
                  ratings: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """J3 in long form, a row per line of a film's thread: (movie_id, part,
    review_id, reply_id, user_id, username, content, created_at, number, score).

    part ``film``: mean score and number of ratings; ``review``: the newest
    ``n`` with author and like count; ``reply``: every reply to these with its
    author; ``liked``: who likes a review (the viewer's own flag is the row
    of that viewer); ``score``: a viewer's own score of the film. Replies and
    likes stay rows, so no long thread is gathered."""
    null = F.lit(None)
    u = users.select(F.col("id").alias("user_id"), "username")
    top = top_k(reviews, n, [F.col("created_at").desc(), F.col("id").desc()], partition=["movie_id"]).select(
        F.col("id").alias("review_id"), "movie_id", "user_id", "content", "created_at")
    place = top.select("review_id", "movie_id")

    def line(df: DataFrame, part: str, **has) -> DataFrame:
        kinds = {"review_id": "long", "reply_id": "long", "user_id": "long", "username": "string", "content": "string",
                 "created_at": "timestamp", "number": "long", "score": "double"}
        return df.select("movie_id", F.lit(part).alias("part"), *[(has[c] if c in has else null).cast(k).alias(c) for c, k in kinds.items()])

    c = F.col
    film = movie_avg_rating(ratings).withColumnRenamed("item_id", "movie_id").join(place.select("movie_id").distinct(), "movie_id", "right")
    likes = review_likes.join(place, "review_id")
    count = likes.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    said = replies.select(F.col("id").alias("reply_id"), "review_id", "user_id", "content", "created_at").join(place, "review_id").join(u, "user_id")
    mine = ratings.select("user_id", F.col("item_id").alias("movie_id"), "score").join(place.select("movie_id").distinct(), "movie_id", "left_semi")
    own = dict(user_id=c("user_id"), username=c("username"), content=c("content"), created_at=c("created_at"))
    return (line(film, "film", number=F.coalesce("n_ratings", F.lit(0)), score=F.coalesce("avg_score", F.lit(0.0)))
            .unionByName(line(top.join(u, "user_id").join(count, "review_id", "left"), "review", review_id=c("review_id"),
                              number=F.coalesce("n", F.lit(0)), **own))
            .unionByName(line(said, "reply", review_id=c("review_id"), reply_id=c("reply_id"), **own))
            .unionByName(line(likes, "liked", review_id=c("review_id"), user_id=c("user_id")))
            .unionByName(line(mine, "score", user_id=c("user_id"), score=c("score"))))


def item_details(requests: DataFrame, items_by_id: DataFrame, ratings: DataFrame, likes: DataFrame, favorites: DataFrame,
                 reviews: DataFrame, users: DataFrame, similar: DataFrame, n: int = 20) -> DataFrame:
    """J15 in long form for ``requests(user_id, item_id, ts)``, a row per line of
    the page: (user_id, item_id, part, rk, key, text, score, number).

    part ``card``: title, catalogue rating; ``stats``: mean score and number of
    ratings; ``flags``: the visitor's own score, and whether liked (number 1
    or 3) and favourited (2 or 3); ``review``: the newest ``n`` with author;
    ``similar``: the films of ``similar(seed, rk, id, title, similarity)``; ``view``:
    the event that the visit adds to the history (``visits``)."""
    keys = ["user_id", "item_id"]
    req = requests.select(*keys, "ts")
    card = items_by_id.select(F.col("id").alias("item_id"), "title", "rating")
    req = req.join(card.select("item_id"), "item_id", "left_semi")  # a film that is missing has no page

    def line(df: DataFrame, part: str, rk=F.lit(0), key=F.lit(""), text=F.lit(""), score=F.lit(None), number=F.lit(None)) -> DataFrame:
        return df.select(*keys, F.lit(part).alias("part"), rk.cast("long").alias("rk"), key.cast("string").alias("key"),
                         text.cast("string").alias("text"), score.cast("double").alias("score"), number.cast("long").alias("number"))

    c = F.col
    stats = movie_avg_rating(ratings)
    flags = (req.join(ratings.select(*keys, "score"), keys, "left").join(likes.select(*keys, F.lit(1).alias("l")), keys, "left")
             .join(favorites.select(*keys, F.lit(2).alias("f")), keys, "left"))
    said = movie_reviews(reviews, users, n).select(F.col("movie_id").alias("item_id"), "id", "username", F.col("rk").alias("rrk"))
    near = similar.select(F.col("seed").alias("item_id"), F.col("rk").alias("srk"), "id", "title", "similarity")
    return (line(req.join(card, "item_id"), "card", text=c("title"), score=c("rating"))
            .unionByName(line(req.join(stats, "item_id", "left"), "stats", score=F.coalesce("avg_score", F.lit(0.0)), number=F.coalesce("n_ratings", F.lit(0))))
            .unionByName(line(flags, "flags", score=c("score"), number=F.coalesce("l", F.lit(0)) + F.coalesce("f", F.lit(0))))
            .unionByName(line(req.join(said, "item_id"), "review", c("rrk"), c("id"), c("username")))
            .unionByName(line(req.join(near, "item_id"), "similar", c("srk"), c("id"), c("title"), c("similarity")))
            .unionByName(line(req, "view", key=F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))))


def visits(requests: DataFrame, items_by_id: DataFrame) -> DataFrame:
    """The events that the visits of ``requests(user_id, item_id, ts)`` add to the activity log."""
    known = requests.join(items_by_id.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return known.select("user_id", "item_id", F.lit("view").alias("kind"), F.lit(None).cast("int").alias("score"), "ts",
                        F.lit(2).alias("src"), F.xxhash64("user_id", "item_id", "ts").alias("k1"), F.lit(0).cast("long").alias("k2"))


def enrich_items(rows: DataFrame, items_by_id: DataFrame, key: str = "item_id") -> DataFrame:
    """Activity rows left-joined to films; a missing film shows a fixed
    title and empty fields. The rows' own ``score`` is kept; ``rating`` is the
    film's."""
    f = items_by_id.select(F.col("id").alias(key), F.col("title").alias("_t"),
                           F.col("cover").alias("_c"), F.col("rating").alias("_r"))
    j = rows.join(f, key, "left")
    return (j.withColumn("title", F.coalesce(F.col("_t"), F.lit(UNKNOWN_TITLE)))
            .withColumn("cover", F.coalesce(F.col("_c"), F.lit("")))
            .withColumn("rating", F.coalesce(F.col("_r"), F.lit(0.0)))
            .drop("_t", "_c", "_r"))


def enrich_persons(rows: DataFrame, persons_dir: DataFrame, key: str = "person_name") -> DataFrame:
    """Names left-joined to the directory (first entry per name)."""
    from marquee.operators.persons import directory_by_name
    d = directory_by_name(persons_dir).select(
        F.col("name").alias(key), "avatar_url", "name_en", "profession")
    j = rows.join(d, key, "left")
    return j.select(*rows.columns,
                    F.coalesce("avatar_url", F.lit("")).alias("avatar_url"),
                    F.coalesce("name_en", F.lit("")).alias("name_en"),
                    F.coalesce("profession", F.lit("")).alias("profession"))


def user_item_flags(ratings: DataFrame, likes: DataFrame, favorites: DataFrame,
                    history: DataFrame) -> DataFrame:
    """For every (user, film) a user touched: my score, liked, favourited."""
    keys = ["user_id", "item_id"]
    touched = (ratings.select(*keys).unionByName(likes.select(*keys))
               .unionByName(favorites.select(*keys)).unionByName(history.select(*keys)).distinct())
    j = (touched.join(ratings.select(*keys, F.col("score").alias("my_score")), keys, "left")
         .join(likes.select(*keys, F.lit(True).alias("_l")), keys, "left")
         .join(favorites.select(*keys, F.lit(True).alias("_f")), keys, "left"))
    return j.select(*keys, "my_score",
                    F.coalesce("_l", F.lit(False)).alias("liked"),
                    F.coalesce("_f", F.lit(False)).alias("favorited"))
