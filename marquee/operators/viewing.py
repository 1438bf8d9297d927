"""Per-user viewing report (V1-V8), for all users at once.

Weights are integers in units of 0.01 (summed exactly, divided once). Each
user's lists are bounded by the report's limits (500 newest films per
signal, 50 liked persons per role) before any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.agg import dense_ids, top_k
from marquee.functions.text import decade, round_half_up

# Fixed report weights (units of 0.01).
R_HIGH, R_MID, R_LOW = 100, 50, 30   # score >= 4, >= 2, else
FAV, LIKE, VIEW = 120, 80, 15
DIRECTOR, ACTOR = 60, 40
LIST_LIMIT, PERSON_LIMIT = 500, 50
TOP_N, PERSON_POOL = 10, 30


def _newest(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return top_k(df, n, [F.col(ts).desc(), F.col(key).desc()], partition=["user_id"])


def report_inputs(ratings, likes, favorites, history, liked_persons, reviews):
    r = _newest(ratings, "updated_at", "item_id", LIST_LIMIT).select("user_id", "item_id", "score")
    f = _newest(favorites, "created_at", "item_id", LIST_LIMIT).select("user_id", "item_id")
    lk = _newest(likes, "created_at", "item_id", LIST_LIMIT).select("user_id", "item_id")
    h = _newest(history, "viewed_at", "item_id", LIST_LIMIT).select("user_id", "item_id")
    lp = top_k(liked_persons, PERSON_LIMIT, [F.col("created_at").desc(), F.col("person_name").desc()],
               partition=["user_id", "person_type"], name="prk")
    rv = _newest(reviews, "created_at", "id", LIST_LIMIT).select("user_id", "id")
    return r, f, lk, h, lp, rv


def report_item_weights(items: DataFrame, r, f, lk, h, lp) -> DataFrame:
    """V1: (user_id, item_id, w_c) with w_c in hundredths."""
    rw = r.select("user_id", "item_id", F.when(F.col("score") >= 4, R_HIGH).when(F.col("score") >= 2, R_MID)
                  .otherwise(R_LOW).alias("w"))
    fw = f.select("user_id", "item_id", F.lit(FAV).alias("w"))
    lw = lk.select("user_id", "item_id", F.lit(LIKE).alias("w"))
    seen = rw.select("user_id", "item_id").unionByName(fw.select("user_id", "item_id")).unionByName(
        lw.select("user_id", "item_id"))
    hw = h.join(seen, ["user_id", "item_id"], "left_anti").select("user_id", "item_id", F.lit(VIEW).alias("w"))
    # liked persons -> each film record crediting one of them in that role, once per record
    per = []
    for role, col, w in (("director", "directors", DIRECTOR), ("actor", "all_actors", ACTOR)):
        names = lp.filter(F.col("person_type") == role).select("user_id", F.col("person_name").alias("name"))
        cr = items.select("id", "ord", F.explode(F.array_distinct(col)).alias("name"))
        per.append(names.join(cr, "name").select("user_id", "id", "ord").distinct()
                   .select("user_id", F.col("id").alias("item_id"), F.lit(w).alias("w")))
    u = rw.unionByName(fw).unionByName(lw).unionByName(hw).unionByName(per[0]).unionByName(per[1])
    return u.groupBy("user_id", "item_id").agg(F.sum("w").cast("bigint").alias("w_c"))


def _weighted_records(items: DataFrame, weights: DataFrame) -> DataFrame:
    """Every catalogue record of a weighted film (repeated records count again)."""
    return weights.join(items.select(F.col("id").alias("item_id"), "ord", "genres", "country_raw", "year",
                                     "directors", "all_actors"), "item_id")


def person_codes(items: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """``(name, code)`` of all names in the lists ``cols``, numbered in order of name, and the records
    ``(item_id, ord, <cols>)`` with a code for each entry. Codes take little room where a record's lists
    go to each of its users; they compare like the names."""
    from marquee.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(items.sparkSession)
    cr = None
    for i, col in enumerate(cols):
        c = items.select(F.col("id").alias("item_id"), "ord", F.lit(i).alias("list"), F.explode(col).alias("name"))
        cr = c if cr is None else cr.unionByName(c)
    names = dense_ids(cr.select("name").distinct(), "name", "code").select("name", F.col("code").cast("int").alias("code")).checkpoint()
    lists = [F.collect_list(F.when(F.col("list") == i, F.col("code"))).alias(c) for i, c in enumerate(cols)]
    return names, cr.join(names, "name").groupBy("item_id", "ord").agg(*lists).checkpoint()


def report_overview(users: DataFrame, items: DataFrame, weights, r, f, lk, h, lp, rv) -> DataFrame:
    """V2. Each record goes to its users with its lists whole; names are told apart where a user's records lie."""
    coded = person_codes(items, "directors", "all_actors")[1]
    wr = weights.select("user_id", "item_id").join(coded, "item_id").select("user_id", "directors", "all_actors").repartition("user_id")

    def tagged(col: str, role: int):
        return F.transform(col, lambda x: F.struct(F.lit(role).alias("role"), x.alias("code")))

    both = F.concat(tagged("directors", 0), tagged("all_actors", 1))
    met = wr.select("user_id", F.inline(both)).groupBy("user_id", "role", "code").agg(F.lit(1).alias("_one"))
    people = met.groupBy("user_id").agg(*[F.count_if(F.col("role") == k).alias(n)
                                          for k, n in enumerate(("unique_directors", "unique_actors"))])

    def cnt(df, name):
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))

    out = users.select(F.col("id").alias("user_id"))
    rs = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_ratings"),
                                  round_half_up(F.avg("score"), 1).alias("avg_user_rating"))
    parts = [rs, cnt(rv, "total_reviews"), cnt(lk, "total_likes"), cnt(f, "total_favorites"),
             cnt(h, "total_history"),
             cnt(lp.filter(F.col("person_type") == "director"), "total_liked_directors"),
             cnt(lp.filter(F.col("person_type") == "actor"), "total_liked_actors"), people]
    for p in parts:
        out = out.join(p, "user_id", "left")
    cols = ["total_ratings", "total_reviews", "total_likes", "total_favorites", "total_history",
            "total_liked_directors", "total_liked_actors", "unique_directors", "unique_actors"]
    return out.select("user_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols],
                      F.coalesce("avg_user_rating", F.lit(0.0)).alias("avg_user_rating"))


def report_rating_dist(users: DataFrame, r: DataFrame) -> DataFrame:
    """V3: counts of own scores 1..10, zero-filled (each user row expanded
    to its ten score bins; no join)."""
    c = r.groupBy("user_id", "score").agg(F.count(F.lit(1)).alias("n"))
    bins = users.select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("score"))
    return bins.join(c, ["user_id", "score"], "left").select(
        "user_id", "score", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _weighted_top(df: DataFrame, key: str, n: int = TOP_N) -> DataFrame:
    g = df.groupBy("user_id", key).agg(F.sum("w_c").alias("w_c"))
    t = top_k(g, n, [F.col("w_c").desc(), F.col(key).asc()], partition=["user_id"])
    return t.select("user_id", key, (F.col("w_c") / 100.0).alias("weight"), "rk")


def report_genres(items, weights):
    """V4: weighted genres, top 10."""
    wr = _weighted_records(items, weights)
    return _weighted_top(wr.select("user_id", "w_c", F.explode("genres").alias("genre")), "genre")


def report_countries(items, weights):
    """V7: weighted unsplit country strings, top 10."""
    wr = _weighted_records(items, weights).filter(F.col("country_raw") != "")
    return _weighted_top(wr.select("user_id", "w_c", F.col("country_raw").alias("country")), "country")


def report_decades(items, weights, r):
    """V5: weighted count and own mean score (1 place, 0 if none) per decade."""
    wr = _weighted_records(items, weights).filter(F.col("year").isNotNull() & (F.col("year") != 0))
    own = r.select("user_id", "item_id", "score")
    j = wr.join(own, ["user_id", "item_id"], "left").select("user_id", decade("year").alias("d"), "w_c", "score")
    g = j.groupBy("user_id", "d").agg(F.sum("w_c").alias("w_c"), F.avg("score").alias("_a"))
    return g.select("user_id", F.concat(F.col("d").cast("string"), F.lit("s")).alias("decade"),
                    (F.col("w_c") / 100.0).alias("weight"),
                    F.coalesce(round_half_up("_a", 1), F.lit(0.0)).alias("avg_score"))


def report_people(items, weights, lp, role: str) -> DataFrame:
    """V6: liked names with weight first (by weight), then the most common
    30 not liked, cut to 10; weights 1 place. A record goes to its users with its
    list of name codes whole; the names are counted where a user's records lie."""
    col = "directors" if role == "director" else "all_actors"
    names, coded = person_codes(items, col)
    liked = (lp.filter(F.col("person_type") == role).select("user_id", F.col("person_name").alias("name"))
             .join(names, "name").select("user_id", F.lit(0).cast("bigint").alias("w_c"), F.array("code").alias("codes"), F.lit(1).alias("liked")))
    wr = (weights.join(coded, "item_id")
          .select("user_id", F.col("w_c").cast("bigint").alias("w_c"), F.col(col).alias("codes"), F.lit(0).alias("liked")))
    # a liked name is a row without weight of its own: it counts if a record of the user holds the name too
    g = (wr.unionByName(liked).repartition("user_id").select("user_id", "w_c", "liked", F.explode("codes").alias("code"))
         .groupBy("user_id", "code").agg(F.sum("w_c").alias("w_c"), F.max("liked").alias("liked"), F.min("liked").alias("_only"))
         .filter(F.col("_only") == 0))
    # one rank over all names of a user serves the pool; the liked ones join it
    ranked = top_k(g, None, [F.col("w_c").desc(), F.col("code").asc()], partition=["user_id"], name="prk")
    cand = ranked.filter((F.col("liked") == 1) | (F.col("prk") <= PERSON_POOL))
    t = top_k(cand, TOP_N, [F.col("liked").desc(), F.col("w_c").desc(), F.col("code").asc()], partition=["user_id"])
    return t.join(names, "code").select("user_id", "name", round_half_up(F.col("w_c") / 100.0, 1).alias("weight"), "liked", "rk")


def report_top_rated(items, weights, r) -> DataFrame:
    """V8: the user's own rated films (catalogue records) by own score, top 10."""
    wr = _weighted_records(items, weights).join(r.select("user_id", "item_id", "score"), ["user_id", "item_id"])
    t = top_k(wr.filter(F.col("score") > 0), TOP_N, [F.col("score").desc(), F.col("ord").asc()],
              partition=["user_id"])
    return t.select("user_id", "item_id", "score", "rk")
