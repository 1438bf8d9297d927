"""Canonical tables derived from the driver's parquet tables.

The engine's operators read only canonical tables (``items_raw``, ``users``,
``activity`` logs, ``reviews``, ``persons`` ...). This module derives them from
the TPC-H-like driver tables so that every registered query does work that
grows with the input. All derivations are declarative DataFrame plans: the
per-part supplier ranking is one shuffle on ``l_partkey`` after a map-side
distinct; nation/region are fixed 25/5-row dimensions and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the adapter (they define the test catalogue).
LANGUAGE_BY_MOD4 = ("en", "fr/de", "es, en", "")
PROFESSION_BY_MOD3 = ("导演 / 演员", "演员", None)
# activity kinds by lineitem return flag
KIND_BY_RETURNFLAG = {"N": "rate", "R": "favorite", "A": "like"}
# event types that become views, toggles and rating deletions
KIND_BY_EVENT = {"view": "view", "click": "like", "purchase": "favorite", "error": "unrate"}
BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC, origin of synthetic review times


@dataclass
class DriverTables:
    """Lazy reader of the driver parquet tables; only needed columns are read
    because Catalyst prunes the scan to the projection of each query."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


def _row_count(df: DataFrame):
    """Row count as a scalar subquery (evaluated once, inlined as a value)."""
    return df.select(F.count(F.lit(1))).scalar()


def _supplier_slots(t: DriverTables) -> DataFrame:
    """Per part: all its distinct suppliers ranked by md5('<part>-<supp>'): the
    names of slots 1 and 2, the nations of slots 1 and 2, the region of slot 1,
    and the names from slot 2 on as one list (the record's cast)."""
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    h = F.md5(F.concat(F.col("l_partkey").cast("string"), F.lit("-"),
                       F.col("l_suppkey").cast("string")))
    w = Window.partitionBy("l_partkey").orderBy(h)
    ranked = pairs.withColumn("rn", F.row_number().over(w))
    sup = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    nat = F.broadcast(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    reg = F.broadcast(t.region.select("r_regionkey", "r_name"))
    j = (ranked.join(sup, ranked.l_suppkey == sup.s_suppkey, "left")
         .join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left")
         .join(reg, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    aggs = [F.max(F.when(F.col("rn") == i, F.col("s_name"))).alias(f"s{i}") for i in (1, 2)]
    rest = F.collect_list(F.when(F.col("rn") >= 2, F.struct("rn", "s_name")))
    aggs.append(F.array_join(F.transform(F.sort_array(rest), lambda x: x["s_name"]), ", ").alias("others"))
    aggs += [F.max(F.when(F.col("rn") == i, F.col("n_name"))).alias(f"n{i}") for i in (1, 2)]
    aggs.append(F.max(F.when(F.col("rn") == 1, F.col("r_name"))).alias("r1"))
    return j.groupBy("l_partkey").agg(*aggs)


def items_raw(t: DriverTables) -> DataFrame:
    """The 17-field ingest record (all strings) plus the file ordinal ``ord``."""
    p = t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    s = _supplier_slots(t)
    j = p.join(s, p.p_partkey == s.l_partkey, "left")
    k = F.col("p_partkey")
    rating = (F.when(k % 17 == 0, F.lit(""))
              .when(k % 23 == 0, F.lit("N/A"))
              .otherwise(F.concat(((k * 37) % 10).cast("string"), F.lit("."),
                                  ((k * 13 + F.col("p_size")) % 10).cast("string"))))
    genre = F.concat(F.col("p_type"), F.lit(" / "), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)),
                     F.lit(","), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGUAGE_BY_MOD4]), (k % 4 + 1).cast("int"))
    year = F.lit(1950) + (F.floor(F.col("p_retailprice")) + F.col("p_size")) % 77
    release = F.when(k % 29 == 0, F.lit("")).otherwise(
        F.concat(year.cast("string"), F.lit("-01-01("), F.coalesce(F.col("r1"), F.lit("")), F.lit(")")))
    runtime = F.when(k % 31 == 0, F.lit("")).otherwise(
        F.concat(((k * 7) % 430).cast("string"), F.lit(" min")))
    return j.select(
        k.alias("ord"),
        k.cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.lit("").alias("cover"),
        rating.alias("rating"),
        F.concat_ws("/", "s1", "s2").alias("director"),
        F.lit("").alias("screenwriter"),
        F.coalesce("others", F.lit("")).alias("cast"),
        genre.alias("genre"),
        F.concat_ws(" / ", "n1", "n2").alias("country"),
        lang.alias("language"),
        release.alias("release_date"),
        runtime.alias("runtime"),
        F.lit("").alias("imdb"),
        F.lit("").alias("aka"),
        F.col("p_name").alias("summary"),
        F.array().cast("array<string>").alias("hot_comments"),
        F.lit("").alias("poster_local_path"),
    )


def users(t: DriverTables) -> DataFrame:
    first_order = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
    c = t.customer
    j = c.join(first_order, c.c_custkey == first_order.o_custkey, "left")
    return j.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_custkey") % 50 == 0, F.lit("admin")).otherwise(F.lit("user")).alias("role"),
        F.lit("").alias("avatar"),
        F.col("created_at"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def _event_item(props) -> "F.Column":
    return F.get_json_object(props, "$.k")


def activity(t: DriverTables) -> DataFrame:
    """Append-only user activity log.

    Columns: user_id, item_id, kind (rate/like/favorite/view), score (rate
    only), ts, and the total order (ts, src, k1, k2) used for last-write-wins.
    """
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                           "l_returnflag", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey")
    kind = F.coalesce(*[F.when(F.col("l_returnflag") == f, F.lit(k)) for f, k in KIND_BY_RETURNFLAG.items()])
    a = (li.join(o, li.l_orderkey == o.o_orderkey)
         .select(F.col("o_custkey").alias("user_id"),
                 F.col("l_partkey").cast("string").alias("item_id"),
                 kind.alias("kind"),
                 F.when(kind == "rate", (F.lit(1) + F.floor((F.col("l_quantity") - 1) / 5)).cast("int"))
                 .alias("score"),
                 F.col("l_shipdate").alias("ts"),
                 F.lit(0).alias("src"),
                 F.col("l_orderkey").alias("k1"),
                 F.col("l_linenumber").cast("bigint").alias("k2"))
         .filter(F.col("kind").isNotNull()))
    ev = t.events
    ekind = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(k)) for e, k in KIND_BY_EVENT.items()])
    b = (ev.filter(F.col("event_type").isin(*KIND_BY_EVENT))
         .select(F.col("user_id"),
                 _event_item(F.col("props")).alias("item_id"),
                 ekind.alias("kind"),
                 F.lit(None).cast("int").alias("score"),
                 F.col("ts"),
                 F.lit(1).alias("src"),
                 F.col("event_id").alias("k1"),
                 F.lit(0).cast("bigint").alias("k2"))
         .filter(F.col("item_id").isNotNull()))
    return a.unionByName(b)


def _turn_id(turn: str) -> "F.Column":
    """An id for a turn of a conversation, without collisions for any 32-bit turn."""
    return F.col("conv_id") * (1 << 32) + F.col(turn)


def reviews(t: DriverTables) -> DataFrame:
    """User turns of conversations are reviews of a film."""
    n_cust = _row_count(t.customer)
    n_part = _row_count(t.part)
    c = t.conversations.filter(F.col("role") == "user")
    rid = _turn_id("turn")
    return (c.select(rid.alias("id"),
                    ((F.col("conv_id") * 13 + F.col("turn")) % n_cust).alias("user_id"),
                    (F.col("conv_id") % n_part).cast("string").alias("movie_id"),
                    F.col("text").alias("content"),
                    F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("conv_id") * 100 + F.col("turn")).alias("created_at")))


def review_replies(t: DriverTables) -> DataFrame:
    """Assistant turns reply to the latest earlier user turn of the same
    conversation (an as-of lookup inside one conversation: window, no join)."""
    n_cust = _row_count(t.customer)
    c = t.conversations.select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last_user = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    r = c.withColumn("review_turn", last_user).filter(
        (F.col("role") == "assistant") & F.col("review_turn").isNotNull())
    rid = _turn_id("turn")
    return (r.select(rid.alias("id"),
                    _turn_id("review_turn").alias("review_id"),
                    ((F.col("conv_id") * 7 + F.col("turn")) % n_cust).alias("user_id"),
                    F.col("text").alias("content"),
                    F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("conv_id") * 100 + F.col("turn")).alias("created_at")))


def review_like_log(t: DriverTables) -> DataFrame:
    """Every turn of a conversation toggles a like, by the turn's user, on the
    conversation's first review."""
    n_cust = _row_count(t.customer)
    c = t.conversations.select("conv_id", "turn", "role")
    first = (c.filter(F.col("role") == "user").groupBy("conv_id")
             .agg(F.min("turn").alias("first_turn")))
    j = c.join(first, "conv_id")
    rid = _turn_id("turn")
    return (j.select(((F.col("conv_id") * 17 + F.col("turn") * 3) % n_cust).alias("user_id"),
                    _turn_id("first_turn").alias("review_id"),
                    F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
                    rid.alias("seq")))


def person_like_log(t: DriverTables) -> DataFrame:
    """Each customer likes the suppliers of two or more of its lines: the most
    used (line count desc, name asc) as a director, all others as actors."""
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey")
    s = t.supplier.select("s_suppkey", "s_name")
    per = (li.join(o, li.l_orderkey == o.o_orderkey)
           .groupBy("o_custkey", "l_suppkey")
           .agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("ts")).filter(F.col("n") >= 2))
    per = per.join(s, per.l_suppkey == s.s_suppkey)
    w = Window.partitionBy("o_custkey").orderBy(F.desc("n"), F.asc("s_name"))
    return per.withColumn("rn", F.row_number().over(w)).select(
        F.col("o_custkey").alias("user_id"),
        F.col("s_name").alias("person_name"),
        F.when(F.col("rn") == 1, F.lit("director")).otherwise(F.lit("actor")).alias("person_type"),
        F.col("ts"),
        F.col("rn").cast("bigint").alias("seq"))


def application_log(users: DataFrame, act: DataFrame, events: DataFrame, revs: DataFrame, replies: DataFrame,
                    review_like: DataFrame, person_like: DataFrame) -> DataFrame:
    """All nine tables as one log (``operators.deletes.LOG``): accounts exist from
    the start and are opened again by a sign-up of their own; an ``unrate`` of a
    film asks to delete the user's rating and view of it and the reviews and
    replies under it; a sign-up of an item number asks to delete that user."""
    def rows(df: DataFrame, entity: str, op: str, record, ts: str, src: int, k1, k2=F.lit(0), user=None, review=None,
             actor=None, value=None) -> DataFrame:
        null = F.lit(None)
        return df.select(F.lit(entity).alias("entity"), F.lit(op).alias("op"), record.cast("string").alias("record"),
                         (null if user is None else F.col(user)).cast("long").alias("user_id"),
                         (null if review is None else F.col(review)).cast("long").alias("review_id"),
                         (null if actor is None else F.col(actor)).cast("long").alias("actor"),
                         (null if value is None else F.col(value)).cast("string").alias("value"),
                         (ts if not isinstance(ts, str) else F.col(ts)).cast("timestamp").alias("ts"), F.lit(src).alias("src"),
                         k1.cast("long").alias("k1"), k2.cast("long").alias("k2"))

    def pair(a: str, b: str):
        return F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))

    of = lambda kind: act.filter(F.col("kind") == kind)
    k1, k2 = F.col("k1"), F.col("k2")
    film = pair("user_id", "item_id")

    def logged(kind: str, entity: str, op: str, **more) -> list[DataFrame]:
        return [rows(of(kind).filter(F.col("src") == n), entity, op, film, "ts", n, k1, k2, **more) for n in (0, 1)]

    signups = events.filter(F.col("event_type") == "signup").withColumn("item", _event_item(F.col("props")))
    gone = of("unrate").select(F.col("user_id").alias("actor"), F.col("item_id").alias("movie_id"), "ts", "k1")
    under = replies.join(revs.select(F.col("id").alias("review_id"), "movie_id"), "review_id")
    parts = [
        rows(users, "user", "put", F.col("id"), F.lit("1970-01-01 00:00:00"), -1, F.lit(0), user="id", value="username"),
        rows(signups.join(users.select(F.col("id").alias("user_id"), "username"), "user_id"), "user", "put", F.col("user_id"), "ts", 1,
             F.col("event_id"), user="user_id", value="username"),
        rows(signups.filter("item is not null"), "user", "delete", F.col("item"), "ts", 1, F.col("event_id"), actor="user_id"),
        *logged("rate", "rating", "put", user="user_id", value="score"),
        *logged("like", "like", "toggle", user="user_id"), *logged("favorite", "favorite", "toggle", user="user_id"),
        *logged("view", "history", "put", user="user_id"),
        *logged("unrate", "rating", "delete", actor="user_id"), *logged("unrate", "history", "delete", actor="user_id"),
        rows(revs, "review", "put", F.col("id"), "created_at", 2, F.col("id"), user="user_id", value="movie_id"),
        rows(replies, "reply", "put", F.col("id"), "created_at", 2, F.col("id"), user="user_id", review="review_id"),
        rows(revs.select("id", "movie_id").join(gone, "movie_id"), "review", "delete", F.col("id"), "ts", 1, k1, actor="actor"),
        rows(under.select("id", "movie_id").join(gone, "movie_id"), "reply", "delete", F.col("id"), "ts", 1, k1, actor="actor"),
        rows(review_like, "review_like", "toggle", pair("user_id", "review_id"), "ts", 2, F.col("seq"), user="user_id", review="review_id"),
        rows(person_like, "liked_person", "toggle", pair("user_id", "person_name"), "ts", 3, F.col("seq"), user="user_id",
             value="person_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def persons(t: DriverTables) -> DataFrame:
    """Person directory in file order (``ord``)."""
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    nat = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    k = F.col("s_suppkey")
    prof = F.element_at(F.array(*[F.lit(x) for x in PROFESSION_BY_MOD3]), (k % 3 + 1).cast("int"))
    avatar = (F.when(k % 4 == 0, F.concat(F.lit("https://img.example.com/view/celebrity/s/public/p"),
                                           k.cast("string"), F.lit(".jpg")))
              .when(k % 4 == 1, F.concat(F.lit("https://img.example.com/view/personage/m/public/"),
                                          k.cast("string"), F.lit(".webp")))
              .when(k % 4 == 2, F.lit("")))
    return (s.join(nat, s.s_nationkey == nat.n_nationkey, "left")
            .select(k.alias("ord"),
                    F.col("s_name").alias("name"),
                    F.concat(F.lit("Person "), k.cast("string")).alias("name_en"),
                    avatar.alias("avatar_url"),
                    F.lit("").alias("avatar_local_path"),
                    F.when(k % 2 == 0, F.lit("男")).otherwise(F.lit("女")).alias("gender"),
                    F.lit("").alias("birth_date"),
                    F.col("n_name").alias("birthplace"),
                    prof.alias("profession"),
                    F.lit("").alias("biography"),
                    k.cast("string").alias("douban_id"),
                    F.lit(None).cast("string").alias("personage_id")))


def persons_raw(t: DriverTables) -> DataFrame:
    """Raw scraped directory with duplicate external ids (input of cleaning)."""
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("ord"),
        F.col("c_name").alias("name"),
        F.when(k % 13 != 0, ((k * 7) % 1201).cast("string")).alias("douban_id"),
        F.when(k % 11 != 0, ((k * 5) % 1103).cast("string")).alias("personage_id"),
        F.when(k % 3 == 0, F.concat(F.lit("https://img.example.com/view/celebrity/m/"), k.cast("string"),
                                    F.lit(".jpg"))).alias("avatar_url"),
        F.when(k % 5 == 0, F.repeat(F.col("c_mktsegment"), 8)).alias("biography"),
        F.when(k % 4 == 0, F.concat(F.lit("avatars/"), k.cast("string"), F.lit(".jpg")))
        .otherwise(F.lit("")).alias("avatar_local_path"),
        (k % 7 == 0).alias("_no_avatar"),
        (k % 19 == 0).alias("_scrape_failed"),
        F.lit("2024-01-01").alias("_scraped_at"),
    )
