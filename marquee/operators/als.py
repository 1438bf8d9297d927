"""Collaborative filtering with MLlib ALS.

Training uses the current ratings (log-derived), not invented users. MLlib
needs integer ids, while film ids are strings of any form: distinct ids get
ordinals from a written id table, and the model's factors are mapped back. The
80/20 split goes by a hash of (user, item), so it doesn't depend on
partitioning. Item-item cosine over factors is computed block-wise: items and
seeds are both split into blocks of at most about ``BLOCK`` and ``SEED_BLOCK``
vectors, and each pair of blocks is scored with one dense NumPy product inside
``cogroup.applyInPandas``. Only the rows a caller keeps (top-k or above a
threshold) leave the task; no (seed, item) pair table is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.agg import dense_ids, top_k
from marquee.functions.text import round_half_up
from marquee.session import ensure_checkpoint_dir

RANK, MAX_ITER, REG, SEED = 20, 15, 0.1, 42
TRAIN_FRACTION = 0.8
SIMILAR_TOP = 12
EPS = 1e-8
BLOCK, SEED_BLOCK, USER_BLOCK = 4096, 1024, 512
TOP_BLOCK, TOP_USERS, TOP_GROUP = 131072, 16384, 64  # films, users of a task of the lists of all users; scores that share a maximum
TOP_USERS_AT_ONCE, TOP_SCORES = 256, 1 << 20
# Cosines are ranked on so many decimals, in every block and by the caller alike.
ORDER_PLACES = 9


@dataclass
class ItemModel:
    """A fitted ALS model and the tables of its ordinals: (item, item_id), (user, user_id)."""

    als: object
    ids: DataFrame
    people: DataFrame

    @property
    def rank(self) -> int:
        return self.als.rank

    @property
    def userFactors(self) -> DataFrame:  # noqa: N802  (MLlib's name)
        return self.als.userFactors

    @property
    def itemFactors(self) -> DataFrame:  # noqa: N802
        return self.als.itemFactors

    def named(self, df: DataFrame, item: str = "item") -> DataFrame:
        """``df`` with item ordinals replaced by ``item_id``."""
        return df.join(self.ids.withColumnRenamed("item", item), item).drop(item)

    def named_users(self, df: DataFrame, user: str = "user") -> DataFrame:
        """``df`` with user ordinals replaced by ``user_id``."""
        return df.join(self.people.withColumnRenamed("user", user), user).drop(user)

    def save(self, path: str) -> None:
        """Write model and id tables below ``path``."""
        self.als.write().overwrite().save(f"{path}/als")
        self.ids.write.mode("overwrite").parquet(f"{path}/ids")
        self.people.write.mode("overwrite").parquet(f"{path}/people")

    @staticmethod
    def load(spark, path: str) -> "ItemModel":
        from pyspark.ml.recommendation import ALSModel
        return ItemModel(ALSModel.load(f"{path}/als"), spark.read.parquet(f"{path}/ids"), spark.read.parquet(f"{path}/people"))


def als_train(ratings: DataFrame, rank: int = RANK, max_iter: int = MAX_ITER, reg: float = REG, seed: int = SEED):
    """Fit ALS (non-negative, cold-start rows dropped) on an 80/20 split;
    returns (model, rmse on the held-out 20 %, train rows, test rows).
    ``user_id`` is any long, ``item_id`` any string: both are numbered for MLlib,
    which takes 32-bit ids."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.recommendation import ALS

    from marquee.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(ratings.sparkSession)
    rated = ratings.select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("string").alias("item_id"),
                           F.col("score").cast("float").alias("rating")).filter(F.col("item_id").isNotNull() & F.col("user_id").isNotNull())
    people = dense_ids(rated.select("user_id").distinct(), "user_id", "user").withColumn("user", F.col("user").cast("int"))
    ids = dense_ids(rated.select("item_id").distinct(), "item_id", "item").withColumn("item", F.col("item").cast("int"))
    split = F.pmod(F.xxhash64("user_id", "item_id", F.lit(seed)), F.lit(1000)) < int(TRAIN_FRACTION * 1000)
    data = rated.join(ids, "item_id").join(people, "user_id").withColumn("held_in", split).persist()
    train, test = data.filter("held_in"), data.filter("not held_in")
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, nonnegative=True, coldStartStrategy="drop",
              userCol="user", itemCol="item", ratingCol="rating", seed=seed, checkpointInterval=5)
    model = als.fit(train)
    pred = model.transform(test)
    rmse = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction").evaluate(pred)
    counts = train.count(), test.count()
    data.unpersist()
    return ItemModel(model, ids, people), rmse, *counts


def model_info(model, rmse: float, n_train: int, n_test: int) -> DataFrame:
    """One row describing the trained model."""
    spark = model.userFactors.sparkSession
    users = model.userFactors.count()
    items = model.itemFactors.count()
    return spark.createDataFrame(
        [("trained", "ALS (Spark MLlib)", model.rank, users, items, float(round(rmse, 4)), n_train, n_test)],
        "status string, algorithm string, rank int, n_users long, n_items long, rmse double, "
        "n_train long, n_test long")


def item_factors(model) -> DataFrame:
    """(item_id, features) with string ids like the catalogue."""
    return model.named(model.itemFactors, "id").select("item_id", "features")


def _block_scores(keep_top: int | None, min_sim: float | None):
    def run(seeds: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        cols = {"seed": [], "item_id": [], "sim": []}
        if seeds.empty or cands.empty:
            return pd.DataFrame(cols)
        a = np.stack(seeds["sfeat"].to_numpy()).astype(np.float64)
        b = np.stack(cands["cfeat"].to_numpy()).astype(np.float64)
        na = np.linalg.norm(a, axis=1)
        nb = np.linalg.norm(b, axis=1)
        sims = (a @ b.T) / (na[:, None] * nb[None, :] + EPS)
        cid = cands["item_id"].to_numpy()
        for i, sid in enumerate(seeds["seed"].to_numpy()):
            if na[i] == 0:
                continue  # a zero-length seed vector has no neighbours
            row = sims[i]
            mask = cid != sid
            if min_sim is not None:
                mask &= row > min_sim
            idx = np.nonzero(mask)[0]
            if keep_top is not None and len(idx) > keep_top:
                # best keep_top by (rounded sim desc, id asc), the caller's order
                near = np.floor(row[idx] * 10.0**ORDER_PLACES + 0.5)
                order = np.lexsort((cid[idx], -near))[:keep_top]
                idx = idx[order]
            cols["seed"].extend([sid] * len(idx))
            cols["item_id"].extend(cid[idx].tolist())
            cols["sim"].extend(row[idx].tolist())
        return pd.DataFrame(cols)
    return run


def factor_cosine(factors: DataFrame, seeds: DataFrame, keep_top: int | None = None,
                  min_sim: float | None = None, block: int = BLOCK, seed_block: int = SEED_BLOCK) -> DataFrame:
    """(seed, item_id, sim): cosine of item factors with +1e-8 in the
    denominator, seed excluded; per block only sims > ``min_sim`` and/or each
    seed's ``keep_top`` best are emitted."""
    def blocks(n, size):
        return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")

    wanted = seeds.select("seed").distinct()
    n_blocks = blocks(factors.select(F.count(F.lit(1))).scalar(), block)
    n_seeds = blocks(wanted.select(F.count(F.lit(1))).scalar(), seed_block)
    cands = factors.select("item_id", F.col("features").alias("cfeat"),
                           F.pmod(F.xxhash64("item_id"), n_blocks).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), n_seeds - 1)).alias("sblock"))
    sv = (wanted.join(factors.select(F.col("item_id").alias("seed"), F.col("features").alias("sfeat")), "seed")
          .select("seed", "sfeat", F.pmod(F.xxhash64("seed"), n_seeds).cast("int").alias("sblock"),
                  F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")))
    return (sv.groupBy("block", "sblock").cogroup(cands.groupBy("block", "sblock"))
            .applyInPandas(_block_scores(keep_top, min_sim), "seed string, item_id string, sim double"))


def weighted_cosine(factors: DataFrame, seeds: DataFrame, min_sim: float, block: int = BLOCK,
                    user_block: int = USER_BLOCK) -> DataFrame:
    """(user_id, item_id, s): per user of ``seeds(user_id, seed, weight)`` the sum of weight x cosine
    (``factor_cosine``'s, above ``min_sim``) over the seeds, as a share of the user's greatest sum.

    A block of users with all their seeds meets a block of films in one task, so sums are whole
    when they leave it. They are made twice, first for the maxima only, instead of being written."""
    ensure_checkpoint_dir(factors.sparkSession)
    factors = factors.select("item_id", "features").checkpoint()
    own = seeds.join(factors.select(F.col("item_id").alias("seed"), F.col("features").alias("sfeat")), "seed").checkpoint()
    nu = max(1, -(-own.select("user_id").distinct().count() // user_block))
    nb = max(1, -(-factors.count() // block))

    def met(people: DataFrame, run, schema: str) -> DataFrame:
        left = people.withColumn("ublock", F.pmod(F.xxhash64("user_id"), F.lit(nu)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
        right = factors.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(nb)).cast("int")).withColumn(
            "ublock", F.explode(F.sequence(F.lit(0), F.lit(nu - 1))))
        return left.groupBy("ublock", "block").cogroup(right.groupBy("ublock", "block")).applyInArrow(run, schema)

    def sums(left: pa.Table, right: pa.Table):
        """Per user of the block: the sums for the films of the block and which of them have one."""
        if not (left.num_rows and right.num_rows):
            return
        left = left.sort_by([("user_id", "ascending"), ("seed", "ascending")])
        a, b = (np.stack(t.column(c).to_numpy()).astype(np.float64) for t, c in ((left, "sfeat"), (right, "features")))
        na, nb_ = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        weight, user = left.column("weight").to_numpy(), left.column("user_id").to_numpy()
        at = {name: i for i, name in enumerate(right.column("item_id").to_pylist())}
        itself = np.array([at.get(x, -1) for x in left.column("seed").to_pylist()])
        for rows in np.split(np.arange(len(user)), np.flatnonzero(user[1:] != user[:-1]) + 1):
            sims = (a[rows] @ b.T) / (na[rows, None] * nb_[None, :] + EPS)
            sims[(sims <= min_sim) | (na[rows] == 0)[:, None]] = 0.0
            here = np.flatnonzero(itself[rows] >= 0)
            sims[here, itself[rows[here]]] = 0.0
            yield user[rows[0]], weight[rows] @ sims, (sims > 0).any(axis=0)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(user, s[ok].max()) for user, s, ok in sums(left, right) if ok.any()]
        return pa.table({"user_id": pa.array([u for u, _ in got], pa.int64()), "top": pa.array([t for _, t in got], pa.float64())})

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        users, items, values = [], [], []
        top = dict(zip(left.column("user_id").to_pylist(), left.column("top").to_pylist())) if left.num_rows else {}
        for user, s, ok in sums(left, right):
            hit = np.flatnonzero(ok)
            users.append(np.full(len(hit), user))
            items.append(hit)
            values.append(s[hit] / top[user])
        if not users:
            return pa.table({"user_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.string()), "s": pa.array([], pa.float64())})
        ids = right.column("item_id").combine_chunks().take(pa.array(np.concatenate(items)))
        return pa.table({"user_id": pa.array(np.concatenate(users), pa.int64()), "item_id": ids, "s": pa.array(np.concatenate(values))})

    tops = met(own, best, "user_id long, top double").groupBy("user_id").agg(F.max("top").alias("top")).checkpoint()
    return met(own.join(tops, "user_id"), scored, "user_id long, item_id string, s double")


def als_similar_items(factors: DataFrame, seeds: DataFrame, items_by_id: DataFrame, n: int = SIMILAR_TOP) -> DataFrame:
    """Each seed's ``n`` most similar films by factor cosine (> 0, 3 places)."""
    s = factor_cosine(factors, seeds, keep_top=n, min_sim=0.0)
    t = top_k(s, n, [round_half_up("sim", ORDER_PLACES).desc(), F.col("item_id").asc()], partition=["seed"])
    info = items_by_id.select(F.col("id").alias("item_id"), "title", "rating")
    return t.join(info, "item_id", "left").select("seed", "rk", "item_id", "title", "rating",
                                                  round_half_up("sim", 3).alias("similarity"))


def best_films(people: DataFrame, films: DataFrame, n: int, block: int = TOP_BLOCK, user_block: int = TOP_USERS) -> DataFrame:
    """(user_id, item_id, score, rk): the ``n`` best films of each of ``people(user_id, features)`` by the inner product with
    ``films(item_id, features)``, ties by id.

    A block of users meets a block of films in one task. Scores are made in single precision; of every ``TOP_GROUP`` of
    them only the greatest is compared, since the n-th greatest of these is no more than the user's n-th best score. What
    reaches it, less the error of single precision, is scored again in double precision."""
    spark = people.sparkSession
    n_people, parts = people.count(), int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    nu = max(1, -(-n_people // user_block), min(parts, -(-n_people // 1024)))
    nb = max(1, -(-films.count() // block))
    left = people.select("user_id", "features", F.pmod(F.xxhash64("user_id"), F.lit(nu)).cast("int").alias("ublock"),
                         F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("block"))
    right = films.select("item_id", "features", F.pmod(F.xxhash64("item_id"), F.lit(nb)).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(nu - 1))).alias("ublock"))

    def vectors(t: pa.Table) -> np.ndarray:
        c = t.column("features").combine_chunks()
        return c.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(t.num_rows, -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        who, which, score = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("item_id")
            a, b = vectors(left), vectors(right)
            norms = np.linalg.norm(b.astype(float), axis=1).max()
            groups, n_films = -(-len(b) // TOP_GROUP), len(b)
            b = np.concatenate([b, np.repeat(b[-1:], groups * TOP_GROUP - n_films, axis=0)])  # whole groups, by the last film again
            wide, by_group = np.ascontiguousarray(b.T), b.reshape(groups, TOP_GROUP, -1)
            some = max(1, TOP_SCORES // TOP_USERS_AT_ONCE // TOP_GROUP)  # groups scored at once
            for at in range(0, len(a), TOP_USERS_AT_ONCE):
                part = a[at:at + TOP_USERS_AT_ONCE]
                top = np.empty((len(part), groups), np.float32)
                for g in range(0, groups, some):
                    s = part @ wide[:, g * TOP_GROUP:(g + some) * TOP_GROUP]
                    s.reshape(len(part), -1, TOP_GROUP).max(axis=2, out=top[:, g:g + some])
                kth = np.partition(top, groups - n, axis=1)[:, groups - n] if groups > n else np.full(len(part), -np.inf)
                # a sum of d products in single precision is off by less than 2 d eps |a| |b|
                low = kth - 2 * b.shape[1] * np.finfo(np.float32).eps * np.linalg.norm(part, axis=1) * norms
                u, g = np.nonzero(top >= low[:, None])
                # groups that may hold one of the best, some at a time
                ut, ft = [], []
                for i in range(0, len(u), 4096):
                    s = np.matmul(by_group[g[i:i + 4096]], part[u[i:i + 4096], :, None])[:, :, 0]
                    k, inside = np.nonzero(s >= low[u[i:i + 4096], None])
                    ut.append(u[i:i + 4096][k])
                    ft.append(g[i:i + 4096][k] * TOP_GROUP + inside)
                u, film = np.concatenate(ut), np.concatenate(ft)
                real = film < n_films
                u, film = u[real], film[real]
                exact = np.einsum("ij,ij->i", part[u].astype(float), b[film].astype(float)).astype(np.float32)
                by = np.lexsort((film, -exact, u))
                first = np.searchsorted(u[by], np.arange(len(part)))
                keep = by[np.arange(len(by)) - first[u[by]] < n]
                who.append(at + u[keep])
                which.append(film[keep])
                score.append(exact[keep])
        if not who:
            return pa.table({"user_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.string()), "score": pa.array([], pa.float32())})
        take = lambda t, c, rows: t.column(c).combine_chunks().take(pa.array(np.concatenate(rows)))
        return pa.table({"user_id": take(left, "user_id", who), "item_id": take(right, "item_id", which), "score": pa.array(np.concatenate(score))})

    got = (left.groupBy("ublock", "block").cogroup(right.groupBy("ublock", "block"))
           .applyInArrow(best, "user_id long, item_id string, score float"))
    return top_k(got, n, [F.col("score").desc(), F.col("item_id").asc()], partition=["user_id"])


def als_recommend_users(model, n: int = SIMILAR_TOP, seen: DataFrame | None = None) -> DataFrame:
    """Top ``n`` films per user by predicted score, in blocks of users and films;
    optionally without films the user already rated (MLlib's top-k of each)."""
    def lists(recs: DataFrame) -> DataFrame:
        e = recs.select("user", F.explode("recommendations").alias("r"))
        return model.named_users(model.named(e.select("user", F.col("r.item").alias("item"), F.col("r.rating").alias("score"))))

    if seen is None:
        people = model.named_users(model.userFactors, "id").select("user_id", "features")
        return best_films(people, item_factors(model), n).select("score", "item_id", "user_id", "rk")
    else:
        # a user who has seen s films needs n + s predictions: users go by the power of two above s
        rated = seen.select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("string").alias("item_id")).distinct()
        seen_by = rated.join(model.people, "user_id")
        known = model.userFactors.select(F.col("id").alias("user"))
        many = (known.join(seen_by.groupBy("user").agg(F.count(F.lit(1)).alias("s")), "user", "left")
                .select("user", F.ceil(F.log2(F.coalesce("s", F.lit(0)) + 1)).cast("int").alias("p")).persist())
        steps = sorted(r["p"] for r in many.select("p").distinct().collect())  # at most 64
        parts = [lists(model.als.recommendForUserSubset(many.filter(F.col("p") == p).select("user"), n + (1 << p))) for p in steps]
        e = parts[0] if parts else lists(model.als.recommendForAllUsers(n))
        for more in parts[1:]:
            e = e.unionByName(more)
        e = e.join(rated, ["user_id", "item_id"], "left_anti")
    return top_k(e, n, [F.col("score").desc(), F.col("item_id").asc()], partition=["user_id"])


def recommend_all(content_recs: DataFrame, als_recs: DataFrame) -> DataFrame:
    """Content-based and ALS lists of a film as one tagged table."""
    c = content_recs.select("seed", "rk", F.col("id").alias("item_id"), "similarity",
                            F.lit("content").alias("method"))
    a = als_recs.select("seed", "rk", "item_id", "similarity", F.lit("als").alias("method"))
    return c.unionByName(a)
