"""Deletions and cascades against a simulated database, in batch and as a stream."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import deletes as D

T0 = datetime.datetime(2024, 1, 1)
PARENTS = {t.name: t.parents for t in D.TABLES}
MAY = {t.name: t.may for t in D.TABLES}
TOGGLES = {t.name for t in D.TABLES if t.toggle}


def row(entity, op, record, at, user=None, review=None, actor=None, value=None):
    return (entity, op, str(record), user, review, actor, value, T0 + datetime.timedelta(seconds=at), 0, at, 0)


def random_log(seed, n=500):
    r, out = random.Random(seed), []
    for u in range(1, 7):
        out.append(row("user", "put", u, 0, user=u, value=f"n{u}")[:9] + (u, 0))
    for at in range(1, n):
        entity = r.choice(["user", "rating", "review", "like", "favorite", "history", "liked_person", "review_like", "reply"])
        u, film, review = r.randrange(1, 8), r.choice("abc"), r.randrange(10, 16)
        asks = r.randrange(1, 8)
        record = {"user": u, "review": review, "reply": r.randrange(30, 36)}.get(entity, f"{u}:{film}")
        if entity == "review":
            u = review % 6 + 1  # a review has one author
        if entity == "reply":
            u, review = int(record) % 6 + 1, 10 + int(record) % 6
        if entity == "review_like":
            record = f"{u}:{review}"
        if MAY[entity] and r.random() < (0.12 if entity == "user" else 0.4):
            out.append(row(entity, "delete", record, at, actor=asks))
        elif entity != "user" or r.random() < 0.5:
            op = "toggle" if entity in TOGGLES else "put"
            out.append(row(entity, op, record, at, user=u, review=review if len(PARENTS[entity]) > 1 else None, value=str(at)))
    return out


def simulated(log, admins):
    alive = {t.name: {} for t in D.TABLES}  # record -> rows of this life

    def kill(entity, record):
        if alive[entity].pop(record, None) is None:
            return
        for child, parents in PARENTS.items():
            for column, parent in parents:
                if parent == entity:
                    at = 3 if column == "user_id" else 4
                    for rec in [k for k, rows in alive[child].items() if str(rows[-1][at]) == record]:
                        kill(child, rec)

    for x in sorted(log, key=lambda x: x[7:]):
        entity, op, record, user, review, actor = x[:6]
        if op == "delete":
            if record in alive[entity]:
                owner = alive[entity][record][0][3]
                if ("owner" in MAY[entity] and actor == owner) or ("admin" in MAY[entity] and actor in admins
                                                                   and (entity != "user" or str(actor) != record)):
                    kill(entity, record)
        elif all(str(user if c == "user_id" else review) in alive[p] for c, p in PARENTS[entity]):
            alive[entity].setdefault(record, []).append(x)
    return {(e, rec, rows[-1][3], rows[-1][4], rows[-1][6], rows[0][7], rows[-1][7]) for e, recs in alive.items() for rec, rows in recs.items()
            if e not in TOGGLES or len(rows) % 2}


def admins_of(spark):
    return spark.createDataFrame([(1,), (2,)], "actor long")


@pytest.mark.parametrize("seed", range(4))
def test_batch_is_the_simulated_database(spark, seed):
    log = random_log(seed)
    got = {tuple(r) for r in D.surviving(spark.createDataFrame(log, D.LOG), admins_of(spark)).collect()}
    want = simulated(log, {1, 2})
    assert got == want and {e for e, *_ in want} >= {"user", "rating", "review", "history", "like"}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_stream_gives_the_state_of_the_batch(spark, tmp_path, batches):
    log = sorted(random_log(9, 400), key=lambda x: x[7:])
    src, out, ckpt = (str(tmp_path / x) for x in ("log", "out", "ckpt"))
    for i in range(batches):
        part = log[i * len(log) // batches:(i + 1) * len(log) // batches]
        spark.createDataFrame(part, D.LOG).coalesce(1).write.mode("append").parquet(src)
        state = D.stream_deletes(spark, src, admins_of(spark), out, ckpt)
    assert {tuple(r) for r in state.collect()} == simulated(log, {1, 2})


def test_rights_and_new_lives(spark):
    log = [row("user", "put", u, 0, user=u)[:9] + (u, 0) for u in (1, 2, 3, 4)] + [
        row("review", "put", 10, 1, user=3), row("reply", "put", 30, 2, user=4, review=10), row("review_like", "toggle", "4:10", 3, user=4, review=10),
        row("review", "delete", 10, 4, actor=4),    # neither owner nor admin
        row("reply", "delete", 30, 5, actor=1),     # an admin may not delete a reply
        row("rating", "put", "4:a", 6, user=4, value="5"), row("rating", "delete", "4:a", 7, actor=1),
        row("user", "delete", 2, 8, actor=2),       # not oneself
        row("user", "delete", 4, 9, actor=1),       # takes reply, like and rating
        row("user", "put", 4, 10, user=4), row("rating", "put", "4:a", 11, user=4, value="7"),
        row("review", "delete", 10, 12, actor=1), row("reply", "put", 31, 13, user=3, review=10)]  # no review to reply to
    got = {(r.entity, r.record): r.value for r in D.surviving(spark.createDataFrame(log, D.LOG), admins_of(spark)).collect()}
    assert got == {("user", "1"): None, ("user", "2"): None, ("user", "3"): None, ("user", "4"): None, ("rating", "4:a"): "7"}


def test_rows_meet_their_requests_in_one_move(spark):
    """A table's rows move once by record for owners, deaths and lives together, without a copy of the order columns."""
    log = spark.createDataFrame([], D.LOG)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = D.surviving_rows(log, spark.createDataFrame([], "actor long"))["user"]
        plan = rows.groupBy("record").agg(F.min(D._order()).alias("since"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning(record") == 1 and "_o" not in rows.columns
