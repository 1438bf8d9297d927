"""Viewing report: lists of names move whole to a user's partition, liked names, repeats and records of one id."""
import random
from collections import defaultdict

from pyspark.sql import functions as F

from marquee.operators import viewing as V


def _tables(spark):
    rnd = random.Random(5)
    names = [f"p{i:02d}" for i in range(45)]
    items = [(f"i{k % 25}", k, rnd.choices(names, k=rnd.randint(0, 3)), rnd.choices(names, k=rnd.randint(0, 30))) for k in range(30)]
    weights = [(u, f"i{k}", rnd.choice([15, 40, 100])) for u in range(8) for k in rnd.sample(range(27), 9)]
    liked = [(u, n, role) for u in range(6) for role in ("director", "actor") for n in rnd.sample([*names, "nobody"], 4 * u)]
    return (items, weights, liked,
            spark.createDataFrame(items, "id string, ord long, directors array<string>, all_actors array<string>").selectExpr(
                "*", "all_actors genres", "'' country_raw", "2000 year"),
            spark.createDataFrame(weights, "user_id long, item_id string, w_c long"),
            spark.createDataFrame(liked, "user_id long, person_name string, person_type string"))


def _sums(items, weights, at: int) -> dict:
    got = defaultdict(lambda: defaultdict(int))
    for u, i, w in weights:
        for rec in items:
            if rec[0] == i:
                for n in rec[at]:
                    got[u][n] += w
    return got


def test_people_of_every_user(spark):
    items, weights, liked, it, w, lp = _tables(spark)
    for role, at in (("director", 2), ("actor", 3)):
        own = {(u, n) for u, n, r in liked if r == role}
        want = set()
        for u, sums in _sums(items, weights, at).items():
            ranked = sorted(sums.items(), key=lambda x: (-x[1], x[0]))
            cand = [(-((u, n) in own), -s, n) for k, (n, s) in enumerate(ranked, 1) if (u, n) in own or k <= V.PERSON_POOL]
            want |= {(u, n, int(-s / 10 + 0.5) / 10, -lk, k) for k, (lk, s, n) in enumerate(sorted(cand)[:V.TOP_N], 1)}
        assert {tuple(r) for r in V.report_people(it, w, lp, role).collect()} == want


def test_unique_names_and_what_is_moved(spark):
    items, weights, liked, it, w, lp = _tables(spark)
    users = spark.createDataFrame([(u,) for u in range(9)], "id long")
    r = spark.createDataFrame([(1, "i1", 4)], "user_id long, item_id string, score int")
    none = r.select("user_id", "item_id").limit(0)
    out = V.report_overview(users, it, w, r, none, none, none, lp, none)
    got = {x.user_id: (x.unique_directors, x.unique_actors) for x in out.collect()}
    d, a = _sums(items, weights, 2), _sums(items, weights, 3)
    assert got == {u: (len(d[u]), len(a[u])) for u in range(9)}


def test_names_are_not_moved_one_by_one(spark):
    it, w, lp = _tables(spark)[3:]
    users = spark.createDataFrame([(u,) for u in range(9)], "id long")
    none = w.select("user_id", "item_id", F.lit(4).alias("score")).limit(0)
    for out in (V.report_people(it, w, lp, "actor"), V.report_overview(users, it, w, none, none, none, none, lp, none)):
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        lines = plan.splitlines()
        explode = max(i for i, x in enumerate(lines) if "Generate " in x)
        # between the lists and the ranks no name is exchanged (the plan's root comes first)
        assert not any("Exchange hashpartitioning(user_id" in x and ("name" in x or "code" in x or " n#" in x) for x in lines[:explode])
