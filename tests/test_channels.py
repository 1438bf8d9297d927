"""Channels that list every film: the same scores as plain loops, without a table of user x seed x film or sums per film."""
import random
from collections import defaultdict

import numpy as np
import pytest

from marquee.operators import als, content
from marquee.operators import profiles as H

R = random.Random(11)
GENRES = ["A", "B", "C", "D"]
ITEMS = [(k, f"i{k % 34}", R.choice(["red ring", "old bolt", "new gear"]), R.choices(GENRES, k=R.randint(0, 3))) for k in range(40)]
WEIGHTS = [(u, f"i{i}", R.randint(1, 9) / 10) for u in range(6) for i in R.sample(range(36), 14)]


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame(ITEMS, "ord long, id string, title string, genres array<string>"),
            spark.createDataFrame(WEIGHTS, "user_id long, item_id string, weight double"))


def _rows(df):
    got = [(r.user_id, r.item_id, r.s) for r in df.collect()]
    assert len({g[:2] for g in got}) == len(got)
    return {g[:2]: g[2] for g in got}


def _close(got, want):
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _seeds(n):
    by = defaultdict(list)
    for u, i, w in WEIGHTS:
        by[u].append((-w, i))
    return {u: [(i, -w) for w, i in sorted(rows)[:n]] for u, rows in by.items()}


def _share(sums):
    return {(u, i): s / max(v for (x, _), v in sums.items() if x == u) for (u, i), s in sums.items()}


def test_genre_lists_are_scored_once(spark, tables):
    prefs = [(u, g, R.randint(1, 9) / 10) for u in range(6) for g in R.sample(GENRES, 2)]
    info = spark.createDataFrame([(f"i{k}", x[3]) for k, x in enumerate(ITEMS)] + [("none", None)], "item_id string, genres array<string>")
    df = H.channel_genre(spark.createDataFrame(prefs, "user_id long, genre string, weight double"), info)
    want = {}
    for u in range(6):
        gw = {g: w for x, g, w in prefs if x == u}
        for k, x in enumerate(ITEMS):
            s = sum(gw.get(g, 0) / max(gw.values()) for g in x[3]) / max(1, len(x[3]))
            if s > 0:
                want[u, f"i{k}"] = s
    _close(_rows(df), want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no sum per user and film is exchanged
    assert not any("Exchange hashpartitioning(user_id" in x and "item_id" in x for x in plan.splitlines())


def test_content_by_classes_of_equal_texts(spark, tables, monkeypatch):
    items, weights = tables
    vec = defaultdict(dict)
    for r in content.tfidf(content.content_text(items)).collect():
        vec[r.doc][r.term] = r.w
    last = {x[1]: x[0] for x in ITEMS}
    sums = defaultdict(float)
    for u, seeds in _seeds(H.CONTENT_SEEDS).items():
        for seed, w in seeds:
            for k, i, *_ in ITEMS:
                sim = sum(v * vec[k].get(t, 0) for t, v in vec[last.get(seed, -1)].items())
                if sim > H.CONTENT_SIM_MIN:
                    sums[u, i] += w * sim
    monkeypatch.setattr(content, "cosine_for_targets", None)  # would make a row per target, film and common term
    _close(_rows(H.channel_content(weights, items)), _share(sums))


def test_cosine_in_blocks(spark, tables):
    vec = content.tfidf(content.content_text(tables[0])).localCheckpoint()
    targets = vec.select("doc").distinct().filter("doc % 3 = 0")
    key = lambda df: {(r.target, r.doc): r.sim for r in df.collect()}
    want = key(content.cosine_for_targets(vec, targets).filter("sim > 0.2"))
    got = key(content.cosine_above(vec, targets, 0.2, block=7))
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_als_sums_in_blocks(spark, tables, monkeypatch):
    r = np.random.default_rng(4)
    f = {f"i{k}": r.normal(size=5).astype(np.float32) * (k != 3) for k in range(30)}
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in f.items()], "item_id string, features array<float>")
    cos = lambda a, b: a.astype(float) @ b.astype(float) / (np.linalg.norm(a.astype(float)) * np.linalg.norm(b.astype(float)) + als.EPS)
    sums = defaultdict(float)
    for u, seeds in _seeds(H.ALS_SEEDS).items():
        for seed, w in seeds:
            for i, v in f.items():
                if seed in f and seed != i and f[seed].any() and cos(f[seed], v) > H.ALS_SIM_MIN:
                    sums[u, i] += w * cos(f[seed], v)
    monkeypatch.setattr(als, "factor_cosine", None)  # would make a row per seed and film
    _close(_rows(H.channel_als(tables[1], factors)), _share(sums))
    seeds = H.top_seeds(tables[1], H.ALS_SEEDS)
    _close(_rows(als.weighted_cosine(factors, seeds, H.ALS_SIM_MIN, block=7, user_block=2)), _share(sums))


@pytest.mark.parametrize("block, user_block", [(10**6, 10**6), (150, 7)])
def test_best_films_in_blocks(spark, block, user_block):
    r = np.random.default_rng(6)
    films = r.random((700, 5)).astype(np.float32)
    films[100:140], films[350:] = films[0], films[:350]  # equal films tie, the smaller id first
    people = r.random((25, 5)).astype(np.float32)
    people[3] = 0
    ids = [f"i{k}" for k in range(len(films))]
    got = als.best_films(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(people)], "user_id long, features array<float>"),
                         spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, films)], "item_id string, features array<float>"),
                         12, block=block, user_block=user_block)
    got = {(x.user_id, x.rk): (x.item_id, x.score) for x in got.collect()}
    want = {}
    for u, v in enumerate(people):
        s = (films.astype(float) @ v.astype(float)).astype(np.float32)
        for rk, k in enumerate(sorted(range(len(ids)), key=lambda k: (-s[k], ids[k]))[:12], 1):
            want[u, rk] = (ids[k], float(s[k]))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert got == want


def test_lists_of_all_users_do_not_go_through_mllib(spark):
    class Model:  # MLlib's model would have recommendForAllUsers here
        userFactors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id int, features array<float>")  # noqa: N815
        itemFactors = spark.createDataFrame([(0, [2.0, 1.0]), (1, [1.0, 3.0])], "id int, features array<float>")  # noqa: N815

    model = als.ItemModel(Model, spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, item int"),
                          spark.createDataFrame([(7, 0), (8, 1)], "user_id long, user int"))
    got = [(r.user_id, r.rk, r.item_id, r.score) for r in als.als_recommend_users(model, 1).collect()]
    assert sorted(got) == [(7, 1, "a", 2.0), (8, 1, "b", 3.0)]
