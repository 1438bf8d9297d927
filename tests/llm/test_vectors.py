"""Operators on vectors against numpy, and their defined edge cases."""
import numpy as np
import pytest

from marquee.llm import crosspolytope, itq

KIND = "vec_id long, vector array<float>, label int, key string, rep string, t string"


@pytest.fixture(scope="module")
def table(spark):
    def build(ids, x, labels):
        return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], k, "x", "x", "x")
                                      for i, v, k in zip(ids, x, labels, strict=True)], KIND)
    return build


def nearest(ids, x, every, k):
    x = np.asarray(x, np.float32).astype(float)
    for i, v in zip(ids, x):
        if i % every == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            yield i, [(ids[j], s[j]) for j in order]


def test_search_recall_on_random_directions(table):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(3000)
    found = {}
    for row in crosspolytope.search(table(ids.tolist(), x, [0] * 3000), every=20).collect():
        found.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    hits = 0
    for q, want in nearest(ids, x, 20, 20):
        assert sorted(found[q]) == list(range(1, 21))
        hits += len({v for v, _ in want} & {v for v, _ in found[q].values()})
        scores = [found[q][k][1] for k in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
    assert len(found) == 150 and hits >= 0.9 * 150 * 20


def test_search_with_norms_copies_and_few_rows(table):
    """Different norms (inner products, not angles), copies beyond k, all candidates if fewer; ties by id."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(60, 6)) * r.uniform(0.2, 4, (60, 1)), np.tile([[1, 2, 0, 0, 0, 3.0]], (50, 1))])
    ids = np.arange(110)
    got = {}
    for row in crosspolytope.search(table(ids.tolist(), x, [0] * 110), every=5, k=12, probes=16, block=7).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    for q, want in nearest(ids, x, 5, 12):
        mine = sorted(got[q])
        assert [v for _, v, _ in mine] == [v for v, _ in want]
        assert np.allclose([s for *_, s in mine], [s for _, s in want])
    few = crosspolytope.search(table([0, 1, 2], [[1, 0], [0.5, 0], [0.6, 0.1]], [0] * 3), probes=4)
    assert [(r.query_id, r["rank"], r.vec_id) for r in few.orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]


def recall(table, x, **how):
    """Share of the true neighbours found at production parameters; every list has to be full."""
    ids = list(range(len(x)))
    found = {}
    for row in crosspolytope.search(table(ids, x, [0] * len(x)), **how).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    hits = [len(found[q] & {v for v, _ in want}) / len(want) for q, want in nearest(ids, x, 20, 20)]
    assert all(len(v) == min(20, len(x) - 1) for v in found.values()) and len(found) == len(hits)
    return sum(hits) / len(hits)


@pytest.mark.parametrize("norms", ["outlier", "lognormal", "few longer", "one band"])
def test_search_recall_with_norms(table, norms):
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "outlier":
        x[7] *= 100
    elif norms == "lognormal":
        x *= r.lognormal(size=(len(x), 1))
    elif norms == "few longer":
        x[r.random(len(x)) < 0.02] *= 1.5
    else:
        x *= r.uniform(0.96, 1.04, (len(x), 1))
    assert recall(table, x) >= 0.95


@pytest.mark.parametrize("rows", [25, 100, 500, 2000])
def test_search_recall_on_small_tables_through_the_buckets(table, rows):
    x = np.random.default_rng(rows).normal(size=(rows, 64))
    tell = {}
    assert recall(table, x / np.linalg.norm(x, axis=1)[:, None], tell=tell) >= 0.9
    assert tell["bucket_pairs"] > 0 and (rows < 500 or tell["exact_pairs"] == 0)


def test_search_of_many_rows_scores_few_pairs(table):
    """50,000 vectors in clusters: recall through the buckets, with a small part of all pairs."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(1000, 64))
    x = (centres[r.integers(0, 1000, 50_000)] + 0.5 * r.normal(size=(50_000, 64))).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    found, tell = {}, {}
    for row in crosspolytope.search(table(list(range(50_000)), x, [0] * 50_000), every=500, tell=tell).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    hits = 0
    for q in range(0, 50_000, 500):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hits >= 0.9 * 100 * 20
    assert tell["bucket_pairs"] + tell["exact_pairs"] < 0.25 * 100 * 50_000


def test_digits_and_probes():
    assert [crosspolytope.digits_for(n, 128) for n in (0, 500, 10**6, 10**7, 10**9)] == [1, 1, 1, 2, 3]
    r = np.random.default_rng(0)
    loose = r.normal(size=(1500, 64))
    tight = np.repeat(r.normal(size=(100, 64)), 15, 0) + 0.1 * r.normal(size=(1500, 64))
    assert crosspolytope.measured_probes(tight, 10, 14, 1) < crosspolytope.measured_probes(loose, 10, 14, 1)


def test_search_completes_short_lists(table):
    """Buckets that hold too few: two opposite bundles, of which one is smaller than k, in a band that is hashed."""
    r = np.random.default_rng(8)
    x = np.concatenate([np.eye(64)[:1].repeat(8, 0), -np.eye(64)[:1].repeat(120, 0)]) + r.normal(size=(128, 64)) * 1e-3
    assert recall(table, x, probes=1, tables=2) >= 0.95


def test_search_edge_rows(table):
    rows = table([0, 20, 40, 60, 80, None, 100], [[1, 0], None, [0, 0], [None, 1], [float("nan"), 1], [1, 1], [1, 2]], [0] * 7)
    got = crosspolytope.search(rows, probes=4).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 100), (100, 0)}
    assert crosspolytope.search(rows.where("false")).count() == 0


def linked(x, labels, least=0.93):
    x = np.asarray(x, np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = (u @ u.T >= least) & (np.asarray(labels)[:, None] == np.asarray(labels)[None])
    np.fill_diagonal(s, False)
    low = np.arange(len(x))
    while True:
        now = np.minimum(low, np.where(s, low[None], len(x)).min(1))
        if (now == low).all():
            return s.sum(1), low
        low = now


def clusters(r, groups, size, near):
    out = []
    for _ in range(groups):
        c = r.normal(size=64)
        c /= np.linalg.norm(c)
        for _ in range(size):
            n = r.normal(size=64)
            n -= c * (n @ c)
            cos = r.uniform(*near)
            out.append(cos * c + np.sqrt(1 - cos * cos) * n / np.linalg.norm(n))
    return np.array(out)


def test_links_and_components_are_exact(table, monkeypatch):
    monkeypatch.setattr(itq, "ENTRIES", 16)
    monkeypatch.setattr(itq, "VISITS", 24)
    r = np.random.default_rng(3)
    x = np.concatenate([clusters(r, 40, 8, (0.97, 0.999)), r.normal(size=(300, 64)), clusters(r, 1, 120, (0.985, 0.999))])
    x = np.concatenate([x, x[:40]])  # equal vectors
    labels = r.integers(0, 2, len(x)).tolist()
    n, low = linked(x, labels)
    got = {q.vec_id: q for q in itq.near_duplicates(table(list(range(len(x))), x, labels)).collect()}
    assert n.sum() > 1000
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert [got[i].component_id for i in range(len(x))] == low.tolist()
    assert all(got[i].kept == (low[i] == i) for i in range(len(x)))


def test_tasks_and_pairs_held_are_bounded(table, monkeypatch):
    """A dense group's near pairs are looked at by parts, and blocks are dealt to as many tasks as their rows ask for."""
    r = np.random.default_rng(6)
    x = clusters(r, 3, 60, (0.985, 0.999))
    parts, held, written = [], [], itq.written

    def seen(df, name, *more):
        if name == "found":
            parts.append(df.rdd.getNumPartitions())
        return written(df, name, *more)

    monkeypatch.setattr(itq, "written", seen)
    monkeypatch.setattr(itq, "PAIRS", 100)
    monkeypatch.setattr(itq, "TASK_ROWS", 50)
    n, low = linked(x, [0] * len(x))
    got = {q.vec_id: q for q in itq.near_duplicates(table(list(range(len(x))), x, [0] * len(x))).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == list(zip(n.tolist(), low.tolist(), strict=True))
    assert parts[0] > 8
    u = x / np.linalg.norm(x, axis=1)[:, None]
    pairs = set()
    for i, j in itq._near(u, np.arange(60), np.arange(40), 0.9):
        held.append(len(i))
        pairs |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert max(held) <= 100 and pairs == set(zip(*(a.tolist() for a in np.nonzero(u[:60] @ u[:40].T >= 0.9 - 1e-9)), strict=True))


def test_recall_at_the_threshold(table):
    """Pairs of cosine 0.93 to 0.94, each pair far from all others."""
    r = np.random.default_rng(4)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = r.normal(size=a.shape)
    n -= a * (n * a).sum(1)[:, None]
    n /= np.linalg.norm(n, axis=1)[:, None]
    cos = r.uniform(0.9301, 0.94, (len(a), 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * n])
    found = itq.near_duplicates(table(list(range(len(x))), x, [0] * len(x))).where("n_links > 0").count()
    assert found >= 0.995 * len(x)


def test_embedding_edge_rows(table):
    rows = table([1, 2, 3, 4, 5, None, 7, 7], [[1, 0, 0, 0], [1, 0, 0, 0], None, [0, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0],
                                              [0, 1, 0, 0]], [1, 1, 1, 1, None, 1, 2, 2])
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(rows).collect()))
    assert got == [(0, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                   (7, 1, 7, True), (7, 1, 7, True)]
    assert itq.near_duplicates(rows.where("false")).count() == 0
