"""Louvain levels against a brute-force modularity, on a fixture."""
import numpy as np

from marquee.operators import communities as CM


def brute_modularity(edges, label):
    deg, m = {}, sum(w for *_, w in edges)
    for a, b, w in edges:
        deg[a] = deg.get(a, 0) + w
        deg[b] = deg.get(b, 0) + w
    q = sum(w for a, b, w in edges if label[a] == label[b]) / m
    for c in set(label.values()):
        q -= (sum(deg[n] for n in label if label[n] == c) / (2 * m)) ** 2
    return q


def planted(groups=6, films=25, attrs=5, seed=0):
    """Films of a group mostly share the group's attributes; one hub attribute joins everything."""
    r = np.random.default_rng(seed)
    out = {}
    for g in range(groups):
        for f in range(films):
            film = f"{g:02d}{f:03d}"
            for a in r.choice(attrs, 3, replace=False):
                out[film, f"actor:g{g}a{a}"] = 1.0
            out[film, f"actor:g{r.integers(groups)}a{r.integers(attrs)}"] = 1.0
            out[film, "country:all"] = 0.5
    return [(a, b, w) for (a, b), w in out.items()]


def test_levels_rise_and_match_brute_force(spark):
    edges = planted(3, 7, 3)
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    levels = []
    got = CM.louvain(df, levels)
    label = {r.node: r.community for r in got.collect()}
    assert set(label) == {n for a, b, _ in edges for n in (a, b)}
    qs = [q for *_, q in levels]
    assert levels and qs == sorted(qs) and qs[-1] > 0.3
    assert abs(brute_modularity(edges, label) - qs[-1]) < 1e-9 and abs(CM.modularity(df, got) - qs[-1]) < 1e-9
    assert all(label[c] == c and c == min(n for n in label if label[n] == c) for c in set(label.values()))


def test_no_edges_and_two_parts(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double")
    assert CM.louvain(none).collect() == []
    two = spark.createDataFrame([("1", "genre:a", 1.0), ("2", "genre:a", 1.0), ("3", "genre:b", 2.0)], "src string, dst string, weight double")
    label = {r.node: r.community for r in CM.louvain(two).collect()}
    assert label["1"] == label["2"] == label["genre:a"] == "1" and label["3"] == label["genre:b"] == "3"
