import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import catalogue as C
from marquee.operators import graph as G


def _graph(spark, raw_items):
    items = C.normalize_items(raw_items)
    e = G.graph_edges(items)
    return items, G.graph_nodes(items, e), e


def _numpy_pagerank(nodes, edges, rounds, alpha=0.85, p=None):
    idx = {n: i for i, n in enumerate(nodes)}
    n = len(nodes)
    w = np.zeros((n, n))
    for s, d, wt in edges:
        w[idx[s], idx[d]] += wt
        w[idx[d], idx[s]] += wt
    out = w.sum(axis=1)
    dangling = out == 0
    t = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    p = np.full(n, 1.0 / n) if p is None else p
    x = np.full(n, 1.0 / n)
    for _ in range(rounds):
        x = alpha * (x @ t + x[dangling].sum() * p) + (1 - alpha) * p
    return {nd: x[idx[nd]] for nd in nodes}


def test_pagerank_matches_power_iteration(spark, raw_items):
    items, nodes, edges = _graph(spark, raw_items)
    nl = [r.node for r in nodes.collect()]
    el = [(r.src, r.dst, r.weight) for r in edges.collect()]
    ref = _numpy_pagerank(nl, el, 15)
    got = {r.node: r.pagerank for r in G.pagerank(nodes, edges, max_iter=15, tol=None).collect()}
    assert set(got) == set(ref)
    assert abs(sum(got.values()) - 1.0) < 1e-9
    for k in ref:
        assert abs(got[k] - ref[k]) < 1e-12
    # film "10" has no attributes: isolated, still ranked
    assert "10" in got


def test_edge_weights_and_last_record(spark, raw_items):
    items, nodes, edges = _graph(spark, raw_items)
    e = {(r.src, r.dst): r.weight for r in edges.collect()}
    assert e[("1", "genre:A")] == 2.0          # rating 8.5 > 7.5
    assert e[("1", "director:Ann")] == 1.5
    assert ("1", "actor:Gus") not in e         # only the first five actors
    assert e[("2", "genre:A")] == 1.0


@pytest.mark.parametrize("width, tol", [(4, 1e-2)])
def test_push_stays_within_its_bound(spark, raw_items, width, tol):
    """0 <= exact - pushed <= slack * weighted degree, for every film as a seed."""
    items, nodes, edges = _graph(spark, raw_items)
    seeds = items.select(F.col("id").alias("seed")).distinct()
    nl = [r.node for r in nodes.collect()]
    el = [(r.src, r.dst, r.weight) for r in edges.collect()]
    degree = dict.fromkeys(nl, 0.0)
    for s, d, w in el:
        degree[s] += w
        degree[d] += w
    slack = tol / np.mean([w for w in degree.values() if w])
    restart = {}
    for r in G.restart_vectors(seeds, edges).collect():
        restart.setdefault(r.seed, {})[r.node] = r.p
    got = {}
    for r in G.personalized_pagerank(nodes, edges, seeds, tol=tol, width=width).collect():
        got.setdefault(r.seed, {})[r.node] = r.x
    assert set(got) == {r.seed for r in seeds.collect()}
    for seed, x in got.items():
        p = np.array([restart[seed].get(n, 0.0) for n in nl])
        ref = _numpy_pagerank(nl, el, 300, p=p)
        for node in nl:
            assert -1e-12 <= ref[node] - x.get(node, 0.0) <= slack * degree[node] + 1e-12
    assert got["10"] == {"10": 1.0}  # no edges: all mass stays
    if tol == 1e-2:  # the state holds pushed nodes only
        assert sum(map(len, got.values())) < len(got) * len(nl)


def test_hubs_are_split_over_the_partitions(spark):
    """One genre holds half of all films: no partition of the transitions exceeds three times the median."""
    n, parts = 4000, 8
    edges = spark.range(n).select(F.col("id").cast("string").alias("src"), F.explode(F.array(
        F.when(F.col("id") % 2 == 0, F.lit("genre:hub")).otherwise(F.concat(F.lit("genre:"), F.col("id"))),
        F.concat(F.lit("director:"), (F.col("id") * 7) % 900), F.concat(F.lit("actor:"), (F.col("id") * 13) % 1500))).alias("dst"),
        F.lit("BELONGS_TO").alias("relation"), F.lit(1.0).alias("weight"), F.lit(0).alias("pos"))
    trans, hubs = G.split_hubs(G._transitions(edges), edges.count(), parts)
    sizes = sorted(r["count"] for r in trans.repartition(parts, "src", "salt").groupBy(F.spark_partition_id()).count().collect())
    assert hubs.count() == 1 and len(sizes) == parts and sizes[-1] <= 3 * sizes[parts // 2]
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    el = [(r.src, r.dst, r.weight) for r in edges.collect()]
    got = {r.node: r.pagerank for r in G.pagerank(nodes, edges, max_iter=3, tol=None).collect()}
    idx = {k: i for i, k in enumerate(got)}
    deg = np.zeros(len(idx))
    a, b = np.array([idx[s] for s, _, _ in el]), np.array([idx[d] for _, d, _ in el])
    np.add.at(deg, np.concatenate([a, b]), 1)
    x = np.full(len(idx), 1 / len(idx))
    for _ in range(3):
        y = np.zeros(len(idx))
        np.add.at(y, b, x[a] / deg[a])
        np.add.at(y, a, x[b] / deg[b])
        x = 0.85 * y + 0.15 / len(idx)
    assert max(abs(got[k] - x[i]) for k, i in idx.items()) < 1e-12


def test_common_neighbors_symmetric_jaccard(spark, raw_items):
    items, nodes, edges = _graph(spark, raw_items)
    ib = C.items_by_id(items)
    a = {r.id: r.similarity for r in G.common_neighbors(ib, edges, spark.createDataFrame([("1",)], "seed string")).collect()}
    assert all(0 <= v <= 1 for v in a.values()) and "1" not in a


def test_shortest_path(spark, raw_items):
    items, nodes, edges = _graph(spark, raw_items)
    src = spark.createDataFrame([("3",)], "node string")
    tgt = spark.createDataFrame([("4",)], "node string")
    path = [r.node for r in G.shortest_path(nodes, edges, src, tgt).orderBy("pos").collect()]
    assert path[0] == "3" and path[-1] == "4" and len(path) == 3   # 3 -actor:Eve- 4
