"""Communities of the film-attribute graph by modularity (G7 as intended, input of G9).

Louvain levels as DataFrames. A level starts with every node alone. In a round
each node's links are added up per neighbouring community (one join, one
partial aggregate) and its best move is the one of greatest modularity gain. All
nodes deciding at once could undo each other's gains, so a hashed half of them
moves, and a round counts only if the modularity of the whole partition rose:
it comes out of the next round's sums. Otherwise the round is taken back and a
smaller part moves, at last the one node that gains most, alone. When no move gains,
communities become the nodes of the next level (edges added up, inner weight as
loops), until a level changes nothing. Every round is a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import ensure_checkpoint_dir

#: Least rise of modularity that counts, and the smallest part of the nodes that moves at once (2**-n).
LEAST_GAIN, SMALLEST_PART = 1e-6, 3


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("w"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _moves(links: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """``node, k, c, inner, best, better``: each node's degree, community, weight of
    its links inside it (loops included), the community of its best move and what that gains."""
    to = links.join(state.select(F.col("node").alias("b"), F.col("c").alias("to")), "b")
    per = to.groupBy(F.col("a").alias("node"), "to").agg(
        F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0)).alias("w"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("loop"))
    # staying is always one of the choices
    per = per.unionByName(state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("w"), F.lit(0.0).alias("loop")))
    per = per.groupBy("node", "to").agg(F.sum("w").alias("w"), F.sum("loop").alias("loop"))
    size = state.groupBy("c").agg(F.sum("k").alias("size")).select(F.col("c").alias("to"), "size")
    own = F.col("to") == F.col("c")
    gain = F.col("w") - F.col("k") * (F.col("size") - F.when(own, F.col("k")).otherwise(0.0)) / F.lit(total)
    return (per.join(state, "node").join(size, "to")
            .groupBy("node", "k", "c")
            .agg(F.min(F.struct((-gain).alias("loss"), (~own).alias("away"), F.col("to"))).alias("m"),
                 F.sum(F.when(own, F.col("w") + F.col("loop")).otherwise(0.0)).alias("inner"), F.min(F.when(own, -gain)).alias("stay"))
            .select("node", "k", "c", "inner", F.col("m.to").alias("best"), (F.col("stay") - F.col("m.loss")).alias("better")))


def _modularity(step: DataFrame, total: float) -> float:
    inner = step.agg(F.sum("inner")).first()[0] or 0.0
    square = step.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    return inner / total - square / total ** 2


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Modularity of ``communities(node, community)`` on the undirected ``edges``."""
    e = _both_ways(edges)
    c = communities.select("node", F.col("community").alias("c"))
    k = e.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(c, "node")
    total = e.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    inner = (e.join(c.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a")
             .join(c.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").filter(F.col("ca") == F.col("cb"))
             .agg(F.sum("w")).first()[0] or 0.0)
    square = k.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return inner / total - square / total ** 2


def louvain(edges: DataFrame, tell: list | None = None) -> DataFrame:
    """``node, community`` for every node with an edge; a community is named by
    its smallest node. ``tell`` receives (level, communities, modularity)."""
    ensure_checkpoint_dir(edges.sparkSession)
    links = _both_ways(edges).checkpoint()
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("community")).limit(0)
    member, level, reached = None, 0, None
    while True:
        state = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node"))
        step = _moves(links, state, total).checkpoint()
        q, part, rounds, moved = _modularity(step, total), 1, 0, False
        while True:
            rounds += 1
            alone = part > SMALLEST_PART
            if alone:  # the best single move, which gains by itself
                top = step.filter(F.col("better") > LEAST_GAIN * total / 2).orderBy(F.desc("better"), "node").first()
                if top is None:
                    break
                moves = F.col("node") == F.lit(top["node"])
            else:
                moves = F.pmod(F.xxhash64("node", F.lit(rounds)), F.lit(1 << part)) == 0
            new = step.select("node", "k", F.when(moves, F.col("best")).otherwise(F.col("c")).alias("c"))
            after = _moves(links, new, total).checkpoint()
            risen = _modularity(after, total)
            if risen > q + LEAST_GAIN:
                step, q, moved = after, risen, True
                part = 1 if alone else max(1, part - 1)
            elif alone:
                break
            else:
                part += 1
        if not moved:
            break
        found = step.select("node", "c").checkpoint()
        member = found if member is None else member.join(found.select(F.col("node").alias("c"), F.col("c").alias("up")), "c").select(
            "node", F.col("up").alias("c")).checkpoint()
        level += 1
        if tell is not None:
            tell.append((level, found.select("c").distinct().count(), q))
        if reached is not None and q <= reached + LEAST_GAIN:
            break
        reached = q
        links = (links.join(found.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a")
                 .join(found.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
                 .groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")).checkpoint())
    if member is None:
        member = links.select(F.col("a").alias("node")).distinct().withColumn("c", F.col("node"))
    name = member.groupBy("c").agg(F.min("node").alias("community"))
    return member.join(name, "c").select("node", "community")
