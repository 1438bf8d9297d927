"""Film knowledge graph: edges, PageRank, personalised PageRank, common
neighbours, communities, shortest paths and graph statistics (G1-G14).

Graph = two DataFrames: ``nodes(node, type, name)`` and undirected
``edges(src, dst, relation, weight)`` (src = film, dst = '<kind>:<name>').

Iterative algorithms are DataFrame loops: one join + one partial/final
aggregate per round, a scalar aggregate as the only action per round, and a
reliable ``checkpoint()`` every few rounds to cut lineage (the folder comes
from ``spark.checkpoint.dir``). Hub nodes (a genre or country holding a large
share of all edges) are split by a salt on their neighbours in the loops over
all edges (``split_hubs``): their rows lie in many partitions, and the node's
value is copied once per salt. Per-destination sums are partial aggregates.
Personalised PageRank is a local push: its state holds the nodes that a
seed's restart mass reaches above a bound, not every node for every seed.

Pairwise scores (common neighbours, community, same-director) are computed
for a table of target films (``seeds``) -- the catalogue's item pages and the
user seeds of the hybrid recommender -- never for all film pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.agg import top_k
from marquee.functions.text import round_half_up

# Fixed values of the graph model.
GENRE_WEIGHT_HIGH, GENRE_WEIGHT_LOW, GENRE_HIGH_RATING = 2.0, 1.0, 7.5
DIRECTOR_WEIGHT = 1.5
ACTOR_WEIGHT = 1.0
COUNTRY_WEIGHT = 0.5
GRAPH_ACTORS = 5
ALPHA = 0.85
MAX_ITER = 100
TOL = 1e-6
RESTART_NEIGHBOURS = 20
PARTITION_EDGES = 200_000  # transitions of a partition in the loops
HUB_SHARE = 8      # a node with more than 1 / (HUB_SHARE * partitions) of all transitions is split
ORDER_PLACES = 12
PUSH_WIDTH = 16    # seeds that share one row per node in the push state
COMMUNITY_BUCKETS = 50
# relation -> (node prefix, rank of the relation in a film's neighbour order)
RELATIONS = {
    "BELONGS_TO": ("genre", 0),
    "DIRECTED_BY": ("director", 1),
    "ACTED_IN": ("actor", 2),
    "FROM_COUNTRY": ("country", 3),
}
ATTR_TYPES = {"genre": "Genre", "director": "Director", "actor": "Actor", "country": "Country"}


# ---------------------------------------------------------------------------
# G1 / G2 / G14
# ---------------------------------------------------------------------------
def graph_edges(items: DataFrame) -> DataFrame:
    """G1: film-attribute edges; a repeated edge keeps the weight of the last
    record (file order). ``pos`` = first list position (neighbour order)."""
    genre_w = F.when(F.col("rating") > GENRE_HIGH_RATING, F.lit(GENRE_WEIGHT_HIGH)).otherwise(F.lit(GENRE_WEIGHT_LOW))
    parts = [
        ("genres", "BELONGS_TO", genre_w),
        ("directors", "DIRECTED_BY", F.lit(DIRECTOR_WEIGHT)),
        ("top_actors", "ACTED_IN", F.lit(ACTOR_WEIGHT)),
        ("countries", "FROM_COUNTRY", F.lit(COUNTRY_WEIGHT)),
    ]
    out = None
    for col, rel, w in parts:
        prefix = RELATIONS[rel][0]
        arr = F.slice(col, 1, GRAPH_ACTORS) if col == "top_actors" else F.col(col)
        e = items.select("id", "ord", w.alias("weight"), F.posexplode(arr).alias("pos", "name")).select(
            F.col("id").alias("src"), F.concat(F.lit(prefix + ":"), F.col("name")).alias("dst"),
            F.lit(rel).alias("relation"), "weight", "ord", "pos")
        out = e if out is None else out.unionByName(e)
    return (out.groupBy("src", "dst", "relation")
            .agg(F.max_by("weight", "ord").alias("weight"), F.min("pos").alias("pos")))


def graph_nodes(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Film nodes (isolated films included; title of the last record)
    plus typed attribute nodes."""
    films = items.groupBy("id").agg(F.max_by("title", "ord").alias("name")).select(
        F.col("id").alias("node"), F.lit("Movie").alias("type"), "name")
    attrs = edges.select(F.col("dst").alias("node")).distinct()
    kind = F.split_part(F.col("node"), F.lit(":"), F.lit(1))
    type_col = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in ATTR_TYPES.items()])
    attrs = attrs.select("node", type_col.alias("type"),
                         F.expr("substring(node, instr(node, ':') + 1)").alias("name"))
    return films.unionByName(attrs)


def path_labels(nodes: DataFrame) -> DataFrame:
    """Node id -> lower-case type and display name."""
    return nodes.select("node", F.lower("type").alias("type"), "name")


# ---------------------------------------------------------------------------
# Power iteration
# ---------------------------------------------------------------------------
def _transitions(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge with w / (sum of the
    source's edge weights)."""
    und = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out_w = und.groupBy("src").agg(F.sum("weight").alias("_w"))
    return und.join(out_w, "src").select("src", "dst", (F.col("weight") / F.col("_w")).alias("p"))


def split_hubs(trans: DataFrame, n_edges: int, parts: int, share: int = HUB_SHARE) -> tuple[DataFrame, DataFrame]:
    """``trans`` with a ``salt`` that cuts the rows of a hub source into many
    keys, and the hubs ``(src, copies)``. A hub is a node with more than
    1 / (share * parts) of all transitions, so there are ``share * parts`` of
    them at most: the table is small whatever the graph's size."""
    limit = max(1, -(-2 * n_edges // (share * parts)))
    hubs = (trans.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
            .select("src", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("copies")))
    salt = F.pmod(F.xxhash64("dst"), F.coalesce("copies", F.lit(1))).cast("int")
    return trans.join(F.broadcast(hubs), "src", "left").withColumn("salt", salt).drop("copies"), hubs


def copied(state: DataFrame, hubs: DataFrame) -> DataFrame:
    """Rows of ``state(src, ...)`` once per salt of their node."""
    salts = F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)
    return state.join(F.broadcast(hubs), "src", "left").withColumn("salt", F.explode(salts)).drop("copies")


def _checkpoint(df: DataFrame, i: int = 1, every: int = 1) -> DataFrame:
    """Materialise one round of an iteration with a reliable checkpoint to
    the shared ``spark.checkpoint.dir``: it truncates both the logical plan
    (which otherwise grows with every round and every self-reference) and the
    RDD lineage, and a lost executor costs only the rounds since the last
    checkpoint. With ``every`` > 1 the rounds in between are only cached
    (computed by the next round's job), so ``every`` rounds share one write."""
    from pyspark import StorageLevel

    from marquee.session import ensure_checkpoint_dir
    if every > 1 and i % every != 0:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    ensure_checkpoint_dir(df.sparkSession)
    # persist first so that writing the checkpoint does not recompute the round
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def _partitions(spark, n_edges: int) -> int:
    """Partitions of a loop's tables: by the number of transitions, at most the session's."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-2 * n_edges // PARTITION_EDGES)))


def _placed(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Hash partitions, or a single one, in which joins and aggregates need no exchange at all."""
    return df.repartition(1) if parts == 1 else df.repartition(parts, *keys)


def _release(*dfs) -> None:
    for d in dfs:
        if d is not None:
            d.unpersist()


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA, max_iter: int = MAX_ITER,
             tol: float | None = TOL, checkpoint_every: int = 2) -> DataFrame:
    """Weighted PageRank on the undirected graph (each edge both ways),
    uniform start and restart, dangling mass spread uniformly. Stops when the
    L1 change is below N * tol (tol=None: exactly ``max_iter`` rounds).
    Returns (node, pagerank, rounds)."""
    spark = nodes.sparkSession
    # The transition table is hash-partitioned on the source and its salt once
    # and cached, so the per-round join does not move the edges -- only the
    # rank vector (a hub once per salt) and the per-destination partial sums.
    n_edges = edges.count()
    parts = _partitions(spark, n_edges)
    trans, hubs = split_hubs(_transitions(edges), n_edges, parts)
    hubs = _checkpoint(hubs)
    trans = _placed(trans, parts, "src", "salt").persist()
    v = _placed(nodes.select("node").distinct(), parts, "node").persist()
    n = v.count()
    if n == 0:
        return v.select("node", F.lit(0.0).alias("pagerank"), F.lit(0).alias("rounds"))
    has_out = trans.select(F.col("src").alias("node")).distinct()
    dangling = v.join(has_out, "node", "left_anti").persist()
    x = _checkpoint(v.select("node", F.lit(1.0 / n).alias("x")), 1, 0)
    rounds = 0
    for i in range(1, max_iter + 1):
        contrib = (trans.join(copied(x.withColumnRenamed("node", "src"), hubs), ["src", "salt"])
                   .groupBy("dst").agg(F.sum(F.col("p") * F.col("x")).alias("c")))
        # dangling mass as a scalar subquery: the generated code stays the
        # same every round (a changing literal would force a recompile)
        dmass = x.join(dangling, "node").select(F.coalesce(F.sum("x"), F.lit(0.0))).scalar()
        new = (v.join(contrib.withColumnRenamed("dst", "node"), "node", "left")
               .select("node", (F.lit(alpha) * (F.coalesce("c", F.lit(0.0)) + dmass / F.lit(float(n)))
                                + F.lit((1.0 - alpha) / n)).alias("x")))
        # the last round is always a reliable checkpoint (see the end of the loop for an early stop)
        new = _checkpoint(new, checkpoint_every if i == max_iter else i, checkpoint_every)
        rounds = i
        err = None
        if tol is not None:
            err = (new.join(x.withColumnRenamed("x", "x0"), "node")
                   .agg(F.sum(F.abs(F.col("x") - F.col("x0")))).collect()[0][0])
        _release(x)
        x = new
        if err is not None and err < n * tol:
            if checkpoint_every > 1 and i % checkpoint_every:
                x = _checkpoint(x)
            break
    # the result is a reliable checkpoint: the cached inputs can go
    _release(trans, v, dangling)
    return x.select("node", F.col("x").alias("pagerank"), F.lit(rounds).alias("rounds"))


def restart_vectors(seeds: DataFrame, edges: DataFrame, k: int = RESTART_NEIGHBOURS) -> DataFrame:
    """Restart distribution of each seed film: 0.5 on the film and 0.5 shared
    by its first ``k`` neighbours (relation order, then list position),
    normalised to sum 1. Returns (seed, node, p)."""
    from pyspark.sql import Window
    rank = F.coalesce(*[F.when(F.col("relation") == r, F.lit(i)) for r, (_, i) in RELATIONS.items()])
    nb = (edges.join(seeds.select(F.col("seed").alias("src")), "src")
          .select(F.col("src").alias("seed"), F.col("dst").alias("node"), rank.alias("rr"), "pos"))
    w = Window.partitionBy("seed")
    nb = (nb.withColumn("deg", F.count(F.lit(1)).over(w))
          .withColumn("rn", F.row_number().over(w.orderBy("rr", "pos", "node")))
          .filter(F.col("rn") <= k)
          .select("seed", "node", (F.lit(0.5) / F.least(F.lit(k), F.col("deg"))).alias("p")))
    own = seeds.select("seed", F.col("seed").alias("node"), F.lit(0.5).alias("p"))
    allp = own.unionByName(nb)
    tot = allp.groupBy("seed").agg(F.sum("p").alias("_t"))
    return allp.join(tot, "seed").select("seed", "node", (F.col("p") / F.col("_t")).alias("p"))


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA,
                          tol: float = TOL, max_rounds: int | None = None, width: int = PUSH_WIDTH,
                          checkpoint_every: int = 4) -> DataFrame:
    """G6 for a table of seed films at once, by local push: (seed, node, x).

    Each seed has an estimate x and a residual r per node, at first r = its
    restart vector. A round pushes every node with r >= slack * W (W the
    node's weighted degree): (1 - alpha) r goes to its estimate and alpha r to
    its neighbours' residuals. The loop ends when no node is left to push, so
    ``0 <= x* - x <= slack * W`` at every node, with x* the exact solution and
    slack = ``tol`` / mean weighted degree. A push at a node takes at least
    (1 - alpha) * slack * W off a residual of 1 in total, so the degrees of all
    pushed nodes add up to 1 / ((1 - alpha) slack) per seed, however large the
    graph: rounds always end, and no other ranking has to stand in for a seed
    that does not converge.

    ``width`` seeds share a row per node (a column each), which is one lookup
    in the join and the aggregate for all of them. Films without edges keep
    all their mass. ``max_rounds`` stops earlier."""
    from marquee.functions.agg import dense_ids
    spark = nodes.sparkSession
    n_edges = edges.count()
    wanted = _checkpoint(seeds.select("seed").distinct())
    n_seeds = wanted.count()
    width = max(1, min(width, n_seeds))
    parts = _partitions(spark, n_edges * n_seeds)  # a round moves as many numbers at most
    lanes = range(width)
    ids = _checkpoint(dense_ids(wanted, "seed", "no").select(
        "seed", F.floor(F.col("no") / width).cast("long").alias("block"), (F.col("no") % width).cast("int").alias("lane")))
    pairs = edges.select("src", "dst", "weight")
    degree = _checkpoint(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
                         .groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("wt")))
    mean = degree.agg(F.sum("wt") / F.count(F.lit(1))).first()[0]
    slack = tol / mean if mean else 0.0
    trans = _transitions(edges).join(degree.select(F.col("node").alias("dst"), "wt"), "dst")
    trans, hubs = split_hubs(trans, n_edges, parts)
    hubs = _checkpoint(hubs)
    trans = _placed(trans, parts, "src", "salt").persist()
    start = restart_vectors(ids.select("seed"), edges).join(ids, "seed")
    state = (start.groupBy("block", "node").agg(*[F.sum(F.when(F.col("lane") == i, F.col("p")).otherwise(0.0)).alias(f"r{i}") for i in lanes])
             .join(degree, "node", "left")
             .select("block", "node", "wt", *[F.lit(0.0).alias(f"x{i}") for i in lanes], *[f"r{i}" for i in lanes]))
    state = _checkpoint(_placed(state, parts, "block", "node"))
    # the columns of a round, made once: null weights (no edges) are never due
    due = [f"(r{i} > 0 AND r{i} >= {slack!r}D * wt)" for i in lanes]
    any_due = " OR ".join(due)
    front_cols = ["node AS src", "block", *[f"CASE WHEN {d} THEN r{i} * {alpha!r}D ELSE 0D END AS f{i}" for i, d in zip(lanes, due)]]
    moved_cols = ["block", "dst AS node", "wt", *[f"0D AS x{i}" for i in lanes], *[f"p * f{i} AS r{i}" for i in lanes]]
    kept_cols = ["block", "node", "wt", *[f"CASE WHEN {d} THEN x{i} + r{i} * {(1.0 - alpha)!r}D ELSE x{i} END AS x{i}" for i, d in zip(lanes, due)],
                 *[f"CASE WHEN {d} THEN 0D ELSE r{i} END AS r{i}" for i, d in zip(lanes, due)]]
    sums = [F.max("wt").alias("wt"), *[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "xr" for i in lanes]]
    rounds, held = 0, []
    while max_rounds is None or rounds < max_rounds:
        if rounds % checkpoint_every == 0 and state.filter(any_due).isEmpty():
            break
        rounds += 1
        moved = trans.join(copied(state.filter(any_due).selectExpr(*front_cols), hubs), ["src", "salt"]).selectExpr(*moved_cols)
        both = state.selectExpr(*kept_cols).unionByName(moved)
        state = (both.coalesce(1) if parts == 1 else both).groupBy("block", "node").agg(*sums)
        # rounds between two checkpoints are only cached; a round without a node to push changes nothing
        state = _checkpoint(state, rounds, checkpoint_every)
        held.append(state)
        if rounds % checkpoint_every == 0:
            _release(*held[:-1])
            held = []
    out = _checkpoint(state)
    _release(trans, *held)
    x = F.array(*[F.when(F.col("wt").isNull(), F.col(f"r{i}")).otherwise(F.col(f"x{i}")) for i in lanes])
    return (out.select("block", "node", F.posexplode(x).alias("lane", "x")).filter(F.col("x") > 0)
            .join(ids, ["block", "lane"]).select("seed", "node", "x"))


def ppr_recommend(items_by_id: DataFrame, ppr: DataFrame, n: int = 12) -> DataFrame:
    """G6 output: films other than the seed, score x * (1 + 0.2 * genre
    overlap) (5 places), top ``n`` per seed."""
    films = items_by_id.select(F.col("id").alias("node"), "title", "rating",
                               F.array_distinct("genres").alias("g"))
    sg = items_by_id.select(F.col("id").alias("seed"), F.array_distinct("genres").alias("sg"))
    s = (ppr.filter(F.col("node") != F.col("seed")).join(films, "node").join(sg, "seed")
         .select("seed", F.col("node").alias("id"), "title", "rating",
                 (F.col("x") * (1 + 0.2 * F.size(F.array_intersect("sg", "g")))).alias("raw")))
    s = s.withColumn("similarity", round_half_up("raw", 5))
    # ranked on ORDER_PLACES, so that films of equal surroundings tie whatever the order of the sums
    return top_k(s, n, [round_half_up("raw", ORDER_PLACES).desc(), F.col("id").asc()], partition=["seed"]).drop("raw")


# ---------------------------------------------------------------------------
# G5 / G9 / G12 / G13 (per target film)
# ---------------------------------------------------------------------------
def _attrs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("film"), F.col("dst").alias("attr"), "relation")


def shared_neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, cand, shared): films sharing >= 1 attribute node with a seed.
    Each seed's attributes are joined to the attribute's film list; the
    per-pair count is a partial aggregate."""
    a = _attrs(edges)
    sa = a.join(seeds.select(F.col("seed").alias("film")), "film").select(F.col("film").alias("seed"), "attr")
    return (sa.join(a.select(F.col("film").alias("cand"), "attr"), "attr")
            .filter(F.col("cand") != F.col("seed"))
            .groupBy("seed", "cand").agg(F.count(F.lit(1)).alias("shared")))


def common_neighbors(items_by_id: DataFrame, edges: DataFrame, seeds: DataFrame, n: int = 12) -> DataFrame:
    """0.6 * Jaccard of attribute sets + 0.4 * shared genres / number of
    the seed's genres (list length, min 1); top ``n`` per seed (3 places)."""
    deg = edges.groupBy(F.col("src").alias("film")).agg(F.count(F.lit(1)).alias("deg"))
    sh = shared_neighbours(edges, seeds)
    info = items_by_id.select(F.col("id").alias("cand"), "title", "rating", F.array_distinct("genres").alias("g"))
    sinfo = items_by_id.select(F.col("id").alias("seed"), F.array_distinct("genres").alias("sg"),
                               F.size("genres").alias("sglen"))
    j = (sh.join(deg.select(F.col("film").alias("seed"), F.col("deg").alias("d1")), "seed")
         .join(deg.select(F.col("film").alias("cand"), F.col("deg").alias("d2")), "cand")
         .join(info, "cand").join(sinfo, "seed"))
    raw = (0.6 * F.col("shared") / (F.col("d1") + F.col("d2") - F.col("shared"))
           + 0.4 * F.size(F.array_intersect("sg", "g")) / F.greatest(F.lit(1), F.col("sglen")))
    s = j.select("seed", F.col("cand").alias("id"), "title", "rating", raw.alias("raw"))
    s = s.withColumn("similarity", round_half_up("raw", 3))
    return top_k(s, n, [F.col("raw").desc(), F.col("id").asc()], partition=["seed"]).drop("raw")


def community_assign(items_by_id: DataFrame, buckets: int = COMMUNITY_BUCKETS) -> DataFrame:
    """Baseline community = stable hash of the first genre modulo 50
    (films without a genre get none)."""
    g = F.try_element_at("genres", F.lit(1))
    h = F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint")
    return items_by_id.filter(g.isNotNull()).select(F.col("id").alias("node"), (h % buckets).alias("community"))


def community_label_prop(items_by_id: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Label propagation on the film-film projection without building the
    projection: a film's support for label L is the number of (attribute,
    other film with label L) pairs, summed from per-attribute label counts
    (partial aggregates; a hub attribute contributes one row per label).
    Starts from G7 labels; ties go to the smallest label; synchronous rounds
    until no label changes. Synchronous rounds can end in two states that
    follow each other for ever; then each film takes the smaller of its two
    labels. ``max_rounds`` stops earlier (default: no limit)."""
    a = _attrs(edges).select("film", "attr")
    lab = community_assign(items_by_id).select(F.col("node").alias("film"), F.col("community").alias("label"))
    states: list[tuple] = []
    while max_rounds is None or len(states) < max_rounds:
        al = a.join(lab, "film").groupBy("attr", "label").agg(F.count(F.lit(1)).alias("cnt"))
        sup = (a.join(al, "attr").join(lab.withColumnRenamed("label", "own"), "film", "left")
               .groupBy("film", "label")
               .agg(F.sum(F.col("cnt") - F.when(F.col("own") == F.col("label"), 1).otherwise(0)).alias("s"))
               .filter(F.col("s") > 0))
        best = top_k(sup, 1, [F.col("s").desc(), F.col("label").asc()], partition=["film"]).select("film", "label")
        new = _checkpoint(best.unionByName(lab.join(best.select("film"), "film", "left_anti")))
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("film", "label").cast("decimal(38,0)"))).first())
        if states and state == states[-1]:
            lab = new
            break
        if state in states[:-1]:  # the two states alternate
            lab = (new.join(lab.withColumnRenamed("label", "other"), "film")
                   .select("film", F.least("label", "other").alias("label")))
            break
        states.append(state)
        lab = new
    return lab.select(F.col("film").alias("node"), F.col("label").alias("community"))


def community_recommend(items_by_id: DataFrame, edges: DataFrame, communities: DataFrame, seeds: DataFrame,
                        n: int = 12) -> DataFrame:
    """Films of the seed's community, 0.7 * rating + 0.3 * shared
    neighbours (3 places), top ``n``."""
    sc = seeds.join(communities.withColumnRenamed("node", "seed"), "seed")
    members = sc.join(communities.withColumnRenamed("node", "cand"), "community").filter(
        F.col("cand") != F.col("seed"))
    sh = shared_neighbours(edges, seeds)
    info = items_by_id.select(F.col("id").alias("cand"), "title", "rating")
    j = members.join(sh, ["seed", "cand"], "left").join(info, "cand")
    raw = 0.7 * F.col("rating") + 0.3 * F.coalesce("shared", F.lit(0))
    s = j.select("seed", F.col("cand").alias("id"), "title", "rating", "community", raw.alias("raw"))
    s = s.withColumn("similarity", round_half_up("raw", 3))
    return top_k(s, n, [F.col("raw").desc(), F.col("id").asc()], partition=["seed"]).drop("raw")


def same_director_genre(items_by_id: DataFrame, edges: DataFrame, seeds: DataFrame, n: int = 10) -> DataFrame:
    """Films sharing a director with the seed; 3 * shared directors +
    shared genres; top ``n``."""
    a = _attrs(edges)
    sa = a.join(seeds.select(F.col("seed").alias("film")), "film").select(
        F.col("film").alias("seed"), "attr", "relation")
    pairs = (sa.join(a.select(F.col("film").alias("cand"), "attr"), "attr")
             .filter(F.col("cand") != F.col("seed")))
    g = pairs.groupBy("seed", "cand").agg(
        F.count_if(F.col("relation") == "DIRECTED_BY").alias("shared_directors"),
        F.count_if(F.col("relation") == "BELONGS_TO").alias("shared_genres"))
    g = g.filter(F.col("shared_directors") > 0)
    info = items_by_id.select(F.col("id").alias("cand"), "title", "rating")
    s = g.join(info, "cand").select("seed", F.col("cand").alias("id"), "title", "rating", "shared_directors",
                                    "shared_genres",
                                    (F.col("shared_directors") * 3 + F.col("shared_genres")).alias("score"))
    return top_k(s, n, [F.col("score").desc(), F.col("id").asc()], partition=["seed"])


def hybrid_graph(cn: DataFrame, ppr: DataFrame, comm: DataFrame, n: int = 12) -> DataFrame:
    """0.35 * CN + 0.40 * PPR + 0.25 * community / 10 over each list's
    top 15 (rounded scores), top ``n`` (3 places)."""
    parts = [cn.filter(F.col("rk") <= 15).select("seed", "id", (F.col("similarity") * 0.35).alias("s")),
             ppr.filter(F.col("rk") <= 15).select("seed", "id", (F.col("similarity") * 0.40).alias("s")),
             comm.filter(F.col("rk") <= 15).select("seed", "id", (F.col("similarity") / 10.0 * 0.25).alias("s"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    g = u.groupBy("seed", "id").agg(F.sum("s").alias("raw"))
    g = g.withColumn("similarity", round_half_up("raw", 3))
    return top_k(g, n, [round_half_up("raw", ORDER_PLACES).desc(), F.col("id").asc()], partition=["seed"]).drop("raw")


def pagerank_recommend(items: DataFrame, pr: DataFrame, n: int = 20, genre: str | None = None) -> DataFrame:
    """0.7 * PageRank + 0.3 * rating / 10 (0 if unrated), optional genre."""
    it = items if genre is None else items.filter(F.array_contains("genres", genre))
    j = it.join(pr.select(F.col("node").alias("id"), "pagerank"), "id", "left")
    pr_c = F.coalesce("pagerank", F.lit(0.0))
    comb = pr_c * 0.7 + F.when(F.col("rating") > 0, F.col("rating") / 10.0).otherwise(F.lit(0.0)) * 0.3
    s = j.select("id", "ord", "title", "rating", pr_c.alias("pr"), comb.alias("comb"))
    t = top_k(s, n, [F.col("comb").desc(), F.col("id").asc(), F.col("ord").asc()])
    return t.select("rk", "id", "title", "rating", round_half_up("pr", 6).alias("pagerank_score"),
                    round_half_up("comb", 4).alias("combined_score"))


# ---------------------------------------------------------------------------
# G10 shortest path, G11 statistics
# ---------------------------------------------------------------------------
def shortest_path(nodes: DataFrame, edges: DataFrame, source: DataFrame, target: DataFrame,
                  max_depth: int | None = None) -> DataFrame:
    """Unweighted shortest path between two nodes (one-row DataFrames
    with column ``node``) by level-synchronous BFS; a node's parent is the
    smallest node id one level closer. Levels follow until the target is met
    or none is left (``max_depth`` stops earlier; default: no limit). Returns
    (pos, node) rows, empty when either node is missing or no path exists."""
    und = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    src = source.join(nodes.select("node"), "node", "left_semi")
    tgt = target.join(nodes.select("node"), "node", "left_semi")
    goal = tgt.first()
    none = nodes.limit(0).select(F.lit(0).alias("pos"), "node")
    if goal is None:
        return none
    at_goal = F.col("node") == F.lit(goal["node"])
    levels = [_checkpoint(src.select("node", F.lit(None).cast("string").alias("parent")))]
    while levels[-1].filter(at_goal).isEmpty():
        if max_depth is not None and len(levels) > max_depth:
            return none
        # neighbours of a level lie in it, in the one before or in the next one
        near = levels[-1].select("node") if len(levels) < 2 else levels[-1].select("node").unionByName(levels[-2].select("node"))
        nxt = (levels[-1].select(F.col("node").alias("src")).join(und, "src").groupBy(F.col("dst").alias("node"))
               .agg(F.min("src").alias("parent")).join(near, "node", "left_anti"))
        levels.append(_checkpoint(nxt))
        if levels[-1].isEmpty():
            return none
    # one id per level leads back to the source
    path = [goal["node"]]
    for level in levels[:0:-1]:
        path.append(level.filter(F.col("node") == F.lit(path[-1])).first()["parent"])
    return nodes.sparkSession.createDataFrame(list(enumerate(reversed(path))), "pos int, node string")


def graph_stats(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row of node / edge totals, mean degree (2 places), density
    (6 places) and number of communities."""
    counts = nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(F.col("type") == "Movie").alias("movie_nodes"),
        F.count_if(F.col("type") == "Genre").alias("genre_nodes"),
        F.count_if(F.col("type") == "Director").alias("director_nodes"),
        F.count_if(F.col("type") == "Actor").alias("actor_nodes"))
    e = edges.select(F.count(F.lit(1))).scalar()
    nc = communities.select(F.count_distinct("community")).scalar()
    n = F.col("total_nodes").cast("double")
    return counts.select("*", e.alias("total_edges"),
                         round_half_up(F.try_divide(2.0 * e, n), 2).alias("avg_degree"),
                         round_half_up(F.try_divide(2.0 * e, n * (n - 1)), 6).alias("density"),
                         nc.alias("num_communities"))


def top_degree_films(nodes: DataFrame, edges: DataFrame, items_by_id: DataFrame, n: int = 20) -> DataFrame:
    """Films with the most edges."""
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    films = nodes.filter(F.col("type") == "Movie").select(F.col("node").alias("id"))
    d = films.join(deg, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    t = top_k(d, n, [F.col("degree").desc(), F.col("id").asc()])
    return t.join(items_by_id.select("id", "title", "rating"), "id")


def top_pagerank_films(nodes: DataFrame, pr: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest PageRank nodes, then non-films dropped."""
    t = top_k(pr.select("node", "pagerank"), n, [F.col("pagerank").desc(), F.col("node").asc()])
    return (t.join(nodes, "node").filter(F.col("type") == "Movie")
            .select("rk", "node", "name", round_half_up("pagerank", 6).alias("pagerank")))


def seed_film(items: DataFrame) -> DataFrame:
    """A data-derived target film: the best rated (ties by id)."""
    return top_k(items.select("id", "rating", "ord"), 1,
                 [F.col("rating").desc(), F.col("id").asc(), F.col("ord").asc()]).select(F.col("id").alias("seed"))
