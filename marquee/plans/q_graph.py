"""Registered knowledge-graph queries (G1-G14) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import graph as G
from marquee.plans.registry import register
from marquee.plans.sqlviews import rhu, view, with_views

FIXED_ROUNDS = 20  # PageRank rounds of the oracle-checked variants

view("gedges", """
SELECT src, dst, relation, arg_max(weight, ord) AS weight, CAST(min(pos) AS INTEGER) AS pos FROM (
  SELECT id AS src, 'genre:' || name AS dst, 'BELONGS_TO' AS relation,
    CASE WHEN rating > 7.5 THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS weight, ord, pos
  FROM (SELECT id, ord, rating, unnest(genres) AS name, generate_subscripts(genres, 1) - 1 AS pos FROM items) g
  UNION ALL
  SELECT id, 'director:' || name, 'DIRECTED_BY', CAST(1.5 AS DOUBLE), ord, pos
  FROM (SELECT id, ord, unnest(directors) AS name, generate_subscripts(directors, 1) - 1 AS pos FROM items) d
  UNION ALL
  SELECT id, 'actor:' || name, 'ACTED_IN', CAST(1.0 AS DOUBLE), ord, pos
  FROM (SELECT id, ord, unnest(top_actors[1:5]) AS name, generate_subscripts(top_actors[1:5], 1) - 1 AS pos
        FROM items) a
  UNION ALL
  SELECT id, 'country:' || name, 'FROM_COUNTRY', CAST(0.5 AS DOUBLE), ord, pos
  FROM (SELECT id, ord, unnest(countries) AS name, generate_subscripts(countries, 1) - 1 AS pos FROM items) c
) e GROUP BY src, dst, relation
""")

view("gnodes", """
SELECT id AS node, 'Movie' AS type, arg_max(title, ord) AS name FROM items GROUP BY id
UNION ALL
SELECT dst AS node,
  CASE split_part(dst, ':', 1) WHEN 'genre' THEN 'Genre' WHEN 'director' THEN 'Director'
    WHEN 'actor' THEN 'Actor' WHEN 'country' THEN 'Country' END AS type,
  substring(dst, strpos(dst, ':') + 1) AS name
FROM (SELECT DISTINCT dst FROM gedges) a
""")

view("gtrans", """
SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM (
  SELECT src, dst, weight FROM gedges UNION ALL SELECT dst AS src, src AS dst, weight FROM gedges) u
""")

view("gdang", "SELECT node FROM gnodes WHERE node NOT IN (SELECT src FROM gtrans)")

view("seedf", "SELECT id AS seed FROM items ORDER BY rating DESC, id ASC, ord ASC LIMIT 1")

view("gdeg", "SELECT src AS film, count(*) AS deg FROM gedges GROUP BY src")

view("gshared", """
SELECT s.seed, a.src AS cand, count(*) AS shared
FROM seedf s JOIN gedges sa ON sa.src = s.seed JOIN gedges a ON a.dst = sa.dst
WHERE a.src <> s.seed GROUP BY s.seed, a.src
""")

view("gcomm", """
SELECT id AS node, CAST(('0x' || substr(md5(genres[1]), 1, 8))::BIGINT % 50 AS BIGINT) AS community
FROM items_by_id WHERE len(genres) > 0
""")


def _pagerank_ctes(rounds: int) -> dict[str, str]:
    ctes = {"pr_n": "SELECT CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT node FROM gnodes) x",
            "pr0": "SELECT DISTINCT node, 1.0 / (SELECT n FROM pr_n) AS x FROM gnodes"}
    for i in range(1, rounds + 1):
        prev = f"pr{i - 1}"
        ctes[f"pr{i}"] = f"""
SELECT v.node, 0.85 * (coalesce(c.c, 0.0) + (SELECT coalesce(sum(x), 0.0) FROM {prev} JOIN gdang USING (node))
                      / (SELECT n FROM pr_n)) + 0.15 / (SELECT n FROM pr_n) AS x
FROM (SELECT DISTINCT node FROM gnodes) v
LEFT JOIN (SELECT t.dst AS node, sum(t.p * r.x) AS c FROM gtrans t JOIN {prev} r ON r.node = t.src GROUP BY t.dst) c
  ON c.node = v.node
"""
    ctes["prf"] = f"SELECT node, x AS pagerank FROM pr{rounds}"
    return ctes


PR_CTES = _pagerank_ctes(FIXED_ROUNDS)

# The push of personalised PageRank for the best rated film, as many rounds as a graph of millions of nodes may need (a
# round without a node to push changes nothing).
PUSH_ROUNDS = 60
view("gweight", "SELECT src AS node, sum(weight) AS w FROM (SELECT src, weight FROM gedges UNION ALL SELECT dst, weight FROM gedges) u GROUP BY src")
view("grestart", """
SELECT node, p / sum(p) OVER () AS p FROM (
  SELECT seed AS node, 0.5 AS p FROM seedf
  UNION ALL
  SELECT node, CAST(0.5 AS DOUBLE) / least(20, deg) AS p FROM (
    SELECT e.dst AS node, count(*) OVER () AS deg, row_number() OVER (ORDER BY
      CASE e.relation WHEN 'BELONGS_TO' THEN 0 WHEN 'DIRECTED_BY' THEN 1 WHEN 'ACTED_IN' THEN 2 ELSE 3 END, e.pos, e.dst) AS rn
    FROM gedges e JOIN seedf s ON s.seed = e.src) n WHERE rn <= 20) r
""")


def _push_ctes(rounds: int) -> dict[str, str]:
    due = "r > 0 AND r >= w * (SELECT slack FROM pslack)"
    ctes = {"pslack": "SELECT CAST(0.000001 AS DOUBLE) / avg(w) AS slack FROM gweight",
            "pp0": "SELECT g.node, g.w, CAST(0.0 AS DOUBLE) AS x, CAST(p.p AS DOUBLE) AS r FROM grestart p JOIN gweight g ON g.node = p.node"}
    for i in range(1, rounds + 1):
        ctes[f"pp{i}"] = f"""
SELECT node, max(w) AS w, sum(x) AS x, sum(r) AS r FROM (
  SELECT node, w, CASE WHEN {due} THEN x + r * CAST(0.15 AS DOUBLE) ELSE x END AS x, CASE WHEN {due} THEN 0.0 ELSE r END AS r FROM pp{i - 1}
  UNION ALL
  SELECT t.dst, g.w, 0.0, t.p * (f.r * CAST(0.85 AS DOUBLE)) FROM (SELECT node, r FROM pp{i - 1} WHERE {due}) f
  JOIN gtrans t ON t.src = f.node JOIN gweight g ON g.node = t.dst) u GROUP BY node
"""
    ctes["pseen"] = f"""
SELECT s.seed, c.id, c.title, c.rating,
  p.x * (1 + CAST(0.2 AS DOUBLE) * len(list_intersect(list_distinct(si.genres), list_distinct(c.genres)))) AS raw
FROM seedf s JOIN items_by_id si ON si.id = s.seed JOIN pp{rounds} p ON p.node <> s.seed AND p.x > 0 JOIN items_by_id c ON c.id = p.node
"""
    return ctes


PUSH_CTES = _push_ctes(PUSH_ROUNDS)



def _graph(cat):
    return cat.graph_nodes, cat.graph_edges


def _pr_fixed(cat):
    if not hasattr(cat, "_pr_fixed"):
        nodes, edges = _graph(cat)
        cat._pr_fixed = G.pagerank(nodes, edges, max_iter=FIXED_ROUNDS, tol=None)
    return cat._pr_fixed


def _seeds(cat):
    return G.seed_film(cat.items)


@register("graph_edges", with_views("SELECT src, dst, relation, weight, pos FROM gedges"))
def q_graph_edges(cat):
    """G1."""
    return G.graph_edges(cat.items)


@register("graph_nodes", with_views("SELECT node, type, name FROM gnodes"))
def q_graph_nodes(cat):
    """G2."""
    return _graph(cat)[0]


@register("path_labels", with_views("SELECT node, lower(type) AS type, name FROM gnodes"))
def q_path_labels(cat):
    """G14."""
    return G.path_labels(_graph(cat)[0])


@register("pagerank_fixed", with_views(f"""
SELECT node, {rhu("pagerank", 9)} AS pagerank, {FIXED_ROUNDS} AS rounds FROM prf
""", PR_CTES))
def q_pagerank_fixed(cat):
    """G3 with a fixed number of rounds (the oracle-checked form)."""
    pr = _pr_fixed(cat)
    return pr.select("node", G.round_half_up("pagerank", 9).alias("pagerank"), "rounds")


@register("pagerank")
def q_pagerank(cat):
    """PageRank to convergence (L1 change < N * 1e-6, at most 100 rounds)."""
    return cat.pagerank


@register("pagerank_recommend", with_views(f"""
SELECT rk, id, title, rating, {rhu("pr", 6)} AS pagerank_score, {rhu("comb", 4)} AS combined_score FROM (
  SELECT id, title, rating, pr, comb, row_number() OVER (ORDER BY comb DESC, id ASC, ord ASC) AS rk FROM (
    SELECT i.id, i.ord, i.title, i.rating, coalesce(p.pagerank, 0.0) AS pr,
      coalesce(p.pagerank, 0.0) * 0.7 + (CASE WHEN i.rating > 0 THEN i.rating / 10.0 ELSE 0.0 END) * 0.3 AS comb
    FROM items i LEFT JOIN prf p ON p.node = i.id) s
) t WHERE rk <= 20
""", PR_CTES))
def q_pagerank_recommend(cat):
    """G4 (over the fixed-round PageRank)."""
    return G.pagerank_recommend(cat.items, _pr_fixed(cat))


@register("common_neighbors", with_views(f"""
SELECT seed, id, title, rating, similarity, rk FROM (
  SELECT s.seed, s.cand AS id, i.title, i.rating, {rhu("raw", 3)} AS similarity,
    row_number() OVER (PARTITION BY s.seed ORDER BY raw DESC, s.cand ASC) AS rk
  FROM (SELECT sh.seed, sh.cand,
          CAST(0.6 AS DOUBLE) * sh.shared / (d1.deg + d2.deg - sh.shared)
          + CAST(0.4 AS DOUBLE) * len(list_intersect(list_distinct(si.genres), list_distinct(ci.genres)))
            / greatest(1, len(si.genres)) AS raw
        FROM gshared sh JOIN gdeg d1 ON d1.film = sh.seed JOIN gdeg d2 ON d2.film = sh.cand
        JOIN items_by_id si ON si.id = sh.seed JOIN items_by_id ci ON ci.id = sh.cand) s
  JOIN items_by_id i ON i.id = s.cand
) t WHERE rk <= 12
"""))
def q_common_neighbors(cat):
    """G5 for the best rated film."""
    nodes, edges = _graph(cat)
    return G.common_neighbors(cat.items_by_id, edges, _seeds(cat))


@register("community_assign", with_views("SELECT node, community FROM gcomm"))
def q_community_assign(cat):
    """G7."""
    return G.community_assign(cat.items_by_id)


@register("community_label_prop")
def q_community_label_prop(cat):
    """Label propagation over the film-film projection, until it settles."""
    nodes, edges = _graph(cat)
    return G.community_label_prop(cat.items_by_id, edges)


@register("community_recommend", with_views(f"""
SELECT seed, id, title, rating, community, similarity, rk FROM (
  SELECT s.seed, m.node AS id, i.title, i.rating, sc.community,
    {rhu("CAST(0.7 AS DOUBLE) * i.rating + CAST(0.3 AS DOUBLE) * coalesce(sh.shared, 0)", 3)} AS similarity,
    row_number() OVER (PARTITION BY s.seed ORDER BY CAST(0.7 AS DOUBLE) * i.rating
                       + CAST(0.3 AS DOUBLE) * coalesce(sh.shared, 0) DESC, m.node ASC) AS rk
  FROM seedf s JOIN gcomm sc ON sc.node = s.seed
  JOIN gcomm m ON m.community = sc.community AND m.node <> s.seed
  JOIN items_by_id i ON i.id = m.node
  LEFT JOIN gshared sh ON sh.seed = s.seed AND sh.cand = m.node
) t WHERE rk <= 12
"""))
def q_community_recommend(cat):
    """G9 for the best rated film."""
    nodes, edges = _graph(cat)
    return G.community_recommend(cat.items_by_id, edges, G.community_assign(cat.items_by_id), _seeds(cat))


@register("same_director_genre", with_views("""
SELECT seed, id, title, rating, shared_directors, shared_genres, score, rk FROM (
  SELECT p.seed, p.cand AS id, i.title, i.rating, p.shared_directors, p.shared_genres,
    p.shared_directors * 3 + p.shared_genres AS score,
    row_number() OVER (PARTITION BY p.seed ORDER BY p.shared_directors * 3 + p.shared_genres DESC, p.cand ASC) AS rk
  FROM (SELECT s.seed, a.src AS cand,
          count(*) FILTER (WHERE sa.relation = 'DIRECTED_BY') AS shared_directors,
          count(*) FILTER (WHERE sa.relation = 'BELONGS_TO') AS shared_genres
        FROM seedf s JOIN gedges sa ON sa.src = s.seed JOIN gedges a ON a.dst = sa.dst
        WHERE a.src <> s.seed GROUP BY s.seed, a.src) p
  JOIN items_by_id i ON i.id = p.cand
  WHERE p.shared_directors > 0
) t WHERE rk <= 10
"""))
def q_same_director_genre(cat):
    """G12 for the best rated film."""
    nodes, edges = _graph(cat)
    return G.same_director_genre(cat.items_by_id, edges, _seeds(cat))


def _ppr(cat):
    if not hasattr(cat, "_ppr"):
        nodes, edges = _graph(cat)
        cat._ppr = G.personalized_pagerank(nodes, edges, _seeds(cat))
    return cat._ppr


@register("personalized_pagerank", with_views(f"""
SELECT seed, id, title, rating, {rhu("raw", 5)} AS similarity,
  row_number() OVER (PARTITION BY seed ORDER BY {rhu("raw", 12)} DESC, id ASC) AS rk
FROM pseen QUALIFY rk <= 12
""", PUSH_CTES))
def q_personalized_pagerank(cat):
    """G6 for the best rated film."""
    return G.ppr_recommend(cat.items_by_id, _ppr(cat))


@register("hybrid_graph", with_views(f"""
SELECT seed, id, {rhu("raw", 3)} AS similarity, row_number() OVER (PARTITION BY seed ORDER BY {rhu("raw", 12)} DESC, id ASC) AS rk
FROM (SELECT seed, id, sum(s) AS raw FROM (
  SELECT seed, id, {rhu("raw", 5)} * CAST(0.40 AS DOUBLE) AS s FROM (
    SELECT *, row_number() OVER (ORDER BY {rhu("raw", 12)} DESC, id ASC) AS rk FROM pseen) a WHERE rk <= 15
  UNION ALL
  SELECT seed, id, {rhu("raw", 3)} * CAST(0.35 AS DOUBLE) FROM (
    SELECT sh.seed, sh.cand AS id, raw, row_number() OVER (ORDER BY raw DESC, sh.cand ASC) AS rk FROM (
      SELECT sh.seed, sh.cand, CAST(0.6 AS DOUBLE) * sh.shared / (d1.deg + d2.deg - sh.shared)
        + CAST(0.4 AS DOUBLE) * len(list_intersect(list_distinct(si.genres), list_distinct(ci.genres))) / greatest(1, len(si.genres)) AS raw
      FROM gshared sh JOIN gdeg d1 ON d1.film = sh.seed JOIN gdeg d2 ON d2.film = sh.cand
      JOIN items_by_id si ON si.id = sh.seed JOIN items_by_id ci ON ci.id = sh.cand) sh) b WHERE rk <= 15
  UNION ALL
  SELECT seed, id, {rhu("raw", 3)} / CAST(10.0 AS DOUBLE) * CAST(0.25 AS DOUBLE) FROM (
    SELECT seed, id, raw, row_number() OVER (ORDER BY raw DESC, id ASC) AS rk FROM (
      SELECT s.seed, m.node AS id, CAST(0.7 AS DOUBLE) * i.rating + CAST(0.3 AS DOUBLE) * coalesce(sh.shared, 0) AS raw
      FROM seedf s JOIN gcomm sc ON sc.node = s.seed JOIN gcomm m ON m.community = sc.community AND m.node <> s.seed
      JOIN items_by_id i ON i.id = m.node LEFT JOIN gshared sh ON sh.seed = s.seed AND sh.cand = m.node) c) c WHERE rk <= 15
) u GROUP BY seed, id) t QUALIFY rk <= 12
""", PUSH_CTES))
def q_hybrid_graph(cat):
    """G13 for the best rated film."""
    nodes, edges = _graph(cat)
    seeds = _seeds(cat)
    cn = G.common_neighbors(cat.items_by_id, edges, seeds, 15)
    pp = G.ppr_recommend(cat.items_by_id, _ppr(cat), 15)
    cm = G.community_recommend(cat.items_by_id, edges, G.community_assign(cat.items_by_id), seeds, 15)
    return G.hybrid_graph(cn, pp, cm)


_LEVELS = 12


def _path_ctes() -> dict[str, str]:
    ctes = {"und": "SELECT src, dst FROM gedges UNION ALL SELECT dst, src FROM gedges",
            "ptarget": "SELECT id AS node FROM items ORDER BY rating ASC, id DESC LIMIT 1",
            "lev0": "SELECT seed AS node, 0 AS d FROM seedf"}
    for i in range(1, _LEVELS + 1):
        near = f"SELECT node FROM lev{i - 1}" + (f" UNION ALL SELECT node FROM lev{i - 2}" if i > 1 else "")
        ctes[f"lev{i}"] = f"SELECT DISTINCT e.dst AS node, {i} AS d FROM lev{i - 1} l JOIN und e ON e.src = l.node WHERE e.dst NOT IN ({near})"
    ctes["dist"] = " UNION ALL ".join(f"SELECT * FROM lev{i}" for i in range(_LEVELS + 1))
    ctes["way0"] = "SELECT t.node, x.d FROM ptarget t JOIN dist x ON x.node = t.node"
    for i in range(1, _LEVELS + 1):
        ctes[f"way{i}"] = (f"SELECT min(e.src) AS node, w.d - 1 AS d FROM way{i - 1} w JOIN und e ON e.dst = w.node "
                           f"JOIN dist x ON x.node = e.src AND x.d = w.d - 1 WHERE w.d > 0 GROUP BY w.d")
    ctes["way"] = " UNION ALL ".join(f"SELECT * FROM way{i}" for i in range(_LEVELS + 1))
    return ctes


@register("shortest_path", with_views("SELECT w.d AS pos, w.node, lower(n.type) AS type, n.name FROM way w JOIN gnodes n ON n.node = w.node",
                                      _path_ctes()))
def q_shortest_path(cat):
    """G10 (+G14 labels): path from the best rated film to the worst rated one."""
    from marquee.functions.agg import top_k
    nodes, edges = _graph(cat)
    src = G.seed_film(cat.items).select(F.col("seed").alias("node"))
    tgt = top_k(cat.items.select("id", "rating", "ord"), 1,
                [F.col("rating").asc(), F.col("id").desc()]).select(F.col("id").alias("node"))
    path = G.shortest_path(nodes, edges, src, tgt)
    return path.join(G.path_labels(nodes), "node").select("pos", "node", "type", "name")


@register("graph_stats", with_views(f"""
SELECT count(*) AS total_nodes, count(*) FILTER (WHERE type = 'Movie') AS movie_nodes,
  count(*) FILTER (WHERE type = 'Genre') AS genre_nodes, count(*) FILTER (WHERE type = 'Director') AS director_nodes,
  count(*) FILTER (WHERE type = 'Actor') AS actor_nodes, (SELECT count(*) FROM gedges) AS total_edges,
  {rhu("CAST(2 AS DOUBLE) * (SELECT count(*) FROM gedges) / CAST(count(*) AS DOUBLE)", 2)} AS avg_degree,
  {rhu("CAST(2 AS DOUBLE) * (SELECT count(*) FROM gedges) / (CAST(count(*) AS DOUBLE) * (CAST(count(*) AS DOUBLE) - 1))", 6)} AS density,
  (SELECT count(DISTINCT community) FROM gcomm) AS num_communities
FROM gnodes
"""))
def q_graph_stats(cat):
    """G11 totals."""
    nodes, edges = _graph(cat)
    return G.graph_stats(nodes, edges, G.community_assign(cat.items_by_id))


@register("top_degree_films", with_views("""
SELECT t.id, t.degree, t.rk, i.title, i.rating FROM (
  SELECT f.node AS id, coalesce(d.deg, 0) AS degree,
    row_number() OVER (ORDER BY coalesce(d.deg, 0) DESC, f.node ASC) AS rk
  FROM gnodes f LEFT JOIN gdeg d ON d.film = f.node WHERE f.type = 'Movie' QUALIFY rk <= 20
) t JOIN items_by_id i ON i.id = t.id
"""))
def q_top_degree_films(cat):
    """Most connected films."""
    nodes, edges = _graph(cat)
    return G.top_degree_films(nodes, edges, cat.items_by_id)


@register("top_pagerank_films", with_views(f"""
SELECT t.rk, t.node, n.name, {rhu("t.pagerank", 6)} AS pagerank FROM (
  SELECT node, pagerank, row_number() OVER (ORDER BY pagerank DESC, node ASC) AS rk FROM prf QUALIFY rk <= 10
) t JOIN gnodes n ON n.node = t.node WHERE n.type = 'Movie'
""", PR_CTES))
def q_top_pagerank_films(cat):
    """Top PageRank nodes that are films (fixed-round PageRank)."""
    nodes, edges = _graph(cat)
    return G.top_pagerank_films(nodes, _pr_fixed(cat))
