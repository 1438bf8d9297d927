"""Independent SQL (DuckDB dialect) definitions of the canonical tables.

The correctness oracle re-derives every canonical table from the raw driver
tables in plain SQL, written separately from the DataFrame code, so that a
query and its oracle share no code path. ``with_views(body, ...)`` prefixes a
query body with the CTEs it needs (and their dependencies).
"""

from __future__ import annotations

import re

# --- scalar expression templates -------------------------------------------


def ustrip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def txt(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def split_multi(x: str) -> str:
    return (f"list_filter(list_transform(string_split(replace({txt(x)}, '/', ','), ','), "
            f"lambda v: {ustrip('v')}), lambda v: v <> '')")


def parse_rating(x: str) -> str:
    s = txt(x)
    return (rf"(CASE WHEN regexp_full_match({s}, '\s*[-+]?[0-9]*\.?[0-9]*([eE][-+]?[0-9]+)?\s*') "
            rf"THEN coalesce(try_cast(trim({s}) AS DOUBLE), 0.0) ELSE 0.0 END)")


def rhu(x: str, places: int) -> str:
    """Round half up exactly like marquee.functions.text.round_half_up."""
    scale = float(10 ** places)
    return f"(floor(({x}) * {scale!r} + 0.5) / {scale!r})"


def mean_c(expr_c: str, cond: str | None = None) -> str:
    """Mean of an integer-hundredths column -> double (one division)."""
    v = f"CASE WHEN {cond} THEN {expr_c} END" if cond else expr_c
    return f"(CAST(sum({v}) AS DOUBLE) / nullif(count({v}), 0) / CAST(100 AS DOUBLE))"


def hash_order(seed, key: str) -> str:
    return f"md5('{seed}-' || CAST({key} AS VARCHAR))"


# --- canonical views ---------------------------------------------------------
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


view("sup_slots", """
SELECT r.l_partkey,
  max(CASE WHEN rn = 1 THEN s_name END) AS s1, max(CASE WHEN rn = 2 THEN s_name END) AS s2,
  string_agg(s_name, ', ' ORDER BY rn) FILTER (WHERE rn >= 2) AS others,
  max(CASE WHEN rn = 1 THEN n_name END) AS n1, max(CASE WHEN rn = 2 THEN n_name END) AS n2,
  max(CASE WHEN rn = 1 THEN r_name END) AS r1
FROM (
  SELECT l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_partkey
            ORDER BY md5(CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR))) AS rn
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d
) r
LEFT JOIN supplier ON s_suppkey = r.l_suppkey
LEFT JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
GROUP BY r.l_partkey
""")

view("items_raw", """
SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, '' AS cover,
  CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN 'N/A'
       ELSE CAST((p_partkey * 37) % 10 AS VARCHAR) || '.' || CAST((p_partkey * 13 + p_size) % 10 AS VARCHAR) END AS rating,
  concat_ws('/', s1, s2) AS director, '' AS screenwriter,
  coalesce(others, '') AS "cast",
  p_type || ' / ' || split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) AS genre,
  concat_ws(' / ', n1, n2) AS country,
  CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr/de' WHEN 2 THEN 'es, en' ELSE '' END AS language,
  CASE WHEN p_partkey % 29 = 0 THEN ''
       ELSE CAST(1950 + (CAST(floor(p_retailprice) AS BIGINT) + p_size) % 77 AS VARCHAR) || '-01-01(' || coalesce(r1, '') || ')' END AS release_date,
  CASE WHEN p_partkey % 31 = 0 THEN '' ELSE CAST((p_partkey * 7) % 430 AS VARCHAR) || ' min' END AS runtime,
  '' AS imdb, '' AS aka, p_name AS summary, '' AS poster_local_path
FROM part LEFT JOIN sup_slots ON l_partkey = p_partkey
""")

view("items", f"""
SELECT ord, id, title, rating, CAST(round(rating * 100) AS BIGINT) AS rating_c, genres, countries, year, runtime,
  directors, all_actors[1:5] AS top_actors, all_actors, language, country_raw, genre_raw, director_raw, cast_raw,
  release_date, runtime_raw, summary, cover, poster_local_path
FROM (
  SELECT ord, CAST(id AS VARCHAR) AS id, {ustrip('title')} AS title, {parse_rating('rating')} AS rating,
    {split_multi('genre')} AS genres, {split_multi('country')} AS countries,
    CAST(nullif(regexp_extract({txt('release_date')}, '(\\d{{4}})', 1), '') AS INTEGER) AS year,
    coalesce(try_cast(nullif(regexp_extract({txt('runtime')}, '(\\d+)', 1), '') AS INTEGER), 0) AS runtime,
    {split_multi('director')} AS directors, {split_multi('"cast"')} AS all_actors,
    {txt('language')} AS language, {txt('country')} AS country_raw, {txt('genre')} AS genre_raw,
    {txt('director')} AS director_raw, {txt('"cast"')} AS cast_raw, {txt('release_date')} AS release_date,
    {txt('runtime')} AS runtime_raw, {txt('summary')} AS summary, {txt('cover')} AS cover,
    {txt('poster_local_path')} AS poster_local_path
  FROM items_raw
  WHERE title IS NOT NULL AND title <> '' AND id IS NOT NULL AND CAST(id AS VARCHAR) <> ''
) x
""")

# last record per id (file order)
view("items_by_id", """
SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1
""")

view("credits", """
SELECT id AS item_id, ord, person, 'director' AS role, pos
FROM (SELECT id, ord, unnest(directors) AS person, generate_subscripts(directors, 1) AS pos FROM items)
UNION ALL
SELECT id AS item_id, ord, person, 'actor' AS role, pos
FROM (SELECT id, ord, unnest(all_actors) AS person, generate_subscripts(all_actors, 1) AS pos FROM items)
""")

view("credits_by_id", """
SELECT id AS item_id, ord, person, 'director' AS role, pos
FROM (SELECT id, ord, unnest(directors) AS person, generate_subscripts(directors, 1) AS pos FROM items_by_id)
UNION ALL
SELECT id AS item_id, ord, person, 'actor' AS role, pos
FROM (SELECT id, ord, unnest(all_actors) AS person, generate_subscripts(all_actors, 1) AS pos FROM items_by_id)
""")

view("users", """
SELECT c_custkey AS id, c_name AS username, lower(c_name) || '@example.com' AS email,
  CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role, '' AS avatar,
  fo.created_at, c_acctbal >= 0 AS is_active
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) fo
  ON fo.o_custkey = c_custkey
""")

view("activity", """
SELECT o_custkey AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
  CASE l_returnflag WHEN 'N' THEN 'rate' WHEN 'R' THEN 'favorite' WHEN 'A' THEN 'like' END AS kind,
  CASE WHEN l_returnflag = 'N' THEN CAST(1 + floor((l_quantity - 1) / 5) AS INTEGER) END AS score,
  l_shipdate AS ts, 0 AS src, l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag IN ('N', 'R', 'A')
UNION ALL
SELECT user_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS item_id,
  CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'favorite'
    WHEN 'error' THEN 'unrate' END AS kind,
  CAST(NULL AS INTEGER) AS score, ts, 1 AS src, event_id AS k1, CAST(0 AS BIGINT) AS k2
FROM events
WHERE event_type IN ('view', 'click', 'purchase', 'error') AND regexp_extract(props, '"k": ([0-9]+)', 1) <> ''
""")

view("rate_live", """
SELECT a.user_id, a.item_id, a.score, a.ts, a.src, a.k1, a.k2
FROM activity a
LEFT JOIN (SELECT user_id, item_id, max({'ts': ts, 'src': src, 'k1': k1, 'k2': k2}) AS last_del
           FROM activity WHERE kind = 'unrate' GROUP BY user_id, item_id) d
  ON d.user_id = a.user_id AND d.item_id = a.item_id
WHERE a.kind = 'rate' AND (d.last_del IS NULL OR {'ts': a.ts, 'src': a.src, 'k1': a.k1, 'k2': a.k2} > d.last_del)
""")

view("ratings", """
SELECT user_id, item_id, arg_max(score, {'ts': ts, 'src': src, 'k1': k1, 'k2': k2}) AS score,
  min(ts) AS created_at, max(ts) AS updated_at
FROM rate_live GROUP BY user_id, item_id
""")

view("likes", """
SELECT user_id, item_id, max(ts) AS created_at FROM activity WHERE kind = 'like'
GROUP BY user_id, item_id HAVING count(*) % 2 = 1
""")

view("favorites", """
SELECT user_id, item_id, max(ts) AS created_at FROM activity WHERE kind = 'favorite'
GROUP BY user_id, item_id HAVING count(*) % 2 = 1
""")

view("history", """
SELECT user_id, item_id, max(ts) AS viewed_at FROM activity WHERE kind = 'view' GROUP BY user_id, item_id
""")

view("reviews", """
SELECT conv_id * 4294967296 + turn AS id,
  (conv_id * 13 + turn) % (SELECT count(*) FROM customer) AS user_id,
  CAST(conv_id % (SELECT count(*) FROM part) AS VARCHAR) AS movie_id,
  text AS content, make_timestamp((1704067200 + conv_id * 100 + turn) * 1000000) AS created_at
FROM conversations WHERE role = 'user'
""")

view("review_replies", """
SELECT conv_id * 4294967296 + turn AS id, conv_id * 4294967296 + review_turn AS review_id,
  (conv_id * 7 + turn) % (SELECT count(*) FROM customer) AS user_id,
  text AS content, make_timestamp((1704067200 + conv_id * 100 + turn) * 1000000) AS created_at
FROM (
  SELECT conv_id, turn, role, text,
    max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS review_turn
  FROM conversations
) c WHERE role = 'assistant' AND review_turn IS NOT NULL
""")

view("review_like_log", """
SELECT (c.conv_id * 17 + c.turn * 3) % (SELECT count(*) FROM customer) AS user_id,
  c.conv_id * 4294967296 + f.first_turn AS review_id,
  make_timestamp((1704067200 + c.conv_id * 100 + c.turn) * 1000000) AS ts,
  c.conv_id * 4294967296 + c.turn AS seq
FROM conversations c
JOIN (SELECT conv_id, min(turn) AS first_turn FROM conversations WHERE role = 'user' GROUP BY conv_id) f
  ON f.conv_id = c.conv_id
""")

view("review_likes", """
SELECT user_id, review_id, max(ts) AS created_at FROM review_like_log
GROUP BY user_id, review_id HAVING count(*) % 2 = 1
""")

view("person_like_log", """
SELECT o_custkey AS user_id, s_name AS person_name,
  CASE WHEN rn = 1 THEN 'director' ELSE 'actor' END AS person_type, ts, CAST(rn AS BIGINT) AS seq
FROM (
  SELECT o_custkey, s_name, ts,
    row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, s_name ASC) AS rn
  FROM (SELECT o_custkey, l_suppkey, count(*) AS n, max(l_shipdate) AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey HAVING count(*) >= 2) p
  JOIN supplier ON s_suppkey = l_suppkey
) t
""")

view("liked_persons", """
SELECT user_id, person_name, arg_max(person_type, {'ts': ts, 'seq': seq}) AS person_type,
  max(ts) AS created_at
FROM person_like_log GROUP BY user_id, person_name HAVING count(*) % 2 = 1
""")

view("persons", """
SELECT s_suppkey AS ord, s_name AS name, 'Person ' || CAST(s_suppkey AS VARCHAR) AS name_en,
  CASE s_suppkey % 4
    WHEN 0 THEN 'https://img.example.com/view/celebrity/s/public/p' || CAST(s_suppkey AS VARCHAR) || '.jpg'
    WHEN 1 THEN 'https://img.example.com/view/personage/m/public/' || CAST(s_suppkey AS VARCHAR) || '.webp'
    WHEN 2 THEN '' END AS avatar_url,
  '' AS avatar_local_path, CASE WHEN s_suppkey % 2 = 0 THEN '男' ELSE '女' END AS gender,
  '' AS birth_date, n_name AS birthplace,
  CASE s_suppkey % 3 WHEN 0 THEN '导演 / 演员' WHEN 1 THEN '演员' END AS profession,
  '' AS biography, CAST(s_suppkey AS VARCHAR) AS douban_id, CAST(NULL AS VARCHAR) AS personage_id
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
""")

view("persons_raw", """
SELECT c_custkey AS ord, c_name AS name,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST((c_custkey * 7) % 1201 AS VARCHAR) END AS douban_id,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST((c_custkey * 5) % 1103 AS VARCHAR) END AS personage_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://img.example.com/view/celebrity/m/' || CAST(c_custkey AS VARCHAR) || '.jpg' END AS avatar_url,
  CASE WHEN c_custkey % 5 = 0 THEN repeat(c_mktsegment, 8) END AS biography,
  CASE WHEN c_custkey % 4 = 0 THEN 'avatars/' || CAST(c_custkey AS VARCHAR) || '.jpg' ELSE '' END AS avatar_local_path,
  c_custkey % 7 = 0 AS _no_avatar, c_custkey % 19 = 0 AS _scrape_failed, '2024-01-01' AS _scraped_at
FROM customer
""")

# directory lookups keep the last entry per name in file order
view("persons_by_name", """
SELECT * FROM persons QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC) = 1
""")


_IDENT = re.compile(r"\b([a-z_][a-z0-9_]*)\b")


def _deps(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(_IDENT.findall(sql)) if w in VIEWS]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it references (transitively), in
    dependency order. ``extra`` adds query-local CTEs (name -> SQL)."""
    local = dict(extra or {})
    order: list[str] = []
    seen: set[str] = set()

    def visit(name: str, sql: str) -> None:
        if name in seen:
            return
        seen.add(name)
        for d in _deps(sql):
            if d != name:
                visit(d, VIEWS[d])
        for d in [w for w in dict.fromkeys(_IDENT.findall(sql)) if w in local and w != name]:
            visit(d, local[d])
        order.append(name)

    for name, sql in local.items():
        visit(name, sql)
    for d in _deps(body):
        visit(d, VIEWS[d])
    for d in [w for w in dict.fromkeys(_IDENT.findall(body)) if w in local]:
        visit(d, local[d])
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{(local.get(n) or VIEWS[n]).strip()}\n)" for n in order)
    return f"WITH {ctes}\n{body.strip()}"
