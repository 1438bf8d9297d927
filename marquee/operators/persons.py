"""Person directory, credits joins, cleaning and page extraction
(J5, J7-J9, J12, J13, A22, A23, E1-E4).

Skew notes. "Keep the first row per key" is an aggregate ``min(ord)`` per key
(map-side partial aggregation, so a key holding a third of all rows costs one
row per task) followed by a join on ``(key, ord)``, which spreads a hot key
over many tasks. Per-name top-k lists use ``row_number() <= k`` (a per-task
group limit before the exchange), never ``collect_list`` over a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.agg import dense_ids, top_k
from marquee.functions.text import (bio_trim, file_ext_choice, normalize_image_url, primary_type,
                                    split_cjk_latin, text_or_empty, ustrip)

INTERNAL_FIELDS = ("_no_avatar", "_scrape_failed", "_scraped_at")
FILL_FIELDS = ("avatar_local_path", "avatar_url", "name_en", "gender", "birth_date", "biography")
MIN_APPEARANCES = 2
FILMS_PER_PERSON = 10
COLLABORATORS = 10
TASK_PAIRS, CHUNK_PAIRS = 1 << 24, 1 << 22  # (seed, other) pairs of a task, and of those added up at once


def truthy(c) -> "F.Column":
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c.cast("string") != "")


def directory_by_name(persons: DataFrame) -> DataFrame:
    """Directory lookup by name: a repeated name keeps its last entry in file
    order, like a JSON object read into a map (one aggregate, no sort)."""
    cols = [c for c in persons.columns if c != "name"]
    agg = persons.groupBy("name").agg(F.max_by(F.struct(*cols), F.col("ord")).alias("r"))
    return agg.select("name", *[F.col(f"r.{c}").alias(c) for c in cols])


def keep_first(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """First row per non-empty ``key`` by ``order``; rows with an empty
    key pass through. Skew-safe: partial min per key, then join on (key, order)."""
    firsts = df.filter(truthy(key)).groupBy(key).agg(F.min(order).alias(order))
    kept = df.join(firsts, [key, order], "left_semi")
    return kept.unionByName(df.filter(~truthy(key)))


def clean_persons(raw: DataFrame) -> DataFrame:
    """Dedup on douban_id, then on personage_id among the survivors, then
    drop internal fields and rows without douban_id (in that order: a row
    without douban_id can win pass 2 and then be dropped)."""
    p1 = keep_first(raw, "douban_id")
    p2 = keep_first(p1, "personage_id")
    keep = [c for c in raw.columns if c not in INTERNAL_FIELDS]
    return p2.filter(truthy("douban_id")).select(*keep)


def dedup_report(raw: DataFrame) -> DataFrame:
    """Rows removed by each pass, with the name kept in their place."""
    out = None
    cur = raw
    for step, key in ((1, "douban_id"), (2, "personage_id")):
        firsts = (cur.filter(truthy(key)).groupBy(key)
                  .agg(F.min("ord").alias("kept_ord"), F.min_by("name", F.col("ord")).alias("kept_name")))
        removed = (cur.filter(truthy(key)).join(firsts, key)
                   .filter(F.col("ord") != F.col("kept_ord"))
                   .select(F.lit(step).alias("pass"), F.lit(key).alias("key"), F.col(key).alias("key_value"),
                           F.col("name").alias("removed_name"), "kept_name"))
        out = removed if out is None else out.unionByName(removed)
        cur = keep_first(cur, key)
    return out


def fill_rates(persons: DataFrame) -> DataFrame:
    """Per field, non-empty count and percentage (1 place); an empty
    directory gives null percentages instead of a division by zero."""
    from marquee.functions.text import round_half_up
    agg = persons.agg(F.count(F.lit(1)).alias("total"),
                      *[F.count_if(truthy(c)).alias(c) for c in FILL_FIELDS])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in FILL_FIELDS]))
    return agg.select("total", rows.alias("s")).select(
        "s.field", "s.n", "total",
        round_half_up(F.try_divide(F.col("s.n") * 100.0, F.col("total")), 1).alias("pct"))


def person_frequency(items: DataFrame, min_films: int = MIN_APPEARANCES,
                     max_ids: int = FILMS_PER_PERSON) -> DataFrame:
    """Names credited (director or cast, once per film) in at least
    ``min_films`` films, with up to ``max_ids`` film ids in file order."""
    per_film = items.select("id", "ord", F.explode(F.array_distinct(F.concat("directors", "all_actors"))).alias("name"))
    counts = per_film.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_films)
    first = top_k(per_film, max_ids, [F.col("ord").asc(), F.col("id").asc()], partition=["name"], name="pos")
    ids = first.groupBy("name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]), ",")
        .alias("film_ids"))
    # presentation order by a distributed range sort (no single-task global rank)
    return counts.join(ids, "name").orderBy(F.col("n").desc(), F.col("name").asc())


def filmography(items: DataFrame, credits: DataFrame) -> DataFrame:
    """J7 for every person: the films of a name in either role with
    is_director / is_actor flags and the person's total (records, also where
    an id repeats); best rated first
    (a distributed range sort, so a prolific name spans several tasks)."""
    roles = credits.groupBy("person", "ord").agg(
        F.max(F.col("role") == "director").alias("is_director"),
        F.max(F.col("role") == "actor").alias("is_actor"))
    totals = roles.groupBy("person").agg(F.count(F.lit(1)).alias("total"))
    films = items.select(F.col("id").alias("item_id"), "title", "rating", "ord")
    out = roles.join(films, "ord").join(totals, "person")
    return out.orderBy("person", F.col("rating").desc(), "ord").select(
        "person", "item_id", "title", "rating", "is_director", "is_actor", "total")


def _coded_films(credits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(name, code)`` of all credited names, numbered in order of name, and the films ``(ord, codes)`` with a
    code for each credit (repeats kept)."""
    from marquee.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(credits.sparkSession)
    cr = credits.select("ord", F.col("person").alias("name"))
    names = dense_ids(cr.select("name").distinct(), "name", "code").select("name", F.col("code").cast("int").alias("code")).checkpoint()
    return names, cr.join(names, "name").groupBy("ord").agg(F.collect_list("code").alias("codes")).checkpoint()


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its number of rows or the sum of its counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _best_pairs(batches, n: int):
    """Of a partition's ``seed, codes`` rows (a seed's rows lie together in it) each seed's ``n`` most frequent other
    codes, ties to the smaller. Pairs are added up by chunks of ``CHUNK_PAIRS``, so what is held grows with distinct pairs only."""
    keys, counts, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def added():
        k, c = _summed(np.concatenate(held))
        return _summed(np.concatenate([keys, k]), np.concatenate([counts, c]))

    for b in batches:
        codes = b.column("codes")
        seed = np.repeat(b.column("seed").to_numpy().astype(np.int64), codes.value_lengths().to_numpy(zero_copy_only=False))
        other = codes.flatten().to_numpy()
        pair = (seed << 32 | other)[seed != other]
        held.append(pair)
        size += len(pair)
        if size >= CHUNK_PAIRS:
            keys, counts = added()
            held, size = [], 0
    if held:
        keys, counts = added()
    seed, other = keys >> 32, keys & 0xFFFFFFFF
    order = np.lexsort((other, -counts, seed))
    first = np.flatnonzero(np.diff(seed[order], prepend=-1))
    rk = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) + 1
    order, rk = order[rk <= n], rk[rk <= n]
    yield pa.RecordBatch.from_arrays([pa.array(seed[order], pa.int32()), pa.array(other[order], pa.int32()), pa.array(counts[order], pa.int64()),
                                      pa.array(rk, pa.int64())], names=["seed", "other", "n", "rk"])


def collaborators(credits: DataFrame, seeds: DataFrame | None, persons_dir: DataFrame,
                  n: int = COLLABORATORS) -> DataFrame:
    """For each seed name (None: every credited name), the others credited
    in its films (each film of the seed once; a name in both lists of a film,
    or repeated, counts each time), top ``n`` with profile. A film goes to each
    of its seeds once, with its list of name codes whole: pairs arise where a
    seed's films lie, so they are counted and ranked there and never moved."""
    names, films = _coded_films(credits.filter(F.col("person").isNotNull()))
    total = films.agg(F.sum(F.size("codes").cast("long") * F.size(F.array_distinct("codes")))).first()[0] or 0
    own = films.select(F.explode(F.array_distinct("codes")).alias("seed"), "codes")
    if seeds is not None:
        asked = names.join(seeds.select("name").distinct(), "name", "left_semi").select(F.col("code").alias("seed"))
        own = own.join(asked, "seed", "left_semi")
    parts = max(int(films.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // TASK_PAIRS))
    t = own.repartition(parts, "seed").mapInArrow(lambda batches: _best_pairs(batches, n), "seed int, other int, n long, rk long")
    d = directory_by_name(persons_dir).select(F.col("name").alias("other"), "avatar_local_path", "profession")
    t = t.join(names.select(F.col("code").alias("seed"), F.col("name").alias("_seed")), "seed").drop("seed").withColumnRenamed("_seed", "seed")
    t = t.join(names.select(F.col("code").alias("other"), F.col("name").alias("_other")), "other").drop("other").withColumnRenamed("_other", "other")
    return t.join(d, "other", "left").select(
        "seed", "rk", "other", "n", F.coalesce("avatar_local_path", F.lit("")).alias("avatar"),
        F.coalesce("profession", F.lit("")).alias("profession"))


def most_credited(credits: DataFrame) -> DataFrame:
    """The name with the most films (ties by name): a data-derived seed."""
    g = credits.select("person", "item_id").distinct().groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return top_k(g, 1, [F.col("n").desc(), F.col("person").asc()]).select(F.col("person").alias("name"))


def person_lookup(names: DataFrame, persons_dir: DataFrame, credits: DataFrame) -> DataFrame:
    """Directory entry of each name: exact name; else the first entry
    (file order) whose name contains the query or is contained in it; else a
    stub when the name has films; else nothing. Containment candidates come
    from gram-routed equi-joins, not a nested loop."""
    from marquee.operators.textjoin import contains_pairs
    from marquee.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(names.sparkSession)
    d = persons_dir.select("ord", "name", "avatar_url", "profession")
    names = names.checkpoint()  # the names are asked for several times
    exact = names.join(d, "name").select("name", "ord", F.lit(1).alias("tier"))
    missing = names.join(d.select("name"), "name", "left_anti").checkpoint()
    dir_ids = d.select(F.col("ord"), F.col("name").alias("text"))
    q_ids = missing.select(F.col("name").alias("qname"))
    # directory name inside the query name, and query name inside the directory name
    a = contains_pairs(dir_ids.select(F.col("ord").alias("needle_id"), F.col("text").alias("needle_text")),
                       q_ids.select(F.col("qname").alias("hay_id"), F.col("qname").alias("hay_text")))
    b = contains_pairs(q_ids.select(F.col("qname").alias("needle_id"), F.col("qname").alias("needle_text")),
                       dir_ids.select(F.col("ord").alias("hay_id"), F.col("text").alias("hay_text")))
    cont = (a.select(F.col("hay_id").alias("name"), F.col("needle_id").alias("ord"))
            .unionByName(b.select(F.col("needle_id").alias("name"), F.col("hay_id").alias("ord")))
            .groupBy("name").agg(F.min("ord").alias("ord")).select("name", "ord", F.lit(2).alias("tier")))
    hits = exact.unionByName(cont)
    out = hits.join(d.withColumnRenamed("name", "dir_name"), "ord")
    stub_names = (missing.join(cont.select("name"), "name", "left_anti")
                  .join(credits.select(F.col("person").alias("name")).distinct(), "name", "left_semi"))
    stubs = stub_names.select("name", F.lit(None).cast("bigint").alias("ord"), F.lit(3).alias("tier"),
                              F.col("name").alias("dir_name"), F.lit("").alias("avatar_url"),
                              F.lit(None).cast("string").alias("profession"))
    return out.select("name", "ord", "tier", "dir_name", "avatar_url", "profession").unionByName(stubs)


def worklist(persons_dir: DataFrame, names: DataFrame) -> DataFrame:
    """Names that still need a profile: not in the directory with an
    avatar or a no-avatar mark (incremental ingest as a left anti join)."""
    done = persons_dir.filter(truthy("avatar_local_path") | F.coalesce(F.col("_no_avatar"), F.lit(False)))
    return names.join(done.select("name"), "name", "left_anti")


#: Labels of the property list and the field each fills (fixed values of the page format), in order of their test.
PROPERTY_LABELS = (("性别", "gender"), ("出生日期", "birth_date"), ("出生地", "birthplace"), ("职业", "profession"),
                   ("英文名", "latin_name"), ("外文名", "latin_name"))
#: Selectors of the picture, best first: a class on the image, or a part of its address.
IMAGE_CLASS, IMAGE_SOURCES = "avatar", ("personage/m/public", "personage/s_ratio")
IMAGE_SOURCES_LAST = ("celebrity/m/public", "personage")
VOID = ("br", "img", "hr", "input", "meta", "link", "source")
_TOKEN = r"(?s)<!--.*?-->|<[^>]*>|[^<]+"


def _tag(token):
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z0-9]+)", 1))


def _attr(token, name: str):
    return F.coalesce(F.nullif(F.regexp_extract(token, rf'\s{name}\s*=\s*"([^"]*)"', 1), F.lit("")),
                      F.regexp_extract(token, rf"\s{name}\s*=\s*'([^']*)'", 1))


def _has_class(token, name: str):
    return F.array_contains(F.split(_attr(token, "class"), r"\s+"), name)


def _opens(token):
    return token.rlike("^<[A-Za-z]") & ~token.rlike("/>$") & ~_tag(token).isin(*VOID)


def page_tokens(html):
    """A page as an array of tags, comments and texts in order."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def _inside(tokens, starts, dropped=None):
    """The tokens inside the first element whose opening tag satisfies
    ``starts``: one fold over the page with the depth below that tag as state.
    Elements whose opening tag satisfies ``dropped`` are left out."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("skip"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("held"))

    def step(a, t):
        depth, skip, done = a["depth"], a["skip"], a["done"]
        close, opens = t.rlike("^</"), _opens(t)
        begins = ~done & (depth == 0) & opens & starts(t)
        deeper = F.when(begins, 1).when(done | (depth == 0), depth).when(opens, depth + 1).when(close, depth - 1).otherwise(depth)
        ends = ~done & (depth > 0) & (deeper == 0)
        cut = (dropped(t) & opens) if dropped is not None else F.lit(False)
        below = F.when((skip == 0) & (depth > 0) & cut, depth + 1).when((skip > 0) & (deeper < skip), 0).otherwise(skip)
        keep = ~done & (depth > 0) & ~ends & (skip == 0) & (below == 0)
        return F.struct(deeper.alias("depth"), below.alias("skip"), (done | ends).alias("done"),
                        F.when(keep, F.concat(a["held"], F.array(t))).otherwise(a["held"]).alias("held"))

    return F.aggregate(tokens, state, step, lambda a: a["held"])


def _text(tokens, joint: str = ""):
    """The texts among the tokens, each stripped, joined."""
    texts = F.transform(F.filter(tokens, lambda t: ~t.rlike("^<")), lambda t: ustrip(unescape(t)))
    return F.array_join(F.filter(texts, lambda t: t != ""), joint)


def unescape(text):
    """The named character references that such pages use (fixed values of the format)."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"),
                       ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def property_list(tokens):
    """``array<struct<label, value>>`` of the items of ``.subject-property``: a fold
    over the tokens inside it; an item ends with its ``</li>`` and counts if it
    had a label and a value with text."""
    inner = _inside(tokens, lambda t: _has_class(t, "subject-property"))
    state = F.struct(F.lit("").alias("at"), F.lit(0).alias("depth"), F.lit("").alias("label"), F.lit("").alias("value"),
                     F.array().cast("array<struct<label:string,value:string>>").alias("out"))

    def step(a, t):
        opens, close = _opens(t), t.rlike("^</")
        item_ends = close & (_tag(t) == "li")
        starts = F.when(opens & (a["at"] == "") & _has_class(t, "label") & (a["label"] == ""), F.lit("label")).when(
            opens & (a["at"] == "") & _has_class(t, "value") & (a["value"] == ""), F.lit("value"))
        depth = F.when(starts.isNotNull(), 1).when(a["at"] == "", 0).when(opens, a["depth"] + 1).when(close, a["depth"] - 1).otherwise(a["depth"])
        at = F.when(item_ends, F.lit("")).when(starts.isNotNull(), starts).when(depth == 0, F.lit("")).otherwise(a["at"])
        text = F.when(t.rlike("^<"), F.lit("")).otherwise(ustrip(unescape(t)))
        label = F.when(a["at"] == "label", F.concat(a["label"], text)).otherwise(a["label"])
        value = F.when(a["at"] == "value", F.concat(a["value"], text)).otherwise(a["value"])
        full = item_ends & (label != "") & (value != "")
        pair = F.array(F.struct(F.regexp_replace(label, "[:：]+$", "").alias("label"), value.alias("value")))
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(item_ends, F.lit("")).otherwise(label).alias("label"),
                        F.when(item_ends, F.lit("")).otherwise(value).alias("value"),
                        F.when(full, F.concat(a["out"], pair)).otherwise(a["out"]).alias("out"))

    # a page without the closing tag still ends its last item
    return F.aggregate(F.concat(inner, F.array(F.lit("</li>"))), state, step, lambda a: a["out"])


def _property(props, field: str):
    """The value of the last property whose label holds one of the field's
    labels; a label goes to the first field that it fits."""
    def field_of(label):
        return F.coalesce(*[F.when(F.contains(label, F.lit(word)), F.lit(name)) for word, name in PROPERTY_LABELS])

    hits = F.filter(props, lambda p: field_of(p["label"]) == field)
    return F.try_element_at(hits, F.lit(-1))["value"]


def page_image(tokens):
    """The address of the picture by the selectors' order: an image of the class
    inside ``.avatar-container``, of the class anywhere, by address, inside
    ``.pic``, by address."""
    def first(part, test):
        return F.nullif(_attr(F.try_element_at(F.filter(part, lambda t: (_tag(t) == "img") & ~t.rlike("^</") & test(t)), F.lit(1)), "src"), F.lit(""))

    def source(word):
        return lambda t: F.contains(_attr(t, "src"), F.lit(word))

    any_image = lambda t: F.lit(True)
    of_class = lambda t: _has_class(t, IMAGE_CLASS)
    return F.coalesce(first(_inside(tokens, lambda t: _has_class(t, "avatar-container")), of_class), first(tokens, of_class),
                      *[first(tokens, source(w)) for w in IMAGE_SOURCES],
                      first(_inside(tokens, lambda t: _has_class(t, "pic")), any_image),
                      *[first(tokens, source(w)) for w in IMAGE_SOURCES_LAST])


def page_description(tokens):
    """``.desc``, else ``.bd`` inside ``#intro``, without links and buttons."""
    drop = lambda t: _tag(t).isin("a", "button") | _has_class(t, "toggle-more")
    desc = _inside(tokens, lambda t: _has_class(t, "desc"), drop)
    intro = _inside(_inside(tokens, lambda t: _attr(t, "id") == "intro"), lambda t: _has_class(t, "bd"), drop)
    return _text(F.when(F.size(desc) > 0, desc).otherwise(intro), " ")


def person_pages(pages: DataFrame) -> DataFrame:
    """The fields of person pages by selectors: heading split into name and
    Latin name, picture, the property list's fields, description. Tags are
    tokens of one array per page, and each selector is a fold over it."""
    t = pages.select("page_id", "url", page_tokens(F.coalesce("html", F.lit(""))).alias("_t"))
    tokens = F.col("_t")
    h1 = _text(_inside(tokens, lambda x: _tag(x) == "h1"))
    t = t.select("page_id", "url", h1.alias("_h1"), property_list(tokens).alias("_p"), page_image(tokens).alias("_img"),
                 page_description(tokens).alias("_d"))
    name, latin = split_cjk_latin("_h1")
    props = F.col("_p")
    return t.select("page_id", "url", name.alias("name"),
                    F.coalesce(_property(props, "latin_name"), F.nullif(latin, F.lit("")), F.lit("")).alias("name_en"),
                    F.coalesce(normalize_image_url("_img"), F.lit("")).alias("avatar_url"),
                    *[F.coalesce(_property(props, f), F.lit("")).alias(f) for f in ("gender", "birth_date", "birthplace", "profession")],
                    bio_trim("_d").alias("biography"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """E3 on any web page, by regular expressions: heading split into name /
    Latin name, first image's URL normalised to the large size, first
    paragraph trimmed, file extension of the picture. ``person_pages`` reads
    the property list and the selectors of person pages."""
    h = F.regexp_replace(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")
    title = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    img = F.regexp_extract("html", r"<img[^>]*src=\"([^\"]+)\"", 1)
    desc = F.regexp_replace(F.regexp_extract("html", r"(?s)<p[^>]*>(.*?)</p>", 1), "<[^>]+>", " ")
    name, name_en = split_cjk_latin(ustrip(h))
    return pages.select(
        "page_id", "url", ustrip(h).alias("h1"), ustrip(title).alias("title"), name.alias("name"),
        name_en.alias("name_en"), normalize_image_url(img).alias("avatar_url"),
        file_ext_choice(img).alias("ext"), bio_trim(desc).alias("biography"))


def scrape_stats(persons_dir: DataFrame) -> DataFrame:
    """Totals with avatar / biography."""
    return persons_dir.agg(F.count(F.lit(1)).alias("total"),
                           F.count_if(truthy("avatar_local_path")).alias("with_avatar"),
                           F.count_if(truthy("biography")).alias("with_bio"))


def person_primary_type(persons_dir: DataFrame) -> DataFrame:
    """P12 over the directory."""
    return persons_dir.select("name", text_or_empty("profession").alias("profession"),
                              primary_type("profession").alias("primary_type"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page as (item_id, pos, href, text); a page's id is the
    film it describes. Empty link texts are dropped."""
    pat = r'<a href="([^"]*)">([^<]*)</a>'
    e = pages.select(F.col("page_id").cast("string").alias("item_id"),
                     F.arrays_zip(F.regexp_extract_all("html", F.lit(pat), 1).alias("href"),
                                  F.regexp_extract_all("html", F.lit(pat), 2).alias("text")).alias("z"))
    x = e.select("item_id", F.posexplode("z").alias("pos", "l"))
    return x.select("item_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("l.href").alias("href"),
                    ustrip(F.col("l.text")).alias("text")).filter(F.col("text") != "")


def mention_match(credits: DataFrame, links: DataFrame, films: int = 5) -> DataFrame:
    """For every credited name, the first link (film order, then link
    order) on the pages of its first ``films`` films whose text equals,
    contains or is contained in the name. An equi-join on the film, then the
    containment predicate on the candidates."""
    f = credits.select(F.col("person").alias("name"), "item_id", "ord").groupBy("name", "item_id").agg(
        F.min("ord").alias("ord"))
    first = top_k(f, films, [F.col("ord").asc(), F.col("item_id").asc()], partition=["name"], name="frk")
    cand = first.join(links, "item_id")
    t, n = F.col("text"), F.col("name")
    hit = cand.filter((t == n) | F.contains(t, n) | F.contains(n, t))
    best = top_k(hit, 1, [F.col("frk").asc(), F.col("pos").asc()], partition=["name"], name="hrk")
    return best.select("name", "item_id", "pos", "href", "text")


def entity_match(candidates: DataFrame) -> DataFrame:
    """Pick one candidate per name from a ranked result table
    ``(name, pos, cand_id, title, text)``: the first candidate (by ``pos``)
    whose title + text contains the name, or contains a part of the name
    (split on '·' and blanks, parts of at least 2 characters); otherwise the
    first candidate. One window-free pass: flag, then ``min_by`` per name."""
    combined = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    parts = F.filter(F.split(F.regexp_replace(F.col("name"), "·", " "), r"\s+"), lambda p: F.length(p) >= 2)
    hit = (F.contains(combined, F.col("name")) | F.contains(F.coalesce("title", F.lit("")), F.col("name"))
           | F.exists(parts, lambda p: F.contains(combined, p)))
    flagged = candidates.select("name", "pos", "cand_id", F.when(hit, 0).otherwise(1).alias("miss"))
    g = flagged.groupBy("name").agg(F.min_by(F.struct("cand_id", "miss"), F.struct("miss", "pos")).alias("b"))
    return g.select("name", F.col("b.cand_id").alias("cand_id"),
                    F.when(F.col("b.miss") == 0, F.lit("match")).otherwise(F.lit("fallback")).alias("how"))
