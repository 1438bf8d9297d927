"""Person pages by selectors, page index, store, threads and detail pages on fixtures."""
import datetime
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from marquee.operators import activity as A
from marquee.operators import browse as B
from marquee.operators import persons as P

LONG = "He was born in a small town and made forty films over a long career."
PAGE = """<html><body><!-- <h1>no</h1> --><h1 class="x"> 张 三 <small>Zhang San</small></h1>
<img src="/other.png"><div class="avatar-container a"><p><img class="big avatar" src="https://img.example.com/view/personage/m/public/1.webp"></p></div>
<ul class="subject-property"><li><span class="label">性别:</span><span class="value"> 男 </span></li>
<li><span class="label">出生日期：</span><span class="value">1950年<b>1月</b>2日</span></li>
<li><span class='label'>出生地</span><span class="value">London, <a href="#">UK</a></span></li>
<li><span class="label">职业:</span><span class="value">演员 &amp; 导演</span></li>
<li><span class="label">更多外文名:</span><span class="value">Z. San</span></li>
<li><span class="label">星座:</span><span class="value">x</span></li><li><span class="label">性别:</span><span class="value"></span></li><li>no label</li></ul>
<span class="label">性别:</span><span class="value">outside</span>
<div class="desc">%s <a href="#">more</a><button><i>x</i></button><br>End.</div></body></html>""" % LONG


def read(spark, html):
    return P.person_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()


def test_a_whole_person_page(spark):
    r = read(spark, PAGE)
    assert (r.name, r.name_en) == ("张三", "Z. San") or (r.name, r.name_en) == ("张 三", "Z. San")
    assert r.avatar_url == "https://img.example.com/view/personage/l/public/1.webp"
    assert (r.gender, r.birth_date, r.birthplace, r.profession) == ("男", "1950年1月2日", "London,UK", "演员 & 导演")
    assert r.biography == LONG + " End."


@pytest.mark.parametrize("html, url", [
    ('<img src="a.png"><img class="avatar" src="b/celebrity/s/public/p1.jpg">', "b/celebrity/raw/public/p1.jpg"),
    ('<img src="a.png"><img src="x/personage/m/public/2.jpg">', "x/personage/l/public/2.jpg"),
    ('<img src="a.png"><img src="x/personage/s_ratio/2.jpg">', "x/personage/s_ratio/2.jpg"),
    ('<img src="a.png"><div class="pic"><a><img src="in.png"></a></div>', "in.png"),
    ('<div class="pic"></div><img src="y/celebrity/m/public/3.jpg">', "y/celebrity/raw/public/3.jpg"),
    ('<img src="a.png"><img src="z/personage/4.jpg">', "z/personage/4.jpg"),
    ('<div class="avatar-container"><img src="no-class.png"></div><img src="a.png">', ""), ("", ""), (None, "")])
def test_each_fallback_of_the_picture(spark, html, url):
    assert read(spark, html).avatar_url == url


def test_description_fallback_and_short_texts(spark):
    assert read(spark, f'<div id="intro"><h2>Intro</h2><div class="bd">{LONG}<span class="toggle-more">all</span></div></div>').biography == LONG
    assert read(spark, '<div class="desc">short</div>').biography is None
    assert read(spark, f'<div class="bd">{LONG}</div>').biography is None  # not inside the intro


def test_page_index_reads_only_its_folder(spark, tmp_path):
    n = 30_000
    items = spark.range(n).select(
        F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), ((F.col("id") * 7919) % 97 / 10.0).alias("rating"),
        F.lit("").alias("release_date"), (F.col("id") % 180).cast("int").alias("runtime"), F.lit(2000).alias("year"),
        F.array(F.lit("g")).alias("genres"), F.array(F.lit("c")).alias("countries"))
    path = str(tmp_path / "index")
    total = B.page_index(items, path, sort="rating", bucket=1000)
    page = B.indexed_page(spark, path, total, 1000, bucket=1000)
    want = sorted(((-((i * 7919) % 97 / 10.0), str(i)) for i in range(n)))[23_976:24_000]
    assert [(r.rk, r.id) for r in page.orderBy("rk").collect()] == [(23_977 + k, i) for k, (_, i) in enumerate(want)]
    assert page.first().total == n and page.first().total_pages == 1250
    plan = page._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and len({os.path.dirname(f) for f in page.filter("rk = 23977").inputFiles()}) >= 1
    here = [os.path.dirname(r.f) for r in page.select(F.input_file_name().alias("f")).distinct().collect()]
    assert set(here) == {f"file://{path}/bucket=23"}
    across = B.indexed_page(spark, path, total, 42, bucket=1000)  # rows 985 to 1008 lie in two folders
    assert [r.rk for r in across.orderBy("rk").collect()] == list(range(985, 1009))


STORE = """
import sys
sys.path.insert(0, {repo!r})
from marquee.session import local_session
from marquee.sources.store import Store
spark = local_session(2, 2)
store = Store(spark, "v1", {shared!r})
built = []
df = store.get_or_build("numbers", lambda: built.append(1) or spark.range(5))
print("RESULT", len(built), sorted(r.id for r in df.collect()), store.tables(), store.root)
"""


def test_a_second_process_reads_the_first_ones_tables(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = STORE.format(repo=repo, shared=str(tmp_path / "shared"))
    out = [subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300).stdout for _ in range(2)]
    lines = [next(x for x in o.splitlines() if x.startswith("RESULT")) for o in out]
    root = str(tmp_path / "shared" / "marquee-artifacts")
    assert lines == [f"RESULT 1 [0, 1, 2, 3, 4] ['numbers'] {root}", f"RESULT 0 [0, 1, 2, 3, 4] ['numbers'] {root}"]


def test_store_commits_last_and_removes_old_versions(spark, tmp_path):
    from marquee.sources.store import Store
    stores = [Store(spark, f"v{i}", str(tmp_path)) for i in range(4)]
    spark.range(3).write.parquet(f"{stores[0].base}/data/t-unfinished")  # an attempt without an entry
    assert stores[0].read("t") is None
    for s in stores:
        s.write("t", spark.range(2))
    assert stores[1].write("t", spark.range(9)).count() == 2  # the first entry counts
    for i, s in enumerate(stores):
        os.utime(s.base, (1000 + i, 1000 + i))
    assert stores[3].remove_old(1) == ["v0", "v1"] and stores[3].versions() == ["v2", "v3"]
    assert stores[2].read("t").count() == 2 and stores[0].read("t") is None


def _t(s):
    return datetime.datetime(2024, 1, 1, 0, 0, s)


def small(spark):
    make = spark.createDataFrame
    return dict(
        users=make([(1, "ann", ""), (2, "bob", "")], "id long, username string, avatar string"),
        reviews=make([(10 + i, 1 + i % 2, "a", f"r{i}", _t(i)) for i in range(23)] + [(50, 1, "z", "r", _t(1))],
                     "id long, user_id long, movie_id string, content string, created_at timestamp"),
        replies=make([(70, 32, 2, "x", _t(40)), (71, 32, 1, "y", _t(41)), (72, 10, 1, "old", _t(42)), (73, 31, 9, "ghost", _t(43))],
                     "id long, review_id long, user_id long, content string, created_at timestamp"),
        review_likes=make([(1, 32, _t(1)), (2, 32, _t(2)), (2, 10, _t(3))], "user_id long, review_id long, created_at timestamp"),
        ratings=make([(1, "a", 8, _t(1)), (2, "a", 7, _t(1)), (1, "q", 3, _t(1))], "user_id long, item_id string, score int, updated_at timestamp"))


def test_threads_hold_replies_likes_and_scores(spark):
    got = {}
    for r in A.review_thread(**small(spark)).collect():
        got.setdefault(r.part, []).append(r)
    assert {(r.movie_id, r.number, r.score) for r in got["film"]} == {("a", 2, 7.5), ("z", 0, 0.0)}
    assert {r.review_id for r in got["review"] if r.movie_id == "a"} == set(range(13, 33))  # the newest 20
    assert {(r.review_id, r.number) for r in got["review"] if r.number} == {(32, 2)}
    assert {(r.review_id, r.reply_id, r.username) for r in got["reply"]} == {(32, 70, "bob"), (32, 71, "ann")}
    assert {(r.review_id, r.user_id) for r in got["liked"]} == {(32, 1), (32, 2)}
    assert {(r.movie_id, r.user_id, r.score) for r in got["score"]} == {("a", 1, 8.0), ("a", 2, 7.0)}


def test_detail_pages_hold_flags_reviews_similar_films_and_the_visit(spark):
    t, make = small(spark), spark.createDataFrame
    items = make([("a", "A", 9.0), ("b", "B", 0.0)], "id string, title string, rating double")
    requests = make([(1, "a", _t(50)), (2, "b", _t(51)), (2, "ghost", _t(52))], "user_id long, item_id string, ts timestamp")
    pair = "user_id long, item_id string"
    similar = make([("a", 1, "b", "B", 0.5)], "seed string, rk long, id string, title string, similarity double")
    got = {}
    for r in A.item_details(requests, items, t["ratings"], make([(1, "a")], pair), make([(1, "a"), (2, "b")], pair), t["reviews"], t["users"],
                            similar).collect():
        got.setdefault((r.user_id, r.item_id, r.part), []).append((r.rk, r.key, r.text, r.score, r.number))
    assert got[1, "a", "card"] == [(0, "", "A", 9.0, None)] and got[1, "a", "stats"] == [(0, "", "", 7.5, 2)]
    assert got[1, "a", "flags"] == [(0, "", "", 8.0, 3)] and got[2, "b", "flags"] == [(0, "", "", None, 2)]
    assert sorted(got[1, "a", "review"])[:2] == [(1, "32", "ann", None, None), (2, "31", "bob", None, None)] and len(got[1, "a", "review"]) == 20
    assert got[1, "a", "similar"] == [(1, "b", "B", 0.5, None)] and (2, "ghost", "card") not in got and (2, "b", "review") not in got
    log = A.visits(requests, items)
    assert {(r.user_id, r.item_id, r.viewed_at) for r in A.history_current(log).collect()} == {(1, "a", _t(50)), (2, "b", _t(51))}


def test_profile_limits_and_fixed_title(spark):
    """More than 50 ratings and liked persons: the newest 50 show; a film that is missing has the fixed title."""
    make = spark.createDataFrame
    at = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i)
    film = "user_id long, item_id string"
    ratings = make([(1, f"f{i:02d}", 5, at(i)) for i in range(60)], film + ", score int, updated_at timestamp")
    liked = make([(1, f"p{i:02d}", "actor", at(i)) for i in range(70)], "user_id long, person_name string, person_type string, created_at timestamp")
    none = make([], film + ", created_at timestamp")
    reviews = make([], "id long, user_id long, movie_id string, created_at timestamp")
    history = make([], film + ", viewed_at timestamp")
    items = make([("f59", "T", 8.0, "G", "x.jpg")], "id string, title string, rating double, genre_raw string, poster_local_path string")
    persons = make([(1, "p69", "Pe", "演员", "a.jpg")], "ord long, name string, name_en string, profession string, avatar_local_path string")
    users = make([(1, "ann")], "id long, username string")
    got = {}
    for r in A.profile_lists(users, ratings, reviews, none, none, history, liked, items, persons).collect():
        got.setdefault(r.list, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"rating": 50, "actor": 50, "stats": 4}
    first = {r.key: r for v in got.values() for r in v}
    assert (first["f59"].title, first["f59"].genre, first["f59"].poster) == ("T", "G", "x.jpg") and first["f58"].title == A.UNKNOWN_TITLE
    assert (first["p69"].name_en, first["p69"].profession, first["p69"].avatar) == ("Pe", "演员", "a.jpg") and first["p68"].avatar == ""
    assert (first["rating_count"].score, first["rating_count"].rating) == (60, 5.0)
    from marquee.operators.profiles import user_signals
    signals = user_signals(ratings, none, none, history, liked)
    assert signals.filter("signal = 'actor'").count() == 30 and signals.filter("signal = 'rating'").count() == 60
