from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.operators import catalogue as C


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_split_multi(spark):
    assert _one(spark, T.split_multi, " A / B,,C /") == ["A", "B", "C"]
    assert _one(spark, T.split_multi, "　A /B") == ["A", "B"]
    assert _one(spark, T.split_multi, "A/A") == ["A", "A"]
    assert _one(spark, T.split_multi, None) == []


def test_parse_rating(spark):
    got = [_one(spark, T.parse_rating, v) for v in ("", "N/A", None, "8.5d", " 8.5 ", "10")]
    assert got == [0.0, 0.0, 0.0, 0.0, 8.5, 10.0]


def test_year_runtime(spark):
    assert _one(spark, T.parse_year, "soon") is None
    assert _one(spark, T.parse_year, "2035-01(X)") == 2035
    assert _one(spark, T.parse_runtime, "59 min") == 59
    assert _one(spark, T.parse_runtime, "") == 0
    assert _one(spark, T.parse_runtime, "1" + "0" * 29) == 0


def test_round_half_up(spark):
    assert _one(spark, lambda c: T.round_half_up(c, 2), 2.675, "double") in (2.67, 2.68)
    assert _one(spark, lambda c: T.round_half_up(c, 1), 0.25, "double") == 0.3


def test_person_helpers(spark):
    name, en = T.split_cjk_latin(F.lit("张三 Zhang San"))
    r = spark.range(1).select(name.alias("n"), en.alias("e")).first()
    assert (r.n, r.e) == ("张三", "Zhang San")
    r = spark.range(1).select(*T.split_cjk_latin(F.lit("Zhang San"))).first()
    assert tuple(r) == ("Zhang San", "")
    assert _one(spark, T.normalize_image_url, "https://x/view/celebrity/m/public/p1.jpg") == \
        "https://x/view/celebrity/raw/public/p1.jpg"
    assert _one(spark, T.normalize_image_url, "https://x/view/personage/s/public/p1.jpg") == \
        "https://x/view/personage/l/public/p1.jpg"
    assert _one(spark, T.primary_type, "导演 / 演员") == "director"
    assert _one(spark, T.primary_type, "演员 / 导演") == "actor"
    assert _one(spark, lambda c: T.icontains(c, "%"), "100%") is True
    assert _one(spark, lambda c: T.icontains(c, "_"), "ab") is False


def test_normalize_items(spark, raw_items):
    it = {r.ord: r for r in C.normalize_items(raw_items).collect()}
    assert set(it) == {1, 2, 3, 4, 5, 8, 9, 10}        # missing id / empty title dropped
    assert it[8].title == ""                            # blank title survives, stripped
    assert it[1].genres == ["A", "B", "C"] and it[1].top_actors == ["Bob", "Cid", "Dan", "Eve", "Fay"]
    assert it[2].rating == 0.0 and it[4].rating == 0.0 and it[5].rating == 7.0
    assert it[3].year == 0 and it[2].year is None and it[4].year == 2035
    assert it[10].genres == [] and it[10].language == ""
    last = {r.id: r.title for r in C.items_by_id(C.normalize_items(raw_items)).collect()}
    assert last["2"] == "Beta again"                    # lookups keep the last record
