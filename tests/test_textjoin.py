import random

from marquee.operators.textjoin import contains_pairs


def test_contains_pairs_matches_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "abcde "
    hays = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    needles = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4))) for _ in range(40)] + ["a", "ab", "e d"]
    h = spark.createDataFrame(list(enumerate(hays)), "hay_id long, hay_text string")
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle_text string")
    got = {(r.needle_id, r.hay_id) for r in contains_pairs(n, h).collect()}
    want = {(i, j) for i, nd in enumerate(needles) for j, hy in enumerate(hays) if nd and nd in hy}
    assert got == want


def test_candidates_of_long_needles_do_not_grow_with_the_square(spark):
    """Numbered names share all their short grams; longer ones tell them apart."""
    from pyspark.sql import functions as F
    n = 3000
    h = spark.range(n).select(F.col("id").alias("hay_id"), F.format_string("Supplier#%09d Jr.", "id").alias("hay_text"))
    d = spark.range(n).select((F.col("id") + 2).alias("needle_id"), F.format_string("%09d", "id").alias("needle_text"))
    looked = {}
    got = contains_pairs(d, h, tell=looked)
    assert {(r.needle_id - 2, r.hay_id) for r in got.collect()} == {(i, i) for i in range(n)}
    assert looked["candidates"].count() <= 11 * n


def test_needles_of_every_length_and_odd_texts(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("ab") for _ in range(90))
    hays = [long, long[:40], "𝒜b" * 20, "", None, "ab"]
    needles = [long[i:i + k] for k in (1, 2, 3, 4, 5, 7, 8, 13, 31, 32, 33, 70, 90) for i in (0, 6) if i + k <= 90]
    needles += ["", None, "𝒜b" * 9, "b𝒜", long + "a"]
    h = spark.createDataFrame(list(enumerate(hays)), "hay_id long, hay_text string")
    d = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle_text string")
    got = sorted((r.needle_id, r.hay_id) for r in contains_pairs(d, h).collect())
    assert got == sorted((i, j) for i, x in enumerate(needles) for j, y in enumerate(hays) if x and y is not None and x in y)
    assert contains_pairs(d.limit(0), h).collect() == [] and contains_pairs(d, h.limit(0)).collect() == []
