import random
import re
from collections import Counter

from pyspark.sql import functions as F

from marquee.operators import catalogue as C
from marquee.operators import persons as P

RAW = "ord long, name string, douban_id string, personage_id string, _no_avatar boolean, " \
      "_scrape_failed boolean, _scraped_at string, avatar_local_path string"


def test_clean_persons_pass_order(spark):
    rows = [(1, "a", "d1", "p1", False, False, "", ""),
            (2, "b", "d1", "p2", False, False, "", ""),    # dup douban -> removed in pass 1
            (3, "c", None, "p3", False, False, "", ""),    # no douban: wins p3 in pass 2, then dropped
            (4, "d", "d4", "p3", False, False, "", ""),    # loses p3 to c -> removed: both vanish
            (5, "e", "d5", None, False, False, "", "")]
    out = P.clean_persons(spark.createDataFrame(rows, RAW))
    assert sorted(r.name for r in out.collect()) == ["a", "e"]
    assert "_no_avatar" not in out.columns
    rep = {(r["pass"], r.removed_name): r.kept_name for r in P.dedup_report(spark.createDataFrame(rows, RAW)).collect()}
    assert rep == {(1, "b"): "a", (2, "d"): "c"}


def test_collaborators_counting(spark, raw_items):
    items = C.normalize_items(raw_items)
    cr = C.credits(items)
    seeds = spark.createDataFrame([("Ann",)], "name string")
    persons = spark.createDataFrame([(1, "Bob", "", "导演")], "ord long, name string, avatar_local_path string, profession string")
    got = {r.other: r.n for r in P.collaborators(cr, seeds, persons).collect()}
    # Ann's films: 1 (director), 2 and 9 (cast), 4 (cast), 5, 8, 10? (10 has no credits)
    # Bob: director+cast in film 1 counts twice, cast of 5 and 8 -> 4
    assert got["Bob"] == 4
    assert "Ann" not in got


def test_person_frequency(spark, raw_items):
    items = C.normalize_items(raw_items)
    pf = {r.name: (r.n, r.film_ids) for r in P.person_frequency(items).collect()}
    assert pf["Ann"][0] == 6                      # once per film even when director and cast
    assert pf["Ann"][1].split(",")[0] == "1"      # film ids in file order


def test_entity_match_tiers(spark):
    rows = [("张三", 1, "a", "李四", ""), ("张三", 2, "b", "张三 Zhang", ""),        # exact containment at pos 2
            ("Anna Lee", 1, "c", "x", "y"), ("Anna Lee", 2, "d", "Lee Ann", ""),  # part 'Lee' at pos 2
            ("Bo", 1, "e", "q", "r"), ("Bo", 2, "f", "s", "t")]                   # no hit: first candidate
    c = spark.createDataFrame(rows, "name string, pos int, cand_id string, title string, text string")
    got = {r.name: (r.cand_id, r.how) for r in P.entity_match(c).collect()}
    assert got == {"张三": ("b", "match"), "Anna Lee": ("d", "match"), "Bo": ("e", "fallback")}


def test_collaborators_of_all_names_do_not_move_pairs(spark):
    rnd = random.Random(3)
    films = {o: [f"p{rnd.randint(0, 14)}" for _ in range(rnd.randint(0, 6))] for o in range(40)}
    rows = [(str(o), o, p, "actor", i + 1) for o, ps in films.items() for i, p in enumerate(ps)]
    cr = spark.createDataFrame(rows, "item_id string, ord long, person string, role string, pos int")
    persons = spark.createDataFrame([(1, "p3", "pic", None)], "ord long, name string, avatar_local_path string, profession string")
    out = P.collaborators(cr, None, persons, n=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(seed#\d+, other#\d+", plan)
    want = set()
    for seed in {p for ps in films.values() for p in ps}:
        met = Counter(p for ps in films.values() if seed in ps for p in ps if p != seed)
        best = sorted(met.items(), key=lambda x: (-x[1], x[0]))[:4]
        want |= {(seed, k + 1, o, c, "pic" if o == "p3" else "", "") for k, (o, c) in enumerate(best)}
    assert {tuple(r) for r in out.collect()} == want


def test_pairs_are_added_up_without_rows_of_their_own(spark, monkeypatch):
    import pyarrow as pa
    rnd = random.Random(4)
    lists = [(s, [rnd.randint(0, 30) for _ in range(rnd.randint(0, 12))]) for s in range(9) for _ in range(30)]
    rnd.shuffle(lists)
    monkeypatch.setattr(P, "CHUNK_PAIRS", 50)  # many chunks
    batches = [pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int32()), pa.array([c for _, c in part], pa.list_(pa.int32()))], names=["seed", "codes"])
               for part in (lists[i:i + 20] for i in range(0, len(lists), 20))]
    got = {tuple(r.values()) for b in P._best_pairs(iter(batches), 5) for r in b.to_pylist()}
    want = set()
    for seed in range(9):
        met = Counter(c for s, codes in lists if s == seed for c in codes if c != seed)
        want |= {(seed, o, n, k) for k, (o, n) in enumerate(sorted(met.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    assert got == want
    assert sum(b.num_rows for b in P._best_pairs(iter([]), 5)) == 0
    cr = spark.createDataFrame([("1", 1, p, "actor", 1) for p in "abc"], "item_id string, ord long, person string, role string, pos int")
    persons = spark.createDataFrame([], "ord long, name string, avatar_local_path string, profession string")
    plan = P.collaborators(cr, None, persons)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Window" not in plan  # the seeds of a film only
