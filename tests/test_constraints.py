"""Every rule fires once on a fixture, and the sink takes what was rejected."""
from marquee.operators import constraints as CN


def fixture(spark):
    make = spark.createDataFrame
    film = "user_id long, item_id string"
    return {
        "user": make([(1, "ann", "user"), (2, "b", "admin"), (3, "x" * 21, "user"), (4, "ann", "user"), (5, "eve", "root"), (6, None, None)],
                     "id long, username string, role string"),
        "rating": make([(1, "a", 5), (1, "a", 6), (1, "b", 0), (1, "c", 11), (1, "d", None), (9, "a", 5)], film + ", score int"),
        "review": make([(10, 1, " x "), (11, 1, "fine"), (12, 1, "y" * 501), (13, 9, "fine"), (14, 1, None)],
                       "id long, user_id long, content string"),
        "like": make([(1, "a"), (1, "a"), (1, "a"), (9, "b")], film),
        "favorite": make([(1, "a"), (1, "a"), (9, "b")], film),
        "history": make([(1, "a"), (1, "a"), (9, "b")], film),
        "review_like": make([(1, 11), (1, 11), (9, 11), (1, 99)], "user_id long, review_id long"),
        "reply": make([(20, 11, 1, "ok"), (21, 99, 1, "ok"), (22, 11, 9, "ok"), (23, 11, 1, " 　")],
                      "id long, review_id long, user_id long, content string"),
        "liked_person": make([(1, "Ann", "actor"), (1, "Ann", "director"), (1, "Bob", "singer"), (9, "Cid", "actor")],
                             "user_id long, person_name string, person_type string"),
    }


WANT = sorted([
    ("user", "2", "username_too_short"), ("user", "6", "username_too_short"), ("user", "3", "username_too_long"),
    ("user", "4", "username_taken"), ("user", "5", "role_domain"), ("user", "6", "role_domain"),
    ("rating", "1:b", "score_out_of_range"), ("rating", "1:c", "score_out_of_range"), ("rating", "1:d", "score_out_of_range"),
    ("rating", "1:a", "rated_twice"), ("rating", "9:a", "unknown_user"),
    ("review", "10", "review_too_short"), ("review", "14", "review_too_short"), ("review", "12", "review_too_long"), ("review", "13", "unknown_user"),
    ("like", "1:a", "liked_twice"), ("like", "1:a", "liked_twice"), ("like", "9:b", "unknown_user"),
    ("favorite", "1:a", "favorited_twice"), ("favorite", "9:b", "unknown_user"), ("history", "9:b", "unknown_user"),
    ("review_like", "1:11", "liked_twice"), ("review_like", "9:11", "unknown_user"), ("review_like", "1:99", "unknown_review"),
    ("reply", "21", "unknown_review"), ("reply", "22", "unknown_user"), ("reply", "23", "reply_empty"),
    ("liked_person", "1:Ann", "liked_twice"), ("liked_person", "1:Bob", "person_type_domain"), ("liked_person", "9:Cid", "unknown_user")])


def test_every_rule_fires(spark):
    got = sorted(tuple(r) for r in CN.violations(fixture(spark)).collect())
    assert got == WANT
    assert {(e, r) for e, _, r in got} == {(r.entity, r.reason) for r in CN.RULES}
    assert sum(r.kind == "foreign" for r in CN.RULES) == 10


def test_rejected_records_go_to_the_sink(spark, tmp_path):
    tables = fixture(spark)
    CN.write_rejected(CN.violations(tables), str(tmp_path / "rejected"))
    rejected = spark.read.parquet(str(tmp_path / "rejected"))
    assert sorted((r.entity, r.record_id, r.reason) for r in rejected.collect()) == WANT
    left = CN.accepted(tables, rejected)
    assert [r.id for r in left["user"].collect()] == [1] and [r.id for r in left["review"].collect()] == [11]
    assert left["rating"].count() == 0 and [r.id for r in left["reply"].collect()] == [20]
    assert all(CN.violations({**left, e: left[e]}).filter(f"entity = '{e}'").count() == 0 for e in ("review", "reply"))
