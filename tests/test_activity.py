import datetime as dt

from marquee.operators import activity as A

LOG = "user_id long, item_id string, kind string, score int, ts timestamp, src int, k1 long, k2 long"


def _t(s):
    return dt.datetime(2024, 1, 1, 0, 0, s)


def test_toggles_parity(spark):
    rows = [(1, "a", "like", None, _t(1), 0, 1, 0), (1, "a", "like", None, _t(2), 0, 2, 0),       # twice: off
            (1, "b", "like", None, _t(1), 0, 3, 0),                                               # once: on
            (2, "a", "like", None, _t(1), 0, 4, 0), (2, "a", "like", None, _t(2), 0, 5, 0),
            (2, "a", "like", None, _t(3), 0, 6, 0)]                                              # thrice: on
    got = {(r.user_id, r.item_id): r.created_at for r in A.toggles_current(spark.createDataFrame(rows, LOG), "like").collect()}
    assert got == {(1, "b"): _t(1), (2, "a"): _t(3)}


def test_rate_delete_rate_restarts_created(spark):
    rows = [(1, "a", "rate", 5, _t(1), 0, 1, 0), (1, "a", "rate", 7, _t(2), 0, 2, 0),
            (1, "a", "unrate", None, _t(3), 0, 3, 0), (1, "a", "rate", 9, _t(4), 0, 4, 0),
            (1, "b", "rate", 3, _t(1), 0, 5, 0), (1, "b", "rate", 4, _t(1), 0, 6, 0)]  # same second: seq decides
    got = {(r.item_id): (r.score, r.created_at, r.updated_at)
           for r in A.ratings_current(spark.createDataFrame(rows, LOG)).collect()}
    assert got["a"] == (9, _t(4), _t(4))
    assert got["b"] == (4, _t(1), _t(1))


def test_person_like_type_not_in_key(spark):
    rows = [(1, "Ann", "director", _t(1), 1), (1, "Ann", "actor", _t(2), 2),   # like as director, then "like" as actor: off
            (1, "Ann", "actor", _t(3), 3),                                      # re-liked as actor
            (1, "Bob", "director", _t(1), 4)]
    log = spark.createDataFrame(rows, "user_id long, person_name string, person_type string, ts timestamp, seq long")
    got = {r.person_name: r.person_type for r in A.person_likes_current(log).collect()}
    assert got == {"Ann": "actor", "Bob": "director"}


def test_users_current_partial_updates(spark):
    users = spark.createDataFrame([(1, "ann", "a@x", "user", "", None, True)],
                                  "id long, username string, email string, role string, avatar string, "
                                  "created_at timestamp, is_active boolean")
    upd = spark.createDataFrame([(1, _t(1), 1, "", "b@x", None, None, False),
                                 (1, _t(2), 2, "anna", None, None, "admin", True)],
                                "user_id long, ts timestamp, seq long, username string, email string, avatar string, "
                                "role string, toggle_active boolean")
    r = A.users_current(users, upd).first()
    assert (r.username, r.email, r.role, r.is_active) == ("anna", "b@x", "admin", False)
