"""The rating state as a fold of micro-batches, in one and in several batches."""
import datetime

import pytest

from marquee.operators.activity import ratings_current
from marquee.streaming import activity_stream as ST


def _t(s):
    return datetime.datetime(2024, 1, 1, 0, 0, s)


# batches of (user, film, kind, score, second); the order of rows within a batch doesn't matter
BATCHES = [
    [(1, "a", "rate", 5, 2), (1, "a", "rate", 3, 1), (2, "a", "rate", 4, 1)],
    [(1, "a", "rate", 7, 3), (2, "a", "unrate", None, 4)],
    [(1, "a", "rate", 9, 6), (1, "a", "unrate", None, 5), (3, "b", "unrate", None, 5)],
    [(2, "a", "rate", 8, 7), (2, "a", "rate", 2, 8)],
    [(1, "a", "unrate", None, 9), (4, "c", "rate", 1, 9)],
]


@pytest.mark.parametrize("upto", [1, 2, 3, 5])
def test_fold_of_batches_is_the_batch_result(spark, upto):
    rows = lambda b: spark.createDataFrame([(u, i, k, s, _t(t), 0, t, 0) for u, i, k, s, t in b], ST.ACTIVITY_SCHEMA)
    log = None
    for b in BATCHES[:upto]:
        change = ST._rating_changes(rows(b))
        log = change if log is None else log.unionByName(change)
    whole = rows([r for b in BATCHES[:upto] for r in b])
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "item_id", "score", "created_at", "updated_at").collect())
    assert key(ST.ratings_from_changes(log)) == key(ratings_current(whole))
    if upto == 3:
        assert key(ST.ratings_from_changes(log)) == [(1, "a", 9, _t(6), _t(6))]
