import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marquee.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="marquee-tests")
    yield s


RAW_FIELDS = ("ord id title rating director cast genre country language release_date runtime").split()


@pytest.fixture(scope="session")
def raw_items(spark):
    """Hand-made edge rows (expected results written by hand in the tests)."""
    rows = [
        (1, "1", "Alpha", "8.5", "Ann/Bob", "Bob, Cid, Dan, Eve, Fay, Gus", " A / B,,C /", "X / Y", "en/fr",
         "1994-05-01", "120 min"),
        (2, "2", "Beta", "N/A", "Cid", "Ann", "　A /B", "X", "", "soon", ""),
        (3, "3", "Gamma", "", "Dan", "Eve", "A/A", "Y", "es, en", "0000", "0"),
        (4, "4", "Delta", "8.5d", "Eve", "Ann, Eve", "B", "Z", "en", "2035-01", "59 min"),
        (5, "5", "Eps", " 7.0 ", "Ann", "Bob", "C", "X / X", "en", "2021", "400"),
        (6, "", "NoId", "9.0", "Ann", "Bob", "A", "X", "en", "2000", "100"),
        (7, "7", "", "9.0", "Ann", "Bob", "A", "X", "en", "2000", "100"),
        (8, "8", "   ", "10.0", "Ann", "Bob", "A", "X", "en", "1999", "1" + "0" * 29),
        (9, "2", "Beta again", "6.0", "Cid", "Ann", "A", "X", "en", "1980", "90"),
        (10, "10", "Zeta", "10.5", None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'ord' else 'string'}" for c in RAW_FIELDS))
