from marquee.operators import browse as B
from marquee.operators import catalogue as C
from marquee.operators import reports as R


def test_rating_distribution_edges(spark, raw_items):
    items = C.normalize_items(raw_items)
    d = {r.bin: r.n for r in R.rating_distribution(items).collect()}
    # 8.5 (ord 1), 7.0, 10.0 (closed last bin), 6.0; 10.5 falls in no bin; unrated excluded
    assert d[8] == 1 and d[7] == 1 and d[9] == 1 and d[6] == 1 and sum(d.values()) == 4


def test_genre_counts_repeats_vs_facets(spark, raw_items):
    items = C.normalize_items(raw_items)
    g = {r.genre: r.n for r in R.genre_distribution(items).collect()}
    assert g["A"] == 6          # "A/A" counts twice in the report
    f = {r.value: r.n for r in B.facet_counts(items).filter("facet = 'genre'").collect()}
    assert f["A"] == 5          # ... and once in the facet counts


def test_persons_by_count_director_not_actor(spark, raw_items):
    items = C.normalize_items(raw_items)
    pc = B.person_credits_rated(items).collect()
    per_film = [(r.name, r.role) for r in pc]
    # film 1: Bob directs and acts -> counted once, as director
    assert ("Bob", "director") in per_film
    assert per_film.count(("Bob", "actor")) == 2   # films 5 and 8 (rated), not film 1


def test_runtime_bins(spark, raw_items):
    items = C.normalize_items(raw_items)
    rows = sorted(R.runtime_distribution(items).collect(), key=lambda r: r.bin)
    assert [r.label for r in rows][:2] == ["0-30", "30-60"]
    assert sum(r.n for r in rows) == 3    # 120, 59, 90 (400 and 0 excluded)
