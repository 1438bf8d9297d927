import json

from marquee.operators import persons as P
from marquee.sources import files as FS


def test_persons_map_keeps_file_order(spark, tmp_path):
    data = '{"Ann": {"douban_id": "1", "profession": "导演"}, "Bob": {"douban_id": "1"}, ' \
           '"Cid": {"douban_id": "3", "_no_avatar": true}}'
    p = tmp_path / "persons.json"
    p.write_text(data, encoding="utf-8")
    df = FS.read_persons_map(spark, str(p))
    rows = [(r.ord, r.name, r.douban_id) for r in df.orderBy("ord").collect()]
    assert rows == [(0, "Ann", "1"), (1, "Bob", "1"), (2, "Cid", "3")]
    clean = {r.name for r in P.clean_persons(df).collect()}
    assert clean == {"Ann", "Cid"}


def test_items_json_array_and_csv(spark, tmp_path):
    recs = [{"id": 1, "title": "A", "rating": "8.1", "genre": "X/Y", "hot_comments": ["good", "bad"]},
            {"id": "2", "title": "B", "rating": 7, "cast": "P, Q"}]
    jp = tmp_path / "films.json"
    jp.write_text(json.dumps(recs), encoding="utf-8")
    df = FS.read_items_json(spark, str(jp))
    got = {r.id: (r.title, r.rating, r.hot_comments) for r in df.collect()}
    assert got["1"] == ("A", "8.1", ["good", "bad"]) and got["2"][1] == "7"
    cp = tmp_path / "films.csv"
    cp.write_text("﻿id,title,rating,genre\n1,A,8.1,\"X, Y\"\n2,B,,\n", encoding="utf-8")
    c = {r.id: (r.title, r.rating, r.genre, r.cast) for r in FS.read_items_csv(spark, str(cp)).collect()}
    assert c == {"1": ("A", "8.1", "X, Y", ""), "2": ("B", "", "", "")}
    n = FS.import_items(spark, str(jp), str(tmp_path / "out"))
    assert n == 2
