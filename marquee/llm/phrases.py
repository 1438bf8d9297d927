"""Substring dedup by automata of repeated phrases: a word goes if a window of ``LENGTH`` words around it also starts
earlier.

Windows that are equal have to meet. Each belongs to its anchor, the ``GRAM`` words in it whose hash is smallest (the
leftmost of several), so equal windows have equal anchors at equal places; a run of windows with one anchor, a segment,
travels as one row of hashes. Then

1. anchors that occur once are dropped (a partial count on the hash alone). Of the segments left, those with equal words
   become one, the earliest, with its number of copies; its words are fetched, and the segments are dealt to shards by
   anchor;
2. *confirm*: a shard numbers its words and counts its windows. A window recurs if it is in two segments or in one that
   has copies; these are the phrases, and the earliest segment that holds one is its first place;
3. *compile*: one Aho-Corasick automaton of the shard's phrases over the word numbers (pyahocorasick, keys are sequences).
   Neighbouring windows that exactly the same segments hold are one longer phrase, since where one is, all are;
4. *stream*: every distinct segment with a repeated anchor, of all documents, runs through the automaton of its shard,
   joined to one sequence; a match is a place of a phrase;
5. matches go back to all copies of their segment; those other than the phrase's first place are removed.

An anchor of more than ``PIECES`` segments is a shard of its own, split both ways: its windows are counted across tasks
(partial counts and minima per window, so no hot window is gathered), and blocks of ``PIECES`` segments meet automata of
blocks of ``PHRASES`` phrases.

Hashes only bring together what may be equal; an anchor and its segment's words are told by 64 bits each, and the
matches are of the words themselves.

Defined cases: null, empty and short texts lose nothing; a null doc_id is the greatest; rows that repeat a doc_id with
the same text are one document (all change alike), with other texts documents of their own, in the order of a hash; an
empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import discard, release, written
from marquee.llm.shingles import mix, powers
from marquee.llm.suffixdedup import keyed

LENGTH, GRAM = 20, 8
#: Segments that fill a shard, and phrases of an automaton where an anchor has more segments.
PIECES, PHRASES, HOT = 1 << 14, 1 << 16, 256
#: Bytes of text whose words are hashed together; longer words are hashed by blake2b.
BLOCK, LONG_WORD = 1 << 20, 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NEXT = np.uint64(0x9FB21C651E98DF25)


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of some bytes."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h, start


def word_hashes(texts: list[bytes], block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
    """The words of consecutive texts, some texts at a time: first text, text after the last, hash of every word and
    where each text's words end among them."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= block):
            size += len(texts[b]) + 1
            b += 1
        h, start = _hashes(np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8))
        yield a, b, h, np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts[a:b]]))
        a = b


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values."""
    out = np.full(max(len(h) - width + 1, 0), width, np.uint64)
    for k in range(width if len(out) else 0):
        out = mix(out * _NEXT + h[k:k + len(out)])
    return out


def segments(h: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of several texts, given the hashes of all their words and where each text ends: text, start (in its
    text), number of windows, hash of the anchor, hash of all words."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    if len(h) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = rolled(h, gram)
    # the place of the smallest gram of each window, the leftmost of several: by doubling
    place, span, width = np.arange(len(grams)), 1, length - gram + 1
    while span < width:
        ahead = min(span, width - span)
        a, b = place[:-ahead], place[ahead:]
        place = np.where(grams[a] <= grams[b], a, b)
        span += ahead
    inside = owner[:len(place)] == owner[length - 1:]
    first = np.flatnonzero(inside & np.concatenate([[True], (place[1:] != place[:-1]) | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([(place[1:] != place[:-1]) | ~inside[1:], [True]]))
    n = last - first + 1
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=total[1:])
    whole = mix((total[last + length] - total[first]) * down[first] + n.astype(np.uint64))
    text = owner[first]
    return text, first - np.concatenate([[0], ends[:-1]])[text], n, grams[place[first]], whole


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _segments(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, t = (batch.column(k).to_numpy() for k in ("d", "t"))
        for a, _, h, ends in word_hashes(_bytes(batch.column("text"))):
            text, start, n, anchor, whole = segments(h, ends, length, gram)
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(d[a + text]), pa.array(t[a + text]),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "c", "d", "t", "start", "n"])


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words of the segments asked for, joined by one space.

    ``bytes.split()`` cuts at 0x20 and 0x09 to 0x0D.
    """
    for batch in batches:
        rows, kinds = [], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        d, t = batch.column("d").to_pylist(), batch.column("t").to_pylist()
        for i, (text, asked) in enumerate(zip(_bytes(batch.column("text")), batch.column("asked").to_pylist(), strict=True)):
            words = text.split()
            for s in asked:
                rows.append((s["h"], s["c"], d[i], t[i], s["start"], s["n"], s["copies"],
                             b" ".join(words[s["start"]:s["start"] + s["n"] + length - 1])))
            if len(rows) > 20_000 or (rows and i == batch.num_rows - 1):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["h", "c", "d", "t", "start", "n", "copies", "words"])
                rows = []


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The hash of every window of segments, by place."""
    for batch in batches:
        for a, b, hashes, ends in word_hashes(batch.column("words").to_pylist()):
            first, n = np.concatenate([[0], ends[:-1]]), batch.column("n").to_numpy()[a:b]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = pa.array(np.repeat(np.arange(a, b), n))
            window = rolled(hashes, length)[np.repeat(first, n) + k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("h", "d", "t", "start", "copies")),
                                              pa.array(k.astype(np.int32)), pa.array(window.view(np.int64))],
                                             names=["h", "d", "t", "start", "copies", "k", "w"])


def _shard(rows: pa.Table, length: int) -> pa.Table:
    """A shard of whole anchors: its phrases, and their places in each of its segments."""
    number: dict[bytes, int] = {}
    stream, begin = [], []
    for text in rows.column("words").to_pylist():
        begin.append(len(stream))
        stream += [number.setdefault(w, len(number) + 1) for w in text.split(b" ")]
        stream.append(0)  # no word: nothing matches across segments
    n = rows.column("n").to_numpy().astype(np.int64)
    d, t, start, copies = (rows.column(k).to_numpy() for k in ("d", "t", "start", "copies"))
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = np.array(begin, np.int64)[owner] + k
    window = rolled(mix(np.array(stream, np.uint64)), length)[at]
    _, which = np.unique(window, return_inverse=True)
    recurs = np.bincount(which, copies[owner])[which] > 1
    at, owner, which, k = at[recurs], owner[recurs], which[recurs], k[recurs]
    if not len(at):
        return pa.table({name: pa.array([], kind) for name, kind in _HITS.items()})
    # the segments that hold a window, as a sum of random numbers, and the first of them
    holders = np.zeros(which.max() + 1, np.uint64)
    np.add.at(holders, which, mix(np.arange(1, len(n) + 1, dtype=np.uint64))[owner])
    order = np.lexsort((start[owner] + k, t[owner], d[owner], which))
    first = np.sort(order[np.concatenate([[True], which[order][1:] != which[order][:-1]])])
    # neighbouring windows that the same segments hold are one phrase: where one is, all are
    a, same = at[first], holders[which[first]]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (same[1:] != same[:-1]) | (np.diff(owner[first]) != 0)]))
    many = np.diff(np.append(begins, len(first)))
    find = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, (p, m) in enumerate(zip(a[begins].tolist(), many.tolist(), strict=True)):
        find.add_word(tuple(stream[p:p + length + m - 1]), i)
    find.make_automaton()
    found = np.array(list(find.iter(tuple(stream))), np.int64).reshape(-1, 2)
    m = many[found[:, 1]]
    place = found[:, 0] - (length + m - 1) + 1
    segment = np.searchsorted(np.array(begin), place, side="right") - 1
    phrase = first[begins][found[:, 1]]
    of = pa.array(owner[phrase])
    return pa.table({"h": rows.column("h").take(pa.array(segment)), "c": rows.column("c").take(pa.array(segment)),
                     "at": pa.array(place - np.array(begin)[segment], pa.int32()), "m": pa.array(m, pa.int32()),
                     "d": rows.column("d").take(of), "t": rows.column("t").take(of),
                     "start": pa.array(start[owner[phrase]] + k[phrase], pa.int32())})


def automaton(passages: list[tuple[bytes, list[int]]], length: int) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """An automaton of the windows of ``passages`` (words, places of windows) over word numbers from 1 on, and the
    numbers. A match's value counts the windows in the order given."""
    out, number, i = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, 0
    for text, places in passages:
        ids = [number.setdefault(w, len(number) + 1) for w in text.split(b" ")]
        for k in places:
            out.add_word(tuple(ids[k:k + length]), i)
            i += 1
    out.make_automaton()
    return out, number


def _matched(left: pa.Table, right: pa.Table, length: int) -> pa.Table:
    """A shard: the places of the phrases of ``left`` in the segments of ``right``."""
    hit, segment, first = (np.empty(0, np.int64),) * 3
    row = place = np.empty(0, np.int64)
    if left.num_rows and right.num_rows:
        places = left.column("places").to_pylist()
        find, number = automaton(list(zip(left.column("words").to_pylist(), places, strict=True)), length)
        row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        place = np.fromiter((k for p in places for k in p), np.int64, len(row))
        stream, begin, known = [], [], number.get
        for text in right.column("words").to_pylist():
            begin.append(len(stream))
            stream += [known(w, 0) for w in text.split(b" ")]
            stream.append(0)  # no word: nothing matches across segments
        found = np.array(list(find.iter(tuple(stream))), np.int64).reshape(-1, 2)
        hit, first = found[:, 1], found[:, 0] - length + 1
        segment = np.searchsorted(np.array(begin), first, side="right") - 1
        first = first - np.array(begin)[segment]
    if not len(hit):
        return pa.table({k: pa.array([], kind) for k, kind in _HITS.items()})
    of_phrase, of_segment = pa.array(row[hit]), pa.array(segment)
    start = left.column("start").to_numpy()[row[hit]] + place[hit]
    return pa.table({"h": right.column("h").take(of_segment), "c": right.column("c").take(of_segment), "at": pa.array(first, pa.int32()),
                     "m": pa.array(np.ones(len(hit), np.int32)), "d": left.column("d").take(of_phrase), "t": left.column("t").take(of_phrase), "start": pa.array(start, pa.int32())})


_HITS = {"h": pa.int64(), "c": pa.int64(), "at": pa.int32(), "m": pa.int32(), "d": pa.int64(), "t": pa.int64(), "start": pa.int32()}


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, pieces: int = PIECES,
                     phrases: int = PHRASES) -> DataFrame:
    """``d, t, starts``: windows (lists of places of their first words) of ``keyed`` rows, each document once, that start
    earlier too."""
    spark = rows.sparkSession
    all_segments = written(rows.select("d", "t", "text").mapInArrow(
        lambda it: _segments(it, length, gram), "h long, c long, d long, t long, start int, n int"), "segments")
    anchors = written(all_segments.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "anchors")
    # anchors of more than 1 / HOT of all segments, HOT at most, meet them by a salt
    total = all_segments.select(F.count(F.lit(1))).scalar()
    hot = F.broadcast(anchors.where(F.col("k") * HOT > total).select("h", F.lit(HOT).alias("salts")))
    left = all_segments.join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("d", "start"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = anchors.select("h").join(hot, "h", "left").select(
        "h", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    found = written(left.join(right, ["h", "salt"], "left_semi").drop("salt"), "repeated")
    release(spark)
    discard(all_segments, anchors)
    distinct = found.groupBy("h", "c").agg(F.min(F.struct("d", "t", "start")).alias("f"), F.min("n").alias("n"),
                                           F.count(F.lit(1)).alias("copies")).select("h", "c", "f.*", "n", "copies")
    asked = distinct.groupBy("d", "t").agg(F.collect_list(F.struct("h", "c", "start", "n", "copies")).alias("asked"))
    fetched = written(rows.select("d", "t", "text").join(asked, ["d", "t"]).mapInArrow(
        lambda it: _fetched(it, length), "h long, c long, d long, t long, start int, n int, copies long, words binary"), "fetched")
    release(spark)
    per_anchor = fetched.groupBy("h").agg(F.count(F.lit(1)).alias("na"))
    hot = written(per_anchor.where(F.col("na") > pieces), "hot")
    shards = F.greatest(F.lit(1), F.ceil(fetched.select(F.count(F.lit(1))).scalar() / pieces))
    cool = fetched.join(hot, "h", "left_anti")
    kind = "h long, c long, at int, m int, d long, t long, start int"
    hits = cool.withColumn("shard", F.pmod("h", shards)).groupBy("shard").applyInArrow(lambda x: _shard(x, length), kind)
    if not hot.isEmpty():
        hits = hits.unionByName(_of_hot_anchors(fetched.join(hot.select("h"), "h", "left_semi"), length, pieces, phrases))
    per = hits.groupBy("h", "c").agg(F.collect_list(F.struct("at", "m", "d", "t", "start")).alias("hits"))  # its windows at most
    other = F.filter("hits", lambda x: (x["d"] != F.col("d")) | (x["t"] != F.col("t")) | (x["start"] != F.col("start") + x["at"]))
    per = written(per, "hits")
    release(spark)
    discard(fetched)
    starts = (found.select("h", "c", "d", "t", "start").join(per, ["h", "c"])
            .select("d", "t", F.flatten(F.transform(other, lambda x: F.sequence(F.col("start") + x["at"], F.col("start") + x["at"] + x["m"] - 1)))
                    .alias("starts")).where("size(starts) > 0"))
    starts = written(starts.groupBy("d", "t").agg(F.collect_list("starts").alias("starts")), "starts")
    release(spark)
    discard(found, per)
    return starts


def _of_hot_anchors(fetched: DataFrame, length: int, pieces: int, phrases: int) -> DataFrame:
    """``h, c, at, m, d, t, start`` for anchors with more segments than a shard takes."""
    window = fetched.select("h", "d", "t", "start", "copies", "n", "words").mapInArrow(
        lambda it: _windows(it, length), "h long, d long, t long, start int, copies long, k int, w long")
    recurring = (window.groupBy("h", "w").agg(F.min(F.struct("d", "t", (F.col("start") + F.col("k")).alias("place"), "start")).alias("f"),
                                              F.sum("copies").alias("copies")).where("copies > 1"))
    first = recurring.select("h", "f.*").groupBy("h", "d", "t", "start").agg(
        F.sort_array(F.collect_list(F.col("place") - F.col("start"))).alias("places"))  # one per window of a segment at most
    phrase = written(fetched.select("h", "d", "t", "start", "words").join(first, ["h", "d", "t", "start"]), "phrases")
    release(fetched.sparkSession)
    return _streamed(fetched.select("h", "c", "words"), phrase, length, pieces, phrases)


def _streamed(fetched: DataFrame, phrase: DataFrame, length: int, pieces: int, phrases: int) -> DataFrame:
    """``h, c, at, m, d, t, start``: every place of a phrase in the distinct segments, each met in its anchor's shard."""
    of_segments = fetched.groupBy("h").agg(F.count(F.lit(1)).alias("a"))
    of_phrases = phrase.groupBy("h").agg(F.sum(F.size("places")).alias("b"))
    load = written(of_segments.join(of_phrases, "h"), "load")
    blocks = load.select("h", *[F.ceil(F.col(x) / size).cast("int").alias(f"n{x}") for x, size in (("a", pieces), ("b", phrases))])

    def dealt(df: DataFrame, own: list[str], mine: str, other: str) -> DataFrame:
        """Rows with their block; a row goes to one block of its own side and to every one of the other's."""
        place = F.pmod(F.xxhash64(*own), F.col(f"n{mine}")).cast("int").alias(f"k{mine}")
        return df.join(blocks, "h").select(*df.columns, place, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(f"k{other}"))

    key = ["h", "ka", "kb"]
    left = dealt(phrase, ["d", "t", "start"], "b", "a").select(*key, "d", "t", "start", "places", "words").groupBy(*key)
    # segments whose anchor has no phrase can't match
    right = dealt(fetched, ["c"], "a", "b").select(*key, "c", "words").groupBy(*key)
    return left.cogroup(right).applyInArrow(lambda a, b: _matched(a, b, length), "h long, c long, at int, m int, d long, t long, start int")


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts in zip(_bytes(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int32)
            at = np.unique(np.concatenate(starts).astype(np.int64)) if starts else np.empty(0, np.int64)
            gone[at] += 1
            gone[at + length] -= 1  # each start once: ends are distinct too
            left = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(words if len(left) == len(words) else [words[i] for i in left]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                          pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document: the words left, joined by one space, as UTF-8."""
    rows, repeated = keyed(docs)
    single = rows.dropDuplicates(["d", "t"]) if repeated else rows
    starts = repeated_windows(single, length, **how)
    return (rows.join(starts, ["d", "t"], "left").select("doc_id", "text", "starts")
            .mapInArrow(lambda it: _cut(it, length), "doc_id long, n_words long, n_removed long, kept binary"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(length: int = LENGTH) -> str:
    """The same in DuckDB SQL by a table of all windows."""
    return rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM l),
r AS (SELECT doc_id, pos, word, CASE WHEN lead(pos, {length - 1}) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL THEN
             string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) END AS run FROM w),
f AS (SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS again FROM r),
g AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)"""
