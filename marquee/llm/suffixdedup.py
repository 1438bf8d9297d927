"""Suffix-array dedup of byte strings across all documents: windows that also start earlier are removed.

Equal windows of ``LENGTH`` bytes have to meet in one shard. Each window is dealt by its anchor, the ``GRAM``-byte
string in it whose hash is smallest (the leftmost of several): equal windows have equal anchors at equal places.
Neighbouring windows mostly share an anchor, and such a run of windows, a segment, travels as one row: anchor hash,
document, start, number of windows, hash of its bytes. Then

1. equal segments (same anchor, same bytes) become one, the earliest; all others are covered by it entirely. This
   happens in the task that reads them, and again where the anchors meet; anchors with a single segment end there;
2. distinct segments of one anchor are fetched as bytes. Each splits in two at ``SIDE`` bytes before its anchor, since
   windows that start before reach that far back and the others as far ahead; so they are dealt to shards by the anchor
   and the bytes beside it, and those alone in this are dropped;
   A key of more than ``SHARD`` bytes is dealt further by the next bytes beside it, on the side to which a window reaches
   farther, and equal pieces become one, until no key is above;
3. a shard builds the suffix array of its pieces by induced sorting, and the common prefixes with each entry's
   predecessor. An interval of prefixes of ``LENGTH`` and more is a set of equal windows, of which all but the
   earliest are repeats;
4. the repeats of 1 and 3 are joined to spans per document and cut out.

The earliest of several equal windows always lies in the earliest of its equal segments (an earlier one would hold it
too), so it is among the pieces of 3 and is the one that stays.

Copies never come together in a task: a batch of documents sends one of its equal segments, and an anchor occurs once
per passage and document, so even a passage in a third of all documents is a small part of the anchors. Shards work
through their pieces in runs of whole keys of about ``SHARD`` bytes.

Defined cases: null and empty texts have no bytes; rows that repeat a doc_id with the same text are one document,
with other texts documents of their own, ordered by a hash of the text; rows without doc_id come after all others;
an empty table gives an empty result. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import release, written
from marquee.llm.shingles import mix, powers
from marquee.llm.suffixarray import common_prefixes, suffix_array

LENGTH, GRAM, SIDE = 100, 32, 34
SHARD = 1 << 21
#: Bytes of text whose anchors are found at a time; positions in a piece fit 24 bits.
PIECE = 1 << 20


def _anchors(x: np.ndarray, length: int, gram: int):
    """For the bytes of one document: start and number of windows of each segment, anchor place and hash, byte hash."""
    found = []
    step = PIECE
    for a in range(0, len(x) - length + 1, step):
        part = x[a:a + step + length - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[:len(part) - gram + 1])
        low = grams & ~np.uint64(0xFFFFFF) | np.arange(len(grams), dtype=np.uint64)
        # the minimum over each window's grams, by doubling
        span, width = 1, length - gram + 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(first, len(anchor)))
        end = first + n - 1 + length
        found.append((first + a, n, anchor[first] + a, grams[anchor[first]], mix((total[end] - total[first]) * down[first] + n.astype(np.uint64))))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _segments(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Segments of each batch of documents, once per anchor and bytes; the copies are marked (and dealt anywhere)."""
    for batch in batches:
        d, t, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
        for i, text in enumerate(batch.column(2).to_pylist()):
            x = np.frombuffer((text or "").encode(), np.uint8)
            if len(x) >= length:
                start, n, at, h, c = _anchors(x, length, gram)
                found.append((np.full(len(n), i), start, n, at - start, h, c))
        if not found:
            continue
        doc, start, n, off, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
        first = _earliest(h, c, d[doc], t[doc], start)
        copy = np.ones(len(h), bool)
        copy[first] = False
        h = np.where(copy, mix(np.arange(len(h), dtype=np.uint64) ^ c), h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d[doc]), pa.array(t[doc]),
             pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(copy)],
            names=["h", "c", "d", "t", "start", "n", "off", "copy"])


def _earliest(h, c, d, t, start) -> np.ndarray:
    """Indices of the earliest row of each (h, c)."""
    order = np.lexsort((start, t, d, c, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])
    return order[new]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of segments: ``repeat`` rows are covered entirely, the others are one of several of their anchor."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    copy = rows.column("copy").to_numpy()
    own = np.flatnonzero(~copy)
    h, c, d, t, start = (rows.column(k).to_numpy() for k in ("h", "c", "d", "t", "start"))
    first = own[_earliest(h[own], c[own], d[own], t[own], start[own])] if len(own) else own
    repeat = np.ones(len(h), bool)
    repeat[first] = False
    same = h[first][1:] == h[first][:-1]  # first is in the order of h
    several = first[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(first) else first
    keep = np.concatenate([np.flatnonzero(repeat), several])
    out = rows.select(["d", "t", "start", "n", "h", "off"]).take(pa.array(keep)).append_column(
        "repeat", pa.array(np.arange(len(keep)) < int(repeat.sum())))
    yield from out.to_batches(max_chunksize=50_000)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int, side: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments asked for, split beside the anchor."""
    def key(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    for batch in batches:
        out = []
        for d, t, text, asked in zip(*(batch.column(k).to_pylist() for k in ("d", "t", "text", "asked")), strict=True):
            x = text.encode()
            for s in asked:
                start, n, at = s["start"], s["n"], s["start"] + s["off"]
                core = x[at:at + gram]
                cut = min(max(at - side + 1 - start, 0), n)  # windows before the cut reach side bytes back
                if cut:
                    out.append((key(b"<", x[at - side:at], core), d, t, start, cut, x[start:start + cut - 1 + length],
                                at - side - start, at + gram - start))
                if cut < n:
                    a = start + cut
                    out.append((key(b">", core, x[at + gram:at + length - side + 1]), d, t, a, n - cut,
                                x[a:start + n - 1 + length], at - a, at + length - side + 1 - a))
                if len(out) > 20_000:
                    yield _piece_batch(out)
                    out = []
        if out:
            yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["key", "d", "t", "start", "n", "bytes", "c0", "c1"])


PIECES = "key long, d long, t long, start int, n int, bytes binary, c0 int, c1 int"


def _halved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces dealt further: all windows of a piece hold its bytes c0..c1; those that reach half of what is missing
    further back get a key with these bytes, the others, which then reach as far ahead, one with those."""
    for batch in batches:
        out = []
        columns = (batch.column(k).to_pylist() for k in ("key", "d", "t", "start", "n", "bytes", "c0", "c1"))
        for key, d, t, start, n, x, c0, c1 in zip(*columns, strict=True):
            missing = length - (c1 - c0)
            back = -(-missing // 2)
            ahead = missing - back + 1
            seed = key.to_bytes(8, "little", signed=True)
            m = min(max(c0 - back + 1, 0), n)
            for begin, many, a, b, side in ((0, m, c0 - back, c1, b"<"), (m, n - m, c0, min(c1 + ahead, c0 + length), b">")):
                if many:
                    h = int.from_bytes(hashlib.blake2b(seed + side + x[a:b], digest_size=8).digest(), "little", signed=True)
                    out.append((h, d, t, start + begin, many, x[begin:begin + many - 1 + length], a - begin, b - begin))
            if len(out) > 20_000:
                yield _piece_batch(out)
                out = []
        if out:
            yield _piece_batch(out)


def _below(pieces: DataFrame, length: int, shard: int) -> tuple[DataFrame, DataFrame | None]:
    """``pieces`` with the pieces of every key above ``shard`` bytes dealt to longer keys, again and again, until none is
    above; and the runs of windows that are repeats because a whole piece is (None: there were no such keys).

    A key that holds a whole window ends in one piece, since equal pieces become the earliest, so the loop ends after
    the logarithm of ``length``."""
    repeats, kept = None, None
    while True:
        size = pieces.groupBy("key").agg(F.sum(F.length("bytes")).alias("size"))
        hot = written(size.where(F.col("size") > shard).select("key"), "hot")
        if hot.isEmpty():
            return (pieces if kept is None else kept.unionByName(pieces)), repeats
        cool = pieces.join(hot, "key", "left_anti")
        kept = cool if kept is None else kept.unionByName(cool)
        cut = written(pieces.join(hot, "key", "left_semi").mapInArrow(lambda it: _halved(it, length), PIECES)
                      .withColumn("h", F.xxhash64("bytes")), "halved")
        place = F.struct("d", "t", "start")
        first = cut.groupBy("key", "h", "n", "c0", "c1").agg(F.min(place).alias("first"))
        both = written(cut.join(first, ["key", "h", "n", "c0", "c1"]), "met")
        again = both.where(place != F.col("first")).select("d", "t", "start", "n")
        repeats = again if repeats is None else repeats.unionByName(again)
        pieces = both.where(place == F.col("first")).select("key", "d", "t", "start", "n", "bytes", "c0", "c1")


def repeats(pieces: list[bytes], d: np.ndarray, t: np.ndarray, start: np.ndarray, n: np.ndarray, length: int):
    """A shard: for windows 0..n-1 of each piece, those that start earlier too; as (piece, first, number)."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    s = np.full(int(size.sum()), 256, np.int16)
    begin = np.cumsum(size) - size
    inside = np.ones(len(s), bool)
    inside[begin + size - 1] = False  # the separator, which no window holds
    s[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    sa = suffix_array(s)
    shared = common_prefixes(s, sa, length)
    owner = np.repeat(np.arange(len(pieces)), size)
    at = np.arange(len(s)) - np.repeat(begin, size)
    group = np.cumsum(shared < length)
    window = at[sa] < n[owner[sa]]
    who, group = sa[window], group[window]
    several = np.bincount(group, minlength=1)[group] > 1
    who, group = who[several], group[several]
    piece = owner[who]
    order = np.lexsort((start[piece] + at[who], t[piece], d[piece], group))
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else np.empty(0, bool)
    gone = np.zeros(len(s) + 1, bool)
    gone[who[order[~first]]] = True
    edge = np.diff(gone.view(np.int8), prepend=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return owner[a], at[a], b - a


def _shards(batches: Iterator[pa.RecordBatch], length: int, shard: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    rows = rows.sort_by("key")
    key, d, t, start, n = (rows.column(k).to_numpy() for k in ("key", "d", "t", "start", "n"))
    groups = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > -(2**63) else key[0] + 1)), len(key))
    upto = np.cumsum(n.astype(np.int64) + length)
    a = 0
    while a < len(key):
        past = groups[groups > a]
        near = past[upto[past - 1] - (upto[a - 1] if a else 0) <= shard]
        b = int(near[-1] if len(near) else past[0])
        i, first, m = repeats(rows.column("bytes").slice(a, b - a).to_pylist(), d[a:b], t[a:b], start[a:b], n[a:b], length)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[a:b][i]), pa.array(t[a:b][i]), pa.array((start[a:b][i] + first).astype(np.int32)),
                 pa.array(m.astype(np.int32))], names=["d", "t", "start", "n"])
        a = b


def merged(spans: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal byte runs that windows ``start..start + n - 1`` cover."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.array([s["start"] for s in spans], np.int64)
    b = a + np.array([s["n"] for s in spans], np.int64) - 1 + length
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[new], b[np.append(new[1:], len(a)) - 1]


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, text, d, t``: d is doc_id (null: the greatest), t tells texts of a repeated doc_id apart (else 0).

    The second value says whether any d is repeated, so that the rows hold documents more than once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    again = written(rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d"), "again")
    if again.isEmpty():
        return rows.withColumn("t", F.lit(0).cast("long")), False
    return (rows.join(again.withColumn("_again", F.lit(True)), "d", "left")
            .select("doc_id", "text", "d", F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("t"))), True


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, side: int = SIDE, shard: int = SHARD) -> DataFrame:
    """``d, t, start, n``: runs of windows of ``keyed`` rows (each document once) that start earlier too; runs may
    overlap."""
    if not 0 < side <= length - gram - side + 1:
        raise ValueError("every window must reach side bytes before its anchor or as far behind it")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(rows.select("d", "t", "text").mapInArrow(
        lambda it: _segments(it, length, gram), "h long, c long, d long, t long, start int, n int, off int, copy boolean")
        .repartition(parts, "h").mapInArrow(_meet, "d long, t long, start int, n int, h long, off int, repeat boolean"), "segments")
    release(spark)
    asked = (found.where("not repeat").groupBy("d", "t").agg(F.collect_list(F.struct("start", "n", "off")).alias("asked")))
    pieces = written(rows.select("d", "t", "text").join(asked, ["d", "t"])
                     .mapInArrow(lambda it: _pieces(it, length, gram, side), PIECES), "pieces")
    release(spark)
    pieces, whole = _below(pieces, length, shard)
    several = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    more = written(pieces.join(several, "key", "left_semi").repartition(parts, "key")
                   .mapInArrow(lambda it: _shards(it, length, shard), "d long, t long, start int, n int"), "repeats")
    release(spark)
    found = found.where("repeat").select("d", "t", "start", "n").unionByName(more)
    return found if whole is None else found.unionByName(whole)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            x = text.encode()
            a, b = merged(spans or [], length)
            kept = b"".join(x[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(x)], strict=True))
            out.append((len(x), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept))
        size, gone, n, sha, kept = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    rows, repeated = keyed(docs)
    single = rows.dropDuplicates(["d", "t"]) if repeated else rows
    spans = repeated_windows(single, length).groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return (rows.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
            .mapInArrow(lambda it: _cut(it, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
