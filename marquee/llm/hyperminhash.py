"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Its sketch has ``BUCKETS`` registers: shingles are dealt to
buckets by one half of a hash, and a bucket keeps of its smallest other hash the number of leading zeros (6 bits)
and ``MANTISSA`` further bits. A bucket without shingle takes the register of a bucket drawn for it in a fixed
order, so that small sets have full sketches. Four registers at a time make a band of 64 bits.

Equal sets are one class from the start; all later work is on classes. Classes that share a band's registers are
candidates. A bucket's members aren't paired with one another: first each is compared with the bucket's leader
(a different one in each band), and links join classes to components. Only members outside their bucket's largest
component are then compared with the bucket's members of other components, in small buckets as pairs, in buckets of
more than ``SMALL`` members inside blocks, of which only links leave, and at most one for two components of a block.
So every two candidates end in one component or were compared, and pairs are rows only in proportion to members. A
comparison estimates the similarity from the registers, corrected for chance agreement of registers; pairs that
may reach the threshold (within ``SIGMAS`` deviations) are confirmed on their full sets, built anew from the texts.

With 24 bands of 4 registers a pair of similarity 0.85 shares a band with probability 1 - 2e-8.

Defined cases: documents without words or text link with nothing; rows without doc_id link with nothing and have
no component; rows that repeat a doc_id are judged by their own texts; an empty table gives an empty result. Input
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import components, ordinal, written
from marquee.llm.shingles import mix, shingle_set, words

BANDS, ROWS, MANTISSA = 24, 4, 10
BUCKETS = BANDS * ROWS
SIGMAS, SMALL, ALL_BLOCK, FEW_BLOCK = 7.0, 32, 4096, 1024

_DRAW = np.argsort(np.random.default_rng(96).random((BUCKETS, BUCKETS)), axis=1)


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of shingle hashes: BUCKETS registers of 16 bits."""
    bucket = ((found >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = np.minimum.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), first)
    part, power = np.frexp(low.astype(np.float64) + 1)
    zeros = np.clip(64 - power, 0, 63).astype(np.uint16)
    kept = np.minimum((part - 0.5) * (2 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
    full, has = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    full[bucket[first]], has[bucket[first]] = zeros << np.uint16(MANTISSA) | kept, True
    if not has.all():
        empty = np.flatnonzero(~has)
        draw = _DRAW[empty]
        full[empty] = full[draw[np.arange(len(empty)), has[draw].argmax(1)]]
    return full


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that registers of unrelated sets of n and m shingles agree.

    A register says in which of the cells [2**-z * (1 + i / 2**MANTISSA) / 2, ...) the smallest of k uniform hashes
    lies; summed over zeros z, the 2**MANTISSA cells of one z are alike up to their width, so each z adds the product
    of both probabilities to lie in it, divided by the number of its cells.
    """
    z = np.arange(0, 64)
    top, bottom = 2.0 ** -z, 2.0 ** -(z + 1)
    inside = [np.exp(-np.outer(np.maximum(k / BUCKETS, 1), bottom)) - np.exp(-np.outer(np.maximum(k / BUCKETS, 1), top))
              for k in (n, m)]
    return (inside[0] * inside[1]).sum(1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from register rows: the share that agrees, corrected for chance."""
    agree, by_chance = (a == b).mean(1), chance(n, m)
    return np.clip((agree - by_chance) / (1 - by_chance), 0, 1)


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, a, b, bands = [], [], [], []
        for h in words([(t or "").encode() for t in batch.column(2).to_pylist()]):
            s = shingle_set(h, width)
            size.append(len(s))
            a.append(s.sum(dtype=np.uint64))
            b.append(np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0))
            bands.append(registers(s).view(np.int64).tolist() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)),
             pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n", "set_a", "set_b", "bands"])


def _likely(least: float):
    """Keeps pairs whose estimate may reach ``least``; the registers go."""
    floor = least - SIGMAS * np.sqrt(least * (1 - least) / BUCKETS)

    def run(batches):
        for t in batches:
            if t.num_rows:
                regs = [np.array(t.column(k).flatten().to_numpy()).view(np.uint16).reshape(-1, BUCKETS) for k in ("ra", "rb")]
                near = estimate(*regs, t.column("na").to_numpy(), t.column("nb").to_numpy()) >= floor
                yield t.select(["a", "b"]).filter(pa.array(near))
    return run


def _sets(width: int):
    def run(batches):
        for t in batches:
            got = [shingle_set(h, width).tobytes() for h in words([x.encode() for x in t.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([t.column("rep"), pa.array(got, pa.binary())], names=["rep", "found"])
    return run


def _inside(percent: int):
    """Blocks of large buckets: links between the block's few and its members of other components."""
    floor = percent / 100 - SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100) / BUCKETS)

    def block(band: int, rep, part, size, regs, sets, few, every) -> Iterator[tuple[int, int]]:
        keys = regs.view(np.int64)
        top = {c: c for c in set(part[few].tolist()) | set(part[every].tolist())}

        def find(c):
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        for i in few.tolist():
            other = every[part[every] != part[i]]
            # a pair that shares an earlier band meets there
            other = other[~(keys[other, :band] == keys[i, :band]).any(1)]
            if not len(other):
                continue
            near = estimate(np.broadcast_to(regs[i], (len(other), BUCKETS)), regs[other], np.full(len(other), size[i]), size[other])
            order = np.argsort(-near, kind="stable")
            for j in other[order[near[order] >= floor]].tolist():
                if find(part[i]) == find(part[j]):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    x, y = find(part[i]), find(part[j])
                    top[max(x, y)] = min(x, y)
                    yield min(rep[i], rep[j]), max(rep[i], rep[j])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("band", "key", "every_block", "few_block", "few", "rep")])
        where = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "every_block", "few_block")])
        cut = np.flatnonzero(np.concatenate([[True], (where[:, 1:] != where[:, :-1]).any(0)]))
        rep, part, size, few = (t.column(c).to_numpy() for c in ("rep", "component", "n", "few"))
        regs = t.column("bands").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(-1, BUCKETS)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("found").to_pylist()]
        out = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), t.num_rows], strict=True):
            own = np.arange(a, b)
            out += block(int(where[0, a]), rep, part, size, regs, sets, own[few[a:b]], own[~few[a:b]])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
    return run


def _confirm(percent: int, width: int):
    """Keeps pairs whose full sets reach the threshold; the texts go."""
    def run(batches):
        for t in batches:
            left = words([x.encode() for x in t.column("ta").to_pylist()])
            right = words([x.encode() for x in t.column("tb").to_pylist()])
            ok = []
            for g, h in zip(left, right, strict=True):
                s, u = shingle_set(g, width), shingle_set(h, width)
                both = len(np.intersect1d(s, u, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(u) - both))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; links at ``percent`` of the union and more."""
    if not 50 <= percent <= 100:
        raise ValueError("the bands are made for thresholds of 50 to 100 percent")
    least = percent / 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                        F.col("text").cast("string").alias("text"))
    sketch = written(texts.mapInArrow(lambda it: _sketch(it, width), "doc_id long, text_hash long, n long, set_a long, "
                                      "set_b long, bands array<long>"), "sketch")
    known = sketch.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("set_a", "set_b", "n")
                      .agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("r"), F.count(F.lit(1)).alias("copies"))
                      .select(F.col("r.doc_id").alias("rep"), "r.text_hash", "r.bands", "set_a", "set_b", "n", "copies"), "classes")
    bands = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    per = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "key")
    members = written(bands.join(per, ["band", "key"]), "members")
    near = members.select("rep").distinct()
    sets = classes.select("rep", "n", "bands", "text_hash")
    candidates = written(sets.join(near, "rep"), "candidates")
    named = candidates.select(F.col("rep").alias("doc_id"), "text_hash")
    held = written(texts.join(named, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]), "texts")
    held = candidates.select("rep", "text_hash").join(
        held.select(F.col("doc_id").alias("rep"), "text_hash", "text"), ["rep", "text_hash"]).select("rep", "text")

    def compared(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All pairs (each once), and those that are links."""
        asked = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        side = candidates.select("rep", "n", "bands")
        likely = written(asked.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
                         .mapInArrow(_likely(least), "a long, b long"), "likely")
        links = (likely.join(held.toDF("a", "ta"), "a").join(held.toDF("b", "tb"), "b")
                 .mapInArrow(_confirm(percent, width), "a long, b long"))
        return asked, written(links, "links")

    # first every member with its bucket's leader: the least id after flipping its bits by a pattern of the band
    flip = F.xxhash64("band")
    lead = (members.groupBy("band", "key").agg(F.min(F.col("rep").bitwiseXOR(flip)).alias("lead"))
            .select("band", "key", F.col("lead").bitwiseXOR(flip).alias("a")))
    asked, links = compared(members.join(lead, ["band", "key"]).where("a <> rep").select("a", F.col("rep").alias("b")))
    label = components(links)
    # then whoever is outside the largest component of its bucket with all others of the bucket
    now = written(members.join(label, members.rep == label.id, "left")
                  .select("rep", "band", "key", F.coalesce("component", "rep").alias("component")), "now")
    open_ = written(now.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("size"))
                    .groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"),
                                                F.max(F.struct("size", "component")).alias("most")).where("parts > 1")
                    .select("band", "key", "size", (F.col("size") - F.col("most.size")).alias("n_few"),
                            F.col("most.component").alias("most")), "open")
    rest = now.join(open_, ["band", "key"]).withColumn("few", F.col("component") != F.col("most"))
    small = rest.where(F.col("size") <= SMALL).select("band", "key", "rep", "component", "few")
    pairs = (small.where("few").select("band", "key", F.col("rep").alias("a"), F.col("component").alias("ca"))
             .join(small.select("band", "key", F.col("rep").alias("b"), F.col("component").alias("cb")), ["band", "key"])
             .where("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
             .join(asked, ["a", "b"], "left_anti"))
    links = links.unionByName(compared(pairs)[1])
    large = written(rest.where(F.col("size") > SMALL)
                    .select("band", "key", "rep", "component", "few", F.ceil(F.col("size") / ALL_BLOCK).cast("int").alias("eb"),
                            F.ceil(F.col("n_few") / FEW_BLOCK).cast("int").alias("fb")), "large")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    meet = (large.withColumn("every_block", own("eb")).withColumn("few_block", blocks("fb")).withColumn("few", F.lit(False))
            .unionByName(large.where("few").withColumn("few_block", own("fb")).withColumn("every_block", blocks("eb")))
            .drop("eb", "fb"))
    full = (held.join(large.select("rep").distinct(), "rep", "left_semi").mapInArrow(_sets(width), "rep long, found binary")
            .join(candidates.select("rep", "n", "bands"), "rep"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = (meet.join(full, "rep").repartition(parts, "band", "key", "every_block", "few_block")
              .mapInArrow(_inside(percent), "a long, b long"))
    label = components(links.unionByName(written(inside, "inside")))
    named = (classes.join(label, classes.rep == label.id, "left").where("copies > 1 or component is not null")
             .select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component_id")))
    return (sketch.select("doc_id", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows that stay: of each group of near duplicates the one with the smallest doc_id. Columns as given.

    Rows are judged one by one: where ids are missing or repeated, each row is numbered by doc_id (null last) and text,
    and the numbers take the place of ids.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1 or id is null").isEmpty():
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_d"),
                            F.xxhash64(F.col("text").cast("string")).alias("_t"))
        rows = written(ordinal(whole, F.col("_d").asc_nulls_last(), "_t", name="_row"), "rows")
        gone = (near_duplicates(rows.select(F.col("_row").alias("doc_id"), F.col("_doc")["text"].alias("text")), percent, width)
                .where("not kept").select(F.col("doc_id").alias("_row")))
        return rows.join(gone, "_row", "left_anti").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
    gone = (near_duplicates(docs, percent, width).where("not kept").select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
