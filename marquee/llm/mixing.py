"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

DataFrame functions only. Sources are aggregated first; afterwards every decision about a document is an
expression over its own row and its source's row, so a source with a third of all rows is never gathered.

Defined cases: null text counts 0 words; a null source is a source of its own, last in order; an empty table
gives an empty result; rows that repeat a doc_id share its place in the seeded order and so are taken together;
a source without words has target 0. Columns of the input other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import ordinal, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """The seeded order of documents: MD5 of seed and doc_id, in hexadecimal."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def water_fill(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` to ``(source, source_size, weight, target)``.

    Weights repeat over the sources in code point order, null last. All targets add up to all sizes; a target
    stops at ``cap`` times its source's size and the excess is shared by weight among the rest until none is
    above. The loop reads two sums per round; a round ends it unless it clamps a further source.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1, or the targets cannot add up")
    ranked = ordinal(sizes, F.col("source").asc_nulls_last(), name="_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    free = table.agg(F.sum("source_size")).first()[0] or 0
    total, wsum, clamped = free, table.agg(F.sum("weight")).first()[0] or 1, 0
    while True:
        over = F.col("source_size") * F.lit(cap * wsum) < F.col("weight") * F.lit(free)
        n, held, rest = table.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size") * cap)),
                                  F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped:
            break
        clamped, free, wsum = n, total - (held or 0), rest or 1
    share = (F.col("weight") * F.lit(free)).cast("double") / F.lit(float(wsum))
    return table.withColumn("target", F.when(over, (F.col("source_size") * cap).cast("double")).otherwise(share))


def plan_mix(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Per source: target, whole repetitions, and the last key of the seeded order that gets one more.

    ``sized(source, size, key)``. Documents follow one another in key order; the extra repetition goes to the
    longest prefix whose last document's middle lies within the missing words, so the sum is nearest the target.
    The prefix is found in a histogram over the key's first three digits (at most 4096 rows a source), then
    among the documents of the one bucket where it ends.
    """
    sources = written(water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
                      .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                  .otherwise(F.lit(0)).cast("long"))
                      .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    bucket = F.substring("key", 1, 3)
    hist = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    edge = (hist.withColumn("before", before).alias("h")
            .join(sources.select("source", "missing").alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .where(F.col("before") <= F.col("missing"))
            .groupBy("h.source").agg(F.max(F.struct("bucket", "before", "missing")).alias("e"))
            .select("source", "e.*"))
    inside = (sized.withColumn("bucket", bucket).alias("d")
              .join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))
                    & (F.col("d.bucket") == F.col("e.bucket")))
              .groupBy("d.source", "key", "before", "missing").agg(F.sum("size").alias("n")))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("key"))
    last = (inside.withColumn("middle", F.col("before") + upto - F.col("n") / 2)
            .where(F.col("middle") <= F.col("missing")).groupBy("source").agg(F.max("key").alias("last")))
    ends = (edge.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left")
            .select("e.source", F.coalesce("l.last", "e.bucket").alias("last_key")))
    return written(sources.alias("s").join(ends.alias("x"), F.col("s.source").eqNullSafe(F.col("x.source")), "left")
                   .select("s.source", "source_size", "target", "whole",
                           F.coalesce("last_key", F.lit("")).alias("last_key")), "mix")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 6) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies``."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                order_key(seed).alias("key")), "sized")
    plan = plan_mix(sized, weights, cap)
    copies = (F.col("whole") + (F.col("key") <= F.col("last_key")).cast("long")).cast("long")
    return (sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                    copies.alias("copies")))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 6) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it, with the columns of ``docs``."""
    sized = written(docs.select("source", word_count(F.col("text")).alias("size"), order_key(seed).alias("key")), "sized")
    plan = plan_mix(sized, weights, cap).select(F.col("source").alias("_source"), "whole", "last_key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "source", order_key(seed).alias("key"))
    copies = (F.col("whole") + (F.col("key") <= F.col("last_key")).cast("long")).cast("int")
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).where(copies > 0)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select("_doc.*"))


def oracle(weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 6) -> str:
    """The same in DuckDB SQL: sources sorted by size to weight, the water level from prefix sums."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(concat('{seed}:', coalesce(doc_id::VARCHAR, ''))) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
       FROM d GROUP BY source),
s1 AS (SELECT source, source_size, CASE r % {len(weights)} {cases} END::BIGINT AS w FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
              row_number() OVER (ORDER BY source_size / w::DOUBLE, source NULLS LAST) AS i FROM s1),
s3 AS (SELECT *, (total - {cap} * (sum(source_size) OVER (ORDER BY i) - source_size))::BIGINT AS free,
              (sum(w) OVER (ORDER BY i DESC))::BIGINT AS wsum FROM s2),
lev AS (SELECT coalesce(min(i) FILTER (WHERE {cap} * source_size * wsum >= w * free), max(i) + 1) AS i FROM s3),
lv AS (SELECT s3.i, s3.free, s3.wsum FROM s3, lev WHERE s3.i = lev.i),
t AS (SELECT source, source_size, CASE WHEN s3.i < (SELECT i FROM lev) THEN ({cap} * source_size)::DOUBLE
             ELSE (w * (SELECT free FROM lv))::DOUBLE / (SELECT wsum FROM lv)::DOUBLE END AS target FROM s3),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT source, k, sum(size) AS n FROM d GROUP BY source, k),
c AS (SELECT source, k, sum(n) OVER (PARTITION BY source ORDER BY k) - n / 2.0 AS middle FROM g)
SELECT d.doc_id, d.size, u.source_size, u.target,
       (d.size * (u.whole + CASE WHEN c.middle <= u.target - u.whole * u.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
       JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k"""
