"""Line dedup: repeated runs of lines, found by a suffix array over line ids built by distributed prefix doubling.

DataFrame functions only. Every line gets an id from its text (MD5; blank lines too). A suffix is a document's lines
from some line on. In round k each suffix is named by its first 2**k lines: the name of the pair (name at its line,
name 2**k-1 lines further) of the round before, which is again a hash of both. Suffixes sorted by their names of all
rounds are the suffix array; those that share the name of a round form an interval whose longest common prefix is at
least that round's length. In each interval the first suffix, by doc_id and line, stays; the lines that every later one
shares with it are deleted. A suffix that is alone in its interval is alone in all later ones and leaves, so the rounds
work on repeated lines only and go on until no name is shared; a suffix ends up with the longest length at which it is
a later copy, and these stretches join to the maximal repeated runs.

A run counts from a size: ``min_lines`` lines (the round of that length is named by two overlapping names of the largest
power of two within it, and the lengths double from there), or one line of ``min_words`` words.

No name is ever gathered: its number of suffixes and its first one are partial aggregates. Names of more than
1 / ``HOT`` of all rows, ``HOT`` at most, meet their rows by a broadcast of that bounded table, all others by a shuffle.

Defined cases: null texts have no lines; empty texts one, blank; ``min_lines`` lines with no letter or digit at all aren't
deleted, nor is what a longer run has of such lines beside others; rows that repeat a doc_id with the same text are one document (all copies change alike), with other texts
documents of their own; rows without doc_id come after all others. Columns of the input besides doc_id and text are
kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import written

MIN_LINES, MIN_WORDS, HOT = 2, 10, 500


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(docs: DataFrame) -> list[Column]:
    """A document is told by doc_id (null: the greatest) and its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_d"),
            F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("_t")]


def _shared(now: DataFrame) -> DataFrame:
    """The suffixes whose name is shared, each with the first suffix of that name, written."""
    place = F.struct("_d", "_t", "at")
    names = now.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    several = written(names.where("n > 1"), "names")
    total = now.select(F.count(F.lit(1))).scalar()
    hot = several.where(F.col("n") * HOT > total).select("name", F.col("first").alias("hot"))  # HOT rows at most
    rest = several.where(F.col("n") * HOT <= total).select("name", "first")
    marked = now.join(F.broadcast(hot), "name", "left")
    by_shuffle = marked.where("hot is null").drop("hot").join(rest, "name")
    by_broadcast = marked.where("hot is not null").withColumnRenamed("hot", "first")
    return written(by_shuffle.unionByName(by_broadcast), "suffixes")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``_d, _t, first_line, last_line``: maximal runs of lines covered by a run that also begins earlier."""
    if min_lines < 1:
        raise ValueError("a run has one line at least")
    distinct = docs.where("text is not null").select(*_key(docs), F.col("text").cast("string").alias("text"))
    line = (distinct.select("_d", "_t", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
            .select("_d", "_t", "at", F.md5(F.col("line").cast("binary")).alias("name"),
                    F.col("line").rlike(r"[\p{L}\p{N}]").cast("int").alias("solid"),
                    (F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= min_words).alias("long")).distinct())
    doc, length, spans = ["_d", "_t"], 1, None
    now = _shared(written(line, "lines"))
    while True:
        later = now.where((F.struct(*doc, "at") > F.col("first")) & (F.col("solid") == 1))
        if length < min_lines:
            later = later.where(F.col("long") & F.lit(length == 1))
        found = later.select(*doc, "at", F.lit(length).alias("n"))
        spans = found if spans is None else spans.unionByName(found)
        ahead = length if length >= min_lines else min(length, min_lines - length)
        # a run of min_lines needs one solid line; a longer one counts only if each of min_lines within it does
        mixed = F.least if length >= min_lines else F.greatest
        ahead_of = now.select(*doc, (F.col("at") - ahead).alias("at"), F.col("name").alias("next"), F.col("solid").alias("solid_next"))
        longer = now.join(ahead_of, [*doc, "at"]).select(*doc, "at", F.md5(F.concat("name", "next").cast("binary")).alias("name"),
                                                         mixed("solid", "solid_next").alias("solid"), F.lit(True).alias("long"))
        now = _shared(written(longer, "longer"))
        length += ahead
        if now.isEmpty():
            break
    longest = spans.groupBy(*doc, "at").agg(F.max("n").alias("n"))
    # stretches of a document that touch or overlap join: an island begins beyond all ends so far
    w = Window.partitionBy(*doc).orderBy("at")
    reached = F.max(F.col("at") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("at") <= F.col("reached"), 0).otherwise(1)).over(w)
    return (longest.withColumn("reached", reached).withColumn("_i", island).groupBy(*doc, "_i")
            .agg(F.min("at").alias("first_line"), F.max(F.col("at") + F.col("n") - 1).alias("last_line")).drop("_i"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, counter: str = "_removed") -> DataFrame:
    """The documents without the later copies of repeated line runs: the columns of ``docs`` and ``counter``, the
    number of lines deleted. A text that loses all its lines is empty."""
    if counter in docs.columns:
        raise ValueError(f"the documents have a column {counter} already")
    runs = (repeated_runs(docs, min_lines, min_words).groupBy("_d", "_t")
            .agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("_runs"),
                 F.sum(F.col("last_line") - F.col("first_line") + 1).alias("_gone")))
    d, t = _key(docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")  # no name of the input can clash
    joined = docs.select(whole, F.col("text").cast("string").alias("_text"), d, t).join(runs, ["_d", "_t"], "left")
    kept = F.filter(_lines(F.col("_text")), lambda x, i: ~F.exists("_runs", lambda r: i.between(r["first_line"], r["last_line"])))
    text = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns],
                         F.coalesce("_gone", F.lit(0)).cast("long").alias(counter))


def report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_md5`` of every document."""
    before = docs.select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text")))).cast("long")
    done = deduplicated(before.withColumn("n_lines", lines), min_lines, min_words)
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.col("_removed").alias("n_removed"),
                       F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def oracle(min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> str:
    """The same in DuckDB SQL by windows over each document's lines."""
    run = " || chr(10) || ".join(f"lead(line, {k}) OVER w" if k else "line" for k in range(min_lines))
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
           FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, pos, line, {run} AS run, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {min_words} AS long
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k,
             row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k1 FROM r),
g AS (SELECT doc_id, pos, line, (long AND k1 > 1 AND regexp_matches(line, '[\p{{L}}\p{{N}}]'))
             OR max(CASE WHEN k > 1 AND run IS NOT NULL AND regexp_matches(run, '[\p{{L}}\p{{N}}]') THEN pos END)
             OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {min_lines - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       md5(coalesce(kept, '')) AS kept_md5 FROM documents d LEFT JOIN k USING (doc_id)"""
