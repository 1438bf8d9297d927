"""Substring-containment join without a nested loop.

If ``needle`` occurs in ``hay`` then every character n-gram of ``needle``
occurs in ``hay``. Each needle is therefore routed (equi-join) to the postings
of its rarest gram, and only those candidates are verified with an exact
``contains``. A needle's grams are as long as ``GRAMS`` allows: short grams of
long needles are shared by ever more texts as a table grows, and candidates
would grow with its square. Hays have postings for the needles' gram lengths
only. Hot grams are avoided by the rarest-gram choice; what remains skewed is
split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAMS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def gram_length(text) -> "F.Column":
    """The length of a needle's grams: the greatest of ``GRAMS`` that it has (null for an empty text)."""
    return F.coalesce(*[F.when(F.length(text) >= n, F.lit(n)) for n in reversed(GRAMS)])


def grams(text, lengths) -> "F.Column":
    """Hashes of the distinct grams of a text column, for each of the array ``lengths``. Texts whose grams
    only share a hash become candidates at worst; these are verified."""
    t = F.coalesce(text, F.lit(""))

    def of_len(n):
        return F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.xxhash64(F.substring(t, i, n)))

    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(t)), of_len)))


def contains_pairs(needles: DataFrame, hays: DataFrame, lower: bool = False, tell: dict | None = None) -> DataFrame:
    """All (needle_id, hay_id) with needle_text contained in hay_text.

    ``needles``: (needle_id, needle_text); ``hays``: (hay_id, hay_text).
    Empty needles are skipped (they would match everything). ``tell`` receives
    the table of candidates."""
    norm = (lambda c: F.lower(c)) if lower else (lambda c: c)
    h = hays.select("hay_id", norm(F.col("hay_text")).alias("hay_text"))
    n = needles.select("needle_id", norm(F.col("needle_text")).alias("needle_text")).filter(
        F.length("needle_text") > 0)
    ng = n.select("needle_id", "needle_text", F.explode(grams(F.col("needle_text"), F.array(gram_length(F.col("needle_text"))))).alias("gram"))
    # postings only for grams a needle can route to
    lengths = n.agg(F.sort_array(F.collect_set(gram_length(F.col("needle_text")))).alias("lengths"))  # a single row
    post = (h.crossJoin(F.broadcast(lengths)).select("hay_id", F.explode(grams(F.col("hay_text"), F.col("lengths"))).alias("gram"))
            .join(ng.select("gram").distinct(), "gram", "left_semi"))
    dfreq = post.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a gram that no hay has rules its needle out
    pick = (ng.join(dfreq, "gram", "left")
            .groupBy("needle_id", "needle_text")
            .agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"),
                 F.min(F.coalesce("df", F.lit(0))).alias("_df"))
            .filter(F.col("_df") > 0))
    cand = pick.join(post, "gram").select("needle_id", "needle_text", "hay_id").distinct()
    if tell is not None:
        tell["candidates"] = cand
    return (cand.join(h, "hay_id").filter(F.contains(F.col("hay_text"), F.col("needle_text")))
            .select("needle_id", "hay_id"))
