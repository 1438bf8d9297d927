"""Validation by a table of rules (U10): domains, lengths, uniqueness, foreign keys.

The rules of a table are compiled together: all domain and length rules become
one array expression in a single scan, every uniqueness rule one aggregate joined
back, every foreign key one anti-join. Each rejected record gives a row per
rule it breaks; ``accepted`` splits the rejected records off into a sink.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import ustrip


@dataclass(frozen=True)
class Rule:
    """``kind``: domain (values), range (low, high), length (low, high; ``strip``ped
    or not), unique (column list) or foreign (table, key)."""

    entity: str
    reason: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    strip: bool = False


ROLES, PERSON_TYPES = ("user", "admin"), ("director", "actor")
RULES = (
    Rule("user", "username_too_short", "min_length", ("username",), (2,)),
    Rule("user", "username_too_long", "max_length", ("username",), (20,)),
    Rule("user", "username_taken", "unique", ("username",)),
    Rule("user", "role_domain", "domain", ("role",), ROLES),
    Rule("rating", "score_out_of_range", "range", ("score",), (1, 10)),
    Rule("rating", "rated_twice", "unique", ("user_id", "item_id")),
    Rule("rating", "unknown_user", "foreign", ("user_id",), ("user", "id")),
    Rule("review", "review_too_short", "min_length", ("content",), (2,), True),
    Rule("review", "review_too_long", "max_length", ("content",), (500,), True),
    Rule("review", "unknown_user", "foreign", ("user_id",), ("user", "id")),
    Rule("like", "liked_twice", "unique", ("user_id", "item_id")),
    Rule("like", "unknown_user", "foreign", ("user_id",), ("user", "id")),
    Rule("favorite", "favorited_twice", "unique", ("user_id", "item_id")),
    Rule("favorite", "unknown_user", "foreign", ("user_id",), ("user", "id")),
    Rule("history", "unknown_user", "foreign", ("user_id",), ("user", "id")),
    Rule("review_like", "liked_twice", "unique", ("user_id", "review_id")),
    Rule("review_like", "unknown_user", "foreign", ("user_id",), ("user", "id")),
    Rule("review_like", "unknown_review", "foreign", ("review_id",), ("review", "id")),
    Rule("reply", "reply_empty", "min_length", ("content",), (1,), True),
    Rule("reply", "unknown_review", "foreign", ("review_id",), ("review", "id")),
    Rule("reply", "unknown_user", "foreign", ("user_id",), ("user", "id")),
    Rule("liked_person", "liked_twice", "unique", ("user_id", "person_name")),
    Rule("liked_person", "person_type_domain", "domain", ("person_type",), PERSON_TYPES),
    Rule("liked_person", "unknown_user", "foreign", ("user_id",), ("user", "id")),
)
#: What names a record in the reports, per table.
RECORD = {"user": ("id",), "rating": ("user_id", "item_id"), "review": ("id",), "like": ("user_id", "item_id"),
          "favorite": ("user_id", "item_id"), "history": ("user_id", "item_id"), "review_like": ("user_id", "review_id"),
          "reply": ("id",), "liked_person": ("user_id", "person_name")}


def _broken(rule: Rule) -> Column:
    """Whether a row breaks a rule about its own values."""
    c = F.col(rule.columns[0])
    if rule.kind == "domain":
        return ~F.coalesce(c, F.lit("")).isin(*rule.values)
    if rule.kind == "range":
        return c.isNull() | (c < rule.values[0]) | (c > rule.values[1])
    text = F.coalesce(c, F.lit(""))
    size = F.length(ustrip(text) if rule.strip else text)
    return size < rule.values[0] if rule.kind == "min_length" else size > rule.values[0]


def violations(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``entity, record_id, reason`` of every rule that a record of ``tables`` breaks.
    Of several records with one unique key the first by all its values stays."""
    out: list[DataFrame] = []
    for entity, df in tables.items():
        mine = [r for r in rules if r.entity == entity]
        record = F.concat_ws(":", *[F.col(c).cast("string") for c in RECORD[entity]]).alias("record_id")
        own = [r for r in mine if r.kind not in ("unique", "foreign")]
        if own:
            reasons = F.array_compact(F.array(*[F.when(_broken(r), F.lit(r.reason)) for r in own]))
            out.append(df.select(F.lit(entity).alias("entity"), record, F.explode(reasons).alias("reason")))
        for r in mine:
            if r.kind == "unique":
                again = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in r.columns])).groupBy(*r.columns).agg(
                    F.min(F.struct(*df.columns)).alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
                hit = df.join(again, list(r.columns)).filter((F.struct(*[F.col(c) for c in df.columns]) != F.col("_keep")))
                # equal rows can't be told apart: all but one of them are reported
                same = (df.join(again.select(*r.columns, "_keep"), list(r.columns))
                        .filter(F.struct(*[F.col(c) for c in df.columns]).eqNullSafe(F.col("_keep")))
                        .groupBy(record).agg(F.count(F.lit(1)).alias("_c"))
                        .select("record_id", F.explode(F.array_repeat(F.lit(1), (F.col("_c") - 1).cast("int")))).select("record_id"))
                out.append(hit.select(F.lit(entity).alias("entity"), record, F.lit(r.reason).alias("reason")))
                out.append(same.select(F.lit(entity).alias("entity"), "record_id", F.lit(r.reason).alias("reason")))
            elif r.kind == "foreign" and r.values[0] in tables:
                known = tables[r.values[0]].select(F.col(r.values[1]).alias(r.columns[0])).distinct()
                out.append(df.join(known, r.columns[0], "left_anti").select(F.lit(entity).alias("entity"), record, F.lit(r.reason).alias("reason")))
    return reduce(DataFrame.unionByName, out)


def accepted(tables: dict[str, DataFrame], rejected: DataFrame) -> dict[str, DataFrame]:
    """The tables without the records named in ``rejected`` (a written result of ``violations``)."""
    out = {}
    for entity, df in tables.items():
        gone = rejected.filter(F.col("entity") == entity).select(F.col("record_id").alias("_id")).distinct()
        record = F.concat_ws(":", *[F.col(c).cast("string") for c in RECORD[entity]])
        out[entity] = df.join(gone, record == F.col("_id"), "left_anti")
    return out


def write_rejected(rejected: DataFrame, path: str) -> None:
    """The sink of rejected records, a folder per table."""
    rejected.write.mode("overwrite").partitionBy("entity").parquet(path)
