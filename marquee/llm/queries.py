"""Registered queries of the subpackage: ``name -> (spark, sf_dir) -> DataFrame`` over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import (cnn, crosspolytope, fim, hyperminhash, itq, linerun, mixing, packing, phrases, ppm, repair, suffixdedup,
                         whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@query("op1_hyperminhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_ppm_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(table(spark, sf_dir, "documents"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicate(table(spark, sf_dir, "documents"))


@query("op4_byte_cnn_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_line_run_dedup", linerun.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerun.report(table(spark, sf_dir, "documents"))


@query("op6_water_filling_mix", mixing.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def vectors(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding AS vector", *more)


@query("op7_cross_polytope_search")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.search(vectors(spark, sf_dir))


@query("op8_repair_token_output")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.decode_documents(repair.encode_documents(table(spark, sf_dir, "documents")))


@query("op9_itq_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(vectors(spark, sf_dir, "label"))


@query("op10_configuration_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op11_phrase_automata_dedup", phrases.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(table(spark, sf_dir, "documents"))


@query("op12_learned_index_fim", fim.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


@query("op13_cholesky_qr_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(vectors(spark, sf_dir))
