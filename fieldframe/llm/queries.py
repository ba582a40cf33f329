"""The operators applied to their whole tables, with production parameters; one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm import backoff, curves, density, lattice, merge_automaton, merkle, mixing, ngram_join, packing, pii, token_files, toxicity, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL where SQL can express it."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_text_density")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.extract_pages(table(spark, sf_dir, "pages"))


@query("op2_toxicity_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_vector_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, packing.Limits(tokens=2048, segments=64, loss=2048), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op5_mix_sources", mixing.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_round_trip(table(spark, sf_dir, "documents"), VOCABULARY, end_id=0)


@query("op8_pii_field")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query("op3_shifted_curves")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query("op9_backoff_automaton")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_texts(table(spark, sf_dir, "documents"))


@query("op10_lattice_near_copies")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_copies(table(spark, sf_dir, "embeddings"), least=0.98)


@query("op11_merge_automaton")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_automaton.round_trip_digests(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op13_merkle_manifest", merkle.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_fold(table(spark, sf_dir, "documents"))


@query("op12_exact_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
