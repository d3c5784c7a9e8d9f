"""The queries of this package, as (spark, sf_dir) -> DataFrame, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import cleaning, fingerprints, heap_kmeans, jaccard_join, line_crf, mixing, packing, quotations, repair, sharding, spherical, tag_paths, training_order
from fleetlens.llm.check_sql import SQL  # noqa: F401  registered with the queries
from fleetlens.llm.scratch import Scratch

Run = Callable[[SparkSession, str], DataFrame]

SHARDS = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(read(spark, sf_dir, "documents"), size=4, percent=85)


def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.with_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.train(docs, read(spark, sf_dir, "labels"))
    return line_crf.scored(docs, model).select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns quote nothing, so they are first put as mails that quote the two turns before them."""
    mails = quotations.as_mail(read(spark, sf_dir, "conversations"))
    threads = quotations.conversations(mails, scope="conv_id", position="turn")
    return threads.select(
        F.col("scope").alias("conv_id"), F.col("position").alias("turn"), "copy", "n_rows", F.col("parent").alias("parent_turn"), "parent_copy",
        F.col("root").alias("root_turn"), "root_copy", "depth", "place", "text",
    )


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(read(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = f"{Scratch(spark, 'training-order').base}/shards"
    return training_order.materialise(read(spark, sf_dir, "documents"), shards, key=20240229)


def op8_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.with_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), window=1024).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, sizes = mixing.plan_by_cycle(read(spark, sf_dir, "documents"))
    mixed = mixing.copies(sizes, planned)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicates(read(spark, sf_dir, "embeddings"))


def op12_heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_kmeans.clustered(read(spark, sf_dir, "embeddings"))


def op13_block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Run] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_tag_paths": op2_tag_paths,
    "op3_line_crf": op3_line_crf,
    "op4_quotations": op4_quotations,
    "op5_histogram_sort": op5_histogram_sort,
    "op6_one_permutation": op6_one_permutation,
    "op7_training_order": op7_training_order,
    "op8_line_first": op8_line_first,
    "op9_minimum_slack": op9_minimum_slack,
    "op10_pareto": op10_pareto,
    "op11_spherical_cells": op11_spherical_cells,
    "op12_heap_bounds": op12_heap_bounds,
    "op13_block_tables": op13_block_tables,
}

