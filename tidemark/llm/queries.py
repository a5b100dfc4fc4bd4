"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import base, langid, lexical, linededup, merkle, mixing, neighbours, packing, pii, quality_rules, simhash, site_quality, token_store, toxicity


def op1_boosted_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(base.documents(spark, folder))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    named = [F.sha2(pii.joined_names(F.col("base")), 256).alias("base_sha256"), pii.joined_names(F.array_sort(F.concat("base", "added"))).alias("spans")]
    return found.select("doc_id", *counts, *named)


def op2_adaptive_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.apply_rules(base.documents(spark, folder))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_neighbourhoods(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.dedup_lines(base.documents(spark, folder))
    return found.select("doc_id", "line_count", "lines_removed", "text")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(base.documents(spark, folder))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_cross_parsing_language(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = base.documents(spark, folder), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs, learn=~held_out & F.col("doc_id").isNotNull())
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_token_store(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_store.write_token_store(base.documents(spark, folder))
    docs = token_store.read_token_store(spark, manifest)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(base.documents(spark, folder)).select("doc_id", "source", "copy", "place", "text")


def op8_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(base.documents(spark, folder))
    return found.select("doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def op9_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = base.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    found = site_quality.classify(docs, labels, F.col("source"), path, ("source", "lang"))
    rounded = [F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "score")]
    return found.select("doc_id", *rounded, "kept")


def op10_multiprobe_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.nearest_neighbours(vectors, F.col("id") % 100 == 0).withColumnRenamed("distance", "score")


def op11_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.score_toxicity(base.documents(spark, folder), labels, learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(base.documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(base.documents(spark, folder), revised={"text": tampered}).withColumn("folded_root", merkle.folded(F.col("revised_leaf"), F.col("path")))
    proof = F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_boosted_personal_data": op1_boosted_personal_data,
    "op2_adaptive_quality_rules": op2_adaptive_quality_rules,
    "op3_line_neighbourhoods": op3_line_neighbourhoods,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_cross_parsing_language": op5_cross_parsing_language,
    "op6_token_store": op6_token_store,
    "op7_poisson_mixing": op7_poisson_mixing,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_site_quality": op9_site_quality,
    "op10_multiprobe_neighbours": op10_multiprobe_neighbours,
    "op11_weak_toxicity": op11_weak_toxicity,
    "op12_bag_search": op12_bag_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {"op2_adaptive_quality_rules": quality_rules.SQL, "op7_poisson_mixing": mixing.SQL, "op9_site_quality": site_quality.SQL, "op12_bag_search": lexical.SQL, "op13_merkle_manifest": merkle.SQL}
