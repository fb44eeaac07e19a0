"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import bpe, dart, forest, html, importance, lines, mixing, negatives, passages, planes, rules, toxicity, trie
from auditframe.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; with columns, those of a table of texts, dealt over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows.select(*columns)) if columns else rows


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class of near duplicates)."""
    return dart.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, perturbed, kept."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = importance.fit(docs, _table(spark, sf_dir, "labels"))
    return importance.importance_sample(docs, model, keep_all=True, columns=["doc_id"])


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    both = bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rest."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rest")


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return forest.search(_table(spark, sf_dir, "embeddings"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept, n_lines_removed, lost_share."""
    return rules.quality_rules(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "clean_text")


def op7_text_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html.extract_main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("html")


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files read back."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    files, folder = planes.encode_to_planes(docs, public_tokenizers.path("word_bpe_49k.json"))
    return planes.read_planes(spark, files, folder)


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed, n_removed_short, removed_short."""
    return lines.line_report(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return negatives.hard_negatives(negatives.contract_rows(_table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


def op12_doubled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans."""
    return passages.dedup_digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie.prefix_trie(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_dart_minhash, op2_importance, op3_prefix_bpe, op4_water_filling, op5_prefix_forest, op6_line_rules, op7_text_cnn, op8_tag_paths, op9_bit_planes, op10_fuzzy_lines, op11_radix_negatives, op12_doubled_windows, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_water_filling": mixing.mix_sql() + "SELECT doc_id, size, source_size, target, size * copies + rest AS taken, copies, rest FROM mixed"}
