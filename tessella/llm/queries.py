"""Queries of this subpackage over the given tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import binary, bpe, counts, langid, lines, manifest, neardup, packing, quality, rules, search, sharding, spelling, sql

BYTE_BPE, PIECE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
TOKEN_LIMIT = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded and decoded again, with digests of both."""
    ids = bpe.encode(documents(spark, sf_dir), BYTE_BPE)
    text = bpe.decode(ids.select("doc_id", "n_tokens", "ids"), BYTE_BPE)
    return text.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole texts, and which go over the limit."""
    return counts.count_tokens(documents(spark, sf_dir), PIECE_BPE).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each piece of each document in sequences of 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), WORD_BPE)


def part(n: int) -> Column:
    """crc32 of doc_id as text, modulo n: which documents are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a model of three quarters of them."""
    docs, held = documents(spark, sf_dir), part(4) == 2
    model = langid.train(docs, ~held)
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model)


def op6_packed_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences: their segments, and checksums of ids and positions."""
    ids = bpe.encode(documents(spark, sf_dir), BYTE_BPE)
    rows = binary.pack_binary(ids, end=bpe.END_OF_TEXT)
    return rows.select("n_ids", "cu_seqlens", F.col("segments.key").alias("doc_ids"), F.col("segments.start").alias("starts"), F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on whole texts, and the verdicts of their hosts."""
    out = rules.apply_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner products for every 20th vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("int"))
    rows = rows.where(F.col("embedding").isNotNull() & ~odd).select("vec_id", whole.alias("v"))
    return search.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of each document, by a model of four fifths of the labels."""
    docs, held = documents(spark, sf_dir), part(5) == 0
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return quality.score(docs.select("doc_id", "text", held.alias("held_out")), net)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat or nearly repeat an earlier one."""
    return lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document at a shingle similarity of 0.85."""
    return neardup.near_duplicates(documents(spark, sf_dir))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts, the form that each is a variant of, and the root of its group."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; a fifth of them is verified with its text lowered."""
    return manifest.manifest(documents(spark, sf_dir), changed={"text": manifest.lowered(F.col("text"))}, where=part(5) == 0)


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of as many documents each, as runs of a curve through source, language and length."""
    out = sharding.shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_best_two_fit, op4_host_rules, op5_language, op6_packed_binary, op7_threshold_search, op8_quality, op9_line_dedup, op10_near_duplicates, op11_spelling_groups, op12_merkle_manifest, op13_hilbert_shards)}
SQL = {"op4_host_rules": sql.OP4, "op7_threshold_search": sql.OP7, "op10_near_duplicates": sql.OP10, "op11_spelling_groups": sql.OP11, "op12_merkle_manifest": sql.OP12, "op13_hilbert_shards": sql.OP13}
