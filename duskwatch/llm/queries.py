"""The corpus operators as named queries over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, license_scan, line_dedup, ngram_join, packing, passage_dedup, quality_rules, records, token_counts, warc
from .common import new_path, read


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"), removed_col="lines_removed").select("doc_id", "text", "n_chars", "lines_removed")


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole lines cannot find: passages of 50 or more words, wherever lines end."""
    return passage_dedup.dedup_passages(read(spark, sf_dir, "documents"), removed_col="words_removed").select("doc_id", "text", "n_chars", "words_removed")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_rules.score(docs, quality_rules.train(docs, labels), toxic=quality_rules.train_toxic(docs, labels))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to compressed WARC files with noise between records, and salvaged."""
    return warc.rehearse(read(spark, sf_dir, "pages"))


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record, read back in shuffled order and held against its checksums."""
    path = new_path(spark, "records")
    index = records.write_records(read(spark, sf_dir, "documents"), path)
    return records.read_records(spark, path, index, seed=1, ids=False).select("doc_id", "n_tokens", "length", "ok")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op3_passage_dedup": op3_passage_dedup,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_binary_records": op8_binary_records,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard": ngram_join.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op7_warc": warc.SQL,
}
