"""From documents to packed training windows.

Stages, in this order: quality rules, line dedup (whole lines, then passages of 50 words that lines do not show), n-gram Jaccard join, benchmark decontamination, packing.  Each works on all rows that the one before it kept,
is written as Parquet in the shared folder and read again, so that a lost executor never reaches back beyond one stage.  All but the last return the columns of ``documents``;
the last returns the packing manifest.

Defined results: a null, empty or blank text is rejected by the quality rules; a document that line dedup leaves without text is dropped there;
of each group of similar documents the row with the lowest id stays, once (null ids last); rows that share an id are documents of their own; a document that holds a benchmark item is dropped whole; empty tables give
empty results.  Toxic texts are rejected with those of low quality.  With too few labels the quality rules keep all that has text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duskwatch.llm import decontaminate, line_dedup, ngram_join, packing, passage_dedup, quality_rules
from duskwatch.llm.common import new_path, read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return quality_rules.keep(docs, quality_rules.train(docs, labels), toxic=quality_rules.train_toxic(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passage_dedup.dedup_passages(written(line_dedup.dedup_lines(docs), "lines")).where("text <> ''")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: A classifier and a packing heuristic are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
