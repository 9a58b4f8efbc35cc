"""From raw documents to packed training sequences: each stage takes what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language, mixing, neardup, packing
from ledgerloom.llm.kit import read, shared_folder, word_count


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that `docs` has not, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows; it learns from the stage's own labelled rows.

    Null texts and texts without a letter go (their language is unknown); without any labelled row all go; repeated rows are each kept or not
    alike; other columns stay as they are; no rows give no rows.
    """
    return language.keep_known(docs, language.learn(docs))


def one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that with the least doc_id (null last); rows without text are their own class.

    Rows are told apart by a number of their own, written with them: a doc_id may be null or repeated, with one text or several.
    """
    path, row = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}", free_name(docs, "row")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    classes = neardup.jaccard_join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "class_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))).alias("least")
    first = rows.select(row, "doc_id").join(classes, row).groupBy("class_id").agg(least).select(F.col("least.row").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; that depends on its doc_id, source and size alone, any of which may repeat or be null."""
    copies, size, copy = (free_name(docs, x) for x in ("copies", "size", "copy"))
    taken = mixing.mix_sources(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias(copies))
    sized = docs.withColumn(size, word_count(F.col("text")))
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{size}") == F.col("t.size"))
    found = sized.alias("d").join(taken.alias("t"), same).select("d.*", copies)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the mix fills. Null and empty texts fill nothing of their own; repeated rows are packed each; no rows give no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_a_group),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed),
]

#: Learnt languages and best-fit packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
