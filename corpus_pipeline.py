"""From raw documents to packed training windows, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row that the one before kept; ``docs`` is that stage's
output read back from Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import line_dedup, minhash, packing, quality, toxicity
from threadloom.llm._store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, _labels(spark, sf_dir))
    return quality.score_documents(docs, model).where("accepted").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't flag."""
    docs = docs.select(*COLUMNS)
    net = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score_documents(docs, net).where("predicted = 0").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_common_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select("doc_id", "text", "lang", "source", changed.alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id.

    Rows are told apart by id and text, so of rows that repeat an id only those of one class by text fall away. Rows
    without an id can't be told apart by it and all stay.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    classes = minhash.near_duplicates(keyed.select("key", "text"), doc_id="key").distinct()
    first = keyed.select("key", "doc_id").join(classes, "key").groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("f"))
    one = keyed.join(first.select("f.key"), "key", "left_semi").dropDuplicates(["key"])
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in windows of 4096 tokens."""
    return packing.pack_documents(docs.select(*COLUMNS), window=4096, end_id=1)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Classifiers, signatures and packing have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's output written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
