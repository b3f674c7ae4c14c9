"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents, and others that docs has, whatever their names. Stages keep
rows with null ids, texts or sources, count null texts as empty, read very long texts whole, and give no rows for no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.line_dedup import line_dedup
from lorespark.llm.mixing import apply_copies, mix_sources
from lorespark.llm.packing import pack_documents
from lorespark.llm.shared import WORD, spare, written
from lorespark.llm.simhash import similar_texts
from lorespark.llm.toxicity import score, train


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with other names for columns that an operator would replace."""
    clash = [c for c in docs.columns if c.lower() in names]
    return docs.withColumnsRenamed(dict(zip(clash, spare(docs, *(f"own_{c}" for c in clash)), strict=True)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach their language's threshold go. The classifier learns from the labels of sf_dir.

    Repeated rows share one fate, as a score is that of the text alone.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(_aside(docs, "score", "toxic"), model).filter(~F.col("toxic")).drop("score", "toxic").toDF(*docs.columns)


def repeated_line_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier run go, and documents of which no word is left by that.

    Of rows that agree in id and text both keep their lines, or both lose them.
    """
    named = _aside(docs, "n_lines", "deleted", "clean")
    out = line_dedup(named).filter((F.size("deleted") == 0) | F.regexp_like(F.col("clean"), F.lit(WORD)))
    changed = F.size("deleted") > 0
    new = {"text": F.when(changed, F.col("clean")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in named.columns)).toDF(*docs.columns)


def near_copy_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles exactly one row stays.

    It is one with the smallest id, null last; of different texts with that id the one with the least hash; of rows that
    agree in both any. Other texts of an id are documents of their own, which stay unless they are copies themselves.
    """
    groups = written(similar_texts(docs, words=5, similarity=0.8), "near-copies")
    own_id, own_hash = spare(docs, "of_id", "of_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit("")).cast("binary")) == F.col(own_hash))

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_hash))

    left = docs.join(keys(groups.filter("not kept").distinct()), same, "left_anti")
    again = written(keys(groups.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1")), "repeated-rows")
    if again.isEmpty():
        return left.select(*docs.columns)
    repeated = left.join(again, same, "left_semi").withColumn(own_hash, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", own_hash])
    return left.join(again, same, "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows that agree in id, source and size are taken alike."""
    return apply_copies(docs, mix_sources(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return pack_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", repeated_line_removal),
    ("simhash_near_dedup", near_copy_removal),
    ("source_mixing", source_mixing),
    ("best_fit_packing", packing),
]

#: Hash rounding, a trained classifier and packing have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
