"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. Nulls
in any column, empty and repeated rows go through every stage; each stage's docstring says
what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redlake.llm import byte_bpe, decontaminate, line_spread, near_texts, resampling
from redlake.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling picks; a text without words has weight 0 and stays."""
    found = resampling.resample(docs, table(spark, sf_dir, "labels"))
    return found.where("__kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, whole blocks of them too; n_chars follows. No document goes."""
    found = line_spread.remove_boilerplate(docs)
    changed = F.col("__n_removed") > 0
    columns = {"text": F.col("__clean").alias("text"), "n_chars": F.when(changed, F.length("__clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")}
    return found.select(*[columns.get(c, F.col(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8): that with the smallest doc_id, nulls last."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = written(docs.withColumn("__own", own), "rows")
    groups = near_texts.near_duplicates(rows, "__own")
    first = groups.where("doc_id.row = component_id.row").select(F.col("doc_id.row").alias("__row"))
    return rows.withColumn("__row", F.col("__own.row")).join(first.hint("merge"), "__row", "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaked into; null and empty texts stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return byte_bpe.encode_texts(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The first, third and last stages (Gumbel top-k, fingerprints, BPE) aren't SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
