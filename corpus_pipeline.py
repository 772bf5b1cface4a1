"""The corpus pipeline: quality classifier, near-dedup, decontamination, secret scan, packing.

Each stage is written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm.decontaminate import without_contaminated
from sparkweft.llm.minhash_dedup import without_duplicates
from sparkweft.llm.packing import pack, token_pieces
from sparkweft.llm.quality_classifier import fit_quality, with_quality
from sparkweft.llm.queries import CAPACITY, tokenizer_path
from sparkweft.llm.secret_scan import find_secrets, redact
from sparkweft.llm.shared import free_names, new_shared_path, read_table

QUALITY_AT = 0.3
NEAR_PERCENT = 80
CONTAINED_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, scores at 0.3 or more; null and empty texts get its bias alone.

    Rows are judged one by one, so null ids and repeated rows stay as they come; an empty table gives an empty one.
    """
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "score")
    return with_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY_AT).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; of rows that repeat, one; rows without id take part."""
    return without_duplicates(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none. Rows are judged one by one."""
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"), percent=CONTAINED_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; n_chars follows. Null and empty texts stay as they are."""
    (spans,) = free_names(docs, "spans")
    hit = F.size(spans) > 0
    text = F.when(hit, redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    masked = find_secrets(docs, out_col=spans).withColumn("text", text)
    return masked.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(spans)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their place in sequences of at most 4096 tokens; a null or empty text is its end id alone."""
    return pack(token_pieces(docs, tokenizer_path(), CAPACITY), CAPACITY)


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("best-fit packing", packing)]

#: The classifier, the packing and the entropy scan are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_shared_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
