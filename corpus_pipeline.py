"""The corpus pipeline: documents in, packed training pieces out, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm import decontam, jaccard, packing, quality, secrets
from stintline.llm.queries import contamination_digest, held_out, tokenizer_path
from stintline.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the quality classifier rejects. It is fitted on the labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))
    weights = quality.fit(quality.sample_labelled(docs, labels, "quality"))
    return docs.where(quality.chance("text", weights, spark) >= 0.3).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near-duplicates the document of smallest id, and of rows that repeat an id one.

    Rows without an id are compared with each other by a key of their own, and one of each class stays, also beside a named one.
    """
    classes = jaccard.jaccard_classes(docs, n_words=5, percent=80)
    kept = classes.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    one = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return (named.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))
            .unionByName(_unnamed(spark, docs.where("doc_id is null").select(*COLUMNS))))


def _unnamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Of rows without an id, one of each class of near-duplicates."""
    if rows.isEmpty():
        return rows
    keyed = Scratch(spark).write(rows.withColumn("key", F.monotonically_increasing_id()))
    classes = jaccard.jaccard_classes(keyed.select(F.col("key").alias("doc_id"), "text"), n_words=5, percent=80)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return keyed.join(kept, "key", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows of whose words benchmark windows cover a twentieth or more, each by its own verdict, with an id or without."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return contamination_digest(found, keep=COLUMNS[1:]).where("not contaminated").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets; every document stays, with its new length."""
    words = tokenizer_path()
    forest = secrets.train(secrets.labelled_findings(docs), words)
    masked = docs.withColumn("text", secrets.redacted(F.col("text"), forest, spark, words))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.ids_crc32(packing.packed(docs, tokenizer_path()))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the trained stages and the tokenizer are beyond SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
