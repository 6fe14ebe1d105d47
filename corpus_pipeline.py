"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontaminate, line_dedup, packing, quality_classifier, simhash
from strataframe.llm.common import remove, remove_at_end, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under the threshold go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts; every row stays."""
    return line_dedup.rewritten(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, the one with the smallest id, then hash of its text; rows without an id come last."""
    body = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # Components are of texts, named by hashes: ids may be repeated or missing.
    found = simhash.near_duplicates(docs.select(body.alias("doc_id"), "text"))
    component = found.select(F.col("doc_id").alias("body"), "component_id").distinct()
    # Rows of one text are combined before they meet their component.
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("kept_id"), F.col("body").alias("kept_body"))
    texts = docs.select("doc_id", body.alias("body")).groupBy("body").agg(F.min(first).alias("first"))
    keep = texts.join(component, "body").groupBy("component_id").agg(F.min("first").alias("first")).select("first.kept_id", "first.kept_body")
    kept = docs.withColumn("_body", body).join(keep, (F.col("_body") == F.col("kept_body")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_body"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a test item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: The stages' methods (compression, SimHash, tokenizers) have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder and read again. A stage's
    folder goes once the next one is written, the last at the end of the application."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_end(spark, root)
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{root}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
