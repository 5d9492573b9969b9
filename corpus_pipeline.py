"""Training-corpus pipeline over ``documents``: each stage calls one operator and works on all its predecessor kept.

Toxic documents go, then all but one of equal texts, then all but one of each near-duplicate group, then
documents that leak benchmark items; what is left is encoded and decoded. Every stage but the last returns the
columns of ``documents``. Rows that repeat an id and a text are one document and pass or go together; rows that share an id
only are judged apart; rows with a null id come after all others of their group.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.llm.decontaminate import find_leaks  # noqa: E402
from flowloom.llm.exact_dedup import exact_groups  # noqa: E402
from flowloom.llm.queries import bpe_digests  # noqa: E402
from flowloom.llm.simhash import near_groups  # noqa: E402
from flowloom.llm.toxicity import score_toxicity, train_toxicity  # noqa: E402
from flowloom.session import scratch_path, ship_package  # noqa: E402

TOXIC_FROM = 0.5


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    ship_package(spark)
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter(F.col("score") < TOXIC_FROM).select(*_columns(docs))


def _kept(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in the column of ``keys``."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(keys.distinct().toDF("kept"), F.col("key").eqNullSafe(F.col("kept")), "left_semi").select(*_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of equal texts."""
    ship_package(spark)
    digest = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    kept = exact_groups(docs).filter("kept").select(F.struct("doc_id", F.col("text_sha256").alias("of")))
    return _kept(docs, F.struct(docs["doc_id"].alias("doc_id"), digest.alias("of")), kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that SimHash links."""
    ship_package(spark)
    # texts in the order of ids, nulls last, apart for rows of one id but unlike texts
    place = F.lpad((docs["doc_id"].cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    key = F.concat(F.coalesce(place, F.lit("null")), F.lit(" "), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).cast("string"))
    groups = near_groups(docs.select(key.alias("doc_id"), docs["text"].alias("text")), shingle=4, distance=4)
    return _kept(docs, key, groups.filter("doc_id <=> component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    ship_package(spark)
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leak")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(leaks, F.col("row.doc_id").eqNullSafe(F.col("leak")), "left_anti").select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and digests of token ids and decoded text."""
    ship_package(spark)
    return bpe_digests(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminate),
          ("BPE encoding and decoding", encode)]

#: SQL can't express the toxicity model, SimHash groups or BPE; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
