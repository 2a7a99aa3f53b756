"""Reads, checks and writes of the document store."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import not_blank
from ..schemas import MODES, conform


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row a key; repeated rows agree in what is read, so any non-null value stands for all."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns))


def latest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The newest row a key by a time column; a null time is the oldest."""
    order = F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in columns))


def problem(question: Column, top_k: Column, mode: Column) -> Column:
    """Why a request is refused; null if it is not."""
    return F.when(~F.coalesce(not_blank(question), F.lit(False)), "blank question").when(~F.coalesce(top_k.between(1, 20), F.lit(False)), "top_k out of 1..20").when(~F.coalesce(mode.isin(*MODES), F.lit(True)), "unknown mode")


def nested(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents (id, title) with their chunks as an array ordered by index."""
    rows = F.sort_array(F.collect_set(F.struct("chunk_index", "chunk_id", "content")))
    own = chunks.select("document_id", "chunk_index", F.col("id").alias("chunk_id"), "content").groupBy("document_id").agg(rows.alias("chunks"))
    return documents.join(own, documents["id"] == own["document_id"], "left").select("id", "title", F.coalesce("chunks", F.expr("cast(array() as array<struct<chunk_index:int,chunk_id:bigint,content:string>>)")).alias("chunks"))


def upload_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    count = chunks.groupBy("document_id").agg(F.count_distinct("id").alias("chunk_count"))
    return documents.join(count, documents["id"] == count["document_id"], "left").select("id", "title", "source", "page_count", "extraction_status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def write_version(df: DataFrame, root: str, schema=None, order: tuple[str, ...] = ()) -> str:
    """Writes a new version folder and then a pointer file that names it; no file is ever overwritten, so readers see one whole version or another.

    A write that fails leaves no pointer: nothing to roll back. `order`: columns to sort by within files, so that their statistics serve as an index.
    """
    number = time.time_ns()
    path = f"{root}/v={number}"
    rows = conform(df, schema) if schema else df
    (rows.sortWithinPartitions(*order) if order else rows).write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(number, path)], "number long, path string").coalesce(1).write.mode("append").json(f"{root}/_pointers")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The newest version that has a pointer."""
    return spark.read.parquet(spark.read.schema("number long, path string").json(f"{root}/_pointers").agg(F.max_by("path", "number")).first()[0])


def rewritten(old: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with their changes (key and some columns) put in; changed rows get updated_at, as an UPDATE would."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("changed"))
    joined = old.join(new, key, "left")
    pick = lambda c: F.when(F.col("changed"), F.current_timestamp() if c == "updated_at" else F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*(pick(c) if c in columns or c == "updated_at" else F.col(c) for c in old.columns))


def status_after(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, extraction_status): 'completed' once a document has chunks, 'failed' where it has none."""
    have = chunks.select(F.col("document_id").alias("id")).distinct().withColumn("has", F.lit(True))
    return documents.select("id").join(have, "id", "left").select("id", F.when(F.col("has"), "completed").otherwise("failed").alias("extraction_status"))


def without_columns(df: DataFrame, *columns: str) -> DataFrame:
    """The downgrade of an added column."""
    return df.drop(*columns)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pretty(row: dict) -> str:
    """One extraction result as indented JSON, other scripts kept, unknown types as text."""
    return json.dumps(row, ensure_ascii=False, indent=2, default=str)


def save_vector_lists(assigned: DataFrame, path: str) -> None:
    """The inverted file: one folder a list, so a probe reads only its lists."""
    assigned.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def probe_lists(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """The rows of some lists; the ids are few and known, so the other folders are pruned before the scan."""
    return spark.read.parquet(path).where(F.col("list_id").isin(lists))


def save_postings(postings: DataFrame, path: str, shards: int = 256) -> None:
    """The full-text index: postings in shards by lexeme, sorted by it, so that file statistics skip the rest."""
    keyed = postings.withColumn("shard", F.pmod(F.xxhash64("lexeme"), F.lit(shards)))
    keyed.repartition("shard").sortWithinPartitions("lexeme").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_postings(spark: SparkSession, path: str, lexemes: list[str], shards: int = 256) -> DataFrame:
    """The postings of a few lexemes from their shards."""
    keys = [r[0] for r in spark.createDataFrame([(x,) for x in lexemes], "x string").select(F.pmod(F.xxhash64("x"), F.lit(shards))).distinct().collect()]
    return spark.read.parquet(path).where(F.col("shard").isin(keys) & F.col("lexeme").isin(lexemes)).drop("shard")
