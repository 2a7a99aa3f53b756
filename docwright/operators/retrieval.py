"""Retrieval of whole tables of questions: thresholds, fusion, and the three search modes.

The top k is taken before the distance threshold. A threshold that is null or 0 means the default. Fusion is weighted
reciprocal ranks; a keyword-only hit keeps its own row. `filtered_count` is, by mode: fetched minus kept; 0; fused
top k minus kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fulltext, vector

#: Fixed values of the retrieval contract.
DISTANCE_LIMIT, RRF_FLOOR, RRF_K, SEMANTIC_WEIGHT, KEYWORD_WEIGHT, OVERFETCH = 0.8, 0.002, 60, 0.7, 0.3, 4


def threshold(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), F.lit(DISTANCE_LIMIT)).otherwise(c)


def fuse(semantic: DataFrame, keyword: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, distance, score, rrf_score, rank): both ranked lists united by id and cut to top_k. Lists: qid, id, rank and distance or score."""
    a = semantic.select("qid", "id", "distance", F.lit(None).cast("double").alias("score"), F.col("rank").alias("s"), F.lit(None).cast("int").alias("k"))
    b = keyword.select("qid", "id", F.lit(None).cast("double").alias("distance"), "score", F.lit(None).cast("int").alias("s"), F.col("rank").alias("k"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (RRF_K + F.col(rank)), F.lit(0.0))
    both = a.unionByName(b).groupBy("qid", "id").agg(F.max("distance").alias("distance"), F.max("score").alias("score"), F.min("s").alias("s"), F.min("k").alias("k"))
    scored = both.withColumn("rrf_score", part(SEMANTIC_WEIGHT, "s") + part(KEYWORD_WEIGHT, "k"))
    most = queries.agg(F.max("top_k")).first()[0] or 0
    w = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.col("s").asc_nulls_last(), F.col("k").asc_nulls_last(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.join(queries.select("qid", "top_k"), "qid").where("rank <= top_k").select("qid", "id", "distance", "score", "rrf_score", "rank")


Search = Callable[[DataFrame], DataFrame]


def exact(vectors: DataFrame) -> Search:
    return lambda queries: vector.exact_topk(vectors, queries)


def inverted_file(assigned: DataFrame, centroids: DataFrame, probes: int) -> Search:
    """The search by an index that was fitted and stored once; to be given to `dispatch` and the others in the place of vectors."""
    return lambda queries: vector.ivf_topk(assigned, centroids, queries, probes)


def semantic_hits(vectors: DataFrame | Search, queries: DataFrame) -> DataFrame:
    """Top k by distance with `keep` told, not yet filtered. vectors: a table, or a search over one."""
    search = vectors if callable(vectors) else exact(vectors)
    return search(queries).join(queries.select("qid", threshold(F.col("threshold")).alias("limit")), "qid").withColumn("keep", F.coalesce(F.col("distance") <= F.col("limit"), F.lit(False)))


def hybrid_hits(vectors: DataFrame | Search, index: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """Fused top k with `keep` told; the lists hold top_k * 4 rows, and distance drops happen before the fusion."""
    wide = queries.withColumn("top_k", F.col("top_k") * OVERFETCH)
    near = semantic_hits(vectors, wide).where("keep")
    fused = fuse(near, fulltext.keyword_topk(index, wide, stem), queries)
    return fused.withColumn("keep", F.col("rrf_score") >= RRF_FLOOR)


def dispatch(vectors: DataFrame | Search, index: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, id, rank, distance, rrf_score, fts_rank, keep): each question by its own search_mode; unknown and null modes are hybrid. Rounded for display.

    One vector search and one keyword search serve all modes: a hybrid question asks them for four times its top_k.
    """
    mode, none = F.lower("search_mode"), F.lit(None).cast("double")
    told = queries.withColumn("by", F.when(mode.isin("semantic", "keyword"), mode).otherwise("hybrid"))
    wide = told.withColumn("top_k", F.when(F.col("by") == "hybrid", F.col("top_k") * OVERFETCH).otherwise(F.col("top_k")))
    near = semantic_hits(vectors, wide.where("by <> 'keyword'")).join(told.select("qid", "by"), "qid")
    words = fulltext.keyword_topk(index, wide.where("by <> 'semantic'"), stem).join(told.select("qid", "by"), "qid")
    sem = near.where("by = 'semantic'").select("qid", "id", "rank", F.round("distance", 4).alias("distance"), none.alias("rrf_score"), none.alias("fts_rank"), "keep")
    kw = words.where("by = 'keyword'").select("qid", "id", "rank", none.alias("distance"), none.alias("rrf_score"), F.round("score", 6).alias("fts_rank"), F.lit(True).alias("keep"))
    fused = fuse(near.where("by = 'hybrid' and keep"), words.where("by = 'hybrid'"), told.where("by = 'hybrid'"))
    hyb = fused.select("qid", "id", "rank", F.round("distance", 4).alias("distance"), F.round("rrf_score", 6).alias("rrf_score"), F.round("score", 6).alias("fts_rank"), (F.col("rrf_score") >= RRF_FLOOR).alias("keep"))
    return sem.unionByName(kw).unionByName(hyb)


def with_sources(rows: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds content, document and title to the few rows that were kept; the join comes after the top k, never before it."""
    got = rows.join(chunks.select("id", "document_id", "chunk_index", "content"), "id")
    return got.join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title")), "document_id")


def filtered_count(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, kept, filtered_count) of every question, also of those without a hit."""
    counted = rows.groupBy("qid").agg(F.count_if(F.col("keep")).alias("kept"), F.count_if(~F.col("keep")).alias("filtered_count"))
    return queries.select("qid").join(counted, "qid", "left").na.fill(0, ["kept", "filtered_count"])
