"""Whole paths through the engine: ingest of texts and of extracted pages, and answering a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..operators import answer as A
from ..operators import cache as C
from ..operators import chunking as K
from ..operators import extraction as E
from ..operators import fulltext as X
from ..operators import retrieval as R
from ..operators import store as S
from ..schemas import CHUNK, DOCUMENT, conform
from ..session import cut_lineage


def ingest_texts(documents: DataFrame, embed: Callable[[Column], Column] = models.embed, tokenizer: K.TokenizerFactory | None = None) -> DataFrame:
    """Chunk rows of text documents (id, content): windows of words, or of a tokenizer's tokens, embedded, ids from document and index."""
    cut = K.token_windows(documents, tokenizer) if tokenizer else K.sliding_windows(documents)
    rows = cut.select(F.col("id").alias("document_id"), "chunk_index", F.col("text").alias("content"), embed(F.col("text")).alias("embedding"), F.lit("text").alias("chunk_type"))
    return _stored(rows)


def ingest_pages(spans: DataFrame, tables: DataFrame, ocr: DataFrame, strategy: str = "sentence_aware", embed: Callable[[Column], Column] = models.embed) -> DataFrame:
    """Chunk rows of extracted files: spans to blocks, pages with little text to OCR, tables first, chunks embedded.

    tables: document_id, page_number, table_index, cells, confidence; ocr: document_id, page_number, text.
    """
    typed = E.blocks(spans)
    little = E.scanned_pages(typed).where("is_scanned").select("document_id", "page_number")
    real = typed.join(little, ["document_id", "page_number"], "left_anti")
    blocks = real.select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), F.col("block_pos").cast("long").alias("pos"), "block_type", "text", "section_heading")
    good = tables.where(E.big_enough(F.col("cells")) & (F.coalesce("confidence", F.lit(100.0)) >= 50))
    drawn = good.select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), "table_index", E.markdown(F.col("cells")).alias("markdown"), F.lit(None).cast("string").alias("caption"))
    read = ocr.select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), "text")
    out = K.chunk_documents(blocks, read, drawn, strategy)
    return _stored(out.select(F.col("doc").cast("long").alias("document_id"), "chunk_index", F.col("text").alias("content"), embed(F.col("text")).alias("embedding"), "chunk_type", F.col("page").alias("page_number"), "section_heading"))


def _stored(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumns({"id": F.abs(F.xxhash64("document_id", "chunk_index")), "created_at": F.current_timestamp()})
    return conform(keyed, CHUNK)


def answer_questions(
    queries: DataFrame, chunks: DataFrame, cache: DataFrame, now: Column,
    generate: Callable[[Column, Column], Column] = lambda texts, prompt: models.first_chunk_answer(texts), judge: A.Scored = A.stand_in_judge,
    stem: bool = True, score: A.Scored = models.lexical_score, search: R.Search | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """One row of every question: cache, retrieval with an inflated k, rerank, prompt, answer, judge, gate.

    (qid, answer, score, reason, sources, filtered_count, from_cache, cacheable, key); an answer from the cache has neither score nor sources.
    queries: qid, question, qvec, top_k, threshold, search_mode; chunks: id, content, embedding. generate: of (kept texts, prompt). Texts and questions are
    stemmed alike; stem=False is the form that SQL can say. search and index: a stored vector index and a stored tsvector (id, words) for the ones made here.
    """
    keyed = cut_lineage(queries).withColumn("key", C.response_key(F.col("question"), F.col("search_mode")))
    looked = cut_lineage(C.lookup(keyed.select("qid", "key"), cache, now))
    misses = keyed.join(looked.where("not hit").select("qid"), "qid", "left_semi")
    wide = misses.withColumn("top_k", F.greatest(F.col("top_k") * R.OVERFETCH, F.lit(20)))
    texts = chunks.select("id", "content")
    fetched = cut_lineage(R.dispatch(search or R.exact(chunks.select("id", "embedding")), index if index is not None else X.tsvector(texts, stem), wide, stem))
    hits = fetched.where("keep").join(texts, "id")
    best = cut_lineage(A.rerank(hits.select("qid", "id", "content", "rank"), misses.select("qid", "question", "top_k"), F.col("top_k"), score))  # few rows a question, read more than once below
    kept = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda c: c["content"]).alias("texts"))
    asked = kept.join(A.contexts(best), "qid").join(A.prompts(misses, best), "qid")
    said = asked.withColumn("raw", generate(F.col("texts"), F.col("prompt"))).withColumn("verdict", judge(F.col("raw"), F.col("context"))).select("qid", "raw", "verdict.score", "verdict.reason")
    gated = said.select("qid", A.gate(F.col("raw"), F.col("score")).alias("answer"), "score", "reason")
    dropped = R.filtered_count(fetched, misses).select("qid", "filtered_count")
    fresh = A.with_fallback(misses, gated).join(gated.select("qid", "score", "reason"), "qid", "left").join(A.source_rows(A.sources(hits, best)), "qid", "left").join(dropped, "qid")
    fresh = fresh.select("qid", "answer", "score", "reason", "sources", "filtered_count", F.lit(False).alias("from_cache"), "cacheable")
    none = [F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in ("score", "reason", "sources", "filtered_count")]
    held = looked.where("hit").select("qid", F.col("value").alias("answer"), *none, F.lit(True).alias("from_cache"), F.lit(False).alias("cacheable"))
    return fresh.unionByName(held).join(keyed.select("qid", "key"), "qid")


def new_entries(answers: DataFrame, now: Column) -> DataFrame:
    """What the answers add to the response cache; the fixed text for an empty result is never cached."""
    return C.entries(answers.where("cacheable").select("key", F.col("answer").alias("value")), now, C.RESPONSE_TTL)


def embed_through_cache(texts: DataFrame, cache: DataFrame, now: Column, embed: Callable[[Column], Column] = models.embed) -> DataFrame:
    """(id, embedding) of texts (id, text): live cached vectors are used, only the rest is embedded, each distinct text once."""
    keyed = texts.withColumn("key", C.cache_key("embedding", F.col("text")))
    known = C.lookup(keyed.select("key").distinct(), cache, now)
    hits = known.where("hit").select("key", F.from_json("value", "array<float>").alias("embedding"))
    todo = keyed.join(known.where("not hit").select("key"), "key", "left_semi").groupBy("key").agg(F.max("text").alias("text"))
    return keyed.select("id", "key").join(hits.unionByName(todo.select("key", embed(F.col("text")).alias("embedding"))), "key").select("id", "embedding")


def ingest(documents: DataFrame, chunks: DataFrame, root: str) -> None:
    """Writes a batch's documents and chunks as new versions, chunks first, so no reader sees a document without them; documents get their status from their chunks."""
    S.write_version(chunks, f"{root}/chunk", CHUNK, ("id", "page_number"))
    S.write_version(S.rewritten(documents, S.status_after(documents, chunks)), f"{root}/document", DOCUMENT, ("id",))
