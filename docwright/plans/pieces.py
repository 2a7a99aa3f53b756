"""Queries of single operators, each small, with their SQL. Stand-ins for data that the tables lack are made from columns by rules that the SQL repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import answer as A
from ..operators import cache as C
from ..operators import chunking as K
from ..operators import extraction as E
from ..operators import retrieval as R
from ..operators import store as S
from ..schemas import CHUNK, conform
from ..sources.readers import table
from . import registry as Q

query = Q.query
_STRIP = lambda x: f"regexp_replace({x}, '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g')"

# --- store ----------------------------------------------------------------------------------------------------------


@query(f"WITH {Q._DOCS}, {Q._CHUNKS} SELECT d.id, CASE WHEN c.document_id IS NULL THEN 'failed' ELSE 'completed' END AS extraction_status, true AS touched FROM docs d LEFT JOIN (SELECT DISTINCT document_id FROM chunks) c ON c.document_id = d.id")
def status_after_ingest(spark, d):
    docs = Q.docs(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return S.rewritten(docs, S.status_after(docs, Q.chunks(spark, d))).select("id", "extraction_status", F.col("updated_at").isNotNull().alias("touched"))


@query(f"WITH {Q._DOCS}, p AS (SELECT id, unnest(string_split(content, chr(10) || chr(10))) AS part, unnest(range(len(string_split(content, chr(10) || chr(10)))))::INTEGER AS i FROM docs WHERE content IS NOT NULL) SELECT id AS document_id, i AS chunk_index, md5(part) AS digest, 'text' AS chunk_type, true AS no_page FROM p")
def insert_chunks(spark, d):
    rows = Q.docs(spark, d).select(F.col("id").alias("document_id"), F.posexplode(F.split("content", "\n\n")).alias("chunk_index", "content"))
    return conform(rows, CHUNK).select("document_id", "chunk_index", F.md5("content").alias("digest"), "chunk_type", F.col("page_number").isNull().alias("no_page"))


@query(f"WITH {Q._CHUNKS} SELECT id, document_id, chunk_index, chunk_type FROM chunks")
def drop_columns(spark, d):
    return S.without_columns(Q.chunks(spark, d), "content", "token_count")


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR {_STRIP('text')} = '' THEN 'blank' END AS problem, CASE WHEN text IS NULL OR {_STRIP('text')} = '' THEN NULL ELSE sha256(text) END AS sha256 FROM documents")
def text_rejects(spark, d):
    ok = F.coalesce(T.not_blank(F.col("text")), F.lit(False))
    return table(spark, d, "documents").select("doc_id", F.when(~ok, "blank").alias("problem"), F.when(ok, F.sha2("text", 256)).alias("sha256"))


# --- extraction -----------------------------------------------------------------------------------------------------


@query(f"""WITH {Q._BLOCKS}, p AS (SELECT document_id, page_number, count(*) FILTER (WHERE {_STRIP("coalesce(text, '')")} <> '') AS n, count(*) FILTER (WHERE block_type = 'heading') AS t FROM blocks GROUP BY 1, 2),
o AS (SELECT document_id, page_number, max(text) AS text FROM ocr_result GROUP BY 1, 2)
SELECT document_id, sum(coalesce(n, 0) + coalesce(t, 0) + CASE WHEN {_STRIP("coalesce(o.text, '')")} <> '' THEN 1 ELSE 0 END)::BIGINT AS extractable FROM p FULL JOIN o USING (document_id, page_number) GROUP BY 1""")
def extractable_count(spark, d):
    """Headings stand for tables."""
    keys = ["document_id", "page_number"]
    own = Q.blocks(spark, d).groupBy(*keys).agg(F.collect_list("text").alias("block_texts"), F.collect_list(F.when(F.col("block_type") == "heading", F.col("block_id"))).alias("tables"))
    ocr = table(spark, d, "ocr_result").groupBy(*keys).agg(F.max("text").alias("ocr_text"))
    return E.extractable(own.join(ocr, keys, "full").withColumn("tables", F.coalesce("tables", F.array().cast("array<bigint>"))))


@query(f"WITH {Q._BLOCKS} SELECT document_id, count(*) AS entries, md5(string_agg({_STRIP('text')} || ':' || page_number, '|' ORDER BY block_id)) AS digest FROM blocks WHERE block_type IN ('heading', 'caption') AND {_STRIP('text')} <> '' GROUP BY 1")
def table_of_contents(spark, d):
    """Headings and captions as entries of two levels."""
    b = Q.blocks(spark, d).where("block_type in ('heading', 'caption')")
    entry = F.struct("block_id", F.when(F.col("block_type") == "heading", 1).otherwise(2).alias("level"), F.col("text").alias("title"), F.col("page_number").alias("page"))
    toc = b.groupBy("document_id").agg(E.table_of_contents(F.sort_array(F.collect_list(entry))).alias("toc")).where(F.size("toc") > 0)
    return toc.select("document_id", F.size("toc").cast("long").alias("entries"), F.md5(F.array_join(F.transform("toc", lambda e: F.concat(e["title"], F.lit(":"), e["page"].cast("string"))), "|")).alias("digest"))


_OCR_WORDS = """pages AS (SELECT document_id, page_number, max(text) AS text FROM ocr_result WHERE document_id IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2),
words AS (SELECT document_id, page_number, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' '))))::INTEGER AS pos, document_id % 2 = 0 AS second FROM pages)"""


@query(
    f"""WITH {_OCR_WORDS}, scored AS (SELECT *, CASE WHEN second THEN (length(word) % 10)::DOUBLE / 10 ELSE (length(word) - 1)::DOUBLE END AS score FROM words WHERE {_STRIP("word")} <> '')
SELECT document_id, page_number, md5(string_agg({_STRIP("word")}, ' ' ORDER BY pos)) AS digest, nullif(round(round(avg(CASE WHEN second THEN score * 100 ELSE score END) FILTER (WHERE score >= 0), 9), 1), 0) AS confidence FROM scored WHERE NOT second OR score > 0.3 GROUP BY 1, 2"""
)
def ocr_words(spark, d):
    """Words scored by their length; documents of even id by the second backend."""
    pages = table(spark, d, "ocr_result").where("document_id is not null and page_number is not null").groupBy("document_id", "page_number").agg(F.max("text").alias("text"))
    words = pages.select("document_id", "page_number", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    second = F.col("document_id") % 2 == 0
    score = F.when(second, (F.length("word") % 10).cast("double") / 10).otherwise((F.length("word") - 1).cast("double"))
    return E.page_from_words(words.select("*", score.alias("score"), F.when(second, "easyocr").otherwise("tesseract").alias("backend"))).select("document_id", "page_number", F.md5("text").alias("digest"), "confidence")


@query("SELECT document_id, page_number FROM (SELECT document_id, page_number, max(text) AS t, max(confidence) AS c FROM ocr_result GROUP BY 1, 2) WHERE len(string_split(t, chr(10))) >= 2 AND list_max(list_transform(string_split(t, chr(10)), lambda x: len(string_split(x, ' ')))) >= 2 AND coalesce(c, 100) >= 50")
def table_filters(spark, d):
    """Pages as tables, with the page's confidence: at least two rows and two columns, and a confidence of 50 where one is told."""
    sure = table(spark, d, "ocr_result").groupBy("document_id", "page_number").agg(F.max("confidence").alias("confidence"))
    cells = Q._cells(spark, d).join(sure, ["document_id", "page_number"])
    return cells.where(E.big_enough(F.col("cells")) & (F.coalesce("confidence", F.lit(100.0)) >= 50)).select("document_id", "page_number")


@query(f"WITH {Q._BLOCKS} SELECT block_id FROM blocks WHERE block_id % 5 <> 0 AND {_STRIP('''coalesce(text, '')''')} <> ''")
def image_blocks_dropped(spark, d):
    """Every fifth block as an image."""
    return E.blocks(Q._spans(spark, d).withColumn("type", F.when(F.col("block_pos") % 5 == 0, 1).otherwise(0))).select(F.col("block_pos").alias("block_id"))


@query(f"WITH b AS (SELECT block_id, max(text) AS text, any_value(bbox) AS bbox FROM page_block WHERE block_id IS NOT NULL GROUP BY 1), p AS (SELECT block_id, bbox, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS i FROM b WHERE text IS NOT NULL) SELECT block_id, i, round(bbox[i + 1], 6) AS bbox FROM p")
def tables_with_boxes(spark, d):
    """A block's lines paired with the numbers of its box by place."""
    b = table(spark, d, "page_block").where("block_id is not null").groupBy("block_id").agg(F.max("text").alias("text"), F.max("bbox").alias("bbox"))
    return b.select("block_id", F.posexplode(E.paired(F.split("text", "\n"), F.col("bbox"))).alias("i", "p")).select("block_id", "i", F.round("p.bbox", 6).alias("bbox"))


@query(f"WITH {Q._BLOCKS} SELECT block_id, CASE WHEN block_id % 2 = 0 THEN 'first' WHEN block_id % 3 = 0 THEN 'second' END AS finder FROM blocks")
def table_finder_fallback(spark, d):
    found = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    b = Q.blocks(spark, d).select("block_id", found(F.col("block_id") % 2 == 0, "first").alias("a"), found(F.col("block_id") % 3 == 0, "second").alias("b"))
    return b.select("block_id", F.get(E.first_tables(F.col("a"), F.col("b")), F.lit(0)).alias("finder"))


@query(f"WITH {Q._BLOCKS}, n AS (SELECT document_id, max(page_count) AS n FROM pdf_metadata GROUP BY 1) SELECT block_id FROM blocks JOIN n USING (document_id) WHERE page_number = 2 AND n >= 2")
def extract_page(spark, d):
    n = table(spark, d, "pdf_metadata").groupBy("document_id").agg(F.max("page_count").alias("n"))
    return E.extract_page(Q.blocks(spark, d).join(n, "document_id"), 2, F.col("n")).select("block_id")


@query(
    f"""WITH {Q._BLOCKS}, o AS (SELECT document_id, page_number, max(text) AS ocr FROM ocr_result GROUP BY 1, 2),
b AS (SELECT document_id, page_number, count(*) AS n, md5(string_agg(block_type || ':' || coalesce(text, '-'), '|' ORDER BY block_id)) AS digest, count(*) FILTER (WHERE block_type = 'caption') AS t FROM blocks GROUP BY 1, 2)
SELECT document_id, page_number, coalesce(n, 0)::INTEGER AS n_blocks, coalesce(digest, md5('')) AS digest, coalesce(t, 0)::INTEGER AS n_tables, md5(ocr) AS ocr FROM b FULL JOIN o USING (document_id, page_number)"""
)
def extraction_results(spark, d):
    """The nested result, taken apart again by page; captions stand for tables."""
    t = table(spark, d, "page_block").where("block_id is not null").groupBy("block_id").agg(*(F.max(c).alias(c) for c in ("document_id", "page_number", "text", "block_type", "font_size", "font_name", "is_bold", "section_heading"))).withColumnRenamed("block_id", "block_pos")
    tables = t.where("block_type = 'caption'").select("document_id", "page_number", F.col("block_pos").alias("table_index"), F.col("text").alias("markdown"))
    pages = E.results(t, tables, table(spark, d, "ocr_result")).select("document_id", F.explode("pages").alias("p"))
    line = F.array_join(F.transform("p.blocks", lambda b: F.concat(b["block_type"], F.lit(":"), F.coalesce(b["text"], F.lit("-")))), "|")
    return pages.select("document_id", "p.page_number", F.size("p.blocks").alias("n_blocks"), F.md5(line).alias("digest"), F.size("p.tables").alias("n_tables"), F.md5("p.ocr_text").alias("ocr"))


# --- chunks ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {Q._CHUNKS}, p AS (SELECT id, max(page_number) AS page_number FROM app_chunk WHERE id IS NOT NULL GROUP BY 1), o AS (
  SELECT document_id, chunk_index, page_number, sum(CASE WHEN rn = 1 OR token_count >= 250 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY rn) AS island
  FROM (SELECT c.*, p.page_number, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS rn FROM chunks c JOIN p USING (id) WHERE content IS NOT NULL))
SELECT document_id::VARCHAR AS doc, min(chunk_index) AS pos, coalesce(max(page_number), -1) AS page_end FROM o GROUP BY document_id, island"""
)
def merged_page_end(spark, d):
    c = Q.chunks(spark, d, "document_id", "content", "chunk_index", "token_count", "page_number").where("content is not null").select(
        F.col("document_id").cast("string").alias("doc"), F.lit(0).alias("page"), F.struct("chunk_index", "id").alias("pos"), F.col("content").alias("text"), "token_count", F.col("page_number").alias("page_end"),
        F.lit(None).cast("string").alias("section_heading"), F.array(F.lit("text")).alias("block_types"), F.lit(0).alias("overlap_prev"), F.lit(False).alias("is_table"),
    )
    return K.merge_tiny(c, 250).select("doc", F.col("pos.chunk_index").alias("pos"), F.coalesce("page_end", F.lit(-1)).alias("page_end"))


@query(f"WITH {Q._MARKDOWN}, c AS (SELECT document_id, page_number, max(confidence) AS confidence FROM ocr_result GROUP BY 1, 2) SELECT document_id::VARCHAR AS doc, page_number AS page, page_number AS table_index, 'lattice' AS extractor, confidence, md5(markdown) AS digest FROM markdown JOIN c USING (document_id, page_number)")
def table_chunk_fields(spark, d):
    sure = table(spark, d, "ocr_result").groupBy("document_id", "page_number").agg(F.max("confidence").alias("confidence"))
    t = Q._line_tables(spark, d).join(sure, ["document_id", "page_number"]).select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), F.col("page_number").alias("table_index"), "markdown", F.lit(None).cast("string").alias("caption"), F.lit("lattice").alias("extractor"), "confidence")
    return K.table_chunks(t, 10_000_000).select("doc", "page", "table.table_index", "table.extractor", "table.confidence", F.md5("text").alias("digest"))


def _characters():
    """A tokenizer whose tokens are characters."""
    return (lambda t: [ord(c) for c in t]), (lambda ids: "".join(map(chr, ids)))


@query(f"WITH w AS (SELECT doc_id AS id, s, {_STRIP('substring(text, s + 1, 200)')} AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 150)) AS s FROM documents WHERE text IS NOT NULL AND text <> '')) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INTEGER AS chunk_index, md5(piece) AS digest FROM w WHERE piece <> ''")
def token_windows(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return K.token_windows(texts, _characters).select("id", "chunk_index", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {_STRIP('x')}), lambda x: x <> '')[1] AS first, len(list_filter(list_transform(string_split(text, '.'), lambda x: {_STRIP('x')}), lambda x: x <> ''))::INTEGER AS n FROM documents WHERE text IS NOT NULL")
def sentence_splitter_plug_in(spark, d):
    own = table(spark, d, "documents").where("text is not null").select("doc_id", K.split_by(F.col("text"), lambda: lambda t: t.split(".")).alias("s"))
    return own.select("doc_id", F.get("s", F.lit(0)).alias("first"), F.size("s").alias("n"))


# --- models and answers ---------------------------------------------------------------------------------------------


@query(f"WITH {Q._VECTORS}, s AS (SELECT id, list_sum(v) AS total, v[1] AS first FROM vectors) SELECT id, 384 AS dim, round(first, 5) AS first, round(total, 3) AS total FROM s")
def vector_literal(spark, d):
    """Vectors written as text and read back."""
    v = Q.vectors(spark, d).dropDuplicates(["id"]).select("id", F.from_json(F.to_json("embedding"), "array<float>").alias("v"))
    return v.select("id", F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def _sizes():
    """An embedder that counts characters and spaces."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("SELECT item_id, length(coalesce(prompt, ''))::DOUBLE AS characters, (length(coalesce(prompt, '')) - length(replace(coalesce(prompt, ''), ' ', '')))::DOUBLE AS spaces FROM eval_item")
def embed_plug_in(spark, d):
    v = table(spark, d, "eval_item").select("item_id", models.embed(F.col("prompt"), _sizes).alias("v"))
    return v.select("item_id", F.get("v", F.lit(0)).cast("double").alias("characters"), F.get("v", F.lit(1)).cast("double").alias("spaces"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN item_id::DOUBLE ELSE length(prompt)::DOUBLE END AS first FROM eval_item WHERE prompt IS NOT NULL")
def embed_through_cache(spark, d):
    """Every third prompt's vector is in the cache."""
    from .pipelines import embed_through_cache as through

    texts = table(spark, d, "eval_item").where("prompt is not null").select(F.col("item_id").alias("id"), F.col("prompt").alias("text"))
    now = F.lit("2024-01-01").cast("timestamp")
    known = texts.where("id % 3 = 0").select(C.cache_key("embedding", F.col("text")).alias("key"), F.concat(F.lit("["), F.col("id").cast("string"), F.lit(".0, 0.0]")).alias("value"))
    got = through(texts, C.entries(known, now, C.EMBEDDING_TTL), now, lambda t: models.embed(t, _sizes))
    return got.select(F.col("id").alias("item_id"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


def _lengths():
    """A scorer by the length of the content."""
    return lambda questions, contents: [float(len(c)) for c in contents]


@query(f"{Q._HITS} SELECT qid, id, place::INTEGER AS place FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY length(content) DESC, rank, id) AS place FROM hits) WHERE place <= 5")
def rerank_plug_in(spark, d):
    q, h = Q._hits(spark, d)
    return A.rerank(h, q, 5, lambda a, b: models.scored(a, b, _lengths)).select("qid", "id", "place")


_JUDGE = A.JUDGE.replace("'", "''")


@query(f"{Q._HITS}, {Q._LEX}, {Q._CONTEXT} SELECT q.qid, md5(replace(replace('{_JUDGE}', '{{answer}}', q.question), '{{context}}', c.context)) AS digest FROM questions q JOIN context c USING (qid)")
def judge_prompts(spark, d):
    q, h = Q._hits(spark, d)
    return A.judge_prompts(q.select("qid", F.col("question").alias("answer")), A.rerank(h, q)).select("qid", F.md5("prompt").alias("digest"))


def _replies():
    """A generator that says how long its prompt is, as a judge's JSON."""
    return lambda prompts: [f'{{"faithfulness": {len(p) % 10 / 10}, "reason": "{len(p)}"}}' for p in prompts]


@query(f"SELECT item_id, (n % 10)::DOUBLE / 10 AS score, n::VARCHAR AS reason FROM (SELECT item_id, length(replace(replace('{_JUDGE}', '{{answer}}', answer), '{{context}}', prompt)) AS n FROM eval_item WHERE prompt IS NOT NULL AND answer IS NOT NULL)")
def judge_plug_in(spark, d):
    own = table(spark, d, "eval_item").where("prompt is not null and answer is not null")
    return own.select("item_id", A.judged_by(_replies)(F.col("answer"), F.col("prompt")).alias("v")).select("item_id", "v.score", "v.reason")


@query("SELECT item_id, '{\"faithfulness\": ' || ((length(prompt) % 10)::DOUBLE / 10)::VARCHAR || ', \"reason\": \"' || length(prompt) || '\"}' AS reply FROM eval_item")
def generate_plug_in(spark, d):
    return table(spark, d, "eval_item").select("item_id", models.generated(F.col("prompt"), _replies).alias("reply"))


@query(f"SELECT h.qid, h.rank, h.id, h.distance, h.rrf_score, h.fts_rank, md5(c.content) AS digest FROM ({Q._DISPATCH}) h JOIN (SELECT id, max(content) AS content FROM app_chunk GROUP BY 1) c ON c.id = h.id WHERE h.keep")
def chat_sources(spark, d):
    """What the three modes keep, as the answer's sources."""
    kept = R.dispatch(Q.vectors(spark, d), Q.index(spark, d), Q.questions(spark, d)).where("keep").join(Q.chunks(spark, d, "content"), "id")
    rows = A.source_rows(kept).select("qid", F.explode("sources").alias("s"))
    return rows.select("qid", "s.rank", "s.id", "s.distance", "s.rrf_score", "s.fts_rank", F.md5("s.content").alias("digest"))
