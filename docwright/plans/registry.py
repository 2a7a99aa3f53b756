"""Every query of the engine by name, and the SQL that says the same.

Questions are the titles of the documents whose id is divisible by 100, each with the vector of its first piece; they are
asked against all pieces. Vector queries over `embeddings` are its rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..operators import cache as C
from ..operators import chunking as K
from ..operators import extraction as E
from ..operators import fulltext as X
from ..operators import retrieval as R
from ..operators import store as S
from ..operators import vector as V
from ..sources.readers import table
from . import chunk_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- relations that the queries share -------------------------------------------------------------------------------

_DOCS = "docs AS (SELECT id, max(title) AS title, max(content) AS content, max(source) AS source, max(page_count) AS page_count, max(extraction_status) AS extraction_status FROM app_document WHERE id IS NOT NULL GROUP BY id)"
_CHUNKS = "chunks AS (SELECT id, max(document_id) AS document_id, max(content) AS content, max(chunk_index) AS chunk_index, max(chunk_type) AS chunk_type, max(token_count) AS token_count FROM app_chunk WHERE id IS NOT NULL GROUP BY id)"
_VECTORS = "vectors AS (SELECT id, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM app_chunk WHERE len(embedding) = 384 GROUP BY id)"
_QUESTIONS = """questions AS (
  SELECT d.id AS qid, d.title AS question, min_by(v.v, v.id) AS qvec, 5 AS top_k, CASE (d.id // 100) % 4 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.9::DOUBLE END AS threshold,
         CASE (d.id // 100) % 4 WHEN 0 THEN 0.3::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS lim,
         CASE (d.id // 100) % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'semantic' ELSE 'keyword' END AS search_mode
  FROM docs d LEFT JOIN (SELECT c.document_id, v.id, v.v FROM chunks c JOIN vectors v ON v.id = c.id WHERE c.chunk_index = 0) v ON v.document_id = d.id
  WHERE d.id % 100 = 0 GROUP BY d.id, d.title)"""
_WORDS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_POSTINGS = rf"""raw AS (
  SELECT id, unnest(w) AS lexeme, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM chunks WHERE content IS NOT NULL)),
postings AS (SELECT * FROM raw WHERE lexeme NOT IN ({_WORDS})),
lex AS (
  SELECT qid, lexeme, count(*) OVER (PARTITION BY qid) AS needed FROM (
    SELECT DISTINCT qid, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS lexeme FROM questions) WHERE lexeme NOT IN ({_WORDS})),
found AS (SELECT l.qid, p.id, p.lexeme, p.pos, l.needed FROM lex l JOIN postings p USING (lexeme)),
hits AS (SELECT f.* FROM found f JOIN (SELECT qid, id FROM found GROUP BY qid, id, needed HAVING count(DISTINCT lexeme) = needed) m ON m.qid = f.qid AND m.id = f.id)"""
_RANK = """stops AS (SELECT DISTINCT qid, id, needed, pos AS stop FROM hits),
spans AS (
  SELECT s.qid, s.id, s.stop, min(l.last) AS start FROM stops s JOIN LATERAL (
    SELECT h.lexeme, max(h.pos) AS last FROM hits h WHERE h.qid = s.qid AND h.id = s.id AND h.pos <= s.stop GROUP BY h.lexeme) l ON true
  GROUP BY s.qid, s.id, s.stop, s.needed HAVING count(*) = s.needed),
covers AS (SELECT qid, id, start, min(stop) AS stop FROM spans GROUP BY qid, id, start),
ranked AS (
  SELECT c.qid, c.id, round(sum(0.1::DOUBLE / (1 + (c.stop - c.start) - (c.inside - 1))), 12) AS score FROM (
    SELECT c.*, (SELECT count(*) FROM hits h WHERE h.qid = c.qid AND h.id = c.id AND h.pos BETWEEN c.start AND c.stop) AS inside FROM covers c) c GROUP BY 1, 2)"""
_KEYWORD = "(SELECT r.qid, r.id, r.score, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, r.id) AS rank, q.top_k FROM ranked r JOIN questions q USING (qid))"
_SCORED = "scored AS (SELECT q.qid, v.id, round(list_cosine_distance(v.v, q.qvec), 12) AS distance, q.top_k, q.lim FROM questions q CROSS JOIN vectors v WHERE q.qvec IS NOT NULL)"
_NEAR = "(SELECT qid, id, CASE WHEN isnan(distance) THEN NULL ELSE distance END AS distance, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN isnan(distance) THEN NULL ELSE distance END NULLS LAST, id) AS rank, top_k, lim FROM scored)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "app_document").where("id is not null").groupBy("id").agg(*(F.max(c).alias(c) for c in ("title", "content", "source", "page_count", "extraction_status")))


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    columns = columns or ("document_id", "content", "chunk_index", "chunk_type", "token_count")
    return table(spark, d, "app_chunk").where("id is not null").groupBy("id").agg(*(F.max(c).alias(c) for c in columns))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "app_chunk").where("id is not null and size(embedding) = 384").select("id", "embedding")


def questions(spark: SparkSession, d: str) -> DataFrame:
    asked = docs(spark, d).select("id", "title").where("id % 100 = 0")
    first = table(spark, d, "app_chunk").where("id is not null and chunk_index = 0 and size(embedding) = 384 and document_id % 100 = 0").select("document_id", F.col("id").alias("chunk_id"), "embedding")
    own = first.groupBy("document_id").agg(F.min_by("embedding", "chunk_id").cast("array<double>").alias("qvec"))
    limit = F.expr("case (id div 100) % 4 when 0 then 0.3D when 1 then 0.0D when 2 then 0.9D end")
    mode = F.expr("case (id div 100) % 3 when 0 then 'hybrid' when 1 then 'semantic' else 'keyword' end")
    return asked.join(own, asked["id"] == own["document_id"], "left").select(F.col("id").alias("qid"), F.col("title").alias("question"), "qvec", F.lit(5).alias("top_k"), limit.alias("threshold"), mode.alias("search_mode"))


def index(spark: SparkSession, d: str, stem: bool = False) -> DataFrame:
    return X.tsvector(chunks(spark, d, "content"), stem)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    columns = ("document_id", "block_type", "text", "page_number", "font_size", "section_heading")
    return table(spark, d, "page_block").where("block_id is not null").groupBy("block_id").agg(*(F.max(c).alias(c) for c in columns))


_BLOCKS = "blocks AS (SELECT block_id, max(document_id) AS document_id, max(block_type) AS block_type, max(text) AS text, max(page_number) AS page_number, max(font_size) AS font_size, max(section_heading) AS section_heading FROM page_block WHERE block_id IS NOT NULL GROUP BY block_id)"


# --- store ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT id, title, source, page_count, length(content) AS n_chars FROM docs")
def scan_documents(spark, d):
    return docs(spark, d).select("id", "title", "source", "page_count", F.length("content").alias("n_chars"))


@query(f"WITH {_CHUNKS} SELECT id, document_id, chunk_index, chunk_type, length(content) AS n_chars FROM chunks")
def scan_chunks(spark, d):
    return chunks(spark, d).select("id", "document_id", "chunk_index", "chunk_type", F.length("content").alias("n_chars"))


_REQUESTS = "SELECT item_id AS qid, prompt AS question, (item_id % 25)::INTEGER AS top_k, CASE item_id % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'semantic' WHEN 2 THEN 'keyword' ELSE 'vector' END AS mode FROM eval_item"


@query(f"SELECT qid, CASE WHEN question IS NULL OR trim(question) = '' THEN 'blank question' WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k out of 1..20' WHEN mode NOT IN ('hybrid', 'semantic', 'keyword') THEN 'unknown mode' END AS problem FROM ({_REQUESTS})")
def validate_requests(spark, d):
    mode = F.expr("case item_id % 4 when 0 then 'hybrid' when 1 then 'semantic' when 2 then 'keyword' else 'vector' end")
    return table(spark, d, "eval_item").select(F.col("item_id").alias("qid"), S.problem(F.col("prompt"), (F.col("item_id") % 25).cast("int"), mode).alias("problem"))


@query(f"WITH {_DOCS}, {_CHUNKS} SELECT d.id, d.title, coalesce(c.n, 0)::INTEGER AS n_chunks, coalesce(c.ids, '') AS chunk_ids FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY chunk_index, id) AS ids FROM chunks GROUP BY 1) c ON c.document_id = d.id")
def document_with_chunks(spark, d):
    n = S.nested(docs(spark, d), chunks(spark, d))
    return n.select("id", "title", F.size("chunks").alias("n_chunks"), F.array_join(F.transform("chunks", lambda c: c["chunk_id"].cast("string")), ",").alias("chunk_ids"))


@query(f"WITH {_DOCS}, {_CHUNKS} SELECT d.id, title, source, page_count, extraction_status, coalesce(c.n, 0) AS chunk_count FROM docs d LEFT JOIN (SELECT document_id, count(DISTINCT id) AS n FROM chunks GROUP BY 1) c ON c.document_id = d.id")
def upload_summary(spark, d):
    return S.upload_summary(docs(spark, d), chunks(spark, d))


@query("SELECT doc_id AS id, source, 'pending' AS extraction_status, 0 AS n_scanned FROM documents")
def schema_evolution_defaults(spark, d):
    from ..schemas import DOCUMENT, conform

    old = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    return conform(old, DOCUMENT).select("id", "source", "extraction_status", F.size("scanned_pages").alias("n_scanned"))


@query("SELECT id, max_by(extraction_status, coalesce(updated_at, TIMESTAMP '0001-01-01')) AS extraction_status, max(updated_at) AS updated_at FROM app_document WHERE id IS NOT NULL GROUP BY id")
def latest_versions(spark, d):
    t = table(spark, d, "app_document")
    return S.latest(t, "id", "updated_at", "extraction_status", "updated_at").select("id", "extraction_status", F.col("updated_at"))


@query(r"SELECT document_id, max(file_hash_sha256) AS file_hash, max(lower(split_part(file_name, '__', 1))) AS site, bool_or(file_path LIKE '%.pdf') AS is_pdf, max(nullif(author, '')) AS author FROM pdf_metadata GROUP BY document_id")
def pdf_metadata_projection(spark, d):
    m = table(spark, d, "pdf_metadata")
    return m.groupBy("document_id").agg(F.max("file_hash_sha256").alias("file_hash"), F.max(F.lower(F.substring_index("file_name", "__", 1))).alias("site"), F.bool_or(F.col("file_path").endswith(".pdf")).alias("is_pdf"), F.max(F.nullif("author", F.lit(""))).alias("author"))


# --- scalar text ----------------------------------------------------------------------------------------------------


@query(f"WITH {_CHUNKS} SELECT id, greatest(1, length(content) // 4)::INTEGER AS tokens FROM chunks WHERE content IS NOT NULL")
def approx_tokens(spark, d):
    return chunks(spark, d).where("content is not null").select("id", T.approx_tokens(F.col("content")).alias("tokens"))


@query(
    rf"""SELECT doc_id, len(s)::INTEGER AS n_sentences, md5(array_to_string(s, chr(1))) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\f\r]+([A-Z])', concat('\1', chr(2), '\2'), 'g'), '([.!?])[ \t\n\f\r]+([A-Z])', concat('\1', chr(2), '\2'), 'g'), chr(2)),
    lambda x: regexp_replace(x, '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)"""
)
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "\x01")).alias("digest"))


@query(f"WITH {_BLOCKS} SELECT block_id, length(t)::INTEGER AS n, md5(t) AS digest FROM (SELECT block_id, regexp_replace(text, '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g') AS t FROM blocks) WHERE t <> ''")
def strip_nonblank(spark, d):
    t = T.strip(F.col("text"))
    return blocks(spark, d).where(T.not_blank(F.col("text"))).select("block_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


@query(
    f"WITH {_CHUNKS} SELECT id, regexp_replace(substring(sha256(concat(document_id, '::', chunk_index, '::', substring(content, 1, 200))), 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') AS chunk_id FROM chunks WHERE content IS NOT NULL"
)
def chunk_id_uuid(spark, d):
    return chunks(spark, d).where("content is not null").select("id", T.chunk_uuid(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"))


@query("SELECT item_id, concat('response:', md5(concat(prompt, '::', 'hybrid'))) AS response_key, concat('embedding:', md5(prompt)) AS embedding_key FROM eval_item WHERE prompt IS NOT NULL")
def cache_key_md5(spark, d):
    return table(spark, d, "eval_item").where("prompt is not null").select("item_id", C.response_key(F.col("prompt"), F.lit("hybrid")).alias("response_key"), T.cache_key("embedding", F.col("prompt")).alias("embedding_key"))


@query(
    rf"""SELECT ocr_id, line_no, regexp_matches(regexp_replace(regexp_replace(line, '[,%]', '', 'g'), '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g'), '^(?i)[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)$') AS is_number
FROM (SELECT ocr_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10)))))::INTEGER AS line_no FROM (SELECT ocr_id, max(text) AS t FROM ocr_result GROUP BY 1))"""
)
def is_numeric_cell(spark, d):
    pages = table(spark, d, "ocr_result").groupBy("ocr_id").agg(F.max("text").alias("t"))
    return pages.select("ocr_id", F.posexplode(F.split("t", "\n")).alias("line_no", "line")).select("ocr_id", "line_no", T.is_numeric(F.col("line")).alias("is_number"))


@query(
    """WITH t AS (SELECT id, max(created_at) AS made FROM app_document WHERE id IS NOT NULL GROUP BY id)
SELECT 'document' AS kind, id, CASE (id % 4) WHEN 0 THEN strftime(made, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(made, '%Y-%m-%dT%H:%M:%S') || '+05:30' WHEN 2 THEN strftime(made, '%Y-%m-%dT00:00:00') ELSE strftime(made, '%Y') END AS iso FROM t
UNION ALL SELECT 'metadata', document_id, max(creation_date) FROM pdf_metadata WHERE document_id IS NOT NULL GROUP BY document_id"""
)
def pdf_date_parse(spark, d):
    """All three written forms and a year alone, made from time stamps; and the metadata's own dates, which come through as they are."""
    t = table(spark, d, "app_document").where("id is not null").groupBy("id").agg(F.max("created_at").alias("at"))
    raw = F.expr("concat('D:', case id % 4 when 0 then date_format(at, 'yyyyMMddHHmmss') when 1 then concat(date_format(at, 'yyyyMMddHHmmss'), \"+05'30'\") when 2 then date_format(at, 'yyyyMMdd') else date_format(at, 'yyyy') end)")
    m = table(spark, d, "pdf_metadata").where("document_id is not null").groupBy("document_id").agg(F.max("creation_date").alias("raw"))
    own = t.select(F.lit("document").alias("kind"), "id", raw.alias("raw")).unionByName(m.select(F.lit("metadata").alias("kind"), F.col("document_id").alias("id"), "raw"))
    return own.select("kind", "id", T.pdf_date(F.col("raw")).alias("iso"))


# --- chunkers -------------------------------------------------------------------------------------------------------


@query(
    r"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
cut AS (SELECT id, w, unnest(range(0, len(w), 150)) AS s FROM w WHERE len(w) > 0)
SELECT id, (s // 150)::INTEGER AS chunk_index, md5(array_to_string(w[s + 1:s + 200], ' ')) AS digest FROM cut"""
)
def sliding_window_chunks(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return K.sliding_windows(texts).select("id", "chunk_index", F.md5("text").alias("digest"))


def _pages(spark, d):
    b = blocks(spark, d)
    return K.pages(b.select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), F.col("block_id").alias("pos"), "block_type", "text", "section_heading"))


def _packed(spark, d, strategy):
    return K.finalise(K.merge_tiny(K.pack(_pages(spark, d), strategy))).select("doc", "page", "chunk_index", "total_chunks", "chunk_id", "text", "token_count", "section_heading", F.array_join("block_types", ",").alias("block_types"), "overlap_prev", "overlap_next")


@query(chunk_sql.SENTENCE_AWARE)
def sentence_aware_chunks(spark, d):
    return _packed(spark, d, "sentence_aware")


@query(chunk_sql.PARAGRAPH)
def paragraph_chunks(spark, d):
    return _packed(spark, d, "paragraph")


@query(chunk_sql.FIXED_TOKEN)
def fixed_token_chunks(spark, d):
    return _packed(spark, d, "fixed_token")


@query(chunk_sql.DISPATCHER)
def chunk_dispatcher(spark, d):
    b = blocks(spark, d).select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), F.col("block_id").alias("pos"), "block_type", "text", "section_heading")
    ocr = table(spark, d, "ocr_result").select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), "text")
    tables = _line_tables(spark, d).select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), F.lit(0).alias("table_index"), "markdown", F.lit(None).cast("string").alias("caption"))
    out = K.chunk_documents(b, ocr, tables)
    return out.select("doc", "page", "chunk_index", "chunk_type", "total_chunks", "chunk_id", "text", "token_count")


@query(
    f"""WITH {_CHUNKS}, o AS (
  SELECT document_id, chunk_index, id, content, token_count, sum(CASE WHEN rn = 1 OR token_count >= 250 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY rn) AS island
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS rn FROM chunks WHERE content IS NOT NULL)),
m AS (SELECT document_id, island, min(chunk_index) AS first_index, count(*) AS merged, string_agg(content, ' ' ORDER BY chunk_index, id) AS text, any_value(token_count) AS own FROM o GROUP BY 1, 2)
SELECT document_id::VARCHAR AS doc, first_index AS pos, md5(text) AS digest, (CASE WHEN merged = 1 THEN own ELSE greatest(1, length(text) // 4) END)::INTEGER AS token_count FROM m"""
)
def merge_tiny(spark, d):
    c = chunks(spark, d).where("content is not null").select(
        F.col("document_id").cast("string").alias("doc"), F.lit(0).alias("page"), F.struct("chunk_index", "id").alias("pos"), F.col("content").alias("text"), "token_count",
        F.lit(None).cast("string").alias("section_heading"), F.array(F.lit("text")).alias("block_types"), F.lit(0).alias("overlap_prev"), F.lit(False).alias("is_table"),
    )
    return K.merge_tiny(c, 250).select("doc", F.col("pos.chunk_index").alias("pos"), F.md5("text").alias("digest"), "token_count")


@query(
    f"""WITH {_CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS total FROM chunks)
SELECT id, i::INTEGER AS chunk_index, total AS total_chunks FROM n"""
)
def finalise_chunks(spark, d):
    c = chunks(spark, d).select(F.col("document_id").alias("doc"), F.lit(0).alias("page"), F.struct("chunk_index", "id").alias("pos"), "id", F.col("content").alias("text"), F.lit(0).alias("overlap_prev"), F.lit(False).alias("is_table"))
    return K.finalise(c).select("id", "chunk_index", "total_chunks")


def _cells(spark, d):
    """Pages as tables: each line a row, its words the cells, rows filled up to the widest. The data have no tables of their own."""
    pages = table(spark, d, "ocr_result").groupBy("document_id", "page_number").agg(F.max("text").alias("text"))
    words = pages.select("document_id", "page_number", F.transform(F.split("text", "\n"), lambda line: F.split(line, " ")).alias("w")).withColumn("widest", F.array_max(F.transform("w", F.size)))
    return words.select("document_id", "page_number", F.transform("w", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("widest") - F.size(r)))).alias("cells"))


def _line_tables(spark, d):
    return _cells(spark, d).where(E.big_enough(F.col("cells"))).select("document_id", "page_number", E.markdown(F.col("cells")).alias("markdown"))


_NUMERIC = r"^(?i)[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)$"
_MARKDOWN = rf"""lines AS (SELECT document_id, page_number, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10)))))::INTEGER AS r FROM (SELECT document_id, page_number, max(text) AS t FROM ocr_result GROUP BY 1, 2)),
sized AS (SELECT document_id, page_number, count(*) AS n, max(len(string_split(line, ' '))) AS widest, max(CASE WHEN r = 0 THEN len(string_split(line, ' ')) END) AS head FROM lines GROUP BY 1, 2),
cells AS (
  SELECT l.document_id, l.page_number, l.r, c.c, regexp_replace(coalesce(string_split(line, ' ')[c.c + 1], ''), '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g') AS cell
  FROM lines l JOIN sized s USING (document_id, page_number), LATERAL (SELECT unnest(range(s.widest))::INTEGER AS c) c WHERE s.n >= 2 AND s.widest >= 2),
heads AS (
  SELECT document_id, page_number, count(*) FILTER (WHERE cell <> '' AND NOT regexp_matches(regexp_replace(regexp_replace(cell, '[,%]', '', 'g'), '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g'), '{_NUMERIC}')) >= count(*) * 0.5 AS is_head
  FROM cells WHERE r = 0 GROUP BY 1, 2),
every AS (
  SELECT * FROM cells UNION ALL
  SELECT c.document_id, c.page_number, -1, c.c, 'col_' || c.c FROM cells c JOIN heads h USING (document_id, page_number) WHERE c.r = 0 AND NOT h.is_head),
widths AS (SELECT document_id, page_number, c, max(length(cell)) AS w FROM every GROUP BY 1, 2, 3),
drawn AS (
  SELECT document_id, page_number, r::DOUBLE AS r, '| ' || string_agg(cell || repeat(' ', w - length(cell)), ' | ' ORDER BY c) || ' |' AS line FROM every JOIN widths USING (document_id, page_number, c) GROUP BY 1, 2, 3
  UNION ALL SELECT document_id, page_number, CASE WHEN h.is_head THEN 0.5 ELSE -0.5 END, '| ' || string_agg(repeat('-', w), ' | ' ORDER BY c) || ' |' FROM widths JOIN heads h USING (document_id, page_number) GROUP BY 1, 2, 3),
markdown AS (SELECT document_id, page_number, string_agg(line, chr(10) ORDER BY r) AS markdown FROM drawn GROUP BY 1, 2)"""


@query(
    f"""WITH RECURSIVE {_MARKDOWN},
whole AS (SELECT *, greatest(1, length(markdown) // 4) <= 100 AS small FROM markdown),
ls AS (SELECT document_id, page_number, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10)))))::INTEGER AS i FROM whole WHERE NOT small),
head AS (SELECT document_id, page_number, string_agg(line, chr(10) ORDER BY i) AS head FROM ls WHERE i < 2 GROUP BY 1, 2),
items AS (SELECT l.document_id, l.page_number, i - 1 AS r, line, greatest(1, length(line) // 4)::BIGINT AS w, 100 - greatest(1, length(head) // 4) AS room FROM ls l JOIN head USING (document_id, page_number) WHERE i >= 2),
packed AS (
  SELECT document_id, page_number, r, 1 AS grp, w AS total FROM items WHERE r = 1
  UNION ALL SELECT i.document_id, i.page_number, i.r, CASE WHEN p.total + i.w > i.room THEN p.grp + 1 ELSE p.grp END, CASE WHEN p.total + i.w > i.room THEN i.w ELSE p.total + i.w END
  FROM packed p JOIN items i ON i.document_id = p.document_id AND i.page_number = p.page_number AND i.r = p.r + 1),
parts AS (
  SELECT p.document_id, p.page_number, (grp - 1)::INTEGER AS pos, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY r) AS text FROM packed p JOIN items USING (document_id, page_number, r) JOIN head USING (document_id, page_number) GROUP BY 1, 2, 3
  UNION ALL SELECT document_id, page_number, 0, markdown FROM whole WHERE small)
SELECT document_id::VARCHAR AS doc, page_number AS page, pos, text, greatest(1, length(text) // 4)::INTEGER AS token_count FROM parts"""
)
def table_chunks(spark, d):
    t = _line_tables(spark, d).select(F.col("document_id").alias("doc"), F.col("page_number").alias("page"), F.lit(0).alias("table_index"), "markdown", F.lit(None).cast("string").alias("caption"))
    return K.table_chunks(t, 100).select("doc", "page", "pos", "text", "token_count")


@query(f"WITH {_CHUNKS} SELECT id, CASE WHEN token_count >= 390 THEN 'table' WHEN chunk_type = 'ocr' THEN 'ocr' ELSE 'text' END AS kind FROM chunks")
def chunk_type_projection(spark, d):
    return chunks(spark, d).select("id", K.chunk_type(F.col("token_count") >= 390, F.array("chunk_type")).alias("kind"))


# --- vectors --------------------------------------------------------------------------------------------------------

_V64 = "vectors AS (SELECT vec_id AS id, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS v, any_value(label) AS label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1)"
_TOP64 = f"WITH {_V64}, scored AS (SELECT q.id AS qid, v.id, round(list_cosine_distance(v.v, q.v), 12) AS distance FROM vectors q CROSS JOIN vectors v WHERE q.id % 100 = 0), near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM scored)"


def v64(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def q64(spark, d, k=10):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("qvec"), F.lit(k).alias("top_k"))


@query(_TOP64 + " SELECT qid, id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM near WHERE rank <= 10")
def semantic_topk(spark, d):
    return V.exact_topk(v64(spark, d), q64(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_V64} SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM vectors")
def l2_normalise(spark, d):
    return v64(spark, d).select("id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(V.l2_normalised(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query(f"WITH {_V64}, q AS (SELECT v AS qv FROM vectors WHERE id = 0) SELECT id, round(list_cosine_distance(v, qv), 6) AS distance FROM vectors, q")
def cosine_distance_all(spark, d):
    one = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return v64(spark, d).select("id", F.round(V.cosine_distance(F.col("embedding"), F.lit([float(x) for x in one[0]])), 6).alias("distance"))


@query(f"WITH {_DOCS}, {_CHUNKS}, {_VECTORS}, {_QUESTIONS}, {_SCORED} SELECT qid, id, rank::INTEGER AS rank, round(distance, 6) AS distance, coalesce(distance <= lim, false) AS keep FROM {_NEAR} WHERE rank <= top_k")
def multi_query_topk(spark, d):
    return R.semantic_hits(vectors(spark, d), questions(spark, d)).select("qid", "id", "rank", F.round("distance", 6).alias("distance"), "keep")


@query(
    f"WITH {_DOCS}, {_CHUNKS}, {_VECTORS}, {_QUESTIONS}, {_SCORED}, top AS (SELECT * FROM {_NEAR} WHERE rank <= top_k) SELECT q.qid, count(t.id) FILTER (WHERE coalesce(t.distance <= t.lim, false)) AS kept, count(t.id) FILTER (WHERE NOT coalesce(t.distance <= t.lim, false)) AS filtered_count FROM questions q LEFT JOIN top t ON t.qid = q.qid GROUP BY q.qid"
)
def threshold_filtered_count(spark, d):
    q = questions(spark, d)
    return R.filtered_count(R.semantic_hits(vectors(spark, d), q), q)


@query()
def ivf_assign(spark, d):
    v = v64(spark, d)
    return V.ivf_assign(v, V.ivf_fit(v)).select("id", "list_id")


def _ivf(spark, d):
    """The inverted file of all vectors, its centroids, and as many probes as reach the recall."""
    v = v64(spark, d)
    c = V.ivf_fit(v)
    a = V.ivf_assign(v, c)
    return a, c, V.ivf_probes(a, c)


@query()
def ivf_probe_topk(spark, d):
    a, c, probes = _ivf(spark, d)
    return V.ivf_topk(a, c, q64(spark, d), probes).withColumn("distance", F.round("distance", 6))


@query()
def ivf_recall_at_k(spark, d):
    (a, c, probes), q = _ivf(spark, d), q64(spark, d)
    exact = V.exact_topk(v64(spark, d), q).select("qid", "id")
    got = V.ivf_topk(a, c, q, probes).select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(got, ["qid", "id"], "left").groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


_LISTS = f"""WITH {_V64},
parts AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM vectors) GROUP BY 1, 2),
centres AS (SELECT label AS list_id, list(x ORDER BY i) AS c FROM parts GROUP BY 1),
placed AS (SELECT v.id, v.v, c.list_id, row_number() OVER (PARTITION BY v.id ORDER BY round(1 - list_cosine_similarity(v.v, c.c), 12), c.list_id) AS nth FROM vectors v CROSS JOIN centres c)"""


def _label_lists(spark, d):
    """An index whose centroids are given: the mean vector of each label."""
    t = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").dropDuplicates(["vec_id"])
    means = t.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid")).select(F.col("label").cast("int").alias("list_id"), "centroid")
    return V.ivf_assign(v64(spark, d), c), c


@query(_LISTS + " SELECT id, list_id::INTEGER AS list_id FROM placed WHERE nth = 1")
def ivf_label_assign(spark, d):
    return _label_lists(spark, d)[0].select("id", "list_id")


@query(_LISTS + """, probes AS (SELECT id AS qid, v AS q, list_id FROM placed WHERE id % 100 = 0 AND nth <= 3),
near AS (SELECT p.qid, v.id, round(list_cosine_distance(v.v, p.q), 12) AS distance, row_number() OVER (PARTITION BY p.qid ORDER BY round(list_cosine_distance(v.v, p.q), 12), v.id) AS rank FROM probes p JOIN placed v ON v.list_id = p.list_id AND v.nth = 1)
SELECT qid, id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM near WHERE rank <= 10""")
def ivf_label_topk(spark, d):
    a, c = _label_lists(spark, d)
    return V.ivf_topk(a, c, q64(spark, d)).withColumn("distance", F.round("distance", 6))


@query(_LISTS + """, probes AS (SELECT id AS qid, v AS q, list_id FROM placed WHERE id % 100 = 0 AND nth <= 3),
near AS (SELECT p.qid, v.id, row_number() OVER (PARTITION BY p.qid ORDER BY round(list_cosine_distance(v.v, p.q), 12), v.id) AS rank FROM probes p JOIN placed v ON v.list_id = p.list_id AND v.nth = 1),
exact AS (SELECT q.id AS qid, v.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_distance(v.v, q.v), 12), v.id) AS rank FROM vectors q CROSS JOIN vectors v WHERE q.id % 100 = 0)
SELECT e.qid, round(avg(CASE WHEN n.id IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM (SELECT * FROM exact WHERE rank <= 10) e LEFT JOIN (SELECT * FROM near WHERE rank <= 10) n ON n.qid = e.qid AND n.id = e.id GROUP BY 1""")
def ivf_label_recall(spark, d):
    (a, c), q = _label_lists(spark, d), q64(spark, d)
    got = V.ivf_topk(a, c, q).select("qid", "id", F.lit(1).alias("hit"))
    return V.exact_topk(v64(spark, d), q).select("qid", "id").join(got, ["qid", "id"], "left").groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


# --- full text ------------------------------------------------------------------------------------------------------

_TEXT = f"WITH {_DOCS}, {_CHUNKS}, {_VECTORS}, {_QUESTIONS}, {_POSTINGS}"


@query(_TEXT + " SELECT id, lexeme, count(*) AS places, min(pos)::INTEGER AS first_pos FROM postings GROUP BY 1, 2")
def tsvector_postings(spark, d):
    return X.postings(chunks(spark, d, "content")).groupBy("id", "lexeme").agg(F.count("*").alias("places"), F.min("pos").alias("first_pos"))


@query(_TEXT + " SELECT qid, lexeme, needed FROM lex")
def plain_query_lexemes(spark, d):
    return X.query_lexemes(questions(spark, d))


@query(_TEXT + " SELECT DISTINCT qid, id FROM hits")
def fts_match(spark, d):
    return X.match(index(spark, d), questions(spark, d))


@query(_TEXT + f", {_RANK} SELECT qid, id, round(score, 6) AS score FROM ranked")
def fts_rank_cd(spark, d):
    return X.rank_cd(index(spark, d), questions(spark, d)).withColumn("score", F.round("score", 6))


@query(_TEXT + f", {_RANK} SELECT qid, id, round(score, 6) AS score, rank::INTEGER AS rank FROM {_KEYWORD} WHERE rank <= top_k")
def keyword_topk(spark, d):
    return X.keyword_topk(index(spark, d), questions(spark, d)).withColumn("score", F.round("score", 6))


@query()
def keyword_topk_stemmed(spark, d):
    return X.keyword_topk(index(spark, d, True), questions(spark, d), True).withColumn("score", F.round("score", 6))


# --- fusion and modes -----------------------------------------------------------------------------------------------


def _fused(size: int, k: int) -> str:
    return f"""{_TEXT}, {_RANK}, {_SCORED},
sem AS (SELECT qid, id, distance, rank FROM {_NEAR} WHERE rank <= {size} AND distance <= lim),
sem2 AS (SELECT * FROM sem),
kw AS (SELECT qid, id, score, rank FROM {_KEYWORD} WHERE rank <= {size}),
fused AS (SELECT qid, id, s.distance, k.score, s.rank AS sr, k.rank AS kr, coalesce(0.7::DOUBLE / (60 + s.rank), 0::DOUBLE) + coalesce(0.3::DOUBLE / (60 + k.rank), 0::DOUBLE) AS rrf FROM sem2 s FULL OUTER JOIN kw k USING (qid, id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, sr NULLS LAST, kr NULLS LAST, id) AS rank FROM fused)
SELECT qid, id, rank::INTEGER AS rank, round(rrf, 6) AS rrf_score, rrf >= 0.002::DOUBLE AS keep FROM placed WHERE rank <= {k}"""


@query(_fused(20, 5))
def hybrid_topk(spark, d):
    h = R.hybrid_hits(vectors(spark, d), index(spark, d), questions(spark, d))
    return h.select("qid", "id", "rank", F.round("rrf_score", 6).alias("rrf_score"), "keep")


@query(_fused(400, 100))
def rrf_floor_large_k(spark, d):
    h = R.hybrid_hits(vectors(spark, d), index(spark, d), questions(spark, d).withColumn("top_k", F.lit(100)))
    return h.select("qid", "id", "rank", F.round("rrf_score", 6).alias("rrf_score"), "keep")


def _modes(k: int) -> str:
    """The three modes' rows, k a question."""
    return f"""SELECT qid, id, rank::INTEGER AS rank, round(distance, 4) AS distance, NULL::DOUBLE AS rrf_score, NULL::DOUBLE AS fts_rank, coalesce(distance <= lim, false) AS keep FROM {_NEAR} JOIN (SELECT qid, search_mode FROM questions) USING (qid) WHERE rank <= {k} AND search_mode = 'semantic'
UNION ALL SELECT qid, id, rank::INTEGER, NULL, NULL, round(score, 6), true FROM {_KEYWORD} JOIN (SELECT qid, search_mode FROM questions) USING (qid) WHERE rank <= {k} AND search_mode = 'keyword'
UNION ALL SELECT qid, id, rank, distance, rrf_score, fts_rank, keep FROM (
  WITH sem AS (SELECT qid, id, distance, rank FROM {_NEAR} WHERE rank <= {4 * k} AND distance <= lim), kw AS (SELECT qid, id, score, rank FROM {_KEYWORD} WHERE rank <= {4 * k}),
  fused AS (SELECT qid, id, s.distance, k.score, s.rank AS sr, k.rank AS kr, coalesce(0.7::DOUBLE / (60 + s.rank), 0::DOUBLE) + coalesce(0.3::DOUBLE / (60 + k.rank), 0::DOUBLE) AS rrf FROM sem s FULL OUTER JOIN kw k USING (qid, id))
  SELECT f.qid, f.id, row_number() OVER (PARTITION BY f.qid ORDER BY rrf DESC, sr NULLS LAST, kr NULLS LAST, id)::INTEGER AS rank, round(distance, 4) AS distance, round(rrf, 6) AS rrf_score, round(score, 6) AS fts_rank, rrf >= 0.002::DOUBLE AS keep
  FROM fused f JOIN questions q ON q.qid = f.qid WHERE q.search_mode = 'hybrid') WHERE rank <= {k}"""


_DISPATCH = f"{_TEXT}, {_RANK}, {_SCORED} {_modes(5)}"


@query(_DISPATCH)
def search_mode_dispatch(spark, d):
    return R.dispatch(vectors(spark, d), index(spark, d), questions(spark, d))


@query(f"SELECT q.qid, count(*) FILTER (WHERE h.keep) AS kept, count(*) FILTER (WHERE NOT h.keep) AS filtered_count FROM (SELECT id AS qid FROM app_document WHERE id % 100 = 0 GROUP BY 1) q LEFT JOIN ({_DISPATCH}) h ON h.qid = q.qid GROUP BY 1")
def filtered_count_by_mode(spark, d):
    q = questions(spark, d)
    return R.filtered_count(R.dispatch(vectors(spark, d), index(spark, d), q), q)


@query(
    f"{_TEXT}, {_RANK} SELECT k.qid, k.id, k.rank::INTEGER AS rank, c.chunk_index, d.title AS document_title FROM {_KEYWORD} k JOIN chunks c ON c.id = k.id JOIN docs d ON d.id = c.document_id WHERE k.rank <= k.top_k"
)
def results_with_sources(spark, d):
    top = X.keyword_topk(index(spark, d), questions(spark, d))
    return R.with_sources(top, chunks(spark, d), docs(spark, d)).select("qid", "id", "rank", "chunk_index", "document_title")


# --- answers --------------------------------------------------------------------------------------------------------


def _hits(spark, d):
    """Twenty nearest pieces of every question, with their texts."""
    q = questions(spark, d)
    top = V.exact_topk(vectors(spark, d), q.withColumn("top_k", F.lit(20)))
    return q, top.join(chunks(spark, d, "content"), "id").select("qid", "id", "content", "rank")


_HITS = f"WITH {_DOCS}, {_CHUNKS}, {_VECTORS}, {_QUESTIONS}, {_SCORED}, hits AS (SELECT n.qid, n.id, c.content, n.rank FROM {_NEAR} n JOIN chunks c ON c.id = n.id WHERE n.rank <= 20)"
_LEX = r"""lexical AS (SELECT h.*, CASE WHEN len(qw) = 0 THEN 0::DOUBLE ELSE round(len(list_intersect(qw, cw))::DOUBLE / len(qw), 6) END AS score FROM (
  SELECT h.*, list_distinct(regexp_extract_all(lower(q.question), '[\p{L}\p{N}]+')) AS qw, list_distinct(regexp_extract_all(lower(h.content), '[\p{L}\p{N}]+')) AS cw FROM hits h JOIN questions q USING (qid)) h),
best AS (SELECT * FROM (SELECT qid, id, content, rank, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, id) AS place FROM lexical) WHERE place <= 5)"""


@query(f"{_HITS}, {_LEX} SELECT qid, id, score, place::INTEGER AS place FROM best")
def rerank_lexical(spark, d):
    q, h = _hits(spark, d)
    return A.rerank(h, q).select("qid", "id", "score", "place")


@query(f"{_HITS}, {_LEX} SELECT h.qid, h.id, h.rank::INTEGER AS rank FROM hits h WHERE EXISTS (SELECT 1 FROM best b WHERE b.qid = h.qid AND b.content = h.content)")
def source_selection_semi(spark, d):
    q, h = _hits(spark, d)
    return A.sources(h, A.rerank(h, q)).select("qid", "id", "rank")


_CONTEXT = "context AS (SELECT qid, string_agg('[' || place || '] ' || content, chr(10) || chr(10) ORDER BY place) AS context FROM best GROUP BY qid)"
_ASK = A.ASK.replace("'", "''")


@query(f"{_HITS}, {_LEX}, {_CONTEXT} SELECT q.qid, md5(replace(replace('{_ASK}', '{{question}}', q.question), '{{context}}', c.context)) AS digest FROM questions q JOIN context c USING (qid)")
def build_prompt(spark, d):
    q, h = _hits(spark, d)
    return A.prompts(q, A.rerank(h, q)).select("qid", F.md5("prompt").alias("digest"))


@query(
    f"{_HITS}, {_LEX}, {_CONTEXT} SELECT q.qid, CASE WHEN len(a) = 0 THEN 0::DOUBLE ELSE round(len(list_intersect(a, b))::DOUBLE / len(a), 6) END AS score FROM (SELECT q.qid, list_distinct(regexp_extract_all(lower(q.question), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(c.context), '[\\p{{L}}\\p{{N}}]+')) AS b FROM questions q JOIN context c USING (qid)) q"
)
def faithfulness_lexical(spark, d):
    q, h = _hits(spark, d)
    return q.select("qid", "question").join(A.contexts(A.rerank(h, q)), "qid").select("qid", A.faithfulness(F.col("question"), F.col("context")).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE WHEN event_id % 5 = 1 THEN 0::DOUBLE ELSE round(value, 6) END AS score, CASE WHEN event_id % 5 = 0 THEN 'parse error' WHEN event_id % 5 = 2 THEN event_type ELSE '' END AS reason FROM events")
def faithfulness_json_parse(spark, d):
    reply = F.expr("case event_id % 5 when 0 then concat('```json ', event_type) when 1 then '{}' when 2 then to_json(named_struct('faithfulness', value, 'reason', event_type)) else to_json(named_struct('faithfulness', value)) end")
    v = A.parse_verdict(reply)
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", F.round("v.score", 6).alias("score"), F.col("v.reason").alias("reason"))


@query(f"SELECT event_id, CASE WHEN value < 0.5::DOUBLE THEN '{A.NOT_SUPPORTED}' ELSE event_type END AS answer FROM events")
def faithfulness_gate(spark, d):
    return table(spark, d, "events").select("event_id", A.gate(F.col("event_type"), F.col("value")).alias("answer"))


@query(_TEXT + f" SELECT q.qid, CASE WHEN h.qid IS NULL THEN '{A.NOTHING_FOUND}' ELSE q.question END AS answer, h.qid IS NOT NULL AS cacheable FROM questions q LEFT JOIN (SELECT DISTINCT qid FROM hits) h USING (qid)")
def empty_answer_shortcut(spark, d):
    q = questions(spark, d)
    hit = X.match(index(spark, d), q).select("qid").distinct().join(q.select("qid", F.col("question").alias("answer")), "qid")
    return A.with_fallback(q, hit)


# --- extraction -----------------------------------------------------------------------------------------------------

_TYPED = rf"""typed AS (SELECT b.*, CASE WHEN t = '' THEN 'paragraph' WHEN font_size >= body * 1.15::DOUBLE THEN 'heading' WHEN regexp_matches(t, '^(\d+\.|[•·▪▸◦\-])\s') THEN 'list_item'
  WHEN length(t) < 80 AND t NOT LIKE '%.' AND t NOT LIKE '%…' AND font_size < body THEN 'caption' ELSE 'paragraph' END AS kind
  FROM (SELECT b.*, f.body, regexp_replace(coalesce(b.text, ''), '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g') AS t FROM blocks b JOIN font f USING (document_id, page_number)) b)"""
_FONT = """font AS (SELECT document_id, page_number, s AS body FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY n DESC, first_at) AS r FROM (
  SELECT document_id, page_number, round(font_size::VARCHAR::DECIMAL(28, 17), 1)::DOUBLE AS s, sum(length(coalesce(text, ''))) AS n, min(block_id) AS first_at FROM blocks WHERE font_size IS NOT NULL GROUP BY 1, 2, 3)) WHERE r = 1)"""


def _spans(spark, d):
    """A block as one span: the data hold no finer ones."""
    b = blocks(spark, d)
    return b.select("document_id", "page_number", F.col("block_id").alias("block_pos"), F.lit(0).alias("pos"), "text", F.col("font_size").alias("size"), F.lit(0).alias("flags"), F.lit("").alias("font"), F.lit(0).alias("type"))


@query(f"WITH {_BLOCKS}, {_FONT} SELECT document_id, page_number, body AS body_size FROM font")
def body_font_mode(spark, d):
    return E.body_font(_spans(spark, d))


@query(f"WITH {_BLOCKS}, {_FONT}, {_TYPED} SELECT block_id, kind FROM typed")
def classify_blocks(spark, d):
    b = blocks(spark, d).join(E.body_font(_spans(spark, d)), ["document_id", "page_number"])
    return b.select("block_id", E.classify(F.col("font_size"), F.col("body_size"), F.col("text")).alias("kind"))


@query(
    rf"""WITH b AS (SELECT block_id, max(text) AS text, bool_or(is_bold) AS bold, max(font_name) AS font, max(font_size) AS size FROM page_block WHERE block_id IS NOT NULL GROUP BY 1),
spans AS (SELECT block_id, bold, font, size, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS i FROM b WHERE text IS NOT NULL),
real AS (SELECT *, CASE WHEN (block_id + i) % 3 = 0 THEN '' ELSE font || i END AS f FROM spans WHERE regexp_replace(line, '[{T.WHITE}]+', '', 'g') <> '')
SELECT block_id, md5(regexp_replace(regexp_replace(string_agg(line, ' ' ORDER BY i), '[ \t\n\f\r\x0b]+', ' ', 'g'), '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g')) AS digest, bool_or(coalesce(bold, false) AND i % 2 = 0) AS is_bold,
       arg_min(f, i) FILTER (WHERE f <> '') AS font_name, round(avg(size + i), 6) AS font_size FROM real GROUP BY 1"""
)
def build_blocks(spark, d):
    """Blocks from spans: every line of a block is a span, every other one bold where the block is, every third without a font."""
    t = table(spark, d, "page_block").where("block_id is not null").groupBy("block_id").agg(*(F.max(c).alias(c) for c in ("document_id", "page_number", "text", "is_bold", "font_name", "font_size")))
    spans = t.select("document_id", "page_number", F.col("block_id").alias("block_pos"), "is_bold", "font_name", "font_size", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    flags = F.when(F.col("is_bold") & (F.col("pos") % 2 == 0), 16).otherwise(0)
    font = F.when((F.col("block_pos") + F.col("pos")) % 3 == 0, "").otherwise(F.concat("font_name", F.col("pos").cast("string")))
    own = spans.select("document_id", "page_number", "block_pos", "pos", "text", (F.col("font_size") + F.col("pos")).alias("size"), flags.alias("flags"), font.alias("font"), F.lit(0).alias("type"))
    return E.blocks(own).select(F.col("block_pos").alias("block_id"), F.md5("text").alias("digest"), "is_bold", "font_name", F.round("font_size", 6).alias("font_size"))


@query(f"WITH {_BLOCKS} SELECT block_id, CASE WHEN block_type <> 'heading' THEN last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY block_id) END AS heading FROM blocks")
def heading_forward_fill(spark, d):
    return E.forward_headings(blocks(spark, d).drop("section_heading"), "block_id").select("block_id", F.col("section_heading").alias("heading"))


@query(f"WITH {_BLOCKS} SELECT document_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_number, block_id)) AS digest FROM blocks WHERE text IS NOT NULL GROUP BY 1")
def assemble_full_text(spark, d):
    return E.full_text(blocks(spark, d), "block_id").select("document_id", F.md5("full_text").alias("digest"))


@query(f"WITH {_BLOCKS} SELECT document_id, page_number, sum(length(regexp_replace(coalesce(text, ''), '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g')))::BIGINT AS chars, sum(length(regexp_replace(coalesce(text, ''), '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g'))) < 100 AS is_scanned FROM blocks GROUP BY 1, 2")
def scanned_pages(spark, d):
    return E.scanned_pages(blocks(spark, d))


@query(f"WITH {_MARKDOWN} SELECT * FROM markdown")
def table_markdown(spark, d):
    return _line_tables(spark, d)


@query(
    f"WITH {_BLOCKS}, p AS (SELECT DISTINCT document_id, page_number FROM (SELECT document_id, page_number FROM blocks UNION ALL SELECT document_id, page_number FROM ocr_result)), o AS (SELECT document_id, page_number, max_by(text, ocr_id) AS t FROM ocr_result GROUP BY 1, 2), h AS (SELECT document_id, page_number, count(DISTINCT block_id) AS n FROM blocks WHERE block_type = 'heading' GROUP BY 1, 2) SELECT document_id, page_number, coalesce(h.n, 0)::INTEGER AS n_tables, md5(o.t) AS ocr_digest FROM p LEFT JOIN o USING (document_id, page_number) LEFT JOIN h USING (document_id, page_number)"
)
def tables_per_page_left_join(spark, d):
    b, ocr = blocks(spark, d), table(spark, d, "ocr_result")
    pages = b.select("document_id", "page_number").unionByName(ocr.select("document_id", "page_number"))
    stand_in = b.where("block_type = 'heading'").select("document_id", "page_number", F.col("block_id").cast("int").alias("table_index"), F.col("text").alias("markdown"))
    return E.assemble_pages(pages, stand_in, ocr).select("document_id", "page_number", F.size("tables").alias("n_tables"), F.md5("ocr_text").alias("ocr_digest"))


@query("SELECT document_id, nullif(round(round(avg(confidence) FILTER (WHERE confidence >= 0), 9), 1), 0) AS confidence FROM (SELECT DISTINCT ocr_id, document_id, confidence FROM ocr_result) GROUP BY 1")
def ocr_confidence(spark, d):
    pages = table(spark, d, "ocr_result").select("ocr_id", "document_id", "confidence").distinct()
    return pages.groupBy("document_id").agg(E.word_confidence(F.collect_list("confidence")).alias("confidence"))


# --- caches and limits ----------------------------------------------------------------------------------------------

_NOW = "2020-06-01 12:00:00"


def _cache(spark, d):
    """Events as cache entries: one key a user and type, the value is the event's number."""
    e = table(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, "response:").otherwise("embedding:"), F.md5(F.concat_ws("::", F.col("user_id").cast("string"), "event_type"))).alias("key"), F.col("event_id").cast("string").alias("value"), "ts")
    return e.withColumn("expires_at", F.col("ts") + F.expr(f"make_dt_interval(0, 0, 0, {C.RESPONSE_TTL})")).drop("ts")


_CACHE = "cache AS (SELECT concat(CASE WHEN event_id % 2 = 0 THEN 'response:' ELSE 'embedding:' END, md5(concat(user_id, '::', event_type))) AS key, event_id::VARCHAR AS value, ts + INTERVAL 3600 SECOND AS expires_at FROM events), clock AS (SELECT max(ts) - INTERVAL 1800 SECOND AS now FROM events)"


def _clock(spark, d):
    return F.lit(table(spark, d, "events").agg(F.max("ts") - F.expr("make_dt_interval(0, 0, 0, 1800)")).first()[0])


@query(f"WITH {_CACHE}, newest AS (SELECT key, max_by(value, expires_at) AS value FROM cache, clock WHERE expires_at > now GROUP BY 1), r AS (SELECT DISTINCT key FROM cache) SELECT r.key, n.value, n.value IS NOT NULL AS hit FROM r LEFT JOIN newest n USING (key)")
def cache_aside_hits(spark, d):
    c = _cache(spark, d)
    return C.lookup(c.select("key").distinct(), c, _clock(spark, d)).select("key", "value", "hit")


@query(f"WITH {_CACHE} SELECT key, value FROM cache, clock WHERE expires_at > now")
def cache_ttl_expiry(spark, d):
    return C.live(_cache(spark, d), _clock(spark, d)).select("key", "value")


@query(f"WITH {_CACHE} SELECT key, value FROM cache WHERE NOT starts_with(key, 'response:')")
def cache_invalidate_prefix(spark, d):
    return C.invalidate(_cache(spark, d)).select("key", "value")


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests, greatest(count(*) - 10, 0) AS rejected FROM events GROUP BY 1, 2")
def rate_limit_per_minute(spark, d):
    return C.over_limit(table(spark, d, "events"))


# --- whole paths ----------------------------------------------------------------------------------------------------


@query()
def answer_path(spark, d):
    """Every third question is in the cache, every sixth was but is too old."""
    return _answers(spark, d)


def _first_sentence(x: str) -> str:
    cut = rf"regexp_replace({x}, '([.!?])[ \t\n\f\r]+([A-Z])', concat('\1', chr(2), '\2'), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda z: regexp_replace(z, '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g')), lambda z: z <> '')[1]"


@query(
    f"""{_TEXT}, {_RANK}, {_SCORED}, fetched AS ({_modes(20)}),
kept AS (SELECT f.qid, f.id, c.content, f.rank FROM fetched f JOIN chunks c ON c.id = f.id WHERE f.keep), {_LEX.replace('hits h', 'kept h')}, {_CONTEXT},
said AS (SELECT b.qid, {_first_sentence("b.content")} AS raw, c.context FROM best b JOIN context c USING (qid) WHERE b.place = 1),
words AS (SELECT qid, raw, list_distinct(regexp_extract_all(lower(raw), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(context), '[\\p{{L}}\\p{{N}}]+')) AS b FROM said),
judged AS (SELECT qid, raw, CASE WHEN len(a) = 0 THEN 0::DOUBLE ELSE round(len(list_intersect(a, b))::DOUBLE / len(a), 6) END AS score FROM words),
sources AS (SELECT h.qid, count(*) AS n FROM kept h WHERE EXISTS (SELECT 1 FROM best b WHERE b.qid = h.qid AND b.content = h.content) GROUP BY 1),
dropped AS (SELECT qid, count(*) FILTER (WHERE NOT keep) AS n FROM fetched GROUP BY 1),
known AS (SELECT qid, (qid // 100) % 3 = 0 AND (qid // 100) % 6 <> 0 AS held FROM questions)
SELECT q.qid, CASE WHEN held THEN 'known: ' || question WHEN j.qid IS NULL THEN '{A.NOTHING_FOUND}' WHEN j.score < 0.5 THEN '{A.NOT_SUPPORTED}' ELSE j.raw END AS answer, CASE WHEN NOT held AND j.qid IS NOT NULL THEN j.score ELSE -1 END AS score,
       CASE WHEN held THEN 0 ELSE coalesce(s.n, 0) END AS n_sources, CASE WHEN held THEN -1 ELSE coalesce(d.n, 0) END AS filtered_count, held AS from_cache, NOT held AND j.qid IS NOT NULL AS cacheable
FROM questions q JOIN known k USING (qid) LEFT JOIN judged j USING (qid) LEFT JOIN sources s USING (qid) LEFT JOIN dropped d USING (qid)"""
)
def answer_path_plain(spark, d):
    """The same without stemming, which SQL lacks; -1 where an answer from the cache has no score or count."""
    return _answers(spark, d, False).withColumns({"score": F.coalesce("score", F.lit(-1.0)), "filtered_count": F.coalesce("filtered_count", F.lit(-1)), "n_sources": F.greatest("n_sources", F.lit(0))})


def _answers(spark, d, stem=True):
    from .pipelines import answer_questions

    c = chunks(spark, d, "content").join(vectors(spark, d).dropDuplicates(["id"]), "id", "left")
    q, now = questions(spark, d), F.lit("2020-01-01").cast("timestamp")
    asked = q.where("(qid div 100) % 3 = 0").select(C.response_key(F.col("question"), F.col("search_mode")).alias("key"), F.concat(F.lit("known: "), "question").alias("value"), (now + F.expr("make_dt_interval(0, 0, 0, case when (qid div 100) % 6 = 0 then -1 else 60 end)")).alias("expires_at"))
    return answer_questions(q, c, asked, now, stem=stem).select("qid", "answer", "score", F.size(F.coalesce("sources", F.array())).alias("n_sources"), "filtered_count", "from_cache", "cacheable")


@query(
    r"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
cut AS (SELECT id, w, unnest(range(0, len(w), 150)) AS s FROM w WHERE len(w) > 0)
SELECT id AS document_id, (s // 150)::INTEGER AS chunk_index, md5(array_to_string(w[s + 1:s + 200], ' ')) AS digest, 'text' AS chunk_type, 384 AS dim, 1 AS length FROM cut"""
)
def ingest_text_path(spark, d):
    """Each chunk's vector has 384 numbers and the length 1 (or 0, without a word)."""
    from .pipelines import ingest_texts

    rows = ingest_texts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    length = F.round(V.norm(F.col("embedding")), 4)
    return rows.select("document_id", "chunk_index", F.md5("content").alias("digest"), "chunk_type", F.size("embedding").alias("dim"), F.when(F.size(T.tokens(F.col("content"))) == 0, 1).otherwise(length).cast("int").alias("length"))


@query()
def ingest_pdf_path(spark, d):
    from .pipelines import ingest_pages

    cells = _cells(spark, d).select("document_id", "page_number", F.lit(0).alias("table_index"), "cells", F.lit(None).cast("double").alias("confidence"))
    out = ingest_pages(_spans(spark, d), cells, table(spark, d, "ocr_result").select("document_id", "page_number", "text"))
    return out.select("id", "document_id", "chunk_index", "chunk_type", "content", "page_number")


from . import pieces  # noqa: E402, F401 - registers its queries
