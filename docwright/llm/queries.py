"""The pN_ queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, encoding, leakage, neardup, neighbours, ocr, sentences, splitting, truncation
from .common import WHITE, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "page_block"), table(spark, d, "pdf_metadata"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "page_block")
    return boilerplate.without_lines(blocks, boilerplate.repeated_lines(blocks, table(spark, d, "pdf_metadata")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "app_document"), table(spark, d, "app_chunk"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "app_document")).select("document_id", "chunk_index", "content", "overlap_tokens_prev").distinct()


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    return splitting.checked(table(spark, d, "app_document"))


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    return splitting.audit(table(spark, d, "app_chunk"), table(spark, d, "app_document"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.noise(table(spark, d, "ocr_result"))


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repaired(table(spark, d, "ocr_result"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expanded(*neardup.similar(neardup.both_kinds(table(spark, d, "app_document"), table(spark, d, "app_chunk"))))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs, _ = neardup.similar(neardup.both_kinds(table(spark, d, "app_document"), table(spark, d, "app_chunk")))
    return pairs.withColumnRenamed("kind", "record_kind")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return neardup.membership(neardup.both_kinds(table(spark, d, "app_document"), table(spark, d, "app_chunk")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(table(spark, d, "app_chunk")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "page_block")
    texts = sentences.both_kinds(table(spark, d, "app_document"), blocks)
    return sentences.sentence_units(sentences.with_notices(texts, blocks, table(spark, d, "pdf_metadata")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_paraphrased(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrased(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p9_proofs(spark: SparkSession, d: str) -> DataFrame:
    return truncation.proofs(table(spark, d, "documents"))


def p9_spikes(spark: SparkSession, d: str) -> DataFrame:
    """What the length histograms and terminal punctuation alone tell, without the structure of commits and the last words."""
    return truncation.proofs(table(spark, d, "documents")).where("spike").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_found, p1_clean, p2_found, p2_pieces, p2_checked, p2_audit, p3_found, p3_text, p4_found, p4_pairs, p4_members, p5_found, p6_found, p7_ids, p8_found, p8_paraphrased, p9_found, p9_proofs, p9_spikes, p9_rates)
    return {f.__name__: f for f in made}


_LINES = r"""
sites AS (
  SELECT b.document_id, coalesce(max(m.site), max(lower(b.site)), '') AS site
  FROM page_block b LEFT JOIN (
    SELECT document_id, max(lower(split_part(file_name, '__', 1))) AS site FROM pdf_metadata WHERE contains(file_name, '__') GROUP BY 1
  ) m USING (document_id) GROUP BY 1),
lines AS (
  SELECT block_id, document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no FROM page_block),
keyed AS (
  SELECT block_id, document_id, line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS k FROM lines WHERE regexp_matches(line, '\p{L}')),
often AS (
  SELECT s.site, k.k, count(DISTINCT k.document_id) AS n FROM keyed k JOIN sites s USING (document_id) GROUP BY 1, 2),
totals AS (SELECT site, count(*) AS total FROM sites GROUP BY 1)
"""

_P1 = f"""WITH {_LINES}
SELECT DISTINCT k.block_id, k.line_no FROM keyed k JOIN sites s USING (document_id) JOIN often o ON o.site = s.site AND o.k = k.k
JOIN totals t ON t.site = s.site WHERE o.n >= 8 AND o.n >= t.total * 0.05::DOUBLE - 1e-9"""

_P4 = f"""WITH records AS (
  SELECT DISTINCT 'document' AS kind, id, content FROM app_document WHERE content IS NOT NULL
  UNION ALL SELECT DISTINCT 'chunk', id, content FROM app_chunk WHERE content IS NOT NULL),
texts AS (
  SELECT kind, id, regexp_replace(regexp_replace(lower(content), '[{WHITE}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM records),
runs AS (
  SELECT DISTINCT kind, id, hash(unnest(list_transform(range(1, length(t) - 14), lambda i: substring(t, i, 16)))) AS h FROM texts WHERE length(t) >= 800),
sizes AS (SELECT kind, id, count(*) AS n FROM runs GROUP BY 1, 2),
common AS (
  SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS both FROM runs a JOIN runs b ON a.kind = b.kind AND a.h = b.h AND a.id < b.id GROUP BY 1, 2, 3)
SELECT c.kind AS record_kind, id_a, id_b FROM common c JOIN sizes x ON x.kind = c.kind AND x.id = id_a JOIN sizes y ON y.kind = c.kind AND y.id = id_b
WHERE c.both >= 0.6::DOUBLE * (x.n + y.n - c.both) - 1e-9"""

_P1_CLEAN = f"""WITH {_LINES},
gone AS (SELECT k.block_id, list(DISTINCT k.line_no) AS gone FROM keyed k JOIN sites s USING (document_id) JOIN often o ON o.site = s.site AND o.k = k.k JOIN totals t ON t.site = s.site WHERE o.n >= 8 AND o.n >= t.total * 0.05::DOUBLE - 1e-9 GROUP BY 1),
once AS (SELECT block_id, max(text) AS text FROM page_block GROUP BY 1)
SELECT block_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, (i - 1)::INTEGER)), chr(10)) END AS text FROM once LEFT JOIN gone USING (block_id)"""

_P2_CHECKED = f"""SELECT id AS document_id, md5(regexp_replace(max(content), '[{WHITE}]+', '', 'g')) AS digest, true AS within, true AS few_shared, true AS numbered
FROM app_document WHERE id IS NOT NULL AND regexp_replace(content, '[{WHITE}]+', '', 'g') <> '' GROUP BY id"""

_WORD = r"regexp_matches({0}, '^[\p{{L}}\p{{N}}]$') AND NOT regexp_matches({0}, '^[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}]$')"
_P2_AUDIT = f"""WITH stored AS (SELECT DISTINCT document_id, chunk_index, content, overlap_tokens_prev, chunk_type FROM app_chunk WHERE document_id IS NOT NULL AND chunk_index IS NOT NULL AND content <> ''),
text AS (SELECT * FROM stored WHERE chunk_type = 'text'), docs AS (SELECT id AS document_id, max(content) AS whole FROM app_document WHERE content IS NOT NULL GROUP BY 1),
placed AS (SELECT t.document_id, t.chunk_index, content, whole, strpos(whole, content) AS place FROM text t JOIN docs USING (document_id)),
edges AS (SELECT *, CASE WHEN place > 1 THEN substring(whole, place - 1, 1) ELSE '' END AS a, left(content, 1) AS b, right(content, 1) AS c, substring(whole, place + length(content), 1) AS e FROM placed WHERE place > 0),
pairs AS (SELECT t.document_id, t.chunk_index, t.overlap_tokens_prev, coalesce(list_max(list_filter(range(1, least(length(p.content), length(t.content)) + 1), lambda n: right(p.content, n) = left(t.content, n))), 0) AS n
  FROM text t JOIN stored p ON p.document_id = t.document_id AND p.chunk_index + 1 = t.chunk_index)
SELECT DISTINCT document_id, chunk_index, 'cut_in_word' AS kind FROM edges WHERE ({_WORD.format("a")} AND {_WORD.format("b")}) OR ({_WORD.format("c")} AND {_WORD.format("e")})
UNION ALL SELECT DISTINCT document_id, chunk_index, 'wrong_overlap' FROM pairs WHERE overlap_tokens_prev IS DISTINCT FROM (CASE WHEN n = 0 THEN 0 ELSE greatest(1, n // 4) END)"""

_P4_CLASSES = _P4.split("\nSELECT c.kind")[0] + """,
same AS (SELECT kind, t, min(id) AS class_id FROM texts WHERE length(t) >= 800 GROUP BY 1, 2),
alike AS (
  SELECT c.kind, id_a, id_b FROM common c JOIN sizes x ON x.kind = c.kind AND x.id = id_a JOIN sizes y ON y.kind = c.kind AND y.id = id_b JOIN same p ON p.kind = c.kind AND p.class_id = id_a JOIN same q ON q.kind = c.kind AND q.class_id = id_b
  WHERE c.both >= 0.6::DOUBLE * (x.n + y.n - c.both) - 1e-9)
"""
_P4_PAIRS = _P4_CLASSES + "SELECT kind AS record_kind, id_a, id_b FROM alike"
_P4_MEMBERS = _P4_CLASSES + """SELECT t.kind AS record_kind, t.id, s.class_id, coalesce(l.n, 0) AS links FROM texts t JOIN same s USING (kind, t)
LEFT JOIN (SELECT kind, id, count(*) AS n FROM (SELECT kind, id_a AS id FROM alike UNION ALL SELECT kind, id_b FROM alike) GROUP BY 1, 2) l ON l.kind = t.kind AND l.id = s.class_id"""

_P8 = r"""WITH texts AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM (SELECT item_id, prompt AS t FROM eval_item UNION ALL SELECT item_id, answer FROM eval_item) WHERE t IS NOT NULL),
grams AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM items WHERE len(w) >= 12),
held AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM texts WHERE len(w) >= 12)
SELECT DISTINCT h.id AS doc_id, g.item_id FROM held h JOIN grams g USING (g)"""


_P9_SPIKES = rf"""WITH t AS (SELECT DISTINCT doc_id, coalesce(source, '') AS source, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND regexp_replace(text, '[{WHITE}]+', '', 'g') <> ''),
d AS (SELECT DISTINCT source, text FROM t),
lengths AS (SELECT source, 'chars' AS unit, length(text) AS n FROM d UNION ALL SELECT source, 'bytes', strlen(text) FROM d),
counted AS (SELECT source, unit, n, count(*) AS k, CASE unit WHEN 'bytes' THEN 3 ELSE 0 END AS slack FROM lengths GROUP BY ALL),
tops AS (SELECT source, unit, max(n) AS most FROM counted GROUP BY 1, 2),
peaks AS (SELECT source, unit, arg_max(n, k * 1000000000 + n) AS top, max(k) AS height FROM counted JOIN tops USING (source, unit) WHERE n >= most - 8 GROUP BY 1, 2),
tested AS (SELECT source, unit, top, height, slack, sum(CASE WHEN n >= top - slack THEN k ELSE 0 END) AS here, sum(CASE WHEN n < top - slack AND n >= top * 0.9::DOUBLE THEN k ELSE 0 END) AS near FROM counted JOIN peaks USING (source, unit) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY height DESC, unit DESC, top DESC) AS r FROM tested WHERE here >= 5 AND here >= near * (slack + 1) / (top * 0.1::DOUBLE) * 8) WHERE r = 1),
ended AS (SELECT doc_id, source, text, regexp_replace(regexp_replace(text, '[{WHITE}]+$', ''), '["''”’»)\]」』]+$', '') AS tail FROM t)
SELECT DISTINCT doc_id FROM ended JOIN best USING (source) WHERE CASE unit WHEN 'chars' THEN length(text) ELSE strlen(text) END >= top - slack AND NOT (regexp_matches(tail, '[.!?。！？｡।॥؟]$') AND NOT ends_with(tail, '...'))"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_clean": _P1_CLEAN, "p2_checked": _P2_CHECKED, "p2_audit": _P2_AUDIT, "p4_found": _P4, "p4_pairs": _P4_PAIRS, "p4_members": _P4_MEMBERS, "p8_found": _P8, "p9_spikes": _P9_SPIKES}
