"""The greedy chunkers said in SQL: one recursion packs, a second carries the text that overlaps."""

from __future__ import annotations

from ..functions.text import WHITE


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def _sentences(x: str) -> str:
    cut = rf"regexp_replace({x}, '([.!?])[ \t\n\f\r]+([A-Z])', concat('\1', chr(2), '\2'), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda z: {_strip('z')}), lambda z: z <> '')"


def _weight(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def _tail(close: str) -> str:
    """The last pieces of `full_text`, at most 243 characters with their ends closed."""
    pieces = f"list_transform(list_reverse(string_split(f.full_text, '. ')), lambda z: z || {close})"
    count = f"len(list_filter(range(1, len({pieces}) + 1), lambda i: list_sum(list_transform(({pieces})[1:i], lambda z: length(z))) <= 243))"
    return f"coalesce(array_to_string(list_reverse(({pieces})[1:{count}]), ''), '')"


_BLOCKS = f"""blocks AS (SELECT block_id, max(document_id) AS doc, max(page_number) AS page, max(block_type) AS block_type, {_strip("coalesce(max(text), '')")} AS t, nullif(max(section_heading), '') AS section_heading FROM page_block WHERE block_id IS NOT NULL GROUP BY block_id)"""

_MERGED = f"""numbered AS (SELECT *, sum(CASE WHEN first OR token_count >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY grp) AS island FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY grp) = 1 AS first FROM made)),
merged AS (
  SELECT doc, page, min(grp) AS pos, string_agg(text, ' ' ORDER BY grp) AS text, count(*) AS n, min_by(token_count, grp) AS own, min_by(overlap_prev, grp) AS overlap_prev,
         arg_min(section_heading, grp) FILTER (WHERE section_heading IS NOT NULL AND section_heading <> '') AS section_heading, list_sort(list_distinct(flatten(list(kinds)))) AS kinds
  FROM numbered GROUP BY doc, page, island),
final AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, pos) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc) AS total_chunks, coalesce(lead(overlap_prev) OVER (PARTITION BY doc ORDER BY page, pos), 0) AS overlap_next FROM merged)
SELECT doc::VARCHAR AS doc, page, chunk_index::INTEGER AS chunk_index, total_chunks,
       regexp_replace(substring(sha256(concat(doc, '::', chunk_index, '::', substring(text, 1, 200))), 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') AS chunk_id,
       text, (CASE WHEN n = 1 THEN own ELSE {_weight("text")} END)::INTEGER AS token_count, section_heading, array_to_string(kinds, ',') AS block_types, overlap_prev::INTEGER AS overlap_prev, overlap_next::INTEGER AS overlap_next
FROM final"""

_PACK = """packed AS (
  SELECT doc, page, r, 1 AS grp, w::BIGINT AS total FROM items WHERE r = 1
  UNION ALL
  SELECT i.doc, i.page, i.r, CASE WHEN i.opens OR p.total + i.w > 400 THEN p.grp + 1 ELSE p.grp END, (CASE WHEN i.opens OR p.total + i.w > 400 THEN i.w ELSE p.total + i.w END)::BIGINT
  FROM packed p JOIN items i ON i.doc = p.doc AND i.page = p.page AND i.r = p.r + 1)"""

SENTENCE_AWARE = f"""WITH RECURSIVE {_BLOCKS},
real AS (SELECT *, last_value(CASE WHEN block_type = 'heading' THEN t END IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY block_id) AS heading FROM blocks WHERE t <> ''),
cut AS (SELECT doc, page, block_id, block_type, CASE WHEN block_type <> 'heading' THEN coalesce(section_heading, heading) END AS hdg, CASE WHEN block_type = 'heading' THEN [t] ELSE {_sentences("t")} END AS ss FROM real),
flat AS (SELECT doc, page, block_id, block_type, hdg, unnest(ss) AS sent, unnest(range(len(ss))) AS k FROM cut),
items AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY block_id, k) AS r, {_weight("sent")} AS w, block_type = 'heading' AS opens FROM flat),
{_PACK},
groups AS (
  SELECT doc, page, grp, string_agg(sent, ' ' ORDER BY r) AS body, arg_max(hdg, r) FILTER (WHERE hdg IS NOT NULL) AS section_heading, list_sort(list(DISTINCT block_type)) AS kinds
  FROM packed JOIN items USING (doc, page, r) GROUP BY doc, page, grp),
chained AS (
  SELECT doc, page, grp, {_strip("body")} AS full_text, 0::BIGINT AS overlap_prev FROM groups WHERE grp = 1
  UNION ALL
  SELECT doc, page, grp, {_strip("prefix || body")}, (CASE WHEN prefix <> '' THEN {_weight("prefix")} ELSE 0 END)::BIGINT
  FROM (SELECT doc, page, grp, body, CASE WHEN run <> '' THEN run || ' ' ELSE '' END AS prefix FROM (
    SELECT g.doc, g.page, g.grp, g.body, {_strip(_tail("CASE WHEN z LIKE '%.' THEN ' ' ELSE '. ' END"))} AS run FROM chained f JOIN groups g ON g.doc = f.doc AND g.page = f.page AND g.grp = f.grp + 1))),
made AS (SELECT c.doc, c.page, c.grp, full_text AS text, {_weight("full_text")} AS token_count, g.section_heading, g.kinds, c.overlap_prev FROM chained c JOIN groups g USING (doc, page, grp)),
{_MERGED}"""

FIXED_TOKEN = f"""WITH RECURSIVE {_BLOCKS},
texts AS (SELECT doc, page, string_agg(t, ' ' ORDER BY block_id) FILTER (WHERE t <> '') AS t, arg_min(section_heading, block_id) FILTER (WHERE section_heading IS NOT NULL) AS section_heading, list_sort(list(DISTINCT block_type)) AS kinds FROM blocks GROUP BY doc, page),
cut AS (SELECT doc, page, {_sentences("t")} AS ss FROM texts WHERE t IS NOT NULL),
flat AS (SELECT doc, page, unnest(ss) AS sent, unnest(range(1, len(ss) + 1)) AS r FROM cut),
items AS (SELECT *, {_weight("sent")} AS w, false AS opens FROM flat),
{_PACK},
groups AS (SELECT doc, page, grp, string_agg(sent, ' ' ORDER BY r) AS body, max(grp) OVER (PARTITION BY doc, page) AS last FROM packed JOIN items USING (doc, page, r) GROUP BY doc, page, grp),
chained AS (
  SELECT doc, page, grp, {_strip("body")} AS full_text, 0::BIGINT AS overlap_prev FROM groups WHERE grp = 1
  UNION ALL
  SELECT doc, page, grp, {_strip("CASE WHEN bare <> '' THEN bare || ' ' ELSE '' END || body")}, (CASE WHEN inner_one THEN {_weight("run")} ELSE 0 END)::BIGINT
  FROM (SELECT *, {_strip("run")} AS bare FROM (SELECT g.doc, g.page, g.grp, g.body, g.grp < g.last AS inner_one, CASE WHEN g.grp < g.last THEN {_tail("'. '")} ELSE '' END AS run FROM chained f JOIN groups g ON g.doc = f.doc AND g.page = f.page AND g.grp = f.grp + 1))),
made AS (SELECT c.doc, c.page, c.grp, full_text AS text, {_weight("full_text")} AS token_count, t.section_heading, t.kinds, c.overlap_prev FROM chained c JOIN texts t USING (doc, page)),
{_MERGED}"""

PARAGRAPH = f"""WITH RECURSIVE {_BLOCKS},
items AS (
  SELECT doc, page, block_type, t, row_number() OVER (PARTITION BY doc, page ORDER BY block_id) AS r, {_weight("t")} AS w, block_type = 'heading' AS opens,
         last_value(CASE WHEN block_type = 'heading' THEN t END IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY block_id) AS heading FROM blocks WHERE t <> ''),
packed AS (
  SELECT doc, page, r, 1 AS grp, length(t)::BIGINT + 1 AS size FROM items WHERE r = 1
  UNION ALL
  SELECT i.doc, i.page, i.r, CASE WHEN i.opens OR greatest(1, p.size // 4) + i.w > 400 THEN p.grp + 1 ELSE p.grp END, (CASE WHEN i.opens OR greatest(1, p.size // 4) + i.w > 400 THEN 0 ELSE p.size END + length(i.t) + 1)::BIGINT
  FROM packed p JOIN items i ON i.doc = p.doc AND i.page = p.page AND i.r = p.r + 1),
made AS (
  SELECT doc, page, grp, string_agg(t, chr(10) ORDER BY r) AS text, greatest(1, max(size) // 4) AS token_count, arg_max(heading, r) FILTER (WHERE heading IS NOT NULL) AS section_heading, list_sort(list(DISTINCT block_type)) AS kinds, 0 AS overlap_prev
  FROM packed JOIN items USING (doc, page, r) GROUP BY doc, page, grp),
{_MERGED}"""

_OCR_BLOCKS = f"""blocks AS (
  SELECT document_id AS doc, page_number AS page, 0 AS block_id, 'ocr' AS block_type, {_strip("text")} AS t, NULL::VARCHAR AS section_heading FROM (SELECT document_id, page_number, max(text) AS text FROM ocr_result WHERE text <> '' GROUP BY 1, 2) o
  WHERE NOT EXISTS (SELECT 1 FROM page_block b WHERE b.document_id = o.document_id AND b.page_number = o.page_number AND b.block_id IS NOT NULL))"""


def _made(whole: str) -> str:
    """A chunker's SQL up to its chunks before merging."""
    return whole.removesuffix(_MERGED).rstrip().removesuffix(",") + " SELECT doc, page, grp, text, token_count, section_heading, kinds, overlap_prev FROM made"


#: Every table of these data stands on a page that has OCR text and no blocks, where the dispatcher takes no tables.
DISPATCHER = f"""SELECT doc, page, chunk_index, CASE WHEN list_contains(string_split(block_types, ','), 'ocr') THEN 'ocr' ELSE 'text' END AS chunk_type, total_chunks, chunk_id, text, token_count FROM (
WITH made AS (SELECT * FROM ({_made(SENTENCE_AWARE)}) UNION ALL SELECT * FROM ({_made(FIXED_TOKEN).replace(_BLOCKS, _OCR_BLOCKS)})),
{_MERGED})"""
