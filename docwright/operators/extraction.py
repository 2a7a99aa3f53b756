"""Structure of extracted pages: block types, headings, full text, scanned pages, tables, OCR confidence.

Spans: one row a text span (schemas.SPAN). Null texts are empty. Ties of a page's font sizes go to the size seen first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_numeric, let, not_blank, strip

#: Fixed values of the extraction contract.
HEADING_RATIO, CAPTION_LENGTH, SCANNED_BELOW, BODY_DEFAULT, BOLD_FLAG = 1.15, 80, 100, 11.0, 16
LIST_ITEM = r"^(\d+\.|[•·▪▸◦\-])\s"


def body_font(spans: DataFrame) -> DataFrame:
    """(document_id, page_number, body_size): the size with the most characters, sizes rounded to a tenth."""
    text = spans.where("coalesce(type, 0) = 0 and size is not null").select("document_id", "page_number", F.round("size", 1).alias("s"), F.length(F.coalesce("text", F.lit(""))).alias("n"), F.struct("block_pos", "pos").alias("at"))
    sizes = text.groupBy("document_id", "page_number", "s").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    first = Window.partitionBy("document_id", "page_number").orderBy(F.desc("n"), "at")
    return sizes.withColumn("r", F.row_number().over(first)).where("r = 1").select("document_id", "page_number", F.col("s").alias("body_size"))


def classify(size: Column, body: Column, text: Column) -> Column:
    """heading, list_item, caption or paragraph, in this order of proof."""
    t = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "paragraph")
        .when(size >= body * HEADING_RATIO, "heading")
        .when(t.rlike(LIST_ITEM), "list_item")
        .when((F.length(t) < CAPTION_LENGTH) & ~F.endswith(t, F.lit(".")) & ~F.endswith(t, F.lit("…")) & (size < body), "caption")
        .otherwise("paragraph")
    )


def blocks(spans: DataFrame) -> DataFrame:
    """(document_id, page_number, block_pos, text, font_size, is_bold, font_name, block_type, section_heading) from text spans."""
    real = spans.where("coalesce(type, 0) = 0").where(not_blank(F.col("text")))
    joined = real.groupBy("document_id", "page_number", "block_pos").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.avg("size").alias("font_size"),
        F.bool_or(F.col("flags").bitwiseAND(BOLD_FLAG) > 0).alias("is_bold"),
        F.min_by("font", F.when(F.coalesce("font", F.lit("")) != "", F.col("pos"))).alias("font_name"),
    )
    sized = joined.withColumn("text", strip(F.regexp_replace("text", r"\s+", " "))).join(body_font(spans), ["document_id", "page_number"], "left")
    typed = sized.withColumn("block_type", classify(F.col("font_size"), F.coalesce("body_size", F.lit(BODY_DEFAULT)), F.col("text"))).drop("body_size")
    return forward_headings(typed, "block_pos")


def forward_headings(typed: DataFrame, order: str) -> DataFrame:
    """section_heading: the page's last heading so far; headings themselves have none."""
    w = Window.partitionBy("document_id", "page_number").orderBy(order)
    last = F.last(F.when(F.col("block_type") == "heading", F.col("text")), ignorenulls=True).over(w)
    return typed.withColumn("section_heading", F.when(F.col("block_type") != "heading", last))


def full_text(typed: DataFrame, order: str) -> DataFrame:
    """(document_id, full_text): the blocks of all pages in order, two line feeds between them."""
    rows = F.sort_array(F.collect_set(F.struct("page_number", order, "text")))
    return typed.where("text is not null").groupBy("document_id").agg(F.array_join(F.transform(rows, lambda b: b["text"]), "\n\n").alias("full_text"))


def scanned_pages(typed: DataFrame) -> DataFrame:
    """(document_id, page_number, chars, is_scanned): pages with little text are taken for scans."""
    chars = F.sum(F.length(strip(F.coalesce("text", F.lit("")))))
    return typed.groupBy("document_id", "page_number").agg(chars.alias("chars")).withColumn("is_scanned", F.col("chars") < SCANNED_BELOW)


def clean_cell(c: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "\n", " ")


def looks_like_header(row: Column) -> Column:
    """At least half of the row's cells are neither empty nor numbers."""
    return F.size(F.filter(row, lambda c: (c != "") & ~is_numeric(c))) >= F.size(row) * 0.5


def big_enough(cells: Column) -> Column:
    return (F.size(cells) >= 2) & (F.size(F.get(cells, F.lit(0))) >= 2)


def markdown(cells: Column) -> Column:
    """A padded table; the first row is its header if it looks like one, else columns are named col_0, col_1, ..."""

    def padded(every: Column) -> Column:
        head = F.get(every, F.lit(0))

        def lines(widths: Column) -> Column:
            line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, widths, lambda c, w: F.rpad(c, w, F.lit(" "))), " | "), F.lit(" |"))
            rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
            all_lines = F.transform(every, line)
            return let(all_lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.size(x))), "\n"))

        widths = F.aggregate(every, F.transform(head, lambda _: F.lit(0)), lambda most, r: F.zip_with(most, r, lambda w, c: F.greatest(w, F.length(F.coalesce(c, F.lit(""))))))
        return let(widths, lines)

    def named(rows: Column) -> Column:
        first = F.get(rows, F.lit(0))
        numbered = F.transform(first, lambda _, i: F.concat(F.lit("col_"), i.cast("string")))
        return let(F.when(looks_like_header(first), rows).otherwise(F.concat(F.array(numbered), rows)), padded)

    return let(F.transform(cells, lambda r: F.transform(r, clean_cell)), named)


def assemble_pages(pages: DataFrame, tables: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages (document_id, page_number) with their tables in order (an empty array where none) and their OCR text."""
    own = tables.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_set(F.struct("table_index", "markdown"))).alias("tables"))
    read = ocr.groupBy("document_id", "page_number").agg(F.max_by("text", "ocr_id").alias("ocr_text"))
    keys = ["document_id", "page_number"]
    return pages.select(*keys).distinct().join(own, keys, "left").join(read, keys, "left").withColumn("tables", F.coalesce("tables", F.expr("cast(array() as array<struct<table_index:int,markdown:string>>)")))


def word_confidence(scores: Column) -> Column:
    """Mean of the scores that are not negative, one decimal; a mean of 0 is null."""
    good = F.filter(scores, lambda s: s >= 0)
    mean = F.aggregate(good, F.lit(0.0), lambda a, s: a + s.cast("double")) / F.size(good)
    return F.nullif(F.when(F.size(good) > 0, F.round(F.round(mean, 9), 1)), F.lit(0.0))


def extractable(pages: DataFrame) -> DataFrame:
    """(document_id, extractable): blocks that are not blank, tables, and one for each page with OCR text."""
    count = F.size(F.filter(F.coalesce("block_texts", F.array().cast("array<string>")), lambda t: not_blank(t))) + F.size("tables") + F.when(not_blank(F.col("ocr_text")), 1).otherwise(0)
    return pages.groupBy("document_id").agg(F.sum(count).alias("extractable"))


def table_of_contents(entries: Column) -> Column:
    """Entries (level, title, page) without blank titles, titles stripped."""
    kept = F.filter(entries, lambda e: not_blank(e["title"]))
    return F.transform(kept, lambda e: F.struct(e["level"].alias("level"), strip(e["title"]).alias("title"), e["page"].alias("page")))


def first_tables(*found: Column) -> Column:
    """The result of the first table finder that found any, in order of preference; an empty array if none did."""
    some = [F.when(F.size(c) > 0, c) for c in found]
    return F.coalesce(*some, F.filter(found[0], lambda _: F.lit(False)))


def page_from_words(words: DataFrame) -> DataFrame:
    """(document_id, page_number, text, confidence) of recognised words (document_id, page_number, pos, word, score, backend).

    Words of the second backend count from a score of 0.3 up, and its mean is taken times 100.
    """
    second = F.col("backend") == "easyocr"
    real = words.where(not_blank(F.col("word"))).where(~second | (F.col("score") > 0.3)).withColumn("score", F.when(second, F.col("score") * 100).otherwise(F.col("score")))
    per = real.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "score"))).alias("w"))
    return per.select("document_id", "page_number", F.array_join(F.transform("w", lambda x: strip(x["word"])), " ").alias("text"), word_confidence(F.col("w.score")).alias("confidence"))


def paired(tables: Column, boxes: Column) -> Column:
    """Tables with the box of the same place; tables beyond the boxes have none."""
    return F.transform(tables, lambda t, i: F.struct(t.alias("cells"), F.get(boxes, i).alias("bbox")))


def extract_page(rows: DataFrame, page: int, page_count: Column | None = None) -> DataFrame:
    """The rows of one page (counted from 1); a page outside the document has none."""
    inside = (F.lit(page) >= 1) if page_count is None else F.lit(page).between(1, page_count)
    return rows.where(inside & (F.col("page_number") == page))


def results(typed: DataFrame, tables: DataFrame, ocr: DataFrame) -> DataFrame:
    """(document_id, pages, full_text): the extraction result as one nested row a document, blocks and tables as structs with the contract's fields."""
    keys = ["document_id", "page_number"]
    block = F.struct("block_pos", "block_type", "text", "page_number", "font_size", "font_name", "is_bold", "section_heading")
    blocks_ = typed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_set(block)), lambda b: b.dropFields("block_pos")).alias("blocks"))
    own = [F.col(c) if c in tables.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("extractor_used", "string"), ("bbox", "array<double>"), ("confidence", "double"), ("caption", "string"))]
    tables_ = tables.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("table_index", "page_number", *own[:1], "markdown", *own[1:]))).alias("tables"))
    read = ocr.groupBy(*keys).agg(F.max("text").alias("ocr_text"))
    pages = typed.select(*keys).unionByName(tables.select(*keys)).unionByName(ocr.select(*keys)).distinct()
    joined = pages.join(blocks_, keys, "left").join(tables_, keys, "left").join(read, keys, "left")
    page = F.struct("page_number", F.coalesce("blocks", F.array().cast(blocks_.schema["blocks"].dataType)).alias("blocks"), F.coalesce("tables", F.array().cast(tables_.schema["tables"].dataType)).alias("tables"), "ocr_text")
    whole = joined.groupBy("document_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return whole.join(full_text(typed, "block_pos"), "document_id", "left")
