"""Problem 1: lines repeated across the documents of one site.

Every (site, line) owns a bitmap of documents, stored compressed: only the non-zero 64-bit words stay, one row a word
(`word`, `bits`). The bitmaps of variant spellings of a line (other digits, spaces, case: one key) are united by `bit_or`, an exact
cardinality is the sum of `bit_count`, and a line is deleted from a document where the excessive line's bitmap has the document's bit. All
steps combine on the map side, so a site or a line that holds a third of all rows reaches no task whole.

Nulls: a null text has no lines; a null document_id belongs to no site; a document without metadata takes its site from
`page_block.site`; one without either takes the site '', which is a site of its own. Lines without letters never count.
Repeated rows set the same bit twice. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

SHARE, LEAST = 0.05, 8


def document_sites(blocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """(document_id, site) once for every document that has a block."""
    own = blocks.groupBy("document_id").agg(F.max(F.lower(F.col("site"))).alias("own"))
    named = (
        metadata.where(F.col("file_name").contains("__"))
        .groupBy("document_id")
        .agg(F.max(F.lower(F.substring_index("file_name", "__", 1))).alias("named"))
    )
    return own.join(named, "document_id", "left").select("document_id", F.coalesce("named", "own", F.lit("")).alias("site"))


def line_keys(blocks: DataFrame, *more: str) -> DataFrame:
    """(block_id, document_id, line_no, variant, k1, k2) and more columns: each line that has letters, with a hash of it as it stands and 96 bits of hash over its lower-cased letters."""
    lines = blocks.where(F.col("document_id").isNotNull()).select("block_id", "document_id", *more, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    letters = F.regexp_replace(F.lower("line"), r"[^\p{L}]+", "")
    return lines.withColumn("letters", letters).where("letters <> ''").select("block_id", "document_id", *more, "line_no", F.xxhash64("line").alias("variant"), F.xxhash64("letters").alias("k1"), F.hash("letters").alias("k2"))


def line_bitmaps(keys: DataFrame) -> DataFrame:
    """(site, k1, k2, word, bits): the compressed bitmaps of lines, those of variants united."""
    bit = F.expr("shiftleft(1L, int(pmod(document_id, 64)))")
    own = keys.groupBy("site", "k1", "k2", "word", "variant").agg(F.bit_or(bit).alias("bits"))
    return own.groupBy("site", "k1", "k2", "word").agg(F.bit_or("bits").alias("bits"))


def sited(blocks: DataFrame, sites: DataFrame) -> DataFrame:
    """The line keys with their site, and the word of the bitmap that the document's bit is in."""
    return line_keys(blocks).join(sites, "document_id").withColumn("word", F.floor(F.col("document_id") / 64))


def excessive_lines(bitmaps: DataFrame, sites: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(site, k1, k2) of the lines in at least `share` of their site's documents and in at least `least`."""
    often = bitmaps.groupBy("site", "k1", "k2").agg(F.sum(F.bit_count("bits")).alias("docs")).where(F.col("docs") >= least)
    totals = sites.groupBy("site").agg(F.count("*").alias("total"))
    return often.join(totals, "site").where(F.col("docs") >= F.col("total") * share - 1e-9).select("site", "k1", "k2")


def repeated_lines(blocks: DataFrame, metadata: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(block_id, line_no) of every line that stands in at least `share` of its site's documents and in at least `least`."""
    sites = document_sites(blocks, metadata)
    keys = sited(blocks, sites)
    of = ["site", "k1", "k2"]
    excessive = cut_lineage(excessive_lines(line_bitmaps(keys), sites, share, least))
    asked = cut_lineage(keys.join(excessive, of, "left_semi"))  # few lines are excessive: only their bitmaps are looked up
    has = F.expr("(shiftrightunsigned(bits, int(pmod(document_id, 64))) & 1L) = 1L")
    return asked.join(line_bitmaps(asked), [*of, "word"]).where(has).select("block_id", "line_no").distinct()


def without_lines(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(block_id, text): every block once, its found lines taken out; a block that keeps no line has the text ''. Null texts stay null."""
    gone = found.groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))
    once = blocks.groupBy("block_id").agg(F.max("text").alias("text"))
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> not array_contains(gone, i)), '\n')")
    return once.join(gone, "block_id", "left").select("block_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
