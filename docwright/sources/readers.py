"""Sources: tables, text documents, PDF files, databases. Extraction of PDF bytes is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import not_blank
from ..schemas import DOCUMENT, conform

EXTRACTED = "path string, sha256 string, page_number int, block_pos int, pos int, text string, size double, flags int, font string, type int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_documents(spark: SparkSession, path: str, form: str = "json") -> tuple[DataFrame, DataFrame]:
    """Documents and rejected rows of title/content records (json, parquet or whole text files)."""
    if form == "text":
        raw = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("title"), F.col("value").alias("content"))
    elif form == "json":
        raw = spark.read.schema("title string, content string").json(path)
    else:
        raw = spark.read.parquet(path).select("title", "content")
    good = not_blank(F.col("content")) & F.length("title").between(1, 255)
    keyed = raw.withColumn("id", F.abs(F.xxhash64("title", "content")))
    ok = F.coalesce(good, F.lit(False))
    return conform(keyed.where(ok).withColumn("created_at", F.current_timestamp()), DOCUMENT), keyed.where(~ok)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, content) of the files whose name ends in .pdf (case matters) and that are not empty."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.where(F.col("path").endswith(".pdf") & (F.col("length") > 0)).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def extracted(files: DataFrame, extractor: Callable[[bytes], list[tuple]]) -> tuple[DataFrame, DataFrame]:
    """Spans of every file by a plug-in that maps bytes to (page_number, block_pos, pos, text, size, flags, font, type) rows, and the rejects (path, sha256, error)."""
    names = [c.split()[0] for c in EXTRACTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, sha, content in zip(b["path"], b["sha256"], b["content"]):
                try:
                    rows += [(path, sha, *r, None) for r in extractor(bytes(content))]
                except Exception as e:  # noqa: BLE001 - a plug-in may fail in any way; the file is reported
                    rows.append((path, sha, *(None,) * (len(names) - 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*names, "error"])

    out = files.select("path", "sha256", "content").mapInPandas(run, EXTRACTED + ", error string")
    return out.where("error is null").select(*names), out.where("error is not null").select("path", "sha256", "error")


def extract_pdf(files: DataFrame, extractor: Callable[[bytes], list[tuple]]) -> DataFrame:
    """The spans of `extracted`; a caller that wants to know of failures takes both."""
    return extracted(files, extractor)[0]


FOUND_TABLE = "path string, page_number int, table_index int, cells array<array<string>>, bbox array<double>, confidence double, extractor string"


def extract_tables(files: DataFrame, finders: dict[str, Callable[[bytes], list[tuple]]], least: float = 50.0) -> DataFrame:
    """Tables by plug-ins in order of preference, each mapping bytes to (page_number, cells, bbox, confidence) rows; a finder that fails finds nothing.

    A page takes the tables of the first finder that has any there; those with a confidence below `least` don't count (null counts as sure).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                pages: dict[int, tuple[str, list]] = {}
                for name, find in finders.items():
                    try:
                        found = [t for t in find(bytes(content)) if t[3] is None or t[3] >= least]
                    except Exception:  # noqa: BLE001
                        found = []
                    for t in found:
                        if pages.setdefault(t[0], (name, []))[0] == name:
                            pages[t[0]][1].append(t)
                rows += [(path, page, i, *t[1:], name) for page, (name, ts) in sorted(pages.items()) for i, t in enumerate(ts)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND_TABLE.split(", ")])

    return files.select("path", "content").mapInPandas(run, FOUND_TABLE)


def recognise(files: DataFrame, pages: DataFrame, reader: Callable[[bytes, int], list[tuple]], backend: str) -> DataFrame:
    """(document_id, page_number, pos, word, score, backend) of the given pages (document_id, path, page_number) by a plug-in that maps bytes and a page number to (word, score) rows; pages it fails on are left out."""
    schema = "document_id long, page_number int, pos int, word string, score double, backend string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, page, content in zip(b["document_id"], b["page_number"], b["content"]):
                try:
                    rows += [(doc, page, i, w, float(x), backend) for i, (w, x) in enumerate(reader(bytes(content), int(page)))]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.join(files.select("path", "content"), "path").select("document_id", "page_number", "content").mapInPandas(run, schema)


def jdbc(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A database table; with a numeric column and its bounds it is read in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition_column and bounds:
        r = r.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()
