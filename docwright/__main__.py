"""The extraction job: `python -m docwright FOLDER OUT MODULE:EXTRACTOR` reads the PDF files of a folder and writes their extraction results as JSON, and the rejects beside them.

EXTRACTOR maps a file's bytes to rows; see `sources.readers.extracted`.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from .operators import extraction as E
from .operators import store as S
from .session import session
from .sources import readers


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docwright", description="Extract the PDF files of a folder to JSON.")
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("extractor", help="MODULE:FUNCTION, a plug-in from bytes to rows")
    a = parser.parse_args(arguments)
    module, name = a.extractor.split(":")
    spark = session()
    spans, rejects = readers.extracted(readers.pdf_files(spark, a.folder), getattr(importlib.import_module(module), name))
    typed = E.blocks(spans.withColumn("document_id", F.abs(F.xxhash64("path"))))
    none = spark.createDataFrame([], "document_id long, page_number int, table_index int, markdown string, text string")
    S.save_json(E.results(typed, none.drop("text"), none.select("document_id", "page_number", "text")), f"{a.out}/results")
    S.save_json(rejects, f"{a.out}/rejects")


if __name__ == "__main__":
    main()
