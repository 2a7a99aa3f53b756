"""Explicit schemas of the document store; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(ddl: str) -> T.StructType:
    """A flat schema from DDL, without a running session."""
    fields = []
    for name, kind in (x.split() for x in ddl.split(", ")):
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(T.StructField(name, T.ArrayType(_KINDS[inner]) if kind != inner else _KINDS[kind]))
    return T.StructType(fields)


DOCUMENT = _struct("id bigint, title string, content string, created_at timestamp, updated_at timestamp, source string, page_count int, scanned_pages array<int>, extraction_status string")
CHUNK = _struct(
    "id bigint, document_id bigint, content string, chunk_index int, embedding array<float>, created_at timestamp, chunk_type string, page_number int, section_heading string, confidence double, bbox string"
)
BLOCK = _struct("block_type string, text string, page_number int, bbox array<double>, font_size double, font_name string, is_bold boolean, section_heading string")
TABLE = _struct("page_number int, table_index int, extractor_used string, markdown string, bbox array<double>, confidence double, caption string")
SPAN = _struct("document_id bigint, page_number int, block_pos int, pos int, text string, size double, flags int, font string, type int")
REQUEST = _struct("qid bigint, question string, qvec array<double>, top_k int, threshold double, search_mode string")
CACHE = _struct("key string, value string, expires_at timestamp")

#: Enumerations and the columns' defaults.
CHUNK_TYPES = ("text", "table", "ocr")
STATUSES = ("pending", "processing", "completed", "failed")
STRATEGIES = ("sentence_aware", "paragraph", "fixed_token", "table")
MODES = ("hybrid", "semantic", "keyword")
DEFAULTS = {"source": "'text'", "extraction_status": "'pending'", "scanned_pages": "array()", "chunk_type": "'text'"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in its order: missing ones with their default, others cast. This is how old files take new columns."""
    have = set(df.columns)
    return df.select(*(F.coalesce(F.col(f.name).cast(f.dataType), F.expr(DEFAULTS[f.name]).cast(f.dataType)).alias(f.name) if f.name in have and f.name in DEFAULTS else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.expr(DEFAULTS.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in schema))
