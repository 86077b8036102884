"""Schemas of the catalog's tables and of a search result."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "2"

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()
_A = T.ArrayType(_S)


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


LISTED = _struct(project=_S, rel_path=_S, file_mtime=_L, file_size=_L)
FILES = _struct(project=_S, rel_path=_S, file_mtime=_L, file_size=_L, content=T.BinaryType())
QUERIES = _struct(
    project=_S, id=_L, rel_path=_S, title=_S, description=_S, body=_S, file_mtime=_L, file_size=_L, content_hash=_S, has_frontmatter=_B, created_at=_S, updated_at=_S
)
TAGS = _struct(project=_S, query_id=_L, tag=_S)
OBJECTS = _struct(project=_S, query_id=_L, object_type=_S, object_name=_S, object_key=_S)
POSTINGS = _struct(project=_S, token=_S, query_id=_L, field=_S, pos=T.IntegerType())
LENGTHS = _struct(project=_S, query_id=_L, d=_L)
FAVORITES = _struct(project=_S, rel_path=_S)
RECENT = _struct(project=_S, rel_path=_S, viewed_at=T.TimestampType())
RESULT = _struct(
    query_id=_L, rel_path=_S, title=_S, description=_S, snippet=_S, rank=_D, tags=_A, folder=_S, tables=_A, updated_at=_S, is_favorite=_B, file_mtime=_L
)
OBJECT_TYPES = ("table", "column", "procedure", "function")
