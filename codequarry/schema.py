"""The data model: tables of a code-knowledge index, their keys, and the error codes of its operations."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T


# Kinds of units and relations, and the codes of errors.
class UnitKind(StrEnum):
    MODULE = "module"
    CLASS = "class"
    FUNCTION = "function"
    METHOD = "method"


class RelationType(StrEnum):
    IMPORTS = "imports"
    CALLS = "calls"
    INHERITS = "inherits"
    DEFINES = "defines"


class ErrorCode(StrEnum):
    STORAGE_BUSY = "STORAGE_BUSY"
    STORAGE_CORRUPT = "STORAGE_CORRUPT"
    EMBEDDING_MISMATCH = "EMBEDDING_MISMATCH"
    EMBEDDINGS_MISSING = "EMBEDDINGS_MISSING"


class QuarryError(Exception):
    """An error with a code that callers can test."""

    def __init__(self, message: str, code: ErrorCode | None = None):
        super().__init__(message)
        self.code = code


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


UNITS = T.StructType([*_strings("id", "kind", "name", "path", "signature", "docstring", "summary", "code_hash"), T.StructField("tags", T.ArrayType(T.StringType())), *_strings("metadata")])
UNIT_EMBEDDINGS = T.StructType([*_strings("id"), T.StructField("vec", T.ArrayType(T.FloatType(), False))])
RELATIONS = T.StructType(_strings("from_id", "to_id", "type"))
DEPENDENCIES = T.StructType(_strings("name", "path"))

#: Columns that identify a row of each table; the last row written for a key stays.
KEYS = {"units": ["id"], "unit_embeddings": ["id"], "relations": ["from_id", "to_id", "type"], "dependencies": ["name"]}
