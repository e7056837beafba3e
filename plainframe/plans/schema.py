"""Columns and their kinds, as coarse as the grammar tells them apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NUMBER, TEXT, TRUTH, DATE, TIMESTAMP, UNKNOWN = "number", "text", "truth", "date", "timestamp", "unknown"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dtype, T.BooleanType):
        return TRUTH
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    return UNKNOWN


def word(kind: str) -> str:
    return DATE if kind == TIMESTAMP else kind


def agree(a: str, b: str) -> bool:
    return UNKNOWN in (a, b) or word(a) == word(b)


@dataclass(frozen=True)
class Schema:
    columns: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, struct: T.StructType) -> Schema:
        return cls(tuple((f.name, kind_of(f.dataType)) for f in struct.fields))

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def kind(self, name: str) -> str:
        return dict(self.columns)[name]

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def put(self, made: list[tuple[str, str]]) -> Schema:
        """Columns replaced where they stand, new ones at the end."""
        new = dict(made)
        return Schema(tuple((n, new.pop(n, k)) for n, k in self.columns) + tuple(new.items()))
