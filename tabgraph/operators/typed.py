"""Tables held against a schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tabgraph.errors import SchemaProblems

from .frame import Table


@dataclass(frozen=True)
class Schema:
    """Names and types (as simple strings) that a table must have; it may have more."""

    fields: dict[str, str]

    def problems(self, df: DataFrame) -> list[str]:
        have = dict(df.dtypes)
        return [f"unknown column {k}" if k not in have else f"{k} is {have[k]}, not {t}" for k, t in self.fields.items() if have.get(k) != t]


class TypedTable:
    """A table that meets a schema, with its columns as attributes; every problem is in one error."""

    def __init__(self, schema: Schema, table: Table):
        if problems := schema.problems(table.df):
            raise SchemaProblems(problems)
        self.schema, self.untyped = schema, table

    def __getattr__(self, name: str) -> Column:
        if name in self.schema.fields:
            return self.untyped[name].expr
        raise AttributeError(name)
