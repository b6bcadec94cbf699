"""Operators over whole tables. Each is a function of DataFrames; most are one SQL text with {name} for each input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from waymark.functions.sql import sql


@dataclass(frozen=True)
class Operator:
    """A SQL operator: call it with its inputs by name, `op(entities=..., sources=...)`."""

    name: str
    text: str
    doc: str

    def __call__(self, **frames: DataFrame) -> DataFrame:
        return sql(self.text, **frames)


ALL: dict[str, Operator] = {}


def define(name: str, doc: str, text: str) -> Operator:
    ALL[name] = Operator(name, text, doc)
    return ALL[name]
