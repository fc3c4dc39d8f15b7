"""Registered queries: a builder, the inventory items it covers, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    items: tuple[str, ...]
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, items: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(items.split()), build, sql)
        return build

    return register
