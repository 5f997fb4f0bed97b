"""Named queries with their SQL twins, and inline tables that feed both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Registers f(spark, sf_dir); ids: the inventory rows that it shows."""

    def add(f):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(f, sql, ids)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


class Inline:
    """A small table given as rows: a DataFrame on one side, a VALUES clause on the other."""

    def __init__(self, ddl: str, rows: list[tuple]):
        self.ddl, self.rows = ddl, rows

    def df(self, spark: SparkSession) -> DataFrame:
        plain = self.ddl.replace(" date", " string").replace(" timestamp", " string")
        out = spark.createDataFrame(self.rows, plain)
        schema = T.StructType.fromDDL(self.ddl) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], self.ddl).schema
        return out.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in schema])

    def sql(self) -> str:
        cols = [c.strip().split(" ", 1) for c in self.ddl.split(",")]
        body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST(c{k} AS {SQL_TYPES[t.strip().lower().replace('long', 'bigint')]}) AS \"{n}\"" for k, (n, t) in enumerate(cols))
        return f"(SELECT {casts} FROM (VALUES {body}) AS v({', '.join(f'c{k}' for k in range(len(cols)))}))"
