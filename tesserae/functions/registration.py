"""The engine's Arrow functions under names that SQL can use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import records, telemetry
from .markup import visible_texts


def resolved(bases: pa.Array, links: pa.Array) -> pa.Array:
    """Links made absolute against their page, without fragment."""
    from urllib.parse import urldefrag, urljoin

    return pa.array([urldefrag(urljoin(b or "", x or ""))[0] for b, x in zip(bases.to_pylist(), links.to_pylist(), strict=True)], pa.string())


def likeness(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([telemetry.likeness(a, b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


def unescaped(texts: pa.Array) -> pa.Array:
    import html

    return pa.array([None if x is None else html.unescape(x) for x in texts.to_pylist()], pa.string())


def thinned(texts: pa.Array) -> pa.Array:
    return pa.array([records.thin_captions(x or "") for x in texts.to_pylist()], pa.string())


def packed(texts: pa.Array) -> pa.Array:
    return pa.array([records.packed(x or "") for x in texts.to_pylist()], pa.list_(pa.string()))


def record_list(split, schema: str):
    def f(texts: pa.Array) -> pa.Array:
        return pa.array([split(x) if x else [] for x in texts.to_pylist()], records.arrow_type(schema))

    return f, f"array<struct<{','.join(':'.join(c.split()) for c in schema.split(','))}>>"


FUNCTIONS = {
    "visible_text": (visible_texts, "string"),
    "resolve_url": (resolved, "string"),
    "likeness": (likeness, "double"),
    "html_unescape": (unescaped, "string"),
    "thin_captions": (thinned, "string"),
    "packed_pieces": (packed, "array<string>"),
    "record_spans": record_list(records.record_spans, records.RECORD),
    "preamble_spans": record_list(records.preamble_spans, records.PREAMBLE),
    "titled_spans": record_list(records.titled_spans, records.TITLED_RECORD),
    "numbered_run": record_list(records.numbered_run, records.LISTED_RECORD),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions with the session; returns their names."""
    for name, (f, ddl) in FUNCTIONS.items():
        spark.udf.register(name, F.arrow_udf(f, ddl))
    return list(FUNCTIONS)
