"""Sources: text, HTML, JSON, page-wise binary files, paginated services."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text


def scan_files(spark: SparkSession, root: str, pattern: str = "*", skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """Files below root by name pattern, without those under a skipped directory: path, size, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    for d in skip_dirs:
        files = files.where(~F.array_contains(parts, d))
    return files.select("path", F.col("length").alias("size"), "content")


def scan_texts(spark: SparkSession, root: str, least: int = 0) -> DataFrame:
    """Whole text files (path, text) of at least so many characters."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(F.length("text") >= least)


def list_files(spark: SparkSession, root: str, pattern: str = "*", skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(path, size) of files below root by name pattern; skipped folders are not entered and no content is read."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    rule, todo, found = re.compile(fnmatch.translate(pattern)), [top], []
    while todo:
        for status in fs.listStatus(todo.pop()):
            path = status.getPath()
            if status.isDirectory():
                if path.getName() not in skip_dirs:
                    todo.append(path)
            elif rule.match(path.getName()):
                found.append((path.toString(), status.getLen()))
    return spark.createDataFrame(found, "path string, size long")


def by_format(files: DataFrame, extract_pdf: Callable[[bytes], list] | None = None, converters: dict[str, Callable[[bytes], list]] | None = None) -> DataFrame:
    """(path, page, text, error) of files (path, content): HTML stripped, plain text as it is, PDF pages by the given
    function, office documents by docx_text, other extensions by converters.

    A function returns a text for each page, or an exception for one that can't be read; if it raises, the file gives a
    single row. Such rows have an error and no text, so nothing is lost without a trace."""

    extractors = {".docx": docx_text, ".pdf": extract_pdf or (lambda raw: [])} | (converters or {})

    def pages(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                extract = extractors.get("." + path.lower().rpartition(".")[2])
                if extract:
                    try:
                        found = extract(raw)
                    except Exception as e:
                        rows.append((path, None, None, f"{type(e).__name__}: {e}"))
                        continue
                    rows += [(path, k + 1, None, f"{type(t).__name__}: {t}") if isinstance(t, Exception) else (path, k + 1, t, None) for k, t in enumerate(found)]
                else:
                    rows.append((path, 1, raw.decode("utf-8", "ignore"), None))
            out = pd.DataFrame(rows, columns=["path", "page", "text", "error"])
            yield out.astype({"page": "Int32"})

    rows = files.select("path", "content").mapInPandas(pages, "path string, page int, text string, error string")
    is_html = F.lower("path").rlike(r"\.html?$")
    return rows.withColumn("text", F.when(is_html, text.html_to_text("text")).otherwise(F.col("text")))


def docx_text(raw: bytes) -> list[str]:
    """The paragraphs of an office document (a zip with WordprocessingML), as one page; a broken one raises."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    space = root.tag.partition("}")[0] + "}"
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")).strip()]


def magic_kind(content: str, content_type: str | None = None):
    """Kind of a binary by its first bytes and, if a column of declared types is named, by these."""
    head = F.substring(content, 1, 4)
    declared = F.lower(F.coalesce(F.col(content_type), F.lit(""))) if content_type else F.lit("")
    is_html = F.lower(F.substring(content, 1, 15).cast("string")).rlike("^\\s*<(!doctype html|html)")
    return F.when((head == F.lit(b"%PDF")) | declared.contains("application/pdf"), "pdf").when(declared.contains("text/html") | is_html, "html").when(head == F.lit(b"PK\x03\x04"), "zip").otherwise("other")


def as_pages(rows: list[tuple[str, str]], size: int) -> dict[str, list]:
    """(root, name) rows as the pages of a service: for each root a list of [JSON rows, next cursor or None]."""
    out: dict[str, list] = {}
    for root in {r for r, _ in rows}:
        own = [json.dumps({"name": n}) for r, n in rows if r == root]
        parts = [own[k : k + size] for k in range(0, len(own), size)]
        out[root] = [[p, k + 1 if k + 1 < len(parts) else None] for k, p in enumerate(parts)]
    return out


class PagedSource(DataSource):
    """A paginated service as a Spark source: ``spark.read.format("paged")``, one partition per root.

    The option ``client`` is "module:function"; the function takes (root, cursor) and returns (rows, next cursor), each
    row a JSON text. Any transport fits behind it. ``json`` serves the option ``pages`` (as_pages) itself, for trials."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "root string, item int, json string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(r) for r in self.options["roots"].split(",")]

    def read(self, partition):
        import importlib

        if self.options["client"] == "json":
            stored = json.loads(self.options["pages"])
            fetch = lambda root, cursor: tuple(stored[root][cursor or 0])
        else:
            module, function = self.options["client"].split(":")
            fetch = getattr(importlib.import_module(module), function)
        cursor, k = None, 0
        while True:
            rows, cursor = fetch(partition.value, cursor)
            for r in rows:
                yield partition.value, k, r
                k += 1
            if cursor is None:
                return
