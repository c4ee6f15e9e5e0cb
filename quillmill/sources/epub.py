"""Reading e-books: zip archives of XHTML. One file is one row; files are read by Spark and parsed in the workers by batch."""

from __future__ import annotations

import base64
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.sources.markup import cleaned

SCHEMA = "path string, title string, author string, language string, publisher string, year int, isbn string, description string, sections array<string>, paragraphs array<string>, html_sections array<string>, images map<string,string>, error string"
_DC = "{http://purl.org/dc/elements/1.1/}"


def _metadata(package: ElementTree.Element) -> dict:
    def all_(name: str) -> list[str]:
        return [e.text.strip() for e in package.iter(_DC + name) if e.text and e.text.strip()]

    first = lambda name, default=None: next(iter(all_(name)), default)
    year = re.search(r"\d{4}", first("date", "") or "")
    isbn = next((i for i in all_("identifier") if "isbn" in i.lower()), None)
    return {
        "title": first("title", "Unknown Title"), "author": first("creator", "Unknown Author"), "language": first("language", "en"), "publisher": first("publisher"),
        "year": int(year.group()) if year else None, "isbn": isbn, "description": first("description"),
    }


def parse(data: bytes) -> dict:
    """Metadata, sections in reading order and images of one e-book. Unreadable files give the error and no sections."""
    out: dict = {"title": None, "author": None, "language": None, "publisher": None, "year": None, "isbn": None, "description": None, "sections": [], "paragraphs": [], "html_sections": [], "images": {}, "error": None}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            container = ElementTree.fromstring(book.read("META-INF/container.xml"))
            root = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
            package = ElementTree.fromstring(book.read(root))
            out |= _metadata(package)
            base = posixpath.dirname(root)
            items = {e.get("id"): (posixpath.normpath(posixpath.join(base, e.get("href"))), e.get("media-type") or "") for e in package.iter() if e.tag.endswith("}item")}
            names = set(book.namelist())
            for path, kind in items.values():
                if kind.startswith("image/") and path in names:
                    uri = f"data:{kind};base64,{base64.b64encode(book.read(path)).decode()}"
                    out["images"][path] = out["images"][path.rsplit("/", 1)[-1]] = uri
            order = [e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")]
            for path, kind in (items[i] for i in order if i in items):
                if "html" in kind and path in names:
                    markup, text, blocks = cleaned(book.read(path).decode("utf-8", "ignore"), out["images"])
                    if markup:
                        out["html_sections"].append(markup)
                        if text:
                            out["sections"].append(text)
                            out["paragraphs"].append(blocks)
    except Exception as problem:  # a damaged file must not end the job
        out["error"] = f"{type(problem).__name__}: {problem}"[:200]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """All e-books under a path, through Spark's binary file scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, data in zip(rows["path"], rows["content"]):  # one book at a time: books are large
                yield pd.DataFrame([{"path": name} | parse(bytes(data))])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        import glob
        import os

        own = [self.folder] if os.path.isfile(self.folder) else sorted(glob.glob(f"{self.folder}/**/*.epub", recursive=True))
        return [_File(p) for p in own] or [_File("")]

    def read(self, partition):
        if partition.path:
            with open(partition.path, "rb") as file:
                row = parse(file.read())
            yield (partition.path, *(row[c.split()[0]] for c in SCHEMA.split(", ")[1:]))


class EpubSource(DataSource):
    """spark.read.format("epub").load(folder), once registered with spark.dataSource.register(EpubSource)."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
