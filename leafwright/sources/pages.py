"""Page tables from files, rows or PDF packages."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_PAGES

#: ``(bytes) -> [(text, rotation, images)]``, a page each; raises ValueError for files that can't be read.
Decoder = Callable[[bytes], list[tuple[str, int, int]]]


def from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Raw pages of ``(package_id, page_number, text[, rotation, image_count])``."""
    return spark.createDataFrame([(*r, *(0, 0)[len(r) - 3 :]) if len(r) < 5 else tuple(r) for r in rows], RAW_PAGES)


def read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Raw pages from Parquet, ORC or JSON with the columns of ``RAW_PAGES``; absent numbers are 0."""
    df = spark.read.schema(RAW_PAGES).json(path) if kind == "json" else spark.read.format(kind).load(path)
    extra = {c: F.lit(0) for c in ("rotation", "image_count") if c not in df.columns}
    return df.withColumns(extra).select("package_id", "page_number", "text", F.coalesce("rotation", F.lit(0)).alias("rotation"), F.coalesce("image_count", F.lit(0)).alias("image_count"))


def pymupdf_decoder(content: bytes) -> list[tuple[str, int, int]]:
    """Pages of a PDF by the ``pymupdf`` library, which must be installed on the executors."""
    pymupdf = importlib.import_module("pymupdf")
    try:
        doc = pymupdf.open(stream=content, filetype="pdf")
    except Exception as error:
        raise RuntimeError(f"Failed to open PDF: {error}") from error
    try:
        if doc.needs_pass:
            raise ValueError("Encrypted PDF requires a password")
        return [(page.get_text(), page.rotation, len(page.get_images())) for page in doc]
    finally:
        doc.close()


def read_pdfs(spark: SparkSession, path: str, decoder: Decoder = pymupdf_decoder) -> DataFrame:
    """Raw pages of all PDF files that ``path`` names; a package's id is its file name.

    Files are decoded on the executors, a few at a time; a missing path, an unreadable or an encrypted file fails the query.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                package = name.rstrip("/").rpartition("/")[2]
                try:
                    pages = decoder(bytes(content))
                except (RuntimeError, ValueError) as error:
                    raise type(error)(f"{package}: {error}") from error
                yield pd.DataFrame([(package, i, text, rotation, images) for i, (text, rotation, images) in enumerate(pages, 1)], columns=["package_id", "page_number", "text", "rotation", "image_count"])

    return files.mapInPandas(decode, RAW_PAGES)


def page_texts(spark: SparkSession, path: str, decoder: Decoder = pymupdf_decoder) -> DataFrame:
    """``(package_id, page_number, text)`` alone."""
    return read_pdfs(spark, path, decoder).select("package_id", "page_number", "text")
