"""Words of pages: a Parquet table as it is, or PDF files where a PDF library is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import written
from .config import PdfError

WORDS = "doc_id string, page int, y double, x0 double, x1 double, text string"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A table doc_id, page, y (centre), x0, x1, text. A missing path raises PdfError."""
    try:
        return spark.read.schema(WORDS).parquet(path)
    except AnalysisException as error:
        raise PdfError("the price list can't be read", str(error)) from error


def read_pdf_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of all PDF files under a path, a task for each file; needs pymupdf or pdfplumber on the executors.

    Files that can't be read give a row with an error, and those raise PdfError here on the driver; so no task fails.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = [(name, *w, None) for w in pdf_words(bytes(content))]
                except PdfError as error:
                    found = [(name, None, None, None, None, None, f"{error.message} {error.detail}")]
                yield pd.DataFrame(found, columns=["doc_id", "page", "y", "x0", "x1", "text", "error"])

    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as error:
        raise PdfError("the price list can't be read", str(error)) from error
    read = written(files.mapInPandas(words, f"{WORDS}, error string"), "words")
    bad = read.where("error is not null").select("doc_id", "error").orderBy("doc_id").first()
    if bad:
        raise PdfError("the price list can't be read", f"{bad.doc_id}: {bad.error}")
    return read.drop("error")


def pdf_words(content: bytes) -> Iterator[tuple[int, float, float, float, str]]:
    import io

    try:
        import pymupdf
    except ImportError:
        try:
            import pdfplumber
        except ImportError as error:
            raise PdfError("no PDF library is installed", str(error)) from error
        try:
            with pdfplumber.open(io.BytesIO(content)) as book:
                for n, page in enumerate(book.pages, 1):
                    for w in page.extract_words() or []:
                        yield n, (float(w["top"]) + float(w["bottom"])) / 2, float(w["x0"]), float(w["x1"]), w["text"]
        except Exception as error:
            raise PdfError("the file is broken", str(error)) from error
        return
    try:
        book = pymupdf.open(stream=content, filetype="pdf")
    except Exception as error:
        raise PdfError("the price list can't be read", str(error)) from error
    for n in range(book.page_count):
        for x0, y0, x1, y1, text, *_ in book.load_page(n).get_text("words"):
            yield n + 1, (y0 + y1) / 2, x0, x1, text
