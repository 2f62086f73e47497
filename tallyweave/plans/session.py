"""A session over price lists and an inventory: add, run, query, export."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_dense
from ..operators import clean, layout, merge, results
from ..sources import config, pages, sheets
from . import resolve

COLUMNS = [("code", "کد"), ("name", "نام"), ("stock", "موجودی"), ("price", "قیمت"), ("brand", "برند"), ("status_label", "وضعیت")]


class Engine:
    """Lists are added by priority; the inventory is prepared once for all of them.

    ``progress`` is called with a percentage and a message at each step. ``brands_required`` makes a list without a brand
    an error, as an interface for users wants it.
    """

    def __init__(self, spark: SparkSession, over: dict | None = None, path: str | None = None, progress: Callable[[int, str], None] | None = None, brands_required: bool = False):
        self.spark, self.cfg, self.progress, self.brands_required = spark, config.load_config(path, over), progress or (lambda percent, message: None), brands_required
        self._held: list[DataFrame] = []
        self.reset()

    def reset(self) -> None:
        for table in self._held:
            table.unpersist()
        self._held = []
        self.lists: list[tuple[str, str, Callable[[], DataFrame]]] = []
        self.items = self.rows = self.report = None

    def _hold(self, table: DataFrame) -> DataFrame:
        self._held.append(table.cache())
        return table

    def _add(self, load: Callable[[], DataFrame], label: str, brand: str) -> None:
        if self.brands_required and not brand.strip():
            raise config.AppError("name the brand of each price list", label)
        self.lists.append((label or brand, brand, load))

    def add_path(self, path: str, brand: str = "", kind: str = "words", label: str = "") -> None:
        """A price list by its path, a table of words or PDF files. It is read when the run reads its lists, so that a
        failure concerns this list alone. A blank path is no list."""
        if path.strip():
            read = {"words": pages.read_words, "pdf": pages.read_pdf_words}[kind]
            self._add(lambda: layout.price_rows(read(self.spark, path), self.cfg), label or brand or path, brand)

    def add_words(self, words: DataFrame, label: str, brand: str = "", ocr_lines: DataFrame | None = None) -> None:
        """A price list as words of pages."""
        self.add_rows(layout.price_rows(words, self.cfg, ocr_lines), label, brand)

    def add_rows(self, rows: DataFrame, label: str, brand: str = "") -> None:
        """A price list as rows doc_id, page, emit_pos, code, price, text, section_fa, section_en."""
        self._add(lambda: rows, label, brand)

    def set_inventory(self, items: DataFrame) -> None:
        """Rows item_id, row, code, name, stock, unit."""
        self.items = items

    def read_inventory(self, path: str, max_rows: int | None = None) -> None:
        self.items = sheets.read_inventory(self.spark, path, max_rows)

    def prices(self) -> tuple[DataFrame, list[tuple]]:
        """Cleaned rows of all lists that hold any, and (list_ord, label, target, rows, error, seconds) of each list. A list that
        fails to be read is left out; if all fail the run fails."""
        found, report = [], []
        for n, (label, brand, load) in enumerate(self.lists):
            began = time.monotonic()
            self.progress(5 + 45 * n // len(self.lists), f"reading {label}")
            try:
                rows = load()
                place = F.row_number().over(clean.Window.partitionBy(F.lit(n)).orderBy("doc_id", "page", "emit_pos"))
                one = layout.finalize(rows.withColumn("price_id", place.cast("long")).withColumn("list_ord", F.lit(n)))
                one = clean.clean_prices(one, float(self.cfg["min_valid_price"]), float(self.cfg["max_valid_price"]))
                count = self._hold(one).count()
                if not count:
                    raise config.PdfError("the price list holds no product", label)
                found.append(one)
                report.append((n, label, py_dense(brand), count, "", time.monotonic() - began))
            except config.AppError as error:
                report.append((n, label, py_dense(brand), 0, f"{error.message} {error.detail}".strip(), time.monotonic() - began))
        if not found:
            raise config.AppError("no price list could be read", "; ".join(r[4] for r in report))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out, report

    def run(self) -> DataFrame:
        """Merged results, one row for each item, in self.rows; self.report holds list_ord, label, pdf_rows, priced, ok,
        error and the seconds that its reading took."""
        if self.items is None or not self.lists:
            raise config.AppError("add a price list and an inventory first")
        prices, report = self.prices()
        self.progress(50, "preparing the inventory")
        items = self._hold(clean.clean_inventory(clean.prepare_inventory(self.items, self.cfg)))
        lists = self.spark.createDataFrame([r[:4] for r in report if not r[4]], "list_ord int, label string, target string, pdf_rows long")
        self.progress(60, "matching")
        self.rows = self._hold(resolve.resolve_batch(items, prices, lists, self.cfg))
        counted = {r.list_ord: r.priced for r in merge.list_report(self.rows, lists).collect()}
        self.report = [{"list_ord": n, "label": label, "pdf_rows": rows, "priced": counted.get(n, 0), "ok": not error, "error": error, "seconds": took} for n, label, _, rows, error, took in report]
        self.stats = merge.batch_summary(self.rows, lists).first().asDict()
        self.progress(100, "done")
        return self.rows

    def results(self, name: str = "all", query: str = "", offset: int = 0, limit: int = 0) -> DataFrame:
        return results.page_results(results.search_results(results.filter_results(self.rows, name), query), offset, limit)

    def export(self, path: str, only_priced: bool = False) -> str:
        """An .xlsx file by its ending, else a folder of Parquet."""
        rows = results.export_rows(self.rows, self.stats["brand"], only_priced)
        if not path.lower().endswith(".xlsx"):
            rows.write.mode("overwrite").parquet(path)
            return path
        lines = ({**r.asDict(), "code": r.code_number if r.code_number is not None else r.code} for r in rows.orderBy("item_id").toLocalIterator())
        return sheets.write_sheet(lines, COLUMNS, path)
