"""python -m tallyweave.plans.cli --words PATH[:BRAND] ... --inventory SHEET [--out FILE]; --pdf reads PDF files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..sources.config import AppError
from .session import Engine


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--words", action="append", default=[], help="table of page words, with an optional brand after the last colon")
    parser.add_argument("--pdf", action="append", default=[])
    parser.add_argument("--inventory", required=True)
    parser.add_argument("--config")
    parser.add_argument("--out", default="prices.xlsx")
    parser.add_argument("--all-rows", action="store_true", help="export rows without a price too")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        engine = Engine(spark, path=given.config)
        for kind in ("words", "pdf"):
            for spec in getattr(given, kind):
                path, _, brand = spec.rpartition(":")
                path, brand = (path, brand) if path and "/" not in brand else (spec, "")
                engine.add_path(path, brand, kind)
        engine.read_inventory(given.inventory)
        engine.run()
        print(engine.stats)
        print(engine.export(given.out, only_priced=not given.all_rows))
    except AppError as error:
        print(f"{error.message} {error.detail}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
