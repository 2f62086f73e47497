"""A stream of inventory rows resolved against a fixed price list. An extension: batch runs give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean
from ..plans import resolve


def resolve_stream(items: DataFrame, prices: DataFrame, cfg: dict, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the results of each micro-batch as Parquet under ``out``/batch=N; a batch that is repeated after a
    failure replaces its own folder. Top-1 of an item needs its own rows alone, so no state is kept."""

    def batch(rows: DataFrame, number: int) -> None:
        prepared = clean.clean_inventory(clean.prepare_inventory(rows, cfg))
        resolve.resolve(prepared, prices, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
