"""Geocoding a stream of lines, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from terrane.plans.geocode import Geocoder


def geocode_stream(
    lines: DataFrame, geocoder: Geocoder, path: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None
):
    """Start a query that geocodes each micro-batch once and stores it under its number.

    A batch that is run again after a failure replaces its own folder, so every
    line is stored exactly once. Lines keep their order within a batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        out = geocoder.geocode(batch)
        if write is not None:
            write(out, number)
        else:
            out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
