"""Keyed upserts from a stream: each micro-batch replaces the rows of the keys that it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import first_of_group, upserted
from ..sources.writers import swapped


def latest_by_key(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str):
    """A stream's newest row by key, kept as a table at `path`. A batch that is run again gives the same table."""
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = first_of_group(batch, keys, [F.desc_nulls_last(order)])
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        if old is not None:
            both = upserted(old, new, keys, touched=new).unionByName(old.join(new.select(*keys), list(keys), "left_semi"))
            new = first_of_group(both, keys, [F.desc_nulls_last(order)])
        swapped(new, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean value by window and key; late rows are dropped after the watermark. Works on batches and streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), key, "n", "mean_value")
