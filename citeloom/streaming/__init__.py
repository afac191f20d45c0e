"""Counts over streams: the count cube's measures kept per time window and space with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(stream: DataFrame, time: str, keys: list[str], doc: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and distinct documents per window and keys; rows later than `late` are dropped by the watermark.

    Documents are counted exactly in two aggregations, by document and by window, whose states are both dropped when
    the window closes. Works alike on a static table and on a stream in append mode; null documents are not counted.
    """
    rows = stream.withWatermark(time, late)
    per_doc = rows.groupBy(F.window(time, width).alias("w"), *keys, doc).agg(F.count("*").alias("n"))
    counts = per_doc.groupBy("w", *keys).agg(F.sum("n").alias("ind"), F.count(doc).alias("doc"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "ind", "doc")
