"""Per-key results where a few keys hold most rows.

Every aggregate here is algebraic, so Spark's own hash aggregation builds a bounded table per input partition, spills
what does not fit and shuffles one compact state per key and partition: a key with a third of all rows costs the
reducer as many states as there are input partitions, not as many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def profile_by_key(df: DataFrame, key: str, aggregates: Sequence[Column]) -> DataFrame:
    """One row per non-null key with algebraic aggregates (sum, count, min, max, avg, bit_or ...).

    Null keys are left out; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def distinct_by_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Exact count of distinct values per key in two algebraic steps.

    The first step shuffles by (key, value), which spreads a hot key over all reducers; the second sees one partial
    count per key and reducer. Null keys are left out, null values are not counted.
    """
    pairs = df.where(F.col(key).isNotNull()).select(key, value).distinct()
    return pairs.groupBy(key).agg(F.count(value).alias(name))


def stacked_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (field, key_value, n) for several key columns in one pass over the table."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields])
    return (
        df.select(F.explode(entries).alias("e"))
        .select("e.field", "e.key_value")
        .where(F.col("key_value").isNotNull())
        .groupBy("field", "key_value")
        .agg(F.count("*").alias("n"))
    )


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """Keys that hold at least `share` of a field's non-null rows: (field, key_value, n, total).

    Duplicate rows count as they are. The totals are one row per field, hence safe to broadcast. An empty table or an
    all-null field gives no rows; empty strings are keys like any other.
    """
    counts = stacked_counts(df, fields)
    totals = df.agg(*[F.count(f).alias(f) for f in fields]).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("total")) for f in fields])).alias("t")
    ).select("t.field", "t.total")
    return counts.join(F.broadcast(totals), "field").where(F.col("n") >= F.lit(share) * F.col("total"))
