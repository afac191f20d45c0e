"""Two-way tables over count cubes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _axis(spark: SparkSession, name: str, values: Sequence, like: DataFrame) -> DataFrame:
    field = like.schema[name]
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {field.dataType.simpleString()}")


def matrix(counts: DataFrame, rows: tuple[str, Sequence], columns: tuple[str, Sequence], measure: str = "ind", keep: Column | None = None) -> DataFrame:
    """Cells of two value lists, 0 where nothing was counted: row key, column key, measure.

    The spine is the product of the two given lists, whose sizes the caller sets; negative ages and whatever `keep`
    rejects are not counted.
    """
    (r, rv), (c, cv) = rows, columns
    spark = counts.sparkSession
    spine = _axis(spark, r, rv, counts).join(F.broadcast(_axis(spark, c, cv, counts)))
    cells = counts.where(F.col(r).isin(*rv) & F.col(c).isin(*cv))
    cells = (cells if keep is None else cells.where(keep)).groupBy(r, c).agg(F.sum(measure).alias(measure))
    return spine.join(cells, [r, c], "left").select(r, c, F.coalesce(measure, F.lit(0)).alias(measure))


def normalised(cells: DataFrame, by: str, measure: str = "ind") -> DataFrame:
    """Cells by the sum of their row or column; null where that is 0."""
    total = F.sum(measure).over(Window.partitionBy(by))
    return cells.withColumn("share", F.try_divide(F.col(measure), total))


def complemented(counts: DataFrame, rows: tuple[str, Sequence], columns: tuple[str, Sequence], measure: str = "ind", other: str = "other") -> DataFrame:
    """Cells with a row and a column that hold all other values."""
    (r, rv), (c, cv) = rows, columns
    label = lambda k, vs: F.when(F.col(k).isin(*vs), F.col(k).cast("string")).otherwise(F.lit(other))
    return counts.where(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(label(r, rv).alias(r), label(c, cv).alias(c)).agg(F.sum(measure).alias(measure))


def without_cohorts(cells: DataFrame, year: str, age: str, cohorts: Sequence[int], measure: str = "ind", oldest: int | None = None) -> DataFrame:
    """Cells of the given birth cohorts (year - age) set to 0; with `oldest`, the largest age of the axis, only ages from 0 up to `oldest` - 2."""
    born = (F.col(year) - F.col(age)).isin(*cohorts)
    inside = F.lit(True) if oldest is None else (F.col(age) >= 0) & (F.col(age) < oldest - 1)
    return cells.withColumn(measure, F.when(born & inside, F.lit(0)).otherwise(F.col(measure)))


def wide(cells: DataFrame, row: str, column: str, values: Sequence, measure: str = "ind") -> DataFrame:
    """One column per value of `column`."""
    return cells.groupBy(row).pivot(column, list(values)).agg(F.sum(measure)).na.fill(0)
