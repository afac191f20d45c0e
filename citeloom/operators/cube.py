"""Counting facts over spaces with two measures: rows (`ind`) and distinct documents (`doc`)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.schema import dotted_space, space

BATCH = 8  # spaces of one grouping-sets pass: each multiplies the rows that are expanded


def count_space(fact: DataFrame, dotted: str) -> DataFrame:
    """Counts over one space: its columns, ind, doc.

    The distinct count is taken in two steps, by (space, document) and by space, so that a value met in a third of all
    rows is spread over all tasks by its documents.
    """
    dims = list(space(dotted))
    per_doc = fact.groupBy(*dims, "doc").agg(F.count("*").alias("n"))
    return per_doc.groupBy(*dims).agg(F.sum("n").alias("ind"), F.count("doc").alias("doc"))


def count_spaces(fact: DataFrame, spaces: Sequence[str]) -> DataFrame:
    """Counts over several spaces in tidy form: space, one column per entity (null where it is not in the space), ind, doc."""
    entities = sorted({e for s in spaces for e in space(s)})
    parts = []
    for lo in range(0, len(spaces), BATCH):
        batch = [space(s) for s in spaces[lo : lo + BATCH]]
        dims = sorted({e for s in batch for e in s})
        # grouping_id has a bit per column, set where the column is grouped away; nulls in the data stay apart.
        sets = [[F.col(e) for e in s] + [F.col("doc")] for s in batch]
        per_doc = fact.select("doc", *dims).groupingSets(sets, *[F.col(d) for d in dims], F.col("doc")).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        names = {sum(1 << (len(dims) - k) for k, d in enumerate(dims) if d not in s): dotted_space(s) for s in batch}
        label = reduce(lambda c, kv: c.when(F.col("g") == kv[0], F.lit(kv[1])), names.items(), F.when(F.lit(False), F.lit("")))
        per = per_doc.withColumn("space", label).groupBy("space", *dims).agg(F.sum("n").alias("ind"), F.count("doc").alias("doc"))
        missing = [F.lit(None).cast(fact.schema[e].dataType).alias(e) for e in entities if e not in dims]
        parts.append(per.select("space", *dims, *missing, "ind", "doc").select("space", *entities, "ind", "doc"))
    return reduce(DataFrame.unionByName, parts)


def weighted_count(fact: DataFrame, dotted: str, weight: Column) -> DataFrame:
    """Sum of a weight over a space: its columns, value."""
    return fact.groupBy(*space(dotted)).agg(F.sum(weight).alias("value"))


def collapse(counts: DataFrame, by: Mapping[str, Column], measure: str = "ind", keep: Column | None = None) -> DataFrame:
    """Filter a count table and sum a measure by derived keys."""
    rows = counts if keep is None else counts.where(keep)
    return rows.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.sum(measure).alias(measure))


def regroup(fact: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """The fact with values of `column` replaced by their representative; `groups` is (value, rep), others stay."""
    found = fact.join(groups.select(F.col("value").alias(column), "rep"), column, "left")
    return found.withColumn(column, F.coalesce("rep", column)).drop("rep")


def regroup_counts(counts: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """Counts summed again by representative: documents that cite two members count twice (see `regroup` for the exact way)."""
    dims = [c for c in counts.columns if c not in ("ind", "doc")]
    return regroup(counts, column, groups).groupBy(*dims).agg(F.sum("ind").alias("ind"), F.sum("doc").alias("doc"))
