"""Counting the relational tables doc, cit and keyword with filter lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Filter = Column | tuple


def predicate(entry: Filter) -> Column:
    """(column, [values]) is membership, (column, "abc*") contains without case, (column, "abc") equality, a Column itself."""
    if isinstance(entry, Column):
        return entry
    if isinstance(entry, tuple) and len(entry) == 2:
        name, wanted = entry
        if isinstance(wanted, (list, tuple, set)):
            return F.col(name).isin(*wanted)
        if isinstance(wanted, str):
            return F.contains(F.lower(name), F.lit(wanted[:-1].lower())) if wanted.endswith("*") else F.col(name) == wanted
        if isinstance(wanted, int):
            return F.col(name) == wanted
    raise TypeError(f"no filter: {entry!r}")


def filtered(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    for entry in filters:
        df = df.where(predicate(entry))
    return df


def documents_with_citations(doc: DataFrame, cit: DataFrame) -> DataFrame:
    """Inner join of documents and citations; columns of both, the citation's year as cited_year."""
    d = doc.select(F.col("id").alias("doc_id"), "first_author", "journal", F.col("year").alias("doc_year"))
    c = cit.select(F.col("id").alias("cit_id"), "doc_id", "full_ref", "author", F.col("year").alias("cited_year"))
    return c.join(d, "doc_id")


def count_table(joined: DataFrame, by: Sequence[str], documents: bool, filters: Sequence[Filter] = (), min_count: int = 0, years: tuple[int, int] | None = None) -> DataFrame:
    """Counts of citations or distinct documents by columns, at least `min_count`, within citing years if given."""
    rows = filtered(joined, filters)
    if years is not None:
        rows = rows.where(F.col("doc_year").between(*years))
    if documents:
        rows = rows.select(*by, "doc_id").distinct()
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def biggest(counts: DataFrame, n: int, key: str) -> DataFrame:
    """The `n` largest counts, ties by key."""
    return counts.orderBy(F.desc("n"), key).limit(n)


def zero_filled(counts: DataFrame, year: str, start: int, end: int) -> DataFrame:
    """Counts of every year of a span."""
    spine = counts.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias(year))
    return spine.join(counts, year, "left").select(year, F.coalesce("n", F.lit(0)).alias("n"))


def meet(left: DataFrame, right: DataFrame, keys: list[str], block: int = 2000) -> DataFrame:
    """An inner join whose hot keys are many tasks: a key with more than `block` rows on a side is cut into blocks there,
    and every block of one side meets every block of the other in a group of its own."""
    sizes = [df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for df, n in ((left, "_nl"), (right, "_nr"))]
    hot = sizes[0].join(sizes[1], keys).where("_nl > 1 or _nr > 1")  # at most one key for each `block` rows

    def placed(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        rows = df.join(hot, keys, "left").withColumn(i, F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int"))
        return rows.withColumn(j, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_nl", "_nr")

    return placed(left, "_nl", "_nr", "_i", "_j").join(placed(right, "_nr", "_nl", "_j", "_i"), [*keys, "_i", "_j"]).drop("_i", "_j")
