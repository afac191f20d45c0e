"""Fact relations that all counts are grouped from.

An input is a document table (doc, fj, fy, authors ARRAY) and a reference table (doc, c, ta, ty); the facts are
    citations          one row per reference: doc, c, ta, ty, fy, fj, ffa
    by_author          citations times each citing author: fa
    aged               citations with the ages of work, cited author and first author
    reference_pairs    pairs of references of a document in their order, with ages
    cocitations        pairs of works of a document, first smaller
    coauthors          ordered pairs of authors of a document
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UNBORN = 2050  # birth of what was never born, and the latest birth there is


def citations(docs: DataFrame, refs: DataFrame, keep: Column | None = None) -> DataFrame:
    """One row per surviving reference; `keep` is a predicate on the joined row."""
    rows = refs.join(docs, "doc").withColumn("ffa", F.get("authors", F.lit(0)))
    rows = rows if keep is None else rows.where(keep)
    return rows.select("doc", "c", "ta", "ty", "fy", "fj", "ffa", "authors")


def keep_values(cited: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose `column` is among the values of the one-column table `allowed`."""
    return cited.join(allowed.toDF(column).distinct(), column, "left_semi").select(*cited.columns)


def drop_values(cited: DataFrame, column: str, banned: DataFrame) -> DataFrame:
    """Rows whose `column` is not among the values of `banned`; null values stay."""
    return cited.join(banned.toDF(column).where(F.col(column).isNotNull()).distinct(), column, "left_anti").select(*cited.columns)


def skipped(cited: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """How many rows `keep_values` leaves out: one row, n."""
    return cited.join(allowed.toDF(column).distinct(), column, "left_anti").agg(F.count("*").alias("n"))


def by_author(cited: DataFrame) -> DataFrame:
    return cited.withColumn("fa", F.explode("authors"))


def births(cited: DataFrame, key: str) -> DataFrame:
    """First citing year of each key, at most UNBORN: (key, birth)."""
    return cited.where(F.col(key).isNotNull()).groupBy(key).agg(F.least(F.min("fy"), F.lit(UNBORN)).alias("birth"))


def aged(cited: DataFrame) -> DataFrame:
    """Citations with cAge, taAge and ffaAge. The birth tables are aggregates; the optimizer joins them by their size."""
    out = cited
    for key in ("c", "ta", "ffa"):
        out = out.join(births(cited, key).withColumnRenamed("birth", f"{key}_birth"), key)
        out = out.withColumn(f"{key}Age", F.col("fy") - F.col(f"{key}_birth")).drop(f"{key}_birth")
    return out


def aged_by_author(cited: DataFrame) -> DataFrame:
    """`aged` times each citing author; an author is born with the first document they lead."""
    born = births(cited, "ffa").select(F.col("ffa").alias("fa"), F.col("birth").alias("fa_birth"))
    rows = by_author(aged(cited)).join(born, "fa", "left")
    return rows.withColumn("faAge", F.col("fy") - F.coalesce("fa_birth", F.lit(UNBORN))).drop("fa_birth")


def _ranked(cited: DataFrame, order: list[str]) -> DataFrame:
    return cited.withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))


def reference_pairs(cited: DataFrame, order: list[str]) -> DataFrame:
    """Pairs of a document's references, earlier and later: doc, c1age, c2age."""
    rows = _ranked(aged(cited), order).select("doc", "pos", "cAge")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, "doc").where("a.pos < b.pos")
    return pairs.select("doc", F.col("a.cAge").alias("c1age"), F.col("b.cAge").alias("c2age"))


def top_works(cited: DataFrame, n: int = 1000) -> DataFrame:
    """The works of most documents, ties by work: (c)."""
    docs = cited.select("doc", "c").distinct().groupBy("c").agg(F.count("*").alias("n"))
    return docs.orderBy(F.desc("n"), "c").limit(n).select("c")


def cocitations(cited: DataFrame, works: int = 1000) -> DataFrame:
    """Pairs of a document's references among the top works, first work smaller: doc, c1, c2, c1y, c2y."""
    rows = cited.join(F.broadcast(top_works(cited, works)), "c", "left_semi").select("doc", "c", "ty")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, "doc").where("a.c < b.c")
    return pairs.select("doc", F.col("a.c").alias("c1"), F.col("b.c").alias("c2"), F.col("a.ty").alias("c1y"), F.col("b.ty").alias("c2y"))


def coauthors(docs: DataFrame) -> DataFrame:
    """Ordered pairs of different authors of a document, in both directions: doc, fa1, fa2."""
    pairs = docs.select("doc", "authors", F.explode("authors").alias("fa1")).select("doc", "fa1", F.explode("authors").alias("fa2"))
    return pairs.where("fa1 <> fa2")
