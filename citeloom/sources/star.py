"""Reading star-schema tables as documents and references.

An order is a document, its lines are references, parts are works, brands cited authors, suppliers citing authors (in
order of their keys), priorities journals. Years are those of order and shipping; `period` counts the order's months
from January 1995 on and stands for the citing year where many years are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.operators.facts import citations
from citeloom.runtime import table


def documents(spark: SparkSession, folder: str, months: bool = False) -> DataFrame:
    orders = table(spark, folder, "orders")
    year = F.year("o_orderdate")
    time = ((year - 1995) * 12 + F.month("o_orderdate")) if months else year
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("authors"))
    docs = orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("fj"), time.cast("int").alias("fy"))
    return docs.join(lines, docs["doc"] == lines["l_orderkey"]).drop("l_orderkey")


def references(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return rows.select(
        F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("c"), F.col("p_brand").alias("ta"),
        F.year("l_shipdate").cast("int").alias("ty"), "l_suppkey", "l_shipdate", "l_quantity",
    )


def facts(spark: SparkSession, folder: str, months: bool = False) -> DataFrame:
    return citations(documents(spark, folder, months), references(spark, folder))
