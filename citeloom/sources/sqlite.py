"""Tables of an SQLite file in a folder that all workers see, read by ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table with the columns of `schema`, in `parts` ranges of its row ids; an empty table gives no rows."""
    quoted = '"' + table.replace('"', '""') + '"'
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    columns = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    with closing(_connect(path)) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)
    ranges = spark.createDataFrame([(a, min(a + step, high + 1)) for a in range(low, high + 1, step)], "low bigint, high bigint")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["low"], batch["high"]):
                with closing(_connect(path)) as db:
                    cursor = db.execute(f"SELECT {columns} FROM {quoted} WHERE rowid >= ? AND rowid < ?", (int(a), int(b)))
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names, dtype=object)

    return ranges.repartition(parts, "low").mapInPandas(read, schema)
