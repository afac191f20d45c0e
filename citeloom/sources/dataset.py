"""Stored count tables: a folder of tidy Parquet partitioned by space, with JSON attributes, and slices of it."""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citeloom.operators import cube, trend
from citeloom.schema import dotted_space, entity, space


YEARS = frozenset(("fy", "ty", "c1y", "c2y", "cAge", "taAge", "ffaAge", "faAge", "c1age", "c2age"))  # entities that are numbers


class Slice:
    """One count table with some keys fixed and others free (None); immutable."""

    def __init__(self, counts: DataFrame, dotted: str, fixed: dict | None = None) -> None:
        self._counts, self._dims, self._fixed = counts, space(dotted), dict(fixed or {})

    def refine(self, **keys) -> Slice:
        """A slice with more keys fixed; None frees a key."""
        named = {entity(k): v for k, v in keys.items()}
        unknown = set(named) - set(self._dims)
        if unknown:
            raise KeyError(f"no {sorted(unknown)} in {self._dims}")
        merged = {k: v for k, v in (self._fixed | named).items() if v is not None}
        return Slice(self._counts, ".".join(self._dims), merged)

    def _matching(self) -> DataFrame:
        rows = self._counts
        for key, value in self._fixed.items():
            rows = rows.where(F.col(key) == value)
        return rows

    def rows(self) -> DataFrame:
        """Free keys and both measures; order it by the keys where it is shown."""
        return self._matching().select(*[d for d in self._dims if d not in self._fixed], "ind", "doc")

    def ordered(self) -> DataFrame:
        """The rows by their free keys."""
        return self.rows().orderBy(*[d for d in self._dims if d not in self._fixed])

    def value_row(self) -> DataFrame:
        """One row with both measures, 0 where nothing was counted."""
        return self._matching().agg(F.coalesce(F.sum("ind"), F.lit(0)).alias("ind"), F.coalesce(F.sum("doc"), F.lit(0)).alias("doc"))

    def value(self, measure: str = "ind") -> int:
        return self.value_row().head()[measure]


def search(counts: DataFrame, key: str, text: str, anywhere: bool = False) -> DataFrame:
    """Values of an entity that begin with a text, or hold it anywhere, without regard to case."""
    low = F.lower(F.col(entity(key)).cast("string"))
    return counts.where(F.contains(low, F.lit(text.lower())) if anywhere else F.startswith(low, F.lit(text.lower())))


class Dataset:
    """Count tables of one name below a root folder; any Hadoop file system will do."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self._groups: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.name}"

    def _path(self, tail: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{tail}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, counts: DataFrame, mode: str = "overwrite") -> None:
        """Write tidy counts (space, entity columns, ind, doc)."""
        self._tables.clear()
        counts.write.mode(mode).partitionBy("space").parquet(f"{self.folder}/counts")

    def save_variable(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/variables/{name}")

    def load_variable(self, name: str) -> DataFrame:
        path, fs = self._path(f"variables/{name}")
        if not fs.exists(path):
            raise KeyError(f"no variable {name!r} in {self.name!r}; there are {self.variables()}")
        return self.spark.read.parquet(path.toString())

    def variables(self) -> list[str]:
        path, fs = self._path("variables")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def set_attributes(self, **values) -> None:
        rows = [json.dumps(self.attributes() | values, sort_keys=True)]
        self.spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/attributes")

    def attributes(self) -> dict:
        path, fs = self._path("attributes")
        return json.loads(self.spark.read.text(path.toString()).head()[0]) if fs.exists(path) else {}

    def spaces(self) -> list[str]:
        path, fs = self._path("counts")
        found = fs.listStatus(path) if fs.exists(path) else []
        return sorted(s.getPath().getName().removeprefix("space=") for s in found if s.getPath().getName().startswith("space="))

    def by_raw(self, *keys: str) -> DataFrame:
        """The count table of a space as it is stored; only its folder is read. The plan is kept for the next call."""
        dotted = dotted_space(keys)
        if dotted not in self._tables:
            if dotted not in self.spaces():
                near = difflib.get_close_matches(dotted, self.spaces(), 3)
                raise KeyError(f"no counts of {dotted!r} in {self.name!r}; near: {near}")
            self._tables[dotted] = self.spark.read.parquet(f"{self.folder}/counts").where(F.col("space") == dotted).select(*space(dotted), "ind", "doc")
        return self._tables[dotted]

    def by(self, *keys: str) -> DataFrame:
        """The count table of a space, with values grouped where a grouping was added."""
        counts = self.by_raw(*keys)
        for column, groups in self._groups.items():
            if column in counts.columns:
                counts = cube.regroup_counts(counts, column, groups)
        return counts

    def by_or_empty(self, *keys: str) -> DataFrame:
        """The count table of a space, or an empty one of its columns where nothing was counted."""
        if keys and dotted_space(keys) in self.spaces():
            return self.by(*keys)
        columns = ", ".join(f"{c} {'int' if c in YEARS else 'string'}" for c in space(dotted_space(keys)))
        return self.spark.createDataFrame([], f"{columns}, ind bigint, doc bigint")

    def __contains__(self, keys: str) -> bool:
        return dotted_space(keys) in self.spaces()

    def __call__(self, **keys) -> Slice:
        """A slice by keys: fixed where a value is given, free where None."""
        dotted = dotted_space(keys)
        return Slice(self.by(*keys), dotted).refine(**keys)

    def items(self, key: str) -> DataFrame:
        return self.by(key).where("ind > 0").select(entity(key)).orderBy(entity(key))

    def search(self, key: str, text: str, anywhere: bool = False) -> DataFrame:
        return search(self.by(key), key, text, anywhere)

    def add_grouping(self, key: str, groups: DataFrame) -> None:
        """Groups (value, rep) that later reads apply to an entity."""
        self._groups[entity(key)] = groups

    def drop(self, keys: str) -> None:
        """Delete one count table."""
        self._tables.clear()
        path, fs = self._path(f"counts/space={dotted_space(keys)}")
        fs.delete(path, True)

    def drop_all(self, key: str) -> None:
        """Delete every count table that has an entity."""
        for dotted in self.spaces():
            if entity(key) in space(dotted):
                self.drop(dotted)

    def clear(self) -> None:
        path, fs = self._path("")
        fs.delete(path, True)

    def trend(self, key: str, measure: str = "ind", years: tuple[int, int] | None = None) -> DataFrame:
        """Dense yearly series of an entity, by default over the attributes `start` and `end`."""
        own = self.attributes()
        start, end = years if years is not None else (own["start"], own["end"])
        return trend.dense_series(self.by(key, "fy"), entity(key), start, end, measure)

    def save_trends(self, key: str, measure: str = "ind", years: tuple[int, int] | None = None) -> None:
        """The trends of all values of an entity, stored as the variable `<entity>.ysum`."""
        self.save_variable(f"{entity(key)}.ysum", trend.trend_stats(self.trend(key, measure, years), entity(key)))

    def save_all(self, fact: DataFrame, spaces: list[str] | tuple[str, ...], **attributes) -> None:
        """Count a fact over all spaces, replace what is stored and note the attributes."""
        self.clear()
        self.save(cube.count_spaces(fact, spaces))
        self.set_attributes(**attributes)

    def map_items(self, function: Callable, schema: str, *keys: str) -> DataFrame:
        """A pandas function over batches of a count table (key columns, ind, doc)."""
        return self.by(*keys).mapInPandas(function, schema)

    def where(self, condition: Column, *keys: str) -> DataFrame:
        return self.by(*keys).where(condition)


def catalogue(spark: SparkSession, root: str) -> dict[str, dict]:
    """Attributes of every dataset below a root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return {n: Dataset(spark, root, n).attributes() for n in sorted(names)}


def resolve(spark: SparkSession, root: str, wanted: str) -> Dataset:
    """A dataset by its name or by its attribute `doi`."""
    found = catalogue(spark, root)
    name = wanted if wanted in found else next((n for n, a in found.items() if a.get("doi") == wanted), None)
    if name is None:
        raise KeyError(f"no dataset {wanted!r}; near: {difflib.get_close_matches(wanted, found, 3)}")
    return Dataset(spark, root, name)
