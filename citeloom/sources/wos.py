"""Reading bibliographic exports: tab-separated files, tagged text, and their documents and references."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from citeloom.functions.normalize import citing_authors, early_year, looks_like_research, parse_reference

TAGS = ("UT", "DT", "TI", "SO", "PY", "AU", "CR", "EA", "NR", "ID")


def _header(path: str) -> tuple[str | None, bool]:
    """(first line, whether the whole file is UTF-8), read in pieces."""
    system, inner = fs.FileSystem.from_uri(path)
    decoder, head, begun = codecs.getincrementaldecoder("utf-8")(), "", False
    with system.open_input_stream(inner) as stream:
        try:
            while block := stream.read(1 << 22):
                text = decoder.decode(block)
                if not begun:
                    head += text
                    begun = "\n" in text
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return None, False
    return re.split(r"\r?\n", head.removeprefix("\ufeff"), maxsplit=1)[0], True


def read_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all *.txt files below a folder: tab-separated with a header, quotes are text; a file that is not UTF-8 is left out whole.

    Files are grouped by their header, of which there are few, and each group is read by the splitting reader; empty
    cells and tags that a file lacks are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder).select("path")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_header(p) for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "head": [h if good else None for h, good in found]})

    kinds: dict[str, list[str]] = {}
    for r in files.repartition("path").mapInPandas(heads, "path string, head string").where("head is not null and head <> ''").collect():  # one line a file
        kinds.setdefault(r.head, []).append(r.path)
    parts = []
    for head, paths in sorted(kinds.items()):
        cells = [c.strip() for c in head.split("\t")]
        columns = ", ".join(f"c{i} string" for i in range(len(cells)))
        rows = spark.read.csv(sorted(paths), columns, sep="\t", quote="\u0000", header=True, maxColumns=1_000_000, maxCharsPerColumn=-1, enforceSchema=True, encoding="UTF-8")
        tags = [F.col(f"c{cells.index(t)}").alias(t) if t in cells else F.lit(None).cast("string").alias(t) for t in TAGS]
        parts.append(rows.select(F.col("_metadata.file_path").alias("path"), *tags))
    if not parts:
        return spark.createDataFrame([], "path string, " + ", ".join(f"{t} string" for t in TAGS))
    return reduce(DataFrame.unionByName, parts)


def read_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Records of tagged text: blank lines part records, two letters name a field, blanks or the same tag go on with it.

    Parts of a field are joined by semicolons. Records without SO are left out; `bad` marks those in which a tag
    comes back after another one.
    """
    read = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.txt")
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "^\ufeff", "").alias("line"))
    lines = lines.withColumn("blank", (F.trim(F.regexp_replace("line", "\t", " ")) == "").cast("int"))
    # Records are numbered by the blank lines before them: in a block of the file, and by the sums of the blocks before it.
    inside = Window.partitionBy("path", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.sum("blank").alias("blanks"))
    before = F.coalesce(F.sum("blanks").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("rec", F.coalesce(F.sum("blank").over(inside), F.lit(0))).join(blocks.select("path", "block", before.alias("offset")), ["path", "block"])
    lines = numbered.where("blank = 0").select("path", (F.col("rec") + F.col("offset")).alias("rec"), F.col("id").alias("no"), "line")
    lines = lines.select("path", "rec", "no", F.when(F.substring("line", 1, 2) != "  ", F.substring("line", 1, 2)).alias("own"), F.expr("substring(line, 4)").alias("value"))
    order = Window.partitionBy("path", "rec").orderBy("no")
    tagged = lines.withColumn("tag", F.last("own", ignorenulls=True).over(order)).where("tag is not null")
    runs = tagged.withColumn("new", F.coalesce((F.col("tag") != F.lag("tag").over(order)).cast("int"), F.lit(1)))
    fields = runs.groupBy("path", "rec", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "value"))), lambda x: x["value"]), ";").alias("value"), F.sum("new").alias("runs"))
    whole = fields.groupBy("path", "rec").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("m"), (F.max("runs") > 1).alias("bad"))
    return whole.where(F.col("m")["SO"].isNotNull()).select("path", F.col("rec").alias("no"), *[F.col("m")[t].alias(t) for t in TAGS], "bad")


def quality(records: DataFrame, kind: str = "Article") -> DataFrame:
    """The records with `reject`: why a record is no document, null where it is one."""
    reason = (
        F.when(F.coalesce(F.col("DT"), F.lit("")) != kind, "type").when(F.col("PY").try_cast("int").isNull(), "year")
        .when(F.coalesce(F.trim("AU"), F.lit("")) == "", "authors").when(F.coalesce(F.trim("CR"), F.lit("")) == "", "references")
        .when(~looks_like_research(F.coalesce("TI", F.lit(""))), "title")
    )
    return records.withColumn("reject", reason)


def documents(records: DataFrame, kind: str = "Article") -> DataFrame:
    """Documents of good quality: uid, doc, fj, fy, authors."""
    good = quality(records, kind).where("reject is null")
    rows = good.select(F.col("UT").alias("doc"), F.lower("SO").alias("fj"), F.col("PY").try_cast("int").alias("fy"), citing_authors(F.col("AU")).alias("authors"), "CR")
    return rows.where(F.size("authors") > 0)


def references(docs: DataFrame) -> DataFrame:
    """References of documents that have a year and a personal author: doc, pos, c, ta, ty, type."""
    raw = docs.select("doc", F.posexplode(F.split("CR", ";")).alias("pos", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    parsed = raw.withColumn("r", parse_reference(F.col("raw"))).where("r is not null")
    return parsed.select("doc", "pos", F.col("r.full_ref").alias("c"), F.col("r.author").alias("ta"), F.col("r.publish").alias("ty"), F.col("r.type").alias("type"))


def relational(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables doc, cit and keyword of records; the year falls back on the early-access date."""
    r = records.where("UT is not null")
    doc = r.select(F.col("UT").alias("id"), F.col("TI").alias("title"), F.get(citing_authors(F.col("AU")), F.lit(0)).alias("first_author"), F.lower("SO").alias("journal"), early_year(F.col("PY"), F.col("EA")).alias("year"), F.col("NR").try_cast("int").alias("citcnt_external"))
    cit = references(r.select(F.col("UT").alias("doc"), "CR")).select(F.col("doc").alias("doc_id"), F.col("c").alias("full_ref"), F.col("ta").alias("author"), F.col("ty").alias("year"))
    keyword = r.select(F.col("UT").alias("doc_id"), F.explode(F.split("ID", ";")).alias("text")).withColumn("text", F.lower(F.trim("text"))).where("text <> ''")
    return doc, cit, keyword


def survival(records: DataFrame) -> DataFrame:
    """Per file: rows, documents among them and their share: (path, n_rows, n_kept, kept_share)."""
    judged = quality(records).groupBy("path").agg(F.count("*").alias("n_rows"), F.count_if(F.col("reject").isNull()).alias("n_kept"))
    return judged.withColumn("kept_share", F.col("n_kept") / F.col("n_rows"))


def from_sound_files(records: DataFrame, least_share: float = 0.1, least_rows: int = 100) -> DataFrame:
    """The records without files of more than `least_rows` rows of which fewer than `least_share` are documents."""
    poor = survival(records).where((F.col("n_rows") > least_rows) & (F.col("kept_share") < least_share)).select("path")
    return records.join(poor, "path", "left_anti")


def save_relational(records: DataFrame, folder: str) -> None:
    """The tables doc, cit and keyword as Parquet below a folder, each committed as a whole."""
    for name, rows in zip(("doc", "cit", "keyword"), relational(records)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
