"""Loading delimited lines while setting bad ones apart with their reasons.

The lines are parsed permissively under an explicit schema that keeps the raw text of corrupt ones. All fields come
from the parsed struct. What the parser calls corrupt, and lines with quotes, of which it is known to be lenient, are
reclassified from their raw text: broken quoting first, else a wrong number of fields. Casts are checked on the fields
of the others. All of it runs inside the JVM without a shuffle, and each step is worked out once for a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions.text import once

TAGS = ("UT", "DT", "TI", "SO", "PY", "AU", "CR", "EA", "NR", "ID")
FIRST_YEAR, LAST_YEAR = 1900, 2026

# English month abbreviations of early-access dates.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Words that stand for a missing name, compared in lower case without punctuation and blanks.
MISSING_WORDS = (
    "anon", "anonymous", "author unknown", "missing", "n a", "na", "nan", "nil", "no author", "no authors",
    "no author given", "no name", "none", "none given", "none listed", "not available", "not given", "not known",
    "not listed", "not stated", "null", "ref", "unknown", "unknown author", "unnamed", "not applicable", "undefined",
)

_FIELD = r'(?:"(?:[^"]++|"")*+"(?=\t|$)|(?!")[^\t]*+)'
_LINE = rf"^{_FIELD}(?:\t{_FIELD})*+$"
MOST_COLUMNS = 20_000  # the parser stops a job at 20,480 columns; lines with more tabs, or with line ends inside, are cut by `_PIECES`
_PIECES = r'''regexp_extract_all(_text, '(?:^|\\t)("(?:[^"]++|"")*+"(?=\\t|$)|[^\\t]*+)', 1)'''


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(name)).cast("int")


def usable_date(text: Column) -> Column:
    """Whether a text is an existing date: month and year, month, day and year, or month/day/year."""
    t = F.trim(text)
    named = r"^([A-Za-z]{3})\.?(?: +(\d{1,2}),?)? +(\d{4})$"
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    day = F.regexp_extract(t, named, 2)
    first = F.try_make_timestamp(
        F.regexp_extract(t, named, 3).try_cast("int"), _month(F.regexp_extract(t, named, 1)),
        F.when(day == "", 1).otherwise(day.try_cast("int")), F.lit(0), F.lit(0), F.lit(0),
    )
    second = F.try_make_timestamp(
        F.regexp_extract(t, slashed, 3).try_cast("int"), F.regexp_extract(t, slashed, 1).try_cast("int"),
        F.regexp_extract(t, slashed, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0),
    )
    return (
        F.when(t.rlike(named), first.isNotNull() & (_month(F.regexp_extract(t, named, 1)) > 0))
        .when(t.rlike(slashed), second.isNotNull())
        .otherwise(False)
    )


def names_nobody(text: Column) -> Column:
    """Whether an author field is empty, has no letter or is only a word for a missing value."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    return (plain == "") | plain.isin(*MISSING_WORDS)


def classify_lines(df: DataFrame, line: str = "raw_line", line_no: str = "line_no") -> DataFrame:
    """Each data line with its raw text, parsed fields and reasons: the input columns plus `fields` and `reasons`.

    Header lines (line 1 of a file, or a line that repeats the tags) and blank or null lines are left out. `fields`
    is a struct of the ten tags, null where the line could not be read; `reasons` is empty for a good line; columns of the input
    with these names give way. Repeated rows are kept, any length of line is read whole, an empty table gives no rows.
    """
    schema = ", ".join(f"`{t}` STRING" for t in TAGS) + ", `_corrupt` STRING"
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "maxCharsPerColumn": "-1"}
    text = F.regexp_replace(F.col(line), r"\r$", "")
    # Numbered names keep the input's columns apart from those that are made here.
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = df.where(F.col(line).isNotNull() & (F.coalesce(F.col(line_no), F.lit(0)) != 1)).select(*numbered, text.alias("_text"))
    rows = rows.where((F.trim("_text") != "") & (F.col("_text") != "\t".join(TAGS)))
    readable = (F.length("_text") - F.length(F.replace("_text", F.lit("\t"), F.lit(""))) < MOST_COLUMNS) & ~F.contains("_text", F.lit("\n"))
    parsed = once(rows, csv=F.from_csv(F.when(readable, F.col("_text")), schema, options), read=readable)
    csv = F.col("_once.csv")
    doubtful = csv["_corrupt"].isNotNull() | F.contains("_text", F.lit('"')) | ~F.col("_once.read")
    parsed = once(parsed, "_case", quoting=doubtful & ~F.col("_text").rlike(_LINE), pieces=F.when(~F.col("_once.read"), F.expr(_PIECES)))
    quoting, pieces = F.col("_case.quoting"), F.col("_case.pieces")
    # With sound quoting the parser is only at odds with the number of fields.
    columns = ~quoting & F.when(F.col("_once.read"), csv["_corrupt"].isNotNull()).otherwise(F.size(pieces) != len(TAGS))

    def bare(f: Column) -> Column:
        return F.when(F.startswith(f, F.lit('"')) & (F.length(f) > 1), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)

    fields = F.struct(*[F.when(F.col("_once.read"), F.coalesce(csv[t], F.lit(""))).otherwise(bare(F.get(pieces, F.lit(i)))).alias(t) for i, t in enumerate(TAGS)])
    read = once(parsed, "_line", columns=columns, fields=F.when(~quoting & ~columns, fields))
    at, year = F.col("_line.fields"), F.trim("_line.fields.PY")
    ok, has_ea = at.isNotNull(), F.trim("_line.fields.EA") != ""
    read = once(read, "_ea", good=F.when(ok & has_ea, usable_date(at["EA"])))  # null without a date
    good_year = year.rlike(r"^\d{4}$") & year.try_cast("int").between(FIRST_YEAR, LAST_YEAR)
    reasons = F.array_compact(
        F.array(
            F.when(quoting, F.lit("quoting")),
            F.when(F.col("_line.columns"), F.lit("columns")),
            F.when(ok & ~(F.coalesce(good_year, F.lit(False)) | ((year == "") & F.coalesce("_ea.good", F.lit(False)))), F.lit("py")),
            F.when(ok & ~F.col("_ea.good"), F.lit("ea")),
            F.when(ok & names_nobody(at["AU"]), F.lit("au")),
        )
    )
    # The permissive parser's own verdict stays as evidence beside the reasons.
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c not in ("fields", "parser_corrupt", "reasons")]
    return read.select(*kept, at.alias("fields"), csv["_corrupt"].alias("parser_corrupt"), reasons.alias("reasons"))


def bad_lines(classified: DataFrame, line_id: str = "line_id") -> DataFrame:
    """One row per bad line and reason: (line_id, reason)."""
    return classified.select(line_id, F.explode("reasons").alias("reason"))


def good_records(classified: DataFrame, line_id: str = "line_id") -> DataFrame:
    """The valid rows with their tags as columns and the year as a number."""
    return classified.where(F.size("reasons") == 0).select(
        line_id, *[F.col(f"fields.{t}").alias(t.lower()) for t in TAGS if t != "PY"], F.trim(F.col("fields.PY")).try_cast("int").alias("py")
    )
