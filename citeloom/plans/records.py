"""Queries of the operators on records: packed values, bad rows, nested records, hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.operators.hotkeys import distinct_by_key, heavy_keys, profile_by_key
from citeloom.operators.nested import contributions, flat_table, schema_graph, shred
from citeloom.operators.packed import WOS_FIELDS, latest_records, split_packed
from citeloom.operators.rejects import FIRST_YEAR, LAST_YEAR, MISSING_WORDS, MONTHS, TAGS, bad_lines, classify_lines, good_records
from citeloom.runtime import table

HEAVY_SHARE = 0.01


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return bad_lines(classify_lines(table(spark, folder, "wos_line")))


def p4_good(spark: SparkSession, folder: str) -> DataFrame:
    return good_records(classify_lines(table(spark, folder, "wos_line")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return contributions(table(spark, folder, "jstor_entry")).drop("id")


def p5_contributors(spark: SparkSession, folder: str) -> DataFrame:
    # Entries listed twice are alike; if they are not, the smaller text counts.
    entries = table(spark, folder, "jstor_entry").groupBy("entry_name").agg(F.min("metadata_xml").alias("metadata_xml"))
    rows = shred(entries, "entry_name", "metadata_xml", schema_graph(entries, "metadata_xml"))
    return flat_table(rows, "contrib", {"contrib_type": "@contrib-type", "role": "role"})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "cit"), ["full_ref", "author"], HEAVY_SHARE).select("field", "key_value")


def p6_per_work(spark: SparkSession, folder: str) -> DataFrame:
    cit = table(spark, folder, "cit")
    rows = profile_by_key(
        cit, "full_ref",
        [F.count("*").alias("n_rows"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("author").alias("n_author")],
    )
    return rows.join(distinct_by_key(cit, "full_ref", "doc_id", "n_docs"), "full_ref")


def p6_per_author(spark: SparkSession, folder: str) -> DataFrame:
    cit = table(spark, folder, "cit")
    rows = profile_by_key(cit, "author", [F.count("*").alias("n_rows"), F.min("year").alias("first_year"), F.max("year").alias("last_year")])
    return rows.join(distinct_by_key(cit, "author", "full_ref", "n_works"), "author")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p4_good, p5_found, p5_contributors, p6_found, p6_per_work, p6_per_author)
}

_FIELD = '("([^"]|"")*"|([^"\\t][^\\t]*)?)'
_NAMED, _SLASHED = r"([A-Za-z]{3})\.?(?: +(\d{1,2}),?)? +(\d{4})", r"(\d{1,2})/(\d{1,2})/(\d{4})"
_TRIED = "TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) IS NOT NULL"
_LINES = rf"""
    WITH t AS (SELECT line_id, regexp_replace(raw_line, '\r$', '') AS x FROM wos_line WHERE raw_line IS NOT NULL AND line_no <> 1),
    q AS (SELECT *, regexp_full_match(x, '{_FIELD}(\t{_FIELD})*') AS sound, regexp_extract_all(chr(9) || x, '\t("(?:[^"]|"")*"|[^\t]*)', 1) AS p
          FROM t WHERE trim(x) <> '' AND x <> '{chr(9).join(TAGS)}'),
    f AS (SELECT *, [CASE WHEN starts_with(c, '"') AND length(c) > 1 THEN replace(substring(c, 2, length(c) - 2), '""', '"') ELSE c END FOR c IN p] AS v FROM q),
    e AS (SELECT *, sound AND len(p) = 10 AS ok, trim(v[5]) AS py, trim(v[8]) AS ea, trim(regexp_replace(lower(v[6]), '[^\p{{L}}]+', ' ', 'g')) AS au FROM f),
    m AS (SELECT *, CAST(list_position({list(MONTHS)}, upper(regexp_extract(ea, '{_NAMED}', 1))) AS VARCHAR) AS mon,
          coalesce(nullif(regexp_extract(ea, '{_NAMED}', 2), ''), '1') AS md FROM e),
    d AS (SELECT *, CASE WHEN regexp_full_match(ea, '{_NAMED}') THEN {_TRIED.format(y=f"regexp_extract(ea, '{_NAMED}', 3)", m="mon", d="md")}
          WHEN regexp_full_match(ea, '{_SLASHED}') THEN {_TRIED.format(y=f"regexp_extract(ea, '{_SLASHED}', 3)", m=f"regexp_extract(ea, '{_SLASHED}', 1)", d=f"regexp_extract(ea, '{_SLASHED}', 2)")}
          ELSE false END AS dated FROM m),
    r AS (SELECT *, CASE WHEN NOT sound THEN ['quoting'] WHEN NOT ok THEN ['columns'] ELSE list_filter([
          CASE WHEN NOT ((regexp_full_match(py, '\d{{4}}') AND coalesce(TRY_CAST(py AS INT), 0) BETWEEN {FIRST_YEAR} AND {LAST_YEAR}) OR (py = '' AND ea <> '' AND dated)) THEN 'py' END,
          CASE WHEN ea <> '' AND NOT dated THEN 'ea' END, CASE WHEN au = '' OR au IN {MISSING_WORDS} THEN 'au' END], lambda z: z IS NOT NULL) END AS reasons FROM d)"""

SQL: dict[str, str] = {
    "p4_found": _LINES + " SELECT line_id, unnest(reasons) AS reason FROM r",
    "p4_good": _LINES + f""" SELECT line_id, {', '.join(f"v[{i + 1}] AS {t.lower()}" for i, t in enumerate(TAGS) if t != 'PY')}, TRY_CAST(py AS INT) AS py FROM r WHERE len(reasons) = 0""",
    "p6_found": """
        WITH s AS (SELECT 'full_ref' AS field, full_ref AS key_value FROM cit UNION ALL SELECT 'author', author FROM cit),
        c AS (SELECT field, key_value, count(*) AS n FROM s WHERE key_value IS NOT NULL GROUP BY 1, 2)
        SELECT field, key_value FROM c JOIN (SELECT field, sum(n) AS total FROM c GROUP BY 1) t USING (field)
        WHERE n >= 0.01 * total""",
    "p6_per_work": """
        SELECT full_ref, count(*) AS n_rows, min(year) AS first_year, max(year) AS last_year, count(author) AS n_author,
               count(DISTINCT doc_id) AS n_docs
        FROM cit WHERE full_ref IS NOT NULL GROUP BY 1""",
    "p6_per_author": """
        SELECT author, count(*) AS n_rows, min(year) AS first_year, max(year) AS last_year, count(DISTINCT full_ref) AS n_works
        FROM cit WHERE author IS NOT NULL GROUP BY 1""",
}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    records = latest_records(table(spark, folder, "wos_record").select("ut", "au", "cr", "id", "loaded_at"))
    rows = split_packed(records, "_own", WOS_FIELDS)
    return rows.select(F.when(~F.startswith("_own", F.lit("\u0000")), F.col("_own")).alias("ut"), "field", "pos", "item")


QUERIES = {"p1_found": p1_found} | QUERIES
