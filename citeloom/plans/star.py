"""Count, trend, matrix and slice queries over the star-schema tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.operators import cube, facts, matrix, trend
from citeloom.schema import checked_space, dotted_space
from citeloom.sources import star
from citeloom.sources.dataset import Slice, search

Query = Callable[[SparkSession, str], DataFrame]

CITATION_SPACES = ("fj", "fy", "ty", "c.fy", "c.fj", "fj.fy", "c", "fy.ty", "fj.ty", "ta", "fy.ta", "fj.ta", "c.fj.fy", "ffa", "ffa.fy", "ffa.fj", "c.ffa")
AUTHOR_SPACES = ("fa", "fa.fy", "fa.fj", "c.fa")
AGE_SPACES = ("cAge.fj", "cAge.ffa", "ffaAge", "ffaAge.ta", "ffaAge.fy.ta", "ffaAge.taAge", "cAge.ffaAge", "cAge.fy", "fy.taAge", "ffaAge.fy")
AUTHOR_AGE_SPACES = ("cAge.fa", "faAge", "faAge.ta", "faAge.fy.ta", "faAge.taAge", "cAge.faAge", "faAge.fy")
FIRST, LAST = 1, 80  # months of the data

_FACTS = """
    au AS (SELECT l_orderkey AS doc, list_sort(list(DISTINCT l_suppkey)) AS authors FROM lineitem GROUP BY 1),
    d AS (SELECT o_orderkey AS doc, o_orderpriority AS fj, CAST({time} AS INT) AS fy, authors FROM orders JOIN au ON au.doc = o_orderkey),
    f1 AS (SELECT d.doc, l_partkey AS c, p_brand AS ta, CAST(year(l_shipdate) AS INT) AS ty, fy, fj, authors[1] AS ffa, authors, l_shipdate, l_suppkey, l_quantity
           FROM lineitem JOIN d ON d.doc = l_orderkey JOIN part ON p_partkey = l_partkey),
    f2 AS (SELECT *, unnest(authors) AS fa FROM f1),
    bc AS (SELECT c, least(min(fy), 2050) AS b FROM f1 GROUP BY 1), bt AS (SELECT ta, least(min(fy), 2050) AS b FROM f1 GROUP BY 1),
    bf AS (SELECT ffa, least(min(fy), 2050) AS b FROM f1 GROUP BY 1),
    f3 AS (SELECT f1.*, fy - bc.b AS cAge, fy - bt.b AS taAge, fy - bf.b AS ffaAge FROM f1 JOIN bc USING (c) JOIN bt USING (ta) JOIN bf USING (ffa)),
    f4 AS (SELECT x.*, fy - coalesce(bf.b, 2050) AS faAge FROM (SELECT *, unnest(authors) AS fa FROM f3) x LEFT JOIN bf ON bf.ffa = x.fa)"""
YEARS = "WITH" + _FACTS.format(time="year(o_orderdate)")
MONTHS = "WITH" + _FACTS.format(time="(year(o_orderdate) - 1995) * 12 + month(o_orderdate)")


def _counts_sql(head: str, fact: str, dims: tuple[str, ...]) -> str:
    cols = ", ".join(f'"{d}"' for d in dims)
    return f"{head} SELECT {cols}, count(*) AS ind, count(DISTINCT doc) AS doc FROM {fact} GROUP BY {cols}"


def _space_queries() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    groups: tuple[tuple[str, tuple[str, ...], bool, str, Callable[[DataFrame], DataFrame]], ...] = (
        ("cnt", CITATION_SPACES, False, "f1", lambda f: f), ("cnt", AUTHOR_SPACES, False, "f2", facts.by_author),
        ("age", AGE_SPACES, True, "f3", facts.aged), ("age", AUTHOR_AGE_SPACES, True, "f4", facts.aged_by_author),
    )
    for prefix, spaces, months, fact, build in groups:
        for dotted in spaces:
            name = f"{prefix}_{dotted.replace('.', '_')}"
            queries[name] = lambda spark, folder, s=dotted, m=months, b=build: cube.count_space(b(star.facts(spark, folder, m)), s)
            sql[name] = _counts_sql(MONTHS if months else YEARS, fact, checked_space(dotted))
    return queries, sql


QUERIES, SQL = _space_queries()


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@_query(YEARS + " " + " UNION ALL ".join(
    f"""SELECT '{s}' AS space, {', '.join(c if c in s.split('.') else f'NULL AS {c}' for c in ('c', 'fj', 'fy', 'ty'))}, count(*) AS ind, count(DISTINCT doc) AS doc
    FROM f1 GROUP BY {', '.join(s.split('.'))}""" for s in CITATION_SPACES[:7]
))
def cube_core(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_spaces(star.facts(spark, folder), CITATION_SPACES[:7])


@_query(MONTHS + """, r AS (SELECT doc, cAge, row_number() OVER (PARTITION BY doc ORDER BY c, l_suppkey, l_shipdate, l_quantity) AS pos FROM f3)
    SELECT a.cAge AS c1age, b.cAge AS c2age, count(*) AS ind, count(DISTINCT a.doc) AS doc FROM r a JOIN r b ON a.doc = b.doc AND a.pos < b.pos GROUP BY 1, 2""")
def refpair_age(spark: SparkSession, folder: str) -> DataFrame:
    refs = star.references(spark, folder)
    docs = star.documents(spark, folder, months=True)
    return cube.count_space(facts.reference_pairs(facts.citations(docs, refs), ["c", "ta", "ty"]), "c1age.c2age")


_TOP = """, top AS (SELECT c FROM f1 GROUP BY c ORDER BY count(DISTINCT doc) DESC, c LIMIT 1000), k AS (SELECT f1.* FROM f1 JOIN top USING (c)),
    p AS (SELECT a.doc, a.c AS c1, b.c AS c2, a.ty AS c1y, b.ty AS c2y FROM k a JOIN k b ON a.doc = b.doc AND a.c < b.c)"""


@_query(_counts_sql(YEARS + _TOP, "p", ("c1", "c2")))
def cocit_works(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(facts.cocitations(star.facts(spark, folder)), "c1.c2")


@_query(_counts_sql(YEARS + _TOP, "p", ("c1y", "c2y")))
def cocit_years(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(facts.cocitations(star.facts(spark, folder)), "c1y.c2y")


@_query(YEARS + """, x AS (SELECT doc, unnest(authors) AS fa FROM d)
    SELECT a.fa AS fa1, b.fa AS fa2, count(*) AS ind, count(DISTINCT a.doc) AS doc FROM x a JOIN x b ON a.doc = b.doc AND a.fa <> b.fa GROUP BY 1, 2""")
def coauthors(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(facts.coauthors(star.documents(spark, folder)), "fa1.fa2")


@_query(YEARS + " SELECT fj, fy, count(*) AS ind, count(DISTINCT doc) AS doc FROM f1 WHERE ty - fy <= 0 AND fj <> '5-LOW' GROUP BY 1, 2")
def kept_references(spark: SparkSession, folder: str) -> DataFrame:
    docs, refs = star.documents(spark, folder), star.references(spark, folder)
    return cube.count_space(facts.citations(docs, refs, keep=(F.col("ty") <= F.col("fy")) & (F.col("fj") != "5-LOW")), "fj.fy")


@_query(YEARS + " SELECT count(*) AS n FROM f1 WHERE c NOT IN (SELECT c FROM f1 GROUP BY c HAVING count(*) >= 30)")
def whitelist_skipped(spark: SparkSession, folder: str) -> DataFrame:
    rows = star.facts(spark, folder)
    return facts.skipped(rows, "c", rows.groupBy("c").agg(F.count("*").alias("n")).where("n >= 30").select("c"))


for _key in ("c", "ffa", "ta"):
    QUERIES[f"births_{_key}"] = lambda spark, folder, k=_key: facts.births(star.facts(spark, folder, True), k)
    SQL[f"births_{_key}"] = f"{MONTHS} SELECT {_key}, least(min(fy), 2050) AS birth FROM f1 GROUP BY 1"


@_query(YEARS + " SELECT c, fy, sum(l_quantity) AS value FROM f1 GROUP BY 1, 2")
def generic_weighted_count(spark: SparkSession, folder: str) -> DataFrame:
    docs, refs = star.documents(spark, folder), star.references(spark, folder)
    return cube.weighted_count(refs.join(docs, "doc"), "c.fy", F.col("l_quantity"))


@_query(YEARS + " SELECT CAST(floor(fy / 5) * 5 AS INT) AS lustrum, count(*) AS ind FROM f1 WHERE fj <> '5-LOW' GROUP BY 1")
def key_collapse(spark: SparkSession, folder: str) -> DataFrame:
    counts = cube.count_space(star.facts(spark, folder), "fj.fy")
    return cube.collapse(counts, {"lustrum": (F.floor(F.col("fy") / 5) * 5).cast("int")}, keep=F.col("fj") != "5-LOW")


def _brand_groups(spark: SparkSession, folder: str) -> DataFrame:
    brands = star.references(spark, folder).select(F.col("ta").alias("value")).distinct()
    return brands.select("value", F.concat(F.lit("Maker"), F.expr("substring(value, 7, 1)")).alias("rep"))


@_query(YEARS + " SELECT 'Maker' || substring(ta, 7, 1) AS ta, fy, count(*) AS ind, count(DISTINCT doc) AS doc FROM f1 GROUP BY 1, 2")
def group_rep_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(cube.regroup(star.facts(spark, folder), "ta", _brand_groups(spark, folder)), "fy.ta")


@_query(YEARS + """, k AS (SELECT ta, fy, count(*) AS ind, count(DISTINCT doc) AS doc FROM f1 GROUP BY 1, 2)
    SELECT 'Maker' || substring(ta, 7, 1) AS ta, fy, sum(ind)::BIGINT AS ind, sum(doc)::BIGINT AS doc FROM k GROUP BY 1, 2""")
def group_rep_resum(spark: SparkSession, folder: str) -> DataFrame:
    return cube.regroup_counts(cube.count_space(star.facts(spark, folder), "fy.ta"), "ta", _brand_groups(spark, folder))


@_query(YEARS + " SELECT count(*) AS ind, count(DISTINCT doc) AS doc FROM f1 WHERE c = 42 AND fy = 1997")
def slice_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return Slice(cube.count_space(star.facts(spark, folder).where("c = 42"), "c.fy"), "c.fy").refine(c=42, fy=1997).value_row()


@_query(YEARS + " SELECT fy, count(*) AS ind, count(DISTINCT doc) AS doc FROM f1 WHERE fj = '1-URGENT' GROUP BY 1")
def slice_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    return Slice(cube.count_space(star.facts(spark, folder), "fj.fy"), "fj.fy").refine(fj="1-URGENT", fy=None).rows()


@_query("SELECT DISTINCT p_brand AS ta FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey")
def items(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(star.facts(spark, folder), "ta").where("ind > 0").select("ta")


@_query("SELECT DISTINCT p_brand AS ta FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE lower(p_brand) LIKE 'brand#2%'")
def search_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return search(cube.count_space(star.facts(spark, folder), "ta"), "ta", "brand#2").select("ta")


@_query("SELECT DISTINCT p_brand AS ta FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE lower(p_brand) LIKE '%d#1%'")
def search_substring(spark: SparkSession, folder: str) -> DataFrame:
    return search(cube.count_space(star.facts(spark, folder), "ta"), "ta", "D#1", anywhere=True).select("ta")


_SERIES = MONTHS + f""", k AS (SELECT {{key}}, fy, count(*) AS n FROM f1 WHERE fy BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2),
    t AS (SELECT fy, sum(n) AS total FROM k GROUP BY 1), e AS (SELECT DISTINCT {{key}} FROM k), y AS (SELECT CAST(unnest(range({FIRST}, {LAST + 1})) AS INT) AS year),
    s AS (SELECT e.{{key}}, y.year, coalesce(k.n, 0)::BIGINT AS count, coalesce(k.n / t.total, 0.0)::DOUBLE AS share
          FROM e CROSS JOIN y LEFT JOIN k ON k.{{key}} = e.{{key}} AND k.fy = y.year LEFT JOIN t ON t.fy = y.year)"""


def _series(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return trend.dense_series(cube.count_space(star.facts(spark, folder, True), dotted_space([key, "fy"])), key, FIRST, LAST)


@_query(_SERIES.format(key="c") + " SELECT c, year, count, round(share, 9) AS share FROM s")
def trend_series(spark: SparkSession, folder: str) -> DataFrame:
    return _series(spark, folder, "c").withColumn("share", F.round("share", 9))


@_query(_SERIES.format(key="ta") + """ SELECT ta, min(year) FILTER (count > 0) AS first, max(year) FILTER (count > 0) AS last, max_by(year, count * 1000 + year) AS maxcounty,
    max(count) AS maxcount, max_by(year, (share, year)) AS maxpropy, round(max(share), 9) AS maxprop, sum(count)::BIGINT AS total, round(sum(share), 6) AS totalprop FROM s GROUP BY 1 HAVING max(count) > 0""")
def trend_stats(spark: SparkSession, folder: str) -> DataFrame:
    return trend.trend_stats(_series(spark, folder, "ta"), "ta").withColumn("maxprop", F.round("maxprop", 9)).withColumn("totalprop", F.round("totalprop", 6))


@_query(_SERIES.format(key="ta") + """ SELECT ta, year, sum(count) OVER w::BIGINT AS range_sum, round(sum(count) OVER w / 12.0, 6) AS range_mean FROM s
    WINDOW w AS (PARTITION BY ta ORDER BY year ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY ta ORDER BY year) >= 12""")
def range_sum(spark: SparkSession, folder: str) -> DataFrame:
    return trend.range_sums(_series(spark, folder, "ta"), "ta", 12).withColumn("range_mean", F.round("range_mean", 6))


@_query(_SERIES.format(key="ta") + " SELECT ta, sum(count)::BIGINT AS span_sum, round(sum(count) / 24.0, 6) AS span_mean FROM s WHERE year BETWEEN 13 AND 36 GROUP BY 1")
def range_between(spark: SparkSession, folder: str) -> DataFrame:
    return trend.between(_series(spark, folder, "ta"), "ta", 13, 36).withColumn("span_mean", F.round("span_mean", 6))


_WINDOWS = MONTHS + f""", k AS (SELECT c, fy, count(*) AS ind FROM f1 WHERE c IN (SELECT c FROM f1 GROUP BY c HAVING count(*) >= 5) GROUP BY 1, 2),
    w AS (SELECT CAST(unnest(range({FIRST}, {LAST - 8})) AS INT) AS "window"),
    n AS (SELECT "window", c, sum(ind)::BIGINT AS n FROM k JOIN w ON fy BETWEEN "window" AND "window" + 9 GROUP BY 1, 2)"""


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    counts = cube.count_space(star.facts(spark, folder, True), "c.fy")
    often = counts.groupBy("c").agg(F.sum("ind").alias("all")).where("all >= 5").select("c")
    return trend.rolling_windows(counts.join(often, "c", "left_semi"), "c", FIRST, LAST)


@_query(_WINDOWS + """, e AS (SELECT "window", quantile_cont(n, 0.95) AS edge FROM n GROUP BY 1) SELECT "window", c, n FROM n JOIN e USING ("window") WHERE n >= edge""")
def top_decade_pct(spark: SparkSession, folder: str) -> DataFrame:
    return trend.top_share(_windows(spark, folder), "c", 0.05)


@_query(_WINDOWS + """ SELECT "window", c, n, CAST(row_number() OVER (PARTITION BY "window" ORDER BY n DESC, c) AS INT) AS rank FROM n QUALIFY rank <= 10""")
def top_decade_topn(spark: SparkSession, folder: str) -> DataFrame:
    return trend.top_count(_windows(spark, folder), "c", 10)


@_query(_WINDOWS + """, t AS (SELECT "window", c FROM n QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY n DESC, c) <= 10)
    SELECT c, min("window") AS first_added FROM t GROUP BY 1""")
def top_first_added(spark: SparkSession, folder: str) -> DataFrame:
    return trend.first_added(trend.top_count(_windows(spark, folder), "c", 10), "c")


@_query(_WINDOWS.replace(", k AS (SELECT c, fy", ", k2 AS (SELECT c, fy").replace("FROM k JOIN w", "FROM k2 JOIN w") + _SERIES.format(key="c")[len(MONTHS):].replace(" t AS", " tt AS").replace("JOIN t ON t.fy", "JOIN tt ON tt.fy").replace("t.total", "tt.total") + """,
    top AS (SELECT "window", c FROM n QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY n DESC, c) <= 10), added AS (SELECT c, min("window") AS first_added FROM top GROUP BY 1)
    SELECT s.c, min(year) FILTER (count > 0) AS first, max(year) FILTER (count > 0) AS last, max_by(year, count * 1000 + year) AS maxcounty, max(count) AS maxcount, max_by(year, (round(share, 12), year)) AS maxpropy,
    round(max(share), 9) AS maxprop, sum(count)::BIGINT AS total, round(sum(share), 6) AS totalprop, any_value(first_added) AS first_added FROM s JOIN added USING (c) GROUP BY 1""")
def top_decade_stratified(spark: SparkSession, folder: str) -> DataFrame:
    counts = cube.count_space(star.facts(spark, folder, True), "c.fy")
    rows = trend.top_decade_stratified(counts, "c", FIRST, LAST, top_n=10)
    return rows.withColumn("maxprop", F.round("maxprop", 9)).withColumn("totalprop", F.round("totalprop", 6))


@_query(_SERIES.format(key="c").replace("WITH", "WITH RECURSIVE", 1) + f""", v AS (SELECT c, list(count::DOUBLE ORDER BY year) AS v FROM s GROUP BY 1),
    st AS (SELECT c, v, 0 AS i, -1 AS since, false AS alive, NULL::DOUBLE AS life, NULL::VARCHAR AS event FROM v
      UNION ALL SELECT c, v, i + 1, CASE WHEN ev IS NULL THEN since ELSE i END, CASE ev WHEN 'birth' THEN true WHEN 'death' THEN false ELSE alive END, CASE ev WHEN 'death' THEN lived ELSE life END, ev FROM (
        SELECT *, CASE WHEN since < 0 AND v[i + 1] > 0 THEN 'birth' WHEN since < 0 OR i > {LAST - FIRST - 10} THEN NULL
          WHEN alive AND i >= since + 5 AND list_sum(v[i + 1:i + 10]) / 10 <= 0.1 * lived THEN 'death'
          WHEN NOT alive AND i >= since + 10 AND v[i + 1] > 0 AND list_sum(v[i + 1:i + 10]) / 10 > 0.5 * life THEN 'birth' END AS ev
        FROM (SELECT *, CASE WHEN since >= 0 AND i > since THEN list_sum(v[since + 1:i]) / (i - since) END AS lived FROM st WHERE i < {LAST - FIRST + 1})))
    SELECT c, event, CAST({FIRST} + i - 1 AS INT) AS year FROM st WHERE event IS NOT NULL""")
def births_deaths(spark: SparkSession, folder: str) -> DataFrame:
    return trend.births_deaths(_series(spark, folder, "c"), "c")


@_query(_SERIES.format(key="ta") + """, r AS (SELECT *, row_number() OVER (PARTITION BY ta ORDER BY year DESC) AS back FROM s),
    p AS (SELECT ta, max(count) AS max_count, max_by(count, year) AS last_count, avg(count) FILTER (back <= 15) AS tail_mean FROM r GROUP BY 1)
    SELECT s.ta, s.year, max_count, last_count, round(tail_mean, 6) AS tail_mean, round(s.count / nullif(max_count, 0), 9) AS of_max FROM s JOIN p USING (ta)""")
def yearly_table(spark: SparkSession, folder: str) -> DataFrame:
    return trend.yearly_table(_series(spark, folder, "ta"), "ta").withColumn("tail_mean", F.round("tail_mean", 6)).withColumn("of_max", F.round("of_max", 9))


@_query(MONTHS + f""", k AS (SELECT c, count(DISTINCT doc) AS docs, count(*) FILTER (fy BETWEEN 1 AND 40) AS total FROM f1 GROUP BY 1)
    SELECT CASE WHEN docs < 5 THEN 'few documents' WHEN total = 0 THEN 'no count in the span' WHEN total < 5 THEN 'small total' ELSE 'kept' END AS reason, count(*) AS n FROM k GROUP BY 1""")
def trend_rejects(spark: SparkSession, folder: str) -> DataFrame:
    # A document has one time only, so documents per year add up to documents.
    return trend.trend_rejects(cube.count_space(star.facts(spark, folder, True), "c.fy"), "c", 1, 40)


_JOURNALS, _YEARS = ("1-URGENT", "2-HIGH", "3-MEDIUM"), tuple(range(1995, 2002))
_CELLS = YEARS + f""", j AS (SELECT unnest({list(_JOURNALS)!r}) AS fj), y AS (SELECT CAST(unnest(range(1995, 2002)) AS INT) AS fy),
    m AS (SELECT j.fj, y.fy, coalesce(n, 0)::BIGINT AS ind FROM j CROSS JOIN y LEFT JOIN (SELECT fj, fy, count(*) AS n FROM f1 GROUP BY 1, 2) k ON k.fj = j.fj AND k.fy = y.fy)"""


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.matrix(cube.count_space(star.facts(spark, folder), "fj.fy"), ("fj", _JOURNALS), ("fy", _YEARS))


@_query(_CELLS + " SELECT * FROM m")
def matrix_2d(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder)


@_query(_CELLS + " SELECT fj, fy, ind, round(ind / nullif(sum(ind) OVER (PARTITION BY fj), 0), 9) AS share FROM m")
def matrix_norm(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.normalised(_cells(spark, folder), "fj").withColumn("share", F.round("share", 9))


@_query(YEARS + f""" SELECT CASE WHEN fj IN {_JOURNALS} THEN fj ELSE 'other' END AS fj, CASE WHEN fy IN (1996, 1997) THEN CAST(fy AS VARCHAR) ELSE 'other' END AS fy, count(*) AS ind FROM f1 GROUP BY 1, 2""")
def matrix_complement(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.complemented(cube.count_space(star.facts(spark, folder), "fj.fy"), ("fj", _JOURNALS), ("fy", (1996, 1997)))


@_query(MONTHS + """, a AS (SELECT CAST(unnest(range(0, 13)) AS INT) AS cAge), y AS (SELECT CAST(unnest(range(20, 33)) AS INT) AS fy),
    k AS (SELECT cAge, fy, count(*) AS n FROM f3 WHERE cAge >= 0 GROUP BY 1, 2)
    SELECT a.cAge, y.fy, CASE WHEN y.fy - a.cAge IN (18, 19, 20) AND a.cAge < 11 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS ind FROM a CROSS JOIN y LEFT JOIN k ON k.cAge = a.cAge AND k.fy = y.fy""")
def matrix_cohort(spark: SparkSession, folder: str) -> DataFrame:
    counts = cube.count_space(facts.aged(star.facts(spark, folder, True)), "cAge.fy")
    cells = matrix.matrix(counts, ("cAge", tuple(range(13))), ("fy", tuple(range(20, 33))), keep=F.col("cAge") >= 0)
    return matrix.without_cohorts(cells, "fy", "cAge", (18, 19, 20), oldest=12).withColumn("ind", F.col("ind").cast("bigint"))


@_query(_CELLS + " SELECT fj, " + ", ".join(f"sum(ind) FILTER (fy = {y})::BIGINT AS y{y}" for y in _YEARS) + " FROM m GROUP BY 1")
def matrix_wide(spark: SparkSession, folder: str) -> DataFrame:
    rows = matrix.wide(_cells(spark, folder), "fj", "fy", _YEARS)
    return rows.select("fj", *[F.col(str(y)).alias(f"y{y}") for y in _YEARS])
