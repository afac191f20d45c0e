"""Queries of this subpackage with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.llm.cooccurrence import cooccurrences
from citeloom.llm.leakage import find_leaks
from citeloom.llm.mixing import mix_sources, shares_reached
from citeloom.llm.pii import find_places, redact
from citeloom.llm.scans import find_flaws, paragraphs
from citeloom.llm.variants import author_names, link_variants, variant_pairs
from citeloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _authors(spark: SparkSession, folder: str) -> DataFrame:
    return link_variants(author_names(table(spark, folder, "cit"), table(spark, folder, "doc"), table(spark, folder, "wos_record")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(_authors(spark, folder))


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    linked = _authors(spark, folder)
    return linked.join(linked.groupBy("cluster").agg(F.count("*").alias("n_spellings"), F.min("spelling").alias("author")), "cluster").drop("cluster")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrences(table(spark, folder, "cit"), "doc_id", "full_ref", min_count=5, min_lift=8)
    return pairs.select(F.col("item_a").alias("ref_a"), F.col("item_b").alias("ref_b"))


def p3_surprise(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrences(table(spark, folder, "cit"), "doc_id", "full_ref", min_count=5)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_flaws(table(spark, folder, "jstor_page"))[0].select("entry_name", "seq", "line_no", "flaw").distinct()


def p7_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(table(spark, folder, "jstor_page"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))
    return leaks.where("kind = 'verbatim'").select("doc_id", "item_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"), paraphrases=True)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_target")
    return shares_reached(mix_sources(table(spark, folder, "documents"), targets), targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_places(table(spark, folder, "documents")).select("doc_id", "pii_type", "start_pos")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(table(spark, folder, "documents"))


_PAIRS = """
    WITH s AS (SELECT DISTINCT doc_id, full_ref FROM cit WHERE full_ref IS NOT NULL AND doc_id IS NOT NULL),
    n AS (SELECT full_ref, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5),
    k AS (SELECT s.* FROM s JOIN n USING (full_ref)),
    p AS (SELECT a.full_ref AS ref_a, b.full_ref AS ref_b, count(*) AS n_ab
          FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.full_ref < b.full_ref GROUP BY 1, 2 HAVING count(*) >= 5)"""

# Words as `plain_words` reads them; a bracket with a year is a citation.
_WORDS = r"""regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({text}, '[(\[][^()\[\]]*[0-9]{{4}}[^()\[\]]*[)\]]', ' ', 'g'),
    '[-\x{{AD}}\x{{2010}}\x{{2011}}][ \t]*\r?\n\s*', '', 'g'), '[-\x{{AD}}\x{{2010}}\x{{2011}}''’]', '', 'g')), '[\p{{L}}\p{{N}}_]+')"""
_RUNS = f"""
    WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(text='item_text')} AS w FROM eval_item WHERE item_text IS NOT NULL),
    dr AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM d, unnest(range(1, len(w) - 10)) u(k)), ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM i, unnest(range(1, len(w) - 10)) u(k))
    SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_clusters, p3_found, p3_surprise, p7_found, p7_paragraphs, p8_found, p8_report, p9_mixture, p9_shares, p10_found, p10_redacted)}
SQL: dict[str, str] = {
    "p8_found": _RUNS,
    "p3_found": _PAIRS + """
    SELECT ref_a, ref_b FROM p JOIN n x ON x.full_ref = ref_a JOIN n y ON y.full_ref = ref_b
    WHERE n_ab * (SELECT count(DISTINCT doc_id) FROM s) >= 8 * x.n * y.n""",
}


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_sql() -> dict[str, str]:
    return dict(SQL)
