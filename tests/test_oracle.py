"""Some queries against their SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ("cnt_c_fy", "cube_core", "refpair_age", "cocit_works", "trend_series", "top_decade_topn", "matrix_norm", "ref_parse", "author_key", "rel_having", "bib_network", "paren_scan", "p6_found", "p6_per_work",
    "p4_found", "p4_good", "wos_cube", "wos_relational_doc", "wos_relational_cit", "citation_parse", "citation_context", "text_cube", "term_pairs", "text_cocited_year", "page_sentences", "header_vote",
    "pages_without_heads", "pages_and_references", "fuzzy_pairs", "group_reps", "reference_components", "citations_by_group", "births_deaths", "top_decade_stratified", "matrix_cohort", "kept_references",
    "whitelist_skipped", "bib_network_top", "events_windowed",
)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


def test_entry_and_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(f"p{n}_found" in queries for n in (1, 4, 5, 6))
