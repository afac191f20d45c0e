"""Queries over the domain tables: records, relational tables, texts, graphs; SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.functions import normalize, text
from citeloom.operators import cube, facts, graph, relational
from citeloom.operators.packed import latest_records
from citeloom.sources import archive, wos
from citeloom.schema import dotted_space
from citeloom.sources.dataset import search
from citeloom.streaming import windowed_counts
from citeloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, folder: str, latest: bool = False) -> DataFrame:
    rows = table(spark, folder, "wos_record")
    rows = latest_records(rows) if latest else rows
    return rows.select(*[F.col(t.lower()).alias(t) for t in wos.TAGS])


# -- normal forms ------------------------------------------------------------------------------------------------

_AUTHOR = """CASE WHEN len(p) <> 2 THEN k WHEN p[2] = '' THEN p[1] ELSE p[1] || ', ' || substring(p[2], 1, 1) END"""


@_query(f"""
    WITH a AS (SELECT ut, unnest(string_split(au, ';')) AS raw FROM wos_record WHERE au IS NOT NULL),
    b AS (SELECT ut, regexp_replace(lower(trim(raw)), '[^a-zA-Z\\s,]', '', 'g') AS k FROM a), c AS (SELECT ut, k, string_split(k, ', ') AS p FROM b)
    SELECT fa, count(*) AS n FROM (SELECT {_AUTHOR} AS fa FROM c) WHERE fa <> '' GROUP BY 1""")
def author_key(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "wos_record").select(F.explode(normalize.citing_authors(F.col("au"))).alias("fa"))
    return keys.groupBy("fa").agg(F.count("*").alias("n"))


_LATEST = "(SELECT * FROM wos_record QUALIFY row_number() OVER (PARTITION BY ut ORDER BY loaded_at DESC) = 1)"
_REFS = r"""
    WITH r AS (SELECT ut, trim(unnest(string_split(cr, ';'))) AS raw FROM {records} WHERE cr IS NOT NULL),
    y AS (SELECT *, regexp_extract(raw, '(?s)^(.*?)((?:18|19|20)[0-9]{{2}})', 1) AS before, regexp_extract(raw, '(?s)^(.*?)((?:18|19|20)[0-9]{{2}})', 2) AS yr FROM r WHERE raw <> ''),
    w AS (SELECT *, string_split_regex(trim(lower(before)), '\s+') AS ws FROM y WHERE yr <> ''),
    n AS (SELECT *, string_split(CASE WHEN len(ws[1]) = 1 THEN ws[2] ELSE ws[1] END || ', ' || substring(CASE WHEN len(ws[1]) = 1 THEN ws[1] ELSE ws[2] END, 1, 1) || '.', '') AS cs
          FROM w WHERE len(ws) BETWEEN 2 AND 4),
    a AS (SELECT *, array_to_string([CASE WHEN i = 1 OR NOT regexp_matches(cs[i - 1], '\p{{L}}') THEN upper(cs[i]) ELSE cs[i] END FOR i IN range(1, len(cs) + 1)], '') AS author,
          contains(raw, 'DOI') OR regexp_matches(raw, ', [Vv][0-9]+') OR regexp_matches(raw, '[0-9]+, [Pp]?[0-9]+') AS art,
          [trim(x) FOR x IN string_split(lower(raw), ',')] AS f FROM n),
    k AS (SELECT ut, author, CAST(yr AS INT) AS publish, CASE WHEN art THEN 'article' ELSE 'book' END AS type,
          CASE WHEN art THEN author || '|' || yr || '|' || string_split(array_to_string(f[3:], ','), ',doi')[1] WHEN len(f) < 3 THEN author ELSE author || '|' || f[3] END AS full_ref
          FROM a WHERE NOT contains(author, '*'))"""


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "wos_record").select("ut", F.explode(F.split("cr", ";")).alias("raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    return raw.withColumn("r", normalize.parse_reference(F.col("raw"))).where("r is not null").select("ut", "r.*")


@_query(_REFS.format(records="wos_record") + " SELECT author, publish, type, full_ref, count(*) AS n FROM k GROUP BY 1, 2, 3, 4")
def ref_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).groupBy("author", "publish", "type", "full_ref").agg(F.count("*").alias("n"))


_TITLES = "(" + " OR ".join(f"contains(lower(trim(ti)), '{p}')" for p in normalize.TITLE_PARTS) + ")"


@_query(f"SELECT ut, ti FROM wos_record WHERE ti IS NOT NULL AND NOT {_TITLES} AND lower(trim(ti)) NOT IN {normalize.TITLE_WHOLE}")
def title_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "wos_record").where(normalize.looks_like_research(F.col("ti"))).select("ut", "ti")


@_query("""SELECT ut, CASE WHEN contains(lower(ti), 'erratum') THEN 'erratum' WHEN contains(lower(ti), 'comment on') OR lower(ti) = 'commentary and debate' OR starts_with(lower(ti), 'reply to') THEN 'commentary'
    WHEN lower(ti) IN ('book review', 'review essay') THEN 'book-review' ELSE dt END AS kind FROM wos_record""")
def document_kind(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "wos_record").select("ut", normalize.document_type(F.col("dt"), F.col("ti")).alias("kind"))


@_query("""
    SELECT DISTINCT full_ref, string_split(full_ref, '|')[1] AS author, CASE WHEN len(string_split(full_ref, '|')) > 2 THEN 'article' ELSE 'book' END AS type,
    CASE WHEN len(string_split(full_ref, '|')) > 2 THEN TRY_CAST(string_split(full_ref, '|')[2] AS INT) END AS year,
    CASE WHEN len(string_split(full_ref, '|')) > 2 THEN string_split(full_ref, '|')[3] ELSE string_split(full_ref, '|')[2] END AS title FROM cit WHERE full_ref IS NOT NULL""")
def work_key_parse(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "cit").select("full_ref").where("full_ref is not null").distinct()
    return keys.select("full_ref", F.inline(F.array(normalize.work_parts(F.col("full_ref")))))


@_query("""WITH k AS (SELECT DISTINCT full_ref, string_split(full_ref, '|') AS p FROM cit WHERE full_ref IS NOT NULL),
    l AS (SELECT full_ref, p[1] || CASE WHEN len(p) > 2 AND TRY_CAST(p[2] AS INT) IS NOT NULL THEN ' (' || CAST(TRY_CAST(p[2] AS INT) AS VARCHAR) || ')' ELSE '' END
          || coalesce(' ' || CASE WHEN len(p) > 2 THEN p[3] ELSE p[2] END, '') AS label FROM k)
    SELECT full_ref, CASE WHEN length(label) > 30 THEN substring(label, 1, 30) || '...' ELSE label END AS label FROM l""")
def work_labels(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "cit").select("full_ref").where("full_ref is not null").distinct()
    return keys.select("full_ref", normalize.work_label(F.col("full_ref"), 30).alias("label"))


# -- export pipeline: records -> documents, references -> counts -------------------------------------------------


def _wos_fact(spark: SparkSession, folder: str) -> DataFrame:
    docs = wos.documents(_records(spark, folder, latest=True))
    return facts.citations(docs.drop("CR"), wos.references(docs))


def _cube_sql(head: str, fact: str, spaces: tuple[str, ...]) -> str:
    columns = sorted({c for s in spaces for c in s.split(".")})
    parts = (
        f"SELECT '{dotted_space(s.split('.'))}' AS space, {', '.join(c if c in s.split('.') else f'NULL AS {c}' for c in columns)}, count(*) AS ind, count(DISTINCT doc) AS doc FROM {fact} GROUP BY {', '.join(s.split('.'))}"
        for s in spaces
    )
    return head + " " + " UNION ALL ".join(parts)


_WOS_SPACES = ("fj", "fy", "ty", "c.fy", "c.fj", "fj.fy", "c", "fy.ta")
_WOS_DOCS = f""", good AS (SELECT ut, lower(so) AS fj, CAST(TRY_CAST(py AS DOUBLE) AS INT) AS fy FROM {_LATEST}
    WHERE dt = 'Article' AND regexp_matches(trim(py), '^[+-]?[0-9]+$') AND trim(au) <> '' AND trim(cr) <> '' AND NOT {{titles}}
    AND len(list_filter(string_split(au, ';'), lambda x: regexp_replace(lower(trim(x)), '[^a-zA-Z\\s,]', '', 'g') <> '')) > 0),
    f AS (SELECT ut AS doc, full_ref AS c, author AS ta, publish AS ty, fj, fy FROM k JOIN good USING (ut))"""
_NO_RESEARCH = "(" + " OR ".join(f"contains(lower(trim(coalesce(ti, ''))), '{p}')" for p in normalize.TITLE_PARTS) + f" OR lower(trim(coalesce(ti, ''))) IN {normalize.TITLE_WHOLE})"


@_query(_cube_sql(_REFS.format(records=_LATEST) + _WOS_DOCS.format(titles=_NO_RESEARCH), "f", _WOS_SPACES))
def wos_cube(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_spaces(_wos_fact(spark, folder), _WOS_SPACES)


@_query(f"""
    SELECT CASE WHEN coalesce(dt, '') <> 'Article' THEN 'type' WHEN TRY_CAST(trim(py) AS INT) IS NULL OR NOT regexp_matches(trim(py), '^[+-]?[0-9]+$') THEN 'year'
    WHEN coalesce(trim(au), '') = '' THEN 'authors' WHEN coalesce(trim(cr), '') = '' THEN 'references'
    WHEN {_TITLES.replace('ti)', "coalesce(ti, ''))")} OR lower(trim(coalesce(ti, ''))) IN {normalize.TITLE_WHOLE} THEN 'title' ELSE 'kept' END AS reject, count(*) AS n
    FROM wos_record GROUP BY 1""")
def wos_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return wos.quality(_records(spark, folder)).groupBy(F.coalesce("reject", F.lit("kept")).alias("reject")).agg(F.count("*").alias("n"))


@_query(f"""
    WITH r AS (SELECT * FROM {_LATEST} WHERE ut IS NOT NULL),
    x AS (SELECT ut, i, regexp_replace(lower(trim(string_split(au, ';')[i])), '[^a-zA-Z\\s,]', '', 'g') AS k FROM r, unnest(range(1, len(string_split(au, ';')) + 1)) t(i) WHERE au IS NOT NULL),
    c AS (SELECT ut, i, k, string_split(k, ', ') AS p FROM x), a AS (SELECT ut, min_by(fa, i) AS first_author FROM (SELECT ut, i, {_AUTHOR} AS fa FROM c) WHERE fa <> '' GROUP BY 1)
    SELECT r.ut AS id, ti AS title, first_author, lower(so) AS journal,
           coalesce(TRY_CAST(py AS INT), TRY_CAST(string_split(trim(ea), ' ')[-1] AS INT)) AS year, TRY_CAST(nr AS INT) AS citcnt_external FROM r LEFT JOIN a ON a.ut = r.ut""")
def wos_relational_doc(spark: SparkSession, folder: str) -> DataFrame:
    return wos.relational(_records(spark, folder, latest=True))[0]


@_query(_REFS.format(records=_LATEST) + " SELECT ut AS doc_id, full_ref, author, publish AS year FROM k WHERE ut IS NOT NULL")
def wos_relational_cit(spark: SparkSession, folder: str) -> DataFrame:
    return wos.relational(_records(spark, folder, latest=True))[1]


@_query(f"SELECT ut AS doc_id, lower(trim(t)) AS text FROM (SELECT ut, unnest(string_split(id, ';')) AS t FROM {_LATEST} WHERE ut IS NOT NULL AND id IS NOT NULL) WHERE trim(t) <> ''")
def wos_relational_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return wos.relational(_records(spark, folder, latest=True))[2]


# -- relational tables -------------------------------------------------------------------------------------------

_DC = """WITH d AS (SELECT DISTINCT id AS doc_id, first_author, journal, year AS doc_year FROM doc), c AS (SELECT DISTINCT id, doc_id, full_ref, author, year AS cited_year FROM cit), j AS (SELECT * FROM c JOIN d USING (doc_id))"""


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    doc = table(spark, folder, "doc").select("id", "first_author", "journal", "year").distinct()
    cit = table(spark, folder, "cit").select("id", "doc_id", "full_ref", "author", "year").distinct()
    return relational.documents_with_citations(doc, cit)


@_query(_DC + " SELECT journal, doc_year, count(DISTINCT doc_id) AS n FROM j GROUP BY 1, 2")
def rel_count_docs(spark: SparkSession, folder: str) -> DataFrame:
    return relational.count_table(_joined(spark, folder), ["journal", "doc_year"], documents=True)


@_query(_DC + " SELECT author, doc_year, count(*) AS n FROM j GROUP BY 1, 2")
def rel_count_cits(spark: SparkSession, folder: str) -> DataFrame:
    return relational.count_table(_joined(spark, folder), ["author", "doc_year"], documents=False)


@_query(_DC + " SELECT full_ref, count(DISTINCT doc_id) AS n FROM j WHERE journal IN ('annals of rural settlement', 'current civic education') AND contains(lower(full_ref), 'soc') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def rel_having(spark: SparkSession, folder: str) -> DataFrame:
    filters = [("journal", ["annals of rural settlement", "current civic education"]), ("full_ref", "soc*")]
    return relational.count_table(_joined(spark, folder), ["full_ref"], True, filters, min_count=2)


@_query(_DC + " SELECT full_ref, count(DISTINCT doc_id) AS n FROM j WHERE full_ref IS NOT NULL GROUP BY 1 ORDER BY n DESC, full_ref LIMIT 100")
def biggest_docs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _joined(spark, folder).where("full_ref is not null")
    return relational.biggest(relational.count_table(rows, ["full_ref"], True), 100, "full_ref")


@_query(_DC + " SELECT author, count(*) AS n FROM j WHERE author IS NOT NULL GROUP BY 1 ORDER BY n DESC, author LIMIT 50")
def biggest_cits(spark: SparkSession, folder: str) -> DataFrame:
    rows = _joined(spark, folder).where("author is not null")
    return relational.biggest(relational.count_table(rows, ["author"], False), 50, "author")


@_query(_DC + " SELECT y.year AS doc_year, coalesce(n, 0)::BIGINT AS n FROM (SELECT CAST(unnest(range(1950, 2031)) AS INT) AS year) y LEFT JOIN (SELECT doc_year, count(DISTINCT doc_id) AS n FROM j GROUP BY 1) k ON k.doc_year = y.year")
def rel_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    counts = relational.count_table(_joined(spark, folder), ["doc_year"], True, years=(1950, 2030))
    return relational.zero_filled(counts, "doc_year", 1950, 2030)


@_query("SELECT lower(trim(text)) AS text, count(DISTINCT doc_id) AS n FROM keyword WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1")
def keyword_docs(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "keyword").select(F.lower(F.trim("text")).alias("text"), "doc_id").where("text <> '' and doc_id is not null").distinct()
    return words.groupBy("text").agg(F.count("*").alias("n"))


# -- graphs ------------------------------------------------------------------------------------------------------


@_query(_DC + """ SELECT least(a.full_ref, b.full_ref) AS src, greatest(a.full_ref, b.full_ref) AS dst, count(*) AS weight
    FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.full_ref < b.full_ref GROUP BY 1, 2 HAVING count(*) >= 5""")
def bib_network(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cocitation_network(_joined(spark, folder), "full_ref", 5)


@_query(_DC + """ SELECT least(a.full_ref, b.full_ref) AS src, greatest(a.full_ref, b.full_ref) AS dst, count(*) AS weight
    FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.full_ref < b.full_ref GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY weight DESC, src, dst LIMIT 200""")
def bib_network_top(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cocitation_network(_joined(spark, folder), "full_ref", 2, limit=200)


@_query(_DC + """ SELECT least(a.author, b.author) AS src, greatest(a.author, b.author) AS dst, count(*) AS weight
    FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.full_ref < b.full_ref WHERE a.author IS NOT NULL AND b.author IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20""")
def bib_network_authors(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cocitation_network(_joined(spark, folder), "author", 20)


# SQL's levenshtein counts bytes, so every sign beyond ASCII is first written as one of few control signs.
def _alike_sql(name: str, strings: str, least: float, edits: int) -> str:
    """CTEs that end in `name` (a, b, cosine) over the query `strings` (one column s)."""
    plain = "regexp_replace({}, '[^\\x00-\\x7f]', chr(1), 'g')"
    return f"""
    {name}_s AS (SELECT DISTINCT s FROM ({strings}) WHERE s IS NOT NULL), {name}_n AS (SELECT count(*) AS n FROM {name}_s),
    {name}_g AS (SELECT s, substring(s, i, 3) AS g, count(*) AS tf FROM {name}_s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) u(i) GROUP BY 1, 2),
    {name}_i AS (SELECT g, ln((SELECT n FROM {name}_n)::DOUBLE / count(*)) + 1 AS idf FROM {name}_g GROUP BY 1),
    {name}_w AS (SELECT s, g, tf * idf AS w FROM {name}_g JOIN {name}_i USING (g)), {name}_l AS (SELECT s, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY 1),
    {name}_p AS (SELECT a.s AS a, b.s AS b, sum(x.w * y.w) / (any_value(a.norm) * any_value(b.norm)) AS cosine FROM {name}_l a JOIN {name}_l b ON a.s < b.s AND abs(length(a.s) - length(b.s)) <= {edits}
        JOIN {name}_w x ON x.s = a.s JOIN {name}_w y ON y.s = b.s AND y.g = x.g GROUP BY 1, 2),
    {name} AS (SELECT a, b, cosine FROM {name}_p WHERE cosine >= {least} AND levenshtein({plain.format('a')}, {plain.format('b')}) <= {edits}
        AND (levenshtein(a, b) <= {edits} OR (length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) <= {edits}) OR length(a) <> length(b)))"""


@_query(_DC + "," + _alike_sql("f", "SELECT author AS s FROM j", 0.5, 1) + " SELECT a, b, round(cosine, 6) AS cosine FROM f")
def fuzzy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.alike_pairs(_joined(spark, folder).select("author"), "author", 0.5, 1).withColumn("cosine", F.round("cosine", 6))


_GROUPS = f"""{_DC.replace('WITH', 'WITH RECURSIVE')}, o AS (SELECT full_ref, count(DISTINCT doc_id) AS n FROM j WHERE full_ref IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
    t AS (SELECT full_ref AS s, TRY_CAST(string_split(full_ref, '|')[2] AS INT) IS NOT NULL AS art FROM o WHERE NOT contains(full_ref, '[no title captured]')),
    {_alike_sql('fb', 'SELECT s FROM t WHERE NOT art', 0.7, 1)}, {_alike_sql('fa', 'SELECT s FROM t WHERE art', 0.8, 2)},
    e AS (SELECT a, b FROM fb UNION ALL SELECT b, a FROM fb UNION ALL SELECT a, b FROM fa UNION ALL SELECT b, a FROM fa),
    reach AS (SELECT full_ref AS x, full_ref AS y FROM o UNION SELECT x, e.b FROM reach JOIN e ON e.a = reach.y),
    comp AS (SELECT x, min(y) AS component FROM reach GROUP BY 1),
    best AS (SELECT component, arg_max(x, (n, x)) AS rep FROM comp JOIN o ON full_ref = x GROUP BY 1), groups AS (SELECT x AS full_ref, rep FROM comp JOIN best USING (component))"""


@_query(_GROUPS + " SELECT full_ref, rep FROM groups")
def group_reps(spark: SparkSession, folder: str) -> DataFrame:
    return graph.resolve_references(_joined(spark, folder))


@_query(_DC.replace("WITH", "WITH RECURSIVE") + """, net AS (SELECT a.full_ref AS a, b.full_ref AS b FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.full_ref < b.full_ref GROUP BY 1, 2 HAVING count(*) >= 8),
    e AS (SELECT a, b FROM net UNION ALL SELECT b, a FROM net), reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT x, e.b FROM reach JOIN e ON e.a = reach.y)
    SELECT x AS node, min(y) AS component FROM reach GROUP BY 1""")
def reference_components(spark: SparkSession, folder: str) -> DataFrame:
    edges = graph.cocitation_network(_joined(spark, folder), "full_ref", 8)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return graph.components(nodes, edges)


@_query(_GROUPS + " SELECT coalesce(rep, j.full_ref) AS full_ref, count(DISTINCT doc_id) AS n FROM j LEFT JOIN groups g ON g.full_ref = j.full_ref WHERE j.full_ref IS NOT NULL GROUP BY 1")
def citations_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Citations rewritten to the representative of their reference."""
    joined = _joined(spark, folder)
    groups = graph.resolve_references(joined).select(F.col("full_ref").alias("value"), "rep")
    return relational.count_table(cube.regroup(joined.where("full_ref is not null"), "full_ref", groups), ["full_ref"], True)


# -- texts -------------------------------------------------------------------------------------------------------


@_query(r"""SELECT doc_id, CAST(i AS INT) AS pos, g[i] AS content FROM (SELECT doc_id, regexp_extract_all(text, '\(([^)]*)\)', 1) AS g FROM documents WHERE text IS NOT NULL), unnest(range(1, len(g) + 1)) AS t(i)""")
def paren_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = text.bracket_rows(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", (F.col("pos") + 1).cast("int").alias("pos"), "content")


@_query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), ' +', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""")
def ocr_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.clean_scan(F.col("text")).alias("text"))


@_query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '-\r?\n', '', 'g'), '\r?\n', ' ', 'g'), ' +', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def one_paragraph(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.one_paragraph(F.col("text")).alias("text"))


_FORM_ROWS = ", ".join("({}, '{}')".format(i, form.replace("'", "''")) for i, form in enumerate(text.CITATION_FORMS))
# Brackets (doc_id, pos) with their places, and the works cited in them, by the two readings.
_CITED = rf"""
    WITH t AS (SELECT doc_id, text, pub_year AS fy, lower(journal) AS fj, regexp_extract_all(text, '\([^)]*\)') AS g, string_split_regex(text, '\([^)]*\)') AS o FROM documents WHERE contains(text, '(')),
    b AS (SELECT doc_id, text, fy, fj, i AS pos, substring(g[i], 2, length(g[i]) - 2) AS inside,
          CAST(coalesce(list_sum([length(x) FOR x IN g[:i - 1]]), 0) + list_sum([length(x) FOR x IN o[:i]]) AS BIGINT) AS spot FROM t, unnest(range(1, len(g) + 1)) u(i)),
    flat AS (SELECT *, regexp_replace(regexp_replace(inside, '-\n', '', 'g'), '\s+', ' ', 'g') AS x FROM b WHERE regexp_matches(inside, '[0-9]{{4}}')),
    parts AS (SELECT doc_id, pos, 0 AS mode, i, trim(string_split(x, ';')[i]) AS part FROM flat, unnest(range(1, len(string_split(x, ';')) + 1)) u(i) WHERE len(string_split(string_split(x, ';')[i], ',')) < 4
              UNION ALL SELECT doc_id, pos, 1, i, trim(string_split(x, ',')[i]) FROM flat, unnest(range(1, len(string_split(x, ',')) + 1)) u(i)),
    forms(form, rx) AS (VALUES {_FORM_ROWS}),
    tried AS (SELECT doc_id, pos, mode, i, form, regexp_extract(part, rx, 1) AS names, regexp_extract(part, rx, 2) AS years FROM parts, forms WHERE regexp_matches(part, '[0-9]{{4}}') AND regexp_matches(part, rx)),
    hits AS (SELECT * FROM tried WHERE names NOT IN {text.MONTHS} QUALIFY mode = 1 OR row_number() OVER (PARTITION BY doc_id, pos, mode, i ORDER BY form) = 1),
    sizes AS (SELECT doc_id, pos, count(*) FILTER (mode = 1) > count(*) FILTER (mode = 0) AS commas FROM hits GROUP BY 1, 2),
    used AS (SELECT h.* FROM hits h JOIN sizes s ON s.doc_id = h.doc_id AND s.pos = h.pos AND (mode = 1) = commas),
    cites AS (SELECT doc_id, pos, i, form, n, replace(names, chr(39) || 's', '') || ' (' || regexp_extract(string_split(years, ',')[n], '[0-9]{{4}}') || ')' AS cite
              FROM used, unnest(range(1, len(string_split(years, ',')) + 1)) u(n) WHERE regexp_matches(string_split(years, ',')[n], '[0-9]{{4}}')),
    raw AS (SELECT DISTINCT b.doc_id, b.pos, fy, fj, spot, substring(text, greatest(spot - 398, 1), spot + 2 - greatest(spot - 398, 1)) AS x, substring(text, spot + length(inside) + 3, 100) AS y FROM b JOIN cites c ON c.doc_id = b.doc_id AND c.pos = b.pos),
    whole AS (SELECT *, CASE WHEN regexp_matches(x, '[\s.!?]') THEN regexp_replace(x, '(?s)^[^\s.!?]*[\s.!?]+', '') ELSE x END AS w,
              regexp_replace(CASE WHEN regexp_matches(y, '[\s.!?]') THEN regexp_replace(y, '(?s)[\s.!?]+[^\s.!?]*$', '') ELSE y END, '^\s+', '') AS v FROM raw),
    last AS (SELECT *, CASE WHEN regexp_matches(w, '[.!?]\s+\S') THEN regexp_extract(w, '(?s)^.*[.!?]\s+(\S.*)$', 1) ELSE w END AS l,
             CASE WHEN regexp_matches(v, '[.!?]\s+\S') THEN regexp_extract(v, '(?s)^(.*?[.!?])\s+\S', 1) ELSE v END AS context_right FROM whole),
    ctx AS (SELECT doc_id, pos, fy, fj, CAST(spot AS INT) AS place, substring(l, 1, length(l) - 1) AS context, context_right FROM last),
    words AS (SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(context), '[^a-zA-Z\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {tuple(text.STOPWORDS)}) AS ws FROM ctx),
    terms AS (SELECT doc_id AS doc, pos, fy, fj, unnest(list_distinct(list_concat(ws, [least(ws[k], ws[k + 1]) || '-' || greatest(ws[k], ws[k + 1]) FOR k IN range(1, len(ws))]))) AS t FROM words),
    fact AS (SELECT c.doc_id AS doc, c.pos, cite AS c, fy, fj FROM cites c JOIN ctx ON ctx.doc_id = c.doc_id AND ctx.pos = c.pos),
    vocab AS (SELECT t, contains(t, '-') AS pair, count(DISTINCT doc) AS docs, CAST(row_number() OVER (PARTITION BY contains(t, '-') ORDER BY count(DISTINCT doc) DESC, t) AS INT) AS rank FROM terms GROUP BY 1 QUALIFY rank <= 100)"""


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "journal", "pub_year")
    return archive.contexts(docs, "doc_id", "text")


def _term_fact(spark: SparkSession, folder: str) -> DataFrame:
    return archive.term_fact(_contexts(spark, folder), "doc_id", "pub_year", "journal")


def _ind_doc(fact: str, *dims: str) -> str:
    return f"{_CITED} SELECT {', '.join(dims)}, count(*) AS ind, count(DISTINCT doc) AS doc FROM {fact} GROUP BY {', '.join(dims)}"


@_query(_CITED + " SELECT c AS cite, count(*) AS n, count(DISTINCT doc) AS docs FROM fact GROUP BY 1")
def citation_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _contexts(spark, folder).select("doc_id", F.explode("cited").alias("cite")).groupBy("cite").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@_query(_CITED + """ SELECT ctx.doc_id, place AS "where", context, context_right, string_agg(cite, '; ' ORDER BY i, form, n) AS cited FROM ctx JOIN cites c ON c.doc_id = ctx.doc_id AND c.pos = ctx.pos GROUP BY 1, ctx.pos, 2, 3, 4""")
def citation_context(spark: SparkSession, folder: str) -> DataFrame:
    return _contexts(spark, folder).select("doc_id", "where", "context", "context_right", F.array_join("cited", "; ").alias("cited"))


_TEXT_SPACES = ("fy", "c", "fj", "fj.fy", "c.fj", "c.fy")


@_query(_cube_sql(_CITED, "fact", _TEXT_SPACES))
def text_cube(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_spaces(archive.cited_fact(_contexts(spark, folder), "doc_id", "pub_year", "journal"), _TEXT_SPACES)


@_query(_ind_doc("terms", "t"))
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(_term_fact(spark, folder), "t")


@_query(_ind_doc("terms", "fy", "t"))
def term_year(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(_term_fact(spark, folder), "fy.t")


@_query(_CITED + " SELECT * FROM vocab")
def term_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return archive.vocabulary(_term_fact(spark, folder), 200)


@_query(_CITED + " SELECT c, t, count(*) AS ind, count(DISTINCT f.doc) AS doc FROM fact f JOIN terms USING (doc, pos) GROUP BY 1, 2")
def cited_term(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(archive.cited_terms(_contexts(spark, folder), "doc_id", "pub_year"), "c.t")


@_query(_CITED + """, kept AS (SELECT terms.* FROM terms JOIN vocab USING (t)),
    met AS (SELECT a.t AS t1, b.t AS t2, a.doc FROM kept a JOIN kept b ON a.doc = b.doc AND a.pos = b.pos AND a.t < b.t)
    SELECT t1, t2, count(*) AS ind, count(DISTINCT doc) AS doc FROM met
    WHERE len(list_intersect(list_distinct(string_split(t1, '')), list_distinct(string_split(t2, '')))) < least(len(list_distinct(string_split(t1, ''))), len(list_distinct(string_split(t2, '')))) GROUP BY 1, 2""")
def term_pairs(spark: SparkSession, folder: str) -> DataFrame:
    fact = _term_fact(spark, folder)
    pairs = archive.term_pairs(fact, archive.vocabulary(fact, 200))
    return pairs.groupBy("t1", "t2").agg(F.count("*").alias("ind"), F.countDistinct("doc").alias("doc"))


@_query(_ind_doc("terms", "fj", "t"))
def term_journal(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(_term_fact(spark, folder), "fj.t")


_COCITED = _CITED + ", one AS (SELECT DISTINCT doc, pos, c, fy FROM fact), met AS (SELECT a.c AS c1, b.c AS c2, a.fy, a.doc FROM one a JOIN one b ON a.doc = b.doc AND a.pos = b.pos AND a.c < b.c)"


@_query(_COCITED + " SELECT c1, c2, count(*) AS ind, count(DISTINCT doc) AS doc FROM met GROUP BY 1, 2")
def text_cocited(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(archive.cited_pairs(_contexts(spark, folder), "doc_id", "pub_year"), "c1.c2")


@_query(_COCITED + " SELECT c1, c2, fy, count(*) AS ind, count(DISTINCT doc) AS doc FROM met GROUP BY 1, 2, 3")
def text_cocited_year(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_space(archive.cited_pairs(_contexts(spark, folder), "doc_id", "pub_year"), "c1.c2.fy")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and sections, each once; the parts of an entry are read by themselves."""
    pages = table(spark, folder, "jstor_page").select("entry_name", "elem", "seq", "content").distinct()
    return pages.withColumn("part", F.concat("entry_name", F.lit("/"), "elem"))


_PAGES = "p AS (SELECT DISTINCT entry_name || '/' || elem AS part, seq, content FROM jstor_page)"


@_query(rf"""WITH {_PAGES}, x AS (SELECT part, seq, string_split(regexp_replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS b FROM p),
    s AS (SELECT part, seq, k, b[k] AS s FROM x, unnest(range(1, len(b) + 1)) u(k) WHERE b[k] <> ''),
    n AS (SELECT *, sum(e) OVER (PARTITION BY part ORDER BY seq, k) AS no FROM (SELECT *, CASE WHEN coalesce(regexp_matches(lag(s) OVER (PARTITION BY part ORDER BY seq, k), '[.!?]$'), true) THEN 1 ELSE 0 END AS e FROM s))
    SELECT part AS doc, CAST(no AS INT) AS no, string_agg(s, ' ' ORDER BY seq, k) AS sentence FROM n GROUP BY 1, 2""")
def page_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return archive.sentences(_pages(spark, folder), "part", "seq", "content")


_HEADS = rf"""{_PAGES}, w AS (SELECT DISTINCT part, seq, string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ')[:20] AS w FROM p), n AS (SELECT part, count(*) AS pages FROM w GROUP BY 1),
    v AS (SELECT part, array_to_string(w[:k], ' ') AS head, count(*) AS votes FROM w, unnest(range(1, least(14, len(w)) + 1)) u(k) GROUP BY 1, 2),
    c AS (SELECT v.* FROM v JOIN n USING (part) WHERE votes > pages / 4.0 AND pages > 1 AND votes > 1 AND head <> ''),
    top AS (SELECT part, head, votes FROM c WHERE NOT EXISTS (FROM c d WHERE d.part = c.part AND starts_with(d.head, c.head || ' ')))"""


@_query(f"""WITH {_HEADS}, h AS (SELECT part, list(head ORDER BY head) AS hs FROM top GROUP BY 1)
    SELECT p.part, p.seq, CASE WHEN seq > 1 AND hs IS NOT NULL THEN list_reduce(list_prepend(content, hs), lambda t, h: CASE WHEN instr(t, h) BETWEEN 1 AND 30 THEN regexp_replace(replace(t, h, ''), '^\\s+|\\s+$', '', 'g') ELSE t END) ELSE content END AS content
    FROM p LEFT JOIN h ON h.part = p.part""")
def pages_without_heads(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder).select("part", "seq", "content")
    return archive.without_heads(pages, archive.head_votes(pages, "part"), "part")


_LIST = "(?:REFERENCES|References|Literature Cited)"


@_query(f"""WITH {_PAGES}, n AS (SELECT *, len(regexp_extract_all(content, '{_LIST}')) AS k FROM p), a AS (SELECT *, sum(k) OVER (PARTITION BY part) AS total, max(seq) FILTER (k > 0) OVER (PARTITION BY part) AS spot FROM n)
    SELECT part, seq, CASE WHEN total = 1 AND seq > spot THEN NULL WHEN total = 1 AND seq = spot THEN trim(string_split_regex(content, '{_LIST}')[1]) ELSE content END AS body,
    CASE WHEN total = 1 AND seq > spot THEN content WHEN total = 1 AND seq = spot THEN string_split_regex(content, '{_LIST}')[2] END AS bibliography FROM a""")
def pages_and_references(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder).select("part", "seq", "content")
    return archive.before_references(pages, "part").drop("content")


@_query(f"WITH {_HEADS} SELECT part AS entry, head, votes FROM top")
def header_vote(spark: SparkSession, folder: str) -> DataFrame:
    return archive.head_votes(_pages(spark, folder), "part")


@_query(_DC + " SELECT full_ref, count(*) AS n FROM j WHERE starts_with(lower(full_ref), 'quillforthe, w.|') GROUP BY 1")
def author_works(spark: SparkSession, folder: str) -> DataFrame:
    rows = _joined(spark, folder).withColumn("c", F.col("full_ref"))
    return relational.count_table(search(rows, "c", "Quillforthe, W.|"), ["full_ref"], documents=False)


@_query(_DC + """ SELECT journal, count(*) AS n FROM j WHERE author NOT IN ('Oskarvalde, T.', 'Quillforthe, W.')
    AND full_ref IN (SELECT full_ref FROM j WHERE doc_year >= 2015) GROUP BY 1""")
def listed_values(spark: SparkSession, folder: str) -> DataFrame:
    joined = _joined(spark, folder).where("author is not null")
    banned = spark.createDataFrame([("Oskarvalde, T.",), ("Quillforthe, W.",)], "author string")
    recent = _joined(spark, folder).where("doc_year >= 2015").select("full_ref")
    return relational.count_table(facts.keep_values(facts.drop_values(joined, "author", banned), "full_ref", recent), ["journal"], documents=False)


@_query("SELECT zip_name AS zip, count(*) AS n_entries FROM jstor_entry GROUP BY 1")
def archive_counts(spark: SparkSession, folder: str) -> DataFrame:
    return archive.entry_counts(table(spark, folder, "jstor_entry").select(F.col("zip_name").alias("zip")))


@_query()
def archive_metadata(spark: SparkSession, folder: str) -> DataFrame:
    # Entries listed twice are alike; if they are not, the smaller text counts.
    entries = table(spark, folder, "jstor_entry").groupBy("entry_name").agg(F.min("zip_name").alias("zip_name"), F.min("metadata_xml").alias("metadata_xml"))
    return archive.metadata(entries, "metadata_xml")


def _entry_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of the scanned texts with the metadata of their entries."""
    pages = _pages(spark, folder).select("entry_name", "part", "seq", "content")
    docs = archive_metadata(spark, folder).select("entry_name", "authors", "year", "journal")
    return archive.contexts(archive.without_heads(pages, archive.head_votes(pages, "part"), "part").join(docs, "entry_name"), "entry_name", "content")


@_query()
def archive_author_spaces(spark: SparkSession, folder: str) -> DataFrame:
    return cube.count_spaces(archive.author_fact(_entry_contexts(spark, folder), "entry_name", "year", "journal"), ("fa", "c.fa", "fa.fj.fy", "c", "c.fj"))


@_query()
def archive_text_starts(spark: SparkSession, folder: str) -> DataFrame:
    """First pages and sections from the end of their entry's own title and authors on."""
    pages = _pages(spark, folder).drop("part")
    return archive.without_front(pages, archive_metadata(spark, folder)).where("seq = 1")


@_query()
def archive_research(spark: SparkSession, folder: str) -> DataFrame:
    return archive.research(archive_metadata(spark, folder)).select("entry_name", "journal", "year", "n_authors")


@_query("""SELECT CASE WHEN trim(l) = '' THEN 'empty' WHEN regexp_matches(trim(l), '^[0-9]+$') THEN 'page number' ELSE 'text' END AS kind, count(*) AS n
    FROM (SELECT unnest(string_split(replace(content, chr(13), ''), chr(10))) AS l FROM jstor_page) GROUP BY 1""")
def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "jstor_page").select(F.explode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("l"))
    return lines.groupBy(text.line_kind(F.col("l")).alias("kind")).agg(F.count("*").alias("n"))


@_query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS ind, count(DISTINCT user_id) AS doc FROM events GROUP BY 1, 2")
def events_windowed(spark: SparkSession, folder: str) -> DataFrame:
    return windowed_counts(table(spark, folder, "events"), "ts", ["event_type"], "user_id")
