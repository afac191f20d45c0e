from pyspark.sql import functions as F

from citeloom.functions import normalize, text


def values(spark, expression, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_references(spark):
    got = values(
        spark, normalize.parse_reference,
        "BOURDIEU P, 1984, DISTINCTION SOCIAL C", "GRANOVETTER MS, 1973, AM J SOCIOL, V78, P1360", "COLEMAN JS, 1988, AM J SOCIOL, V94, pS95, DOI 10.1086/228943",
        "P BOURDIEU, 1977, OUTLINE", "*US BUR CENS, 1990, CENS POP", "ANONYMOUS, 1990, X", "MARX K, CAPITAL", "", None,
    )
    assert [tuple(g) if g else None for g in got] == [
        ("Bourdieu, P.", 1984, "book", "Bourdieu, P.|distinction social c"), ("Granovetter, M.", 1973, "article", "Granovetter, M.|1973|am j sociol,v78,p1360"),
        ("Coleman, J.", 1988, "article", "Coleman, J.|1988|am j sociol,v94,ps95"), ("Bourdieu,, P.", 1977, "book", "Bourdieu,, P.|outline"), None, None, None, None, None,
    ]


def test_citing_authors(spark):
    got = values(spark, normalize.citing_authors, "Smith, John A.; O'Neil, Mary; Müller, K; Plato; Smith, J, Jr")
    assert got == [["smith, j", "oneil, m", "mller, k", "plato", "smith, j, jr"]]


def test_titles(spark):
    assert values(spark, normalize.looks_like_research, "Book Review: X", "Erratum", "", "Erratum in theory", "Errata: y") == [False, False, False, True, False]


def test_title_case(spark):
    assert values(spark, normalize.title_case, "o'brien, smith-JONES") == ["O'Brien, Smith-Jones"]


def test_brackets_and_citations(spark):
    df = spark.createDataFrame([(1, "a (b (c) d) e"), (2, "x (see Bourdieu and Passeron 1977; Coleman 1988a) y"), (3, "z (Bourdieu 1984)"), (4, "(May 1968)"), (5, None), (6, "")], "id int, t string")
    rows = text.bracket_rows(df, "t")
    assert [(r.id, r.start, r.content) for r in rows.orderBy("id").collect()][:1] == [(1, 2, "b (c")]
    cited = text.citation_rows(rows, "content").withColumn("k", text.citation_keys(F.col("cited")))
    assert {r.id: r.k for r in cited.collect()} == {2: ["Bourdieu and Passeron (1977)", "Coleman (1988)"], 3: ["Bourdieu (1984)"]}


def test_terms(spark):
    assert set(values(spark, text.terms, "The social capital of the social")[0]) == {"social", "capital", "capital-social"}
    assert values(spark, text.terms, "", "the of") == [[], []]


def test_scan_cleaning(spark):
    assert values(spark, text.clean_scan, " a  word-\n cut ") == ["a wordcut"]
    assert values(spark, text.one_paragraph, "word-\ncut\nline") == ["wordcut line"]


def test_small_functions(spark):
    assert values(spark, normalize.record_name, "ocr/abc.xml", "abc.txt") == ["abc", "abc"]
    assert values(spark, normalize.is_roman, "xiv", "x1") == [True, False]
    assert values(spark, lambda c: text.untokenized(F.split(c, " ")), "It is n't here .") == ["It is n't here."]
    assert values(spark, lambda c: text.before_bibliography(c)["bibliography"], "a References b", "References References") == [" b", None]


def test_small_volume_and_page_letters_make_articles(spark):
    got = values(
        spark, normalize.parse_reference,
        "GRANOVETTER MS, 1973, AM J SOCIOL, v78, p1360", "DOE J, 1990, SOC FORCES, 12, p3", "DOE J, 1990, SOC FORCES 12, 3", "DOE J, 1990, " + "A, " * 1500 + "v3",
    )
    assert [r.type for r in got] == ["article"] * 4 and got[0].full_ref == "Granovetter, M.|1973|am j sociol,v78,p1360"
    assert got[3].full_ref.count(",a") == 1499 and got[3].full_ref.endswith(",v3")  # references of any length
