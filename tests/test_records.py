"""Packed values, bad rows, nested records and hot keys."""

import datetime
import xml.etree.ElementTree as ET

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from citeloom.operators import hotkeys, nested, packed, rejects

TAB = "\t"


def lines(spark, *rows):
    return spark.createDataFrame([(i, "f", i + 2, r, "clash") for i, r in enumerate(rows)], "line_id long, file_name string, line_no int, raw_line string, fields string")


def record(py="2000", au="Doe, J", ea="", ti="t", n=10):
    cells = ["u", "Article", ti, "J", py, au, "", ea, "0", "k"]
    return TAB.join(cells[:n] + ["x"] * (n - 10))


def reasons(spark, *rows):
    df = lines(spark, *rows)
    got = {}
    for r in rejects.bad_lines(rejects.classify_lines(df)).collect():
        got.setdefault(r.line_id, set()).add(r.reason)
    return [got.get(i, set()) for i in range(len(rows))]


def test_reasons(spark):
    got = reasons(
        spark, record(), record() + "\r", record(n=9), record(n=11), record(ti='"a\tb ""c"""'), record(ti='"a" b'), record(ti='"a'), record(ti='the "x" b'),
        record(py=""), record(py="", ea="APR 2001"), record(py=" 2004 "), record(py="1899"), record(py="2027"), record(py="2Ol7"),
        record(ea="FEB 30 1999"), record(ea="2/29/2019"), record(ea="2/29/2020"), record(ea="MRZ 12 2007"), record(ea="JAN 1988 12"), record(au="NULL"), record(au="12; 14"), record(au="none given"), record(py="", ea="n.d."), "", "  ", None,
    )
    assert got == [
        set(), set(), {"columns"}, {"columns"}, set(), {"quoting"}, {"quoting"}, set(), {"py"}, set(), set(), {"py"}, {"py"}, {"py"},
        {"ea"}, {"ea"}, set(), {"ea"}, {"ea"}, {"au"}, {"au"}, {"au"}, {"py", "ea"}, set(), set(), set(),
    ]


def test_headers_clashing_columns_and_long_lines(spark):
    df = lines(spark, TAB.join(rejects.TAGS), record(ti="x" * 300_000), record(ti='"' + 'y""' * 20_000 + '"')).withColumnRenamed("fields", "_text")
    assert rejects.classify_lines(df).count() == 2
    good = rejects.good_records(rejects.classify_lines(df)).collect()
    assert sorted(len(r.ti) for r in good) == [40_000, 300_000]
    assert rejects.classify_lines(df.limit(0)).count() == 0


def test_lines_beyond_the_parser(spark):
    """More tabs than the parser has columns, and a line end inside a quoted field."""
    wide = record(ti='"' + "a\t" * 30_000 + '"')
    df = lines(spark, wide, record(ti='"one\ntwo"'), "x\t" * 30_000, '"x\t' * 30_000, "a\n" + record(n=9))
    got = {r.line_id: (r.reasons, r.fields.TI if r.fields else None) for r in rejects.classify_lines(df).collect()}
    assert got == {0: ([], "a\t" * 30_000), 1: ([], "one\ntwo"), 2: (["columns"], None), 3: (["quoting"], None), 4: (["columns"], None)}


def test_fields_come_from_the_parser(spark):
    df = rejects.good_records(rejects.classify_lines(lines(spark, record())))
    assert "from_csv" in df._jdf.queryExecution().optimizedPlan().toString()


@settings(max_examples=15, deadline=None)
@given(st.dates(datetime.date(1900, 1, 1), datetime.date(2026, 12, 31)))
def test_every_real_date_is_usable(spark, day):
    df = spark.createDataFrame([(f"{rejects.MONTHS[day.month - 1]} {day.day} {day.year}",), (f"{day.month}/{day.day}/{day.year}",), (f"{rejects.MONTHS[day.month - 1]} {day.year}",)], "x string")
    assert all(r.y for r in df.select(rejects.usable_date(F.col("x")).alias("y")).collect())


XML = """<article><front><title-group><article-title>A <i>b</i></article-title></title-group><contrib-group><aff id="a1">X</aff>
<contrib><name>N</name><xref ref-type="aff" rid="a1 a9"/><aff>Own</aff></contrib><contrib><collab>C<contrib-group><contrib><name>M</name></contrib></contrib-group></collab></contrib></contrib-group>
<product><year>1990</year><contrib/><product><year/><year>1991</year></product></product><year><![CDATA[2000]]></year></front><sub-article><article-title>S</article-title></sub-article></article>"""


def test_nested(spark):
    df = spark.createDataFrame([("e", XML, 1), ("e", XML, 1), ("bad", "<a>", 1), ("none", None, 1), (None, XML, 1)], "entry_name string, metadata_xml string, entry int")
    got = {tuple(r)[:5] for r in nested.contributions(df).collect()}
    assert got == {
        ("e", 0, "article-title", 1, 0), ("e", 0, "contrib", 1, 1), ("e", 0, "contrib", 1, 2), ("e", 0, "contrib", 2, 0), ("e", 0, "contrib", 3, 0),
        ("e", 1, "year", 1, 0), ("e", 1, "contrib", 1, 0), ("e", 2, "year", 1, 0), ("e", 0, "year", 1, 0), ("e", 3, "article-title", 1, 0),
    }
    assert nested.contributions(df.limit(0)).count() == 0


def test_inlining(spark):
    df = spark.createDataFrame([("1", "<r><a><b>x</b></a><c n='1'/><c n='2'/><d><d/></d></r>")], "k string, x string")
    graph = nested.schema_graph(df, "x")
    assert graph.tables == {"r", "c", "d"}
    rows = {(r.tab, r.id): r for r in nested.shred(df, "k", "x", graph).collect()}
    root = next(r for (t, _), r in rows.items() if t == "r")
    assert root.cols == {"a/b": "x"} and {r.cols["@n"] for (t, _), r in rows.items() if t == "c"} == {"1", "2"}
    inner = [r for (t, _), r in rows.items() if t == "d"]
    assert {(r.parent_tab, r.parent_id) for r in inner} == {("r", root.id), ("d", min(r.id for r in inner))}
    ids = {(r.tab, r.id) for r in rows.values()}
    assert all((r.parent_tab, r.parent_id) in ids for r in rows.values() if r.parent_tab)
    assert ET.fromstring("<a/>") is not None


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", None)] * 98 + [("b", "x"), ("", "x"), (None, None)], "full_ref string, author string")
    got = {tuple(r) for r in hotkeys.heavy_keys(df, ["full_ref", "author"], 0.5).select("field", "key_value", "n").collect()}
    assert got == {("full_ref", "a", 98), ("author", "x", 2)}
    assert hotkeys.heavy_keys(df.limit(0), ["full_ref", "author"], 0.5).count() == 0
    assert {tuple(r) for r in hotkeys.distinct_by_key(df, "author", "full_ref", "n").collect()} == {("x", 2)}


NAMES = ["Doe, Jane", "Roe, Richard B.", "Smith, John", "Miller, Ann", "Brown, Carl", "Jones, Ed", "Adams, Flo", "Clark, Gus"]


def test_packed(spark):
    rows = [(f"n{i}", "; ".join([NAMES[i % 8], NAMES[(i + 3) % 8]]), f"A B, {1950 + i}, X Y; C D, 1990, Z", "kinship; guild; class, social" if i % 2 else "kinship, guild") for i in range(40)]
    rows += [
        ("and", "J. Doe, R. Roe and A. Miller", None, ""), ("quoted", '"Doe, Jane";“Roe, Richard B.”;;', '"A B, 1990; NEW SER, X"|C D, 1991, Y // E F, 1992, Z', '"the ""short"" guild", kinship'),
        ("jr", "Doe, J, Jr; Brown, Carl", " ", None), ("empty", "", None, None), ("long", ";".join(["Doe, Jane"] * 3000), None, None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "ut string, au string, cr string, id string, pos int")
    got = {}
    for r in packed.split_packed(df, "ut", packed.WOS_FIELDS).orderBy("ut", "field", "pos").collect():
        got.setdefault((r.ut, r.field), []).append(r.item)
    assert got["n1", "au"] == [NAMES[1], NAMES[4]] and got["n1", "cr"] == ["A B, 1951, X Y", "C D, 1990, Z"] and got["n1", "id"] == ["kinship", "guild", "class, social"]
    assert got["n2", "id"] == ["kinship", "guild"] and got["and", "au"] == ["J. Doe", "R. Roe", "A. Miller"]
    assert got["quoted", "au"] == ["Doe, Jane", "Roe, Richard B."] and got["quoted", "cr"] == ["A B, 1990; NEW SER, X", "C D, 1991, Y", "E F, 1992, Z"] and got["quoted", "id"] == ['the "short" guild', "kinship"]
    assert got["jr", "au"] == ["Doe, J, Jr", "Brown, Carl"] and ("empty", "au") not in got and ("jr", "cr") not in got and len(got["long", "au"]) == 3000
    assert packed.split_packed(df.limit(0), "ut", packed.WOS_FIELDS).count() == 0


def test_every_separator_is_weighed(spark):
    """A bar that stands inside values is learned to do so, a semicolon to cut; values may have any number of parts."""
    rows = [(f"r{i}", f"{NAMES[i % 8]}; {NAMES[(i + 3) % 8]}; {NAMES[(i + 5) % 8]}", "a, b; kinship, ward; guild; kinship, guild") for i in range(160)]
    rows += [(f"b{i}", f"{NAMES[i % 8].replace(', ', '| ')}; {NAMES[(i + 3) % 8]}", None) for i in range(40)]
    many = "one, two, three, four, five, six, seven"
    rows += [(f"l{i}", None, f"{many}; guild") for i in range(3)]
    got = {}
    for r in packed.split_packed(spark.createDataFrame(rows, "ut string, au string, id string"), "ut", {f: packed.WOS_FIELDS[f] for f in ("au", "id")}).orderBy("ut", "field", "pos").collect():
        got.setdefault((r.ut, r.field), []).append(r.item)
    assert got["r1", "au"] == [NAMES[1], NAMES[4], NAMES[6]] and got["b1", "au"] == [NAMES[1].replace(", ", "| "), NAMES[4]]
    lexer = packed._Lexer(packed.WOS_FIELDS["id"])
    lat = packed._lattice(lexer, many)
    model = packed.Model(total=100.0, parts={1: 60.0, 4: 40.0}, split={(0, 0, 0): 1000.0}, places={p: 50.0 for p in range(8)})
    scores, long = packed._scores(lat, many, 0, [0.0] * len(lat.edges), model), packed._long(lat, many, 0, model)
    assert packed._viterbi(lat, scores, long) == [(0, 6)]
    # The chain gives a value of LISTED parts and one more the scores that spelling it out gives.
    whole = model.value(many.split(", "), 0.0) + 6 * model.cut_odds(0, 0)[1]
    enter, more, end = long
    assert abs(enter[0] + more[5] + more[6] + end[7] - whole) < 1e-9
    chances = packed._posterior(lat, scores, long)
    assert 0.0 <= sum(p for p, (i, _) in zip(chances, lat.edges) if i == 0) < 0.5


def test_latest_record(spark):
    df = spark.createDataFrame([("1", "old", datetime.datetime(2020, 1, 1)), ("1", "new", datetime.datetime(2021, 1, 1)), (None, "x", None), (None, "x", None), (None, "y", None)], "ut string, au string, loaded_at timestamp")
    got = sorted((r.ut or "", r.au) for r in packed.latest_records(df).collect())
    assert got == [("", "x"), ("", "y"), ("1", "new")]
