import random
import time
import zipfile

import pytest

from citeloom.operators import cube
from citeloom.sources import archive, wos
from citeloom.sources.dataset import Dataset, Slice, catalogue, resolve, search
from citeloom.streaming import windowed_counts


def test_tsv(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text('UT\tPY\tTI\r\n1\t2000\ta "quoted\r\n\r\n', encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_text("TI\tUT\nx\t2\n", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"UT\n\xff\xfe\n")
    rows = {r.UT: (r.PY, r.TI) for r in wos.read_tsv(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("2000", 'a "quoted'), "2": (None, "x")}


def test_tagged(spark, tmp_path):
    body = "﻿UT 1\nAU Smith, J\n   Doe, A\nSO J ONE\nCR A B, 1990, X\n   C D, 1991, Y\n\nUT 2\nAU X\n\nUT 3\nSO S\nUT 9\n"
    (tmp_path / "a.txt").write_text(body, encoding="utf-8")
    rows = {r.UT: r for r in wos.read_tagged(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "3;9"} and rows["1"].AU == "Smith, J;Doe, A" and rows["1"].CR == "A B, 1990, X;C D, 1991, Y"
    assert not rows["1"].bad and rows["3;9"].bad


def test_documents_and_references(spark):
    columns = ", ".join(f"{t} string" for t in wos.TAGS)
    rows = [
        ("1", "Article", "On ward", "J", "2000", "Doe, Jane; Roe, R", "BOURDIEU P, 1984, DISTINCTION; *X, 1990, Y", "", "1", "a; B ;"),
        ("2", "Letter", "x", "J", "2000", "A", "B", None, None, None), ("3", "Article", "Erratum", "J", "2000", "A", "B", None, None, None),
        ("4", "Article", "t", "J", "x", "A", "B", "APR 2001", None, None), ("5", "Article", "t", "J", "2000", None, "B", None, None, None),
    ]
    r = spark.createDataFrame(rows, columns)
    assert {x.UT: x.reject for x in wos.quality(r).collect()} == {"1": None, "2": "type", "3": "title", "4": "year", "5": "authors"}
    docs = wos.documents(r)
    assert [(d.doc, d.fj, d.fy, d.authors) for d in docs.collect()] == [("1", "j", 2000, ["doe, j", "roe, r"])]
    assert [(x.c, x.ta, x.ty, x.type) for x in wos.references(docs).collect()] == [("Bourdieu, P.|distinction", "Bourdieu, P.", 1984, "book")]
    doc, _, keyword = wos.relational(r)
    assert {d.id: d.year for d in doc.collect()}["4"] == 2001
    assert {k.text for k in keyword.collect()} == {"a", "b"}


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("metadata/one.xml", '<?xml version="1.0"?><article article-type="research-article"><front><article-meta><title-group><article-title>On ward</article-title></title-group><contrib-group><contrib>A</contrib></contrib-group><pub-date><year>1999</year></pub-date></article-meta></front></article>')
        z.writestr("ocr/one.txt", "<page>First one. Then (Bourdieu 1984) more.</page>")
        z.writestr("metadata/two.xml", "<article/>")
    entries = archive.read_entries(spark, str(tmp_path))
    assert archive.entry_counts(entries).head().n_entries == 3
    both = archive.page_texts(archive.metadata(archive.paired(entries)))
    row = archive.research(both).head()
    assert (row["name"], row.title, row.year, row.n_authors) == ("one", "On ward", 1999, 1)
    found = archive.contexts(both.select("name", "content", "year", "journal"), "name", "content").head()
    assert found.cited == ["Bourdieu (1984)"] and found.context == "Then "


def test_page_map(spark):
    known = spark.createDataFrame([("d", 3, 101), ("d", 7, 110)], "doc string, pdf int, printed int")
    wanted = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9)], "doc string, pdf int")
    assert {r.pdf: r.printed for r in archive.page_map(known, wanted).collect()} == {1: 99, 5: 103, 9: 112}


def test_dataset(spark, tmp_path):
    fact = spark.createDataFrame([("d1", "w", 2000), ("d1", "w", 2000), ("d2", "v", 2002)], "doc string, c string, fy int")
    ds = Dataset(spark, str(tmp_path), "demo")
    ds.save(cube.count_spaces(fact, ["c", "c.fy", "fy"]))
    ds.set_attributes(start=2000, end=2002, doi="10.1/x")
    assert ds.spaces() == ["c", "c.fy", "fy"] and "fy.c" in ds and "ta" not in ds
    assert ds(c="w", fy=None).rows().collect()[0].asDict() == {"fy": 2000, "ind": 2, "doc": 1}
    assert ds(c="w", fy=2000).value() == 2 and ds(c="w", fy=1900).value() == 0
    assert [r.c for r in ds.items("cited_work").collect()] == ["v", "w"]
    assert search(ds.by("c"), "c", "W").count() == 1
    assert resolve(spark, str(tmp_path), "10.1/x").name == "demo" and list(catalogue(spark, str(tmp_path))) == ["demo"]
    with pytest.raises(KeyError):
        ds.by("ta")
    assert ds.trend("c").where("c = 'w'").count() == 3
    ds.add_grouping("c", spark.createDataFrame([("w", "g"), ("v", "g")], "value string, rep string"))
    assert [(r.c, r.ind) for r in ds.by("c").collect()] == [("g", 3)]
    ds.save_variable("x", fact)
    assert ds.variables() == ["x"] and ds.load_variable("x").count() == 3
    ds.drop_all("c")
    assert ds.spaces() == ["fy"]


def test_slices_are_immutable(spark):
    counts = spark.createDataFrame([("a", 1, 2, 1)], "c string, fy int, ind long, doc long")
    s = Slice(counts, "c.fy")
    t = s.refine(c="a")
    assert s.rows().columns == ["c", "fy", "ind", "doc"] and t.rows().columns == ["fy", "ind", "doc"]
    with pytest.raises(KeyError):
        s.refine(ta="x")


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1), ("2024-01-01 02:00:00", "a", 1), ("2024-01-09 00:00:00", "a", 2)], "ts string, k string, u int").selectExpr("cast(ts as timestamp) ts", "k", "u")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "ts", ["k"], "u").writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(str(r.window_start)[:10], r.ind, r.doc) for r in spark.table("counts").collect()}
    assert ("2024-01-01", 2, 1) in got


def archives(folder):
    xml = '<?xml version="1.0"?><article article-type="research-article"><front><article-title>On <i>ward</i></article-title><article-title>Second</article-title><contrib><name>Jane  Doe</name></contrib><contrib>R. Roe</contrib><article-meta><year>1999</year><year>2001</year></article-meta></front></article>'
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("metadata/journal-article-10.5_one.xml", xml)
        z.writestr("ocr/journal-article-10.5_one.txt", "<page>One (Bourdieu 1984) &amp; two.</page><sec>Three</sec>")
        z.writestr("metadata/journal-article-10.5_two.xml", xml.replace("</contrib><contrib>", "</contrib><contrib><broken>"))
        z.writestr("ocr/journal-article-10.5_two.txt", "<page>One & <b>two</page><page>Three")
        z.writestr("other/x.txt", "x")
    (folder / "bad.zip").write_bytes(b"no archive")
    return folder


def test_index_and_single_records(spark, tmp_path):
    index = archive.index_entries(spark, str(archives(tmp_path)))
    rows = index.collect()
    assert sorted(r.doi for r in rows if r.entry) == ["10.5/one", "10.5/one", "10.5/two", "10.5/two"] and [r.zip for r in rows if r.entry is None] == ["bad.zip"]
    one = {r.kind: r.text for r in archive.read_record(index, "10.5/one").collect()}
    assert set(one) == {"metadata", "ocr"} and one["ocr"].startswith("<page>One")
    assert archive.read_record(index, "10.5/none").count() == 0
    assert archive.read_indexed(index, part_bytes=1).count() == 4


def test_malformed_records(spark, tmp_path):
    both = archive.paired(archive.read_entries(spark, str(archives(tmp_path))))
    meta = {r["name"][-3:]: r for r in archive.metadata(both).collect()}
    good, bad = meta["one"], meta["two"]
    assert (good.title, good.authors, good.year, good.error) == ("On  ward;Second", ["Jane Doe", "R. Roe"], 1999, None) or good.title == "On ward;Second"
    assert bad.error == "malformed" and bad.authors[0] == "Jane Doe" and bad.type == "research-article"
    pages = sorted((r["name"][-3:], r.elem, r.seq, r.content) for r in archive.page_rows(both).collect())
    assert pages == [("one", "page", 1, "One (Bourdieu 1984) & two."), ("one", "sec", 1, "Three"), ("two", "page", 1, "One & two"), ("two", "page", 2, "Three")]
    texts = archive.page_texts(archive.metadata(both))
    found = archive.contexts(texts.select("name", "content", "year", "journal", "authors"), "name", "content")
    assert {(r.c, r.fa) for r in archive.author_fact(found, "name", "year", "journal").collect()} == {("Bourdieu (1984)", "Jane Doe"), ("Bourdieu (1984)", "R. Roe")}
    assert [r.context_right for r in found.collect()] == ["& two"]
    nothing = spark.createDataFrame([("x", None), ("y", " "), ("z", "no xml")], "name string, metadata string")
    assert {r["name"]: r.error for r in archive.metadata(nothing).collect()} == {"x": "empty", "y": "empty", "z": "malformed"}
    assert archive.metadata(nothing.limit(0)).count() == 0
    assert archive.light_documents(archive.read_entries(spark, str(tmp_path)), ["nowhere"]).count() == 0


def test_heads_fronts_and_references(spark):
    pages = spark.createDataFrame(
        [("e", 1, "ANNALS One"), ("e", 2, "ANNALS two ANNALS"), ("e", 3, "so ANNALS References A 1990"), ("e", 4, "B 1991"), ("f", 1, "References References"), ("f", 2, None)], "entry_name string, seq int, content string"
    )
    heads = spark.createDataFrame([("e", "ANNALS", 3)], "entry string, head string, votes int")
    assert {(r.entry_name, r.seq): r.content for r in archive.without_heads(pages, heads).collect()} == {("e", 1): "ANNALS One", ("e", 2): "two", ("e", 3): "so  References A 1990", ("e", 4): "B 1991", ("f", 1): "References References", ("f", 2): None}
    got = {(r.entry_name, r.seq): (r.body, r.bibliography) for r in archive.before_references(pages).collect()}
    assert got["e", 3] == ("so ANNALS", " A 1990") and got["e", 4] == (None, "B 1991") and got["e", 1] == ("ANNALS One", None) and got["f", 1] == ("References References", None)
    assert archive.near_match("household", "the housebold of") == None and archive.near_match("household economy", "the housebold economy of") == (4, 21)
    assert archive.text_start("On household economics\nJane Doe\nIt begins", "On household economics", "", ["Jane Doe"]) == 31
    docs = spark.createDataFrame([("e", "ANNALS", None, ["X"])], "entry_name string, title string, abstract string, authors array<string>")
    assert {(r.entry_name, r.seq): r.content for r in archive.without_front(pages, docs).collect()}[("e", 1)] == "One"


def edit_table(part, text):
    """near_match by the whole table of edits, each cell with its least edits and the first start of these."""
    column, best = [(j, 0) for j in range(len(part) + 1)], None
    for i, c in enumerate(text, 1):
        new = [(0, i)]
        for j, p in enumerate(part, 1):
            new.append(min((column[j - 1][0] + (p != c), column[j - 1][1]), (column[j][0] + 1, column[j][1]), (new[-1][0] + 1, new[-1][1])))
        column = new
        if column[-1][0] <= len(part) // 10 and (best is None or column[-1][0] < best[0]):
            best = (column[-1][0], column[-1][1], i)
    return best and best[1:]


def test_near_matches_equal_the_edit_table():
    deal, misprinted = random.Random(5), 0
    for n in range(1500):
        letters = ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz ", ".")[n % 4]
        part = "".join(deal.choices(letters, k=deal.randint(1, 80)))
        text = ""
        for _ in range(3):
            harmed = (deal.choice(("", deal.choice(letters), c + deal.choice(letters))) if deal.random() < 0.07 else c for c in part)
            text += "".join(deal.choices(letters, k=deal.randint(0, 30))) + "".join(harmed) * deal.randint(0, 1)
        got = archive.near_match(part, text)
        assert got == ((text.find(part), text.find(part) + len(part)) if part in text else edit_table(part, text)), (part, text)
        misprinted += got is not None and part not in text
    assert misprinted > 200


def test_long_texts_are_matched_in_time():
    """A long abstract on a long scan; by the whole table of edits these four searches took 72 s."""
    deal = random.Random(6)
    words = ["".join(deal.choices("etaoinshrdlu", k=deal.randint(2, 9))) for _ in range(300)]
    page, abstract = (" ".join(deal.choices(words, k=k)) for k in (16000, 100))
    began = time.process_time()
    harmed = "".join("#" if i % 12 == 5 else c for i, c in enumerate(abstract))
    at = len(page) // 2
    assert archive.near_match(abstract, page) is None
    assert archive.near_match(abstract, page[:at] + "\n" + harmed + "\n" + page[at:]) == (at + 1, at + 1 + len(abstract))
    assert archive.text_start(page[:at] + harmed + page[at:], None, abstract, []) == at + len(abstract)
    dots = "." * len(abstract)
    assert archive.near_match(dots[:-9] + "x" * 9, "." * 100_000) == (0, len(dots) - 9)  # no letter of it is rare
    assert time.process_time() - began < 10


def test_page_map_between(spark):
    known = spark.createDataFrame([("d", 3, 101), ("d", 7, 105)], "doc string, pdf int, printed int")
    wanted = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9)], "doc string, pdf int")
    assert {r.pdf: r.between for r in archive.page_map(known, wanted).collect()} == {1: False, 5: True, 9: False}


def test_sqlite(spark, tmp_path):
    import sqlite3

    from citeloom.sources.sqlite import read_sqlite

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE doc (id INTEGER, title TEXT)")
        db.executemany("INSERT INTO doc VALUES (?, ?)", [(i, f"t{i}" if i else None) for i in range(25)])
        db.execute("CREATE TABLE empty (id INTEGER)")
    assert sorted((r.id, r.title) for r in read_sqlite(spark, path, "doc", "id bigint, title string", 4).collect())[:2] == [(0, None), (1, "t1")]
    assert read_sqlite(spark, path, "doc", "id bigint", 40).count() == 25 and read_sqlite(spark, path, "empty", "id bigint").count() == 0


def test_dataset_extras(spark, tmp_path):
    fact = spark.createDataFrame([("d1", "w", 2000), ("d1", "v", 2001), ("d2", "v", 2002)], "doc string, c string, fy int")
    ds = Dataset(spark, str(tmp_path), "more")
    ds.save_all(fact, ["c", "c.fy", "fy"], start=2000, end=2002)
    ds.save_trends("c")
    assert {r.c: r.total for r in ds.load_variable("c.ysum").collect()} == {"w": 1, "v": 2}
    empty = ds.by_or_empty("c", "ta")
    assert empty.count() == 0 and dict(empty.dtypes) == {"c": "string", "ta": "string", "ind": "bigint", "doc": "bigint"} and ds.by_or_empty("fy").count() == 3
    assert [r.fy for r in ds(c="v", fy=None).ordered().collect()] == [2001, 2002] and ds.by_raw("c").count() == 2


def test_sound_files(spark):
    rows = [("a", "Article" if i < 2 else "Letter") for i in range(30)] + [("b", "Article")] * 3
    columns = ", ".join(f"{t} string" for t in wos.TAGS)
    r = spark.createDataFrame([(*["1", k, "On ward", "J", "2000", "A, B", "X 1990, Y", None, None, None], p) for p, k in rows], columns + ", path string")
    assert {x.path: (x.n_rows, x.n_kept) for x in wos.survival(r).collect()} == {"a": (30, 2), "b": (3, 3)}
    assert {x.path for x in wos.from_sound_files(r, least_rows=20).collect()} == {"b"} and wos.from_sound_files(r).count() == 33


def test_tagged_blocks(spark, tmp_path):
    """Files larger than one block, CRLF and blanks on empty lines."""
    body = "".join(f"UT {i}\r\nSO S\r\nCR A\r\n   B{i}\r\n \t\r\n" for i in range(400))
    (tmp_path / "a.txt").write_text(body, newline="", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        rows = wos.read_tagged(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 400 and {(r.UT, r.CR) for r in rows} == {(str(i), f"A;B{i}") for i in range(400)}
