"""Full-text archives: zip files of metadata and scanned text, their documents, citations, contexts and terms.

An archive is listed by its directory only; the entries are then read by as many tasks as their sizes ask for, each
opening the archives it needs and seeking to its entries, so that no archive is ever one cell or one task. Each XML
text is parsed once. What is not well-formed is read as far as it goes and named in a column `error`.
"""

from __future__ import annotations

import html
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from citeloom.functions.normalize import document_type, looks_like_research, record_name
from citeloom.functions.text import STOPWORDS, bracket_rows, citation_keys, citation_rows, left_context, right_context, terms

PART_BYTES = 64 << 20  # of unpacked entries that one task reads
INDEX = "zip string, path string, entry string, kind string, name string, doi string, size bigint"


def _opened(path: str) -> zipfile.ZipFile:
    system, inner = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(system.open_input_file(inner))


def entry_doi(name: str) -> str:
    """The identifier in a record's name: what follows the last hyphen, with slashes for underscores."""
    return name.rsplit("-", 1)[-1].replace("_", "/")


def index_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entry of all zip files below a folder: zip, path, entry, kind (metadata or ocr), name, doi, size.

    Only the archives' directories are read. A file that is no zip archive gives one row with a null entry.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder).select("path")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                short, rows = path.rsplit("/", 1)[-1], []
                try:
                    with _opened(path) as z:
                        for info in z.infolist():
                            kind = info.filename.split("/", 1)[0]
                            if kind in ("metadata", "ocr") and not info.is_dir():
                                name = re.sub(r"\.(?:xml|txt)$", "", info.filename.rsplit("/", 1)[-1])
                                rows.append((short, path, info.filename, kind, name, entry_doi(name), info.file_size))
                except (zipfile.BadZipFile, ValueError, OSError):
                    rows.append((short, path, None, None, None, None, 0))
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in INDEX.split(", ")])

    return files.repartition("path").mapInPandas(listed, INDEX)


def read_indexed(index: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The entries of an index with their text: zip, entry, kind, name, doi, text. Broken entries have a null text."""
    size = index.agg(F.sum("size")).head()[0] or 0
    spread = index.where("entry is not null").repartitionByRange(max(1, -(-size // part_bytes)), "path", "entry")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, archive = None, None
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part, texts = batch.iloc[lo : lo + 64], []
                for path, entry in zip(part["path"], part["entry"]):
                    if path != at:
                        at, archive = path, _opened(path)
                    try:
                        texts.append(archive.read(entry).decode("utf-8", "replace"))
                    except (zipfile.BadZipFile, KeyError, EOFError, ValueError):
                        texts.append(None)
                yield part[["zip", "entry", "kind", "name", "doi"]].assign(text=texts)

    return spread.sortWithinPartitions("path", "entry").mapInPandas(read, "zip string, entry string, kind string, name string, doi string, text string")


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all zip files below a folder: zip, entry, kind (metadata or ocr), name, doi, text."""
    return read_indexed(index_entries(spark, folder))


def read_record(index: DataFrame, doi: str) -> DataFrame:
    """Both sides of one record by its identifier; only its own entries are read."""
    return read_indexed(index.where(F.col("doi") == doi))


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("zip").agg(F.count("*").alias("n_entries"))


def paired(entries: DataFrame, one_in: int = 1) -> DataFrame:
    """Records that have both sides: name, zip, metadata, ocr; of `one_in` records one is kept by its name's hash."""
    named = entries.withColumn("name", record_name(F.col("entry")))
    meta, ocr = (named.where(F.col("kind") == k).groupBy("name").agg(F.min("zip").alias(f"zip_{k}"), F.min("text").alias(k)) for k in ("metadata", "ocr"))
    both = meta.join(ocr, "name").select("name", F.col("zip_metadata").alias("zip"), "metadata", "ocr")
    return both if one_in <= 1 else both.where(F.pmod(F.xxhash64("name"), F.lit(one_in)) == 0)


FIELDS = {
    "title": ".//article-title", "journal": ".//journal-title", "publisher": ".//publisher-name", "abstract": ".//article-meta//abstract", "month": ".//article-meta//month",
    "years": ".//article-meta//year", "volume": ".//article-meta//volume", "issue": ".//article-meta//issue", "fpage": ".//article-meta//fpage", "lpage": ".//article-meta//lpage",
}


def parse_leniently(text: str | None) -> tuple[ET.Element | None, str | None]:
    """(root, error): of a text that is not well-formed, the tree of what stands before the fault."""
    if text is None or not text.strip():
        return None, "empty"
    source = re.sub(r"\s(?:\w+:)(\w+=)", r" \1", re.sub(r"^\s*<\?xml[^>]*\?>", "", text))  # prefixes without a declaration
    parser = ET.XMLPullParser(("start",))
    root = None
    try:
        parser.feed(source)
        error = None
    except ET.ParseError:
        error = "malformed"
    try:
        for _, node in parser.read_events():
            root = node if root is None else root
    except ET.ParseError:
        error = "malformed"
    if error is None:
        try:
            parser.close()
        except ET.ParseError:
            error = "malformed"
    return root, error


def metadata(rows: DataFrame, xml: str = "metadata") -> DataFrame:
    """The rows with type, title, journal, publisher, abstract, authors, n_authors, month, year, volume, issue, fpage, lpage, error.

    Several values of one path are joined by semicolons; the year is the first. `authors` are the texts of the
    contributors. `error` is `empty`, `malformed` (what was read up to the fault is kept), `year` (no valid one) or
    null. Columns of the input with these names give way.
    """
    names = ["type", *[n for n in FIELDS if n != "years"], "authors", "year", "error"]

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                root, error = parse_leniently(text)
                if root is None:
                    out.append((None, *[None] * (len(FIELDS) - 1), [], None, error))
                    continue
                found = {n: ";".join(" ".join(x.itertext()) for x in root.iterfind(path)).strip() for n, path in FIELDS.items()}
                authors = [" ".join(" ".join(x.itertext()).split()) for x in root.iterfind(".//contrib")]
                year = found.pop("years").split(";")[0].strip()
                valid = int(year) if re.fullmatch(r"[+-]?\d{1,9}", year) else None
                out.append((root.get("article-type"), *found.values(), authors, valid, error or (None if valid is not None else "year")))
            yield pd.DataFrame(out, columns=names).astype({"year": "Int32"})

    strings = ", ".join(f"{n} string" for n in names[:-3])
    parse = F.pandas_udf(read, f"{strings}, authors array<string>, year int, error string")
    kept = [c for c in rows.columns if c not in (*names, "n_authors", xml)]
    read_once = rows.withColumn("_m", parse(F.col(xml))).select(*kept, "_m.*")
    return read_once.withColumn("type", document_type(F.col("type"), F.col("title"))).withColumn("n_authors", F.size("authors"))


def research(rows: DataFrame) -> DataFrame:
    """Research articles with a year, an author and a title that is no notice."""
    return rows.where((F.col("type") == "research-article") & looks_like_research(F.col("title")) & (F.col("n_authors") > 0) & F.col("year").isNotNull())


def page_rows(rows: DataFrame, xml: str = "ocr") -> DataFrame:
    """One row per page and section: the columns of `rows` but the text, elem, seq, content.

    A scan that is not well-formed is cut at its page and section tags and freed of all others.
    """
    kept = [c for c in rows.columns if c not in (xml, "elem", "seq", "content")]

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                source = re.sub(r"<\?xml[^>]*\?>", "", text or "")
                try:
                    root = ET.fromstring(f"<doc>{source}</doc>")
                    out.append([(tag, k, "".join(x.itertext())) for tag in ("page", "sec") for k, x in enumerate(root.iter(tag), 1)])
                except ET.ParseError:
                    blocks = {tag: re.findall(rf"(?s)<{tag}\b[^>]*>(.*?)(?=</{tag}>|<{tag}\b|\Z)", source) for tag in ("page", "sec")}
                    out.append([(tag, k, html.unescape(re.sub(r"<[^<>]*>", "", x))) for tag, xs in blocks.items() for k, x in enumerate(xs, 1)])
            yield pd.Series(out)

    pages = F.pandas_udf(cut, "array<struct<elem:string,seq:int,content:string>>")
    return rows.select(*kept, F.explode(pages(F.col(xml))).alias("_p")).select(*kept, "_p.*")


def page_texts(rows: DataFrame, xml: str = "ocr") -> DataFrame:
    """The rows with `content`: the texts of all pages, then of all sections; rows without any have an empty one."""
    name = "name"
    pages = page_rows(rows.select(name, xml), xml)
    order = F.struct((F.col("elem") == "sec").alias("s"), "seq", "content")
    texts = pages.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["content"]), "\n").alias("content"))
    return rows.drop(xml, "content").join(texts, name, "left").withColumn("content", F.coalesce("content", F.lit("")))


def light_documents(entries: DataFrame, journals: list[str] | None = None) -> DataFrame:
    """Documents without pages, with their whole text, of the given journals: name and the columns of `metadata`, content."""
    rows = metadata(paired(entries))
    rows = rows if journals is None else rows.where(F.lower("journal").isin([j.lower() for j in journals]))
    return rows.withColumn("content", F.trim(F.regexp_replace("ocr", r"<[^<>]*>", " "))).drop("ocr")


def contexts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Brackets with citations: the columns of `docs` but the text, where, context, context_right, cited (array of keys)."""
    new = ("where", "context", "context_right", "cited")
    kept = [c for c in docs.columns if c != text and c not in new]
    docs = docs.select(*kept, F.col(text).alias("_text"))
    found = citation_rows(bracket_rows(docs, "_text", ("_no", "_start", "_inside")), "_inside").withColumn("cited", citation_keys(F.col("cited")))
    end = F.col("_start") + F.length("_inside") + 1
    return found.where(F.size("cited") > 0).select(
        *kept, F.col("_start").alias("where"), left_context(F.col("_text"), F.col("_start")).alias("context"), right_context(F.col("_text"), end).alias("context_right"), "cited"
    )


def cited_fact(found: DataFrame, doc: str, year: str, journal: str) -> DataFrame:
    """One row per context and cited work: doc, c, fy, fj."""
    return found.select(F.col(doc).alias("doc"), F.explode("cited").alias("c"), F.col(year).alias("fy"), F.lower(journal).alias("fj"))


def author_fact(found: DataFrame, doc: str, year: str, journal: str, authors: str = "authors") -> DataFrame:
    """One row per context, cited work and citing author: doc, c, fa, fy, fj."""
    rows = found.select(F.col(doc).alias("doc"), F.explode("cited").alias("c"), F.col(year).alias("fy"), F.lower(journal).alias("fj"), authors)
    return rows.select("doc", "c", F.explode(authors).alias("fa"), "fy", "fj")


def term_fact(found: DataFrame, doc: str, year: str, journal: str, stopwords=STOPWORDS) -> DataFrame:
    """One row per context and term: doc, ctx, t, fy, fj."""
    return found.select(F.col(doc).alias("doc"), F.col("where").alias("ctx"), F.explode(terms(F.col("context"), stopwords)).alias("t"), F.col(year).alias("fy"), F.lower(journal).alias("fj"))


def cited_terms(found: DataFrame, doc: str, year: str) -> DataFrame:
    """One row per context, cited work and term: doc, c, t, fy."""
    return found.select(F.col(doc).alias("doc"), F.col(year).alias("fy"), "context", F.explode("cited").alias("c")).select("doc", "fy", "c", F.explode(terms(F.col("context"))).alias("t"))


def vocabulary(fact: DataFrame, size: int) -> DataFrame:
    """The terms that are counted: half of `size` single words, half pairs, by documents, ties by term."""
    docs = fact.select("doc", "t").distinct().groupBy("t").agg(F.count("*").alias("docs")).withColumn("pair", F.contains("t", F.lit("-")))
    order = Window.partitionBy("pair").orderBy(F.desc("docs"), "t")
    return docs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size // 2).select("t", "pair", "docs", "rank")


def term_pairs(fact: DataFrame, keep: DataFrame) -> DataFrame:
    """Pairs of kept terms of a context, first smaller; pairs are left out whose letters are all shared with the shorter one.

    `keep` is a vocabulary of a size set by the caller, hence a context holds few of its terms.
    """
    rows = fact.join(keep.select("t"), "t", "left_semi").select("doc", "ctx", "t")
    lists = rows.groupBy("doc", "ctx").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    pairs = lists.select("doc", F.explode("ts").alias("t1"), "ts").select("doc", "t1", F.explode(F.filter("ts", lambda x: x > F.col("t1"))).alias("t2"))
    a, b = F.array_distinct(F.split("t1", "")), F.array_distinct(F.split("t2", ""))
    return pairs.where(F.size(F.array_intersect(a, b)) < F.least(F.size(a), F.size(b)))


def cited_pairs(found: DataFrame, doc: str, year: str) -> DataFrame:
    """Pairs of works cited in one context, first smaller: doc, c1, c2, fy."""
    lists = found.select(F.col(doc).alias("doc"), F.col(year).alias("fy"), F.array_sort(F.array_distinct("cited")).alias("cs"))
    one = lists.select("doc", "fy", F.explode("cs").alias("c1"), "cs")
    return one.select("doc", "c1", F.explode(F.filter("cs", lambda x: x > F.col("c1"))).alias("c2"), "fy")


def sentences(pages: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, no, sentence): sentences of a document's pages in order, those that run over a page's end in one piece."""
    w = Window.partitionBy("doc").orderBy("o", "k")
    cut = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.!?])\s+(?=\S)")
    bits = pages.select(F.col(doc).alias("doc"), F.col(order).alias("o"), F.posexplode(cut).alias("k", "s")).where("s <> ''")
    # A piece goes on with the one before unless that one ended a sentence.
    begins = F.coalesce(F.lag("s").over(w).rlike(r"[.!?]$"), F.lit(True))
    whole = bits.withColumn("no", F.sum(begins.cast("int")).over(w).cast("int")).groupBy("doc", "no")
    return whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "s"))), lambda x: x["s"]), " ").alias("sentence"))


def head_votes(pages: DataFrame, entry: str = "entry_name", order: str = "seq", text: str = "content") -> DataFrame:
    """Beginnings of pages that repeat: (entry, head), 1 to 14 words on more than a quarter of an entry's pages, longest ones only."""
    words = F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, 20)
    rows = pages.select(F.col(entry).alias("entry"), F.col(order).alias("o"), words.alias("w")).distinct()
    n = rows.groupBy("entry").agg(F.count("*").alias("pages"))
    prefixes = rows.select("entry", F.explode(F.sequence(F.lit(1), F.least(F.lit(14), F.size("w")))).alias("k"), "w").withColumn("head", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
    votes = prefixes.groupBy("entry", "head").agg(F.count("*").alias("votes")).join(n, "entry").where("votes > pages / 4.0 and pages > 1 and votes > 1 and head <> ''")
    longer = votes.select(F.col("entry").alias("e"), F.col("head").alias("h"), F.col("votes").alias("v"))
    # A prefix one word longer with a vote of its own covers this one.
    covered = votes.join(longer, (F.col("entry") == F.col("e")) & F.startswith("h", F.concat("head", F.lit(" "))), "left_anti")
    return covered.select("entry", "head", "votes")


def without_heads(pages: DataFrame, heads: DataFrame, entry: str = "entry_name", order: str = "seq", text: str = "content", near: int = 30) -> DataFrame:
    """Pages without the voted heads: from the second page on, where a head begins within the first `near` signs, all of it is taken out."""
    lists = heads.groupBy(F.col("entry").alias("_e")).agg(F.array_sort(F.collect_set("head")).alias("_heads"))  # a page has 14 at most
    rows = pages.join(lists, pages[entry] == lists["_e"], "left")
    stripped = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    free = F.aggregate("_heads", F.col(text), lambda t, h: F.when(F.instr(t, h).between(1, near), stripped(F.replace(t, h, F.lit("")))).otherwise(t))
    return rows.withColumn(text, F.when((F.col(order) > 1) & F.col("_heads").isNotNull(), free).otherwise(F.col(text))).select(*pages.columns)


_BIBLIOGRAPHY = r"(?:REFERENCES|References|Literature Cited)"


def before_references(pages: DataFrame, entry: str = "entry_name", order: str = "seq", text: str = "content") -> DataFrame:
    """Pages with `body` and `bibliography`: a heading that stands once in an entry parts its page; pages after it are
    bibliography as a whole. Entries without such a heading, or with several, are body."""
    w = Window.partitionBy(entry)
    n = F.regexp_count(text, F.lit(_BIBLIOGRAPHY))
    rows = pages.withColumn("_n", n).withColumn("_all", F.sum("_n").over(w)).withColumn("_at", F.max(F.when(F.col("_n") > 0, F.col(order))).over(w))
    here, after = (F.col("_all") == 1) & (F.col(order) == F.col("_at")), (F.col("_all") == 1) & (F.col(order) > F.col("_at"))
    parts = F.split(F.col(text), _BIBLIOGRAPHY, 2)
    body = F.when(after, F.lit(None).cast("string")).when(here, F.trim(parts[0])).otherwise(F.col(text))
    return rows.select(*pages.columns, body.alias("body"), F.when(after, F.col(text)).when(here, F.get(parts, F.lit(1))).alias("bibliography"))


def _edits(part: str, text: str, anchored: bool = False) -> Iterator[int]:
    """After each letter of `text`: the least edits that make `part` of what ends there, beginning anywhere or, anchored, at the text's start.

    A column of the edit table is held as the bits of two numbers, where it goes up and where down.
    """
    whole, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
    at: dict[str, int] = {}
    for j, p in enumerate(part):
        at[p] = at.get(p, 0) | 1 << j
    up, down, edits = whole, 0, len(part)
    for c in text:
        same = at.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(level | up)), up & level
        edits += bool(more & last) - bool(less & last)
        more, less = more << 1 | anchored, less << 1
        up, down = (less | ~(same | down | more)) & whole, more & (same | down) & whole
        yield edits


def _places(part: str, text: str, most: int) -> list[tuple[int, int]]:
    """Spans of `text` that hold every place where `part` stands with at most `most` edits, under a fifth of its letters.

    An edit harms one piece of five letters or more at most, so the other pieces stand there as they are, shifted by no
    more than `most` against each other. With more shifts than letters, as in rows of dots, the span is the whole text.
    """
    n = len(part) // 5
    edges, shifts, missing = [len(part) * k // n for k in range(n + 1)], [], 0
    for a, b in zip(edges, edges[1:]):
        at = text.find(part[a:b])
        missing += at < 0
        if missing > most:
            return []
        while at >= 0:
            shifts.append(at - a)
            at = text.find(part[a:b], at + 1)
        if len(shifts) > len(text):
            return [(0, len(text))]
    shifts.sort()
    spans: list[tuple[int, int]] = []
    for lo, hi in zip(shifts, shifts[n - most - 1 :]):
        if hi - lo <= most:
            start, end = max(0, lo - most), lo + len(part) + most
            spans.append((spans.pop()[0] if spans and start <= spans[-1][1] else start, end))
    return spans


def near_match(part: str, text: str) -> tuple[int, int] | None:
    """The first and best place (start, end) of `part` in `text` with at most a tenth of its letters wrong; of several starts the first."""
    at, most = text.find(part), len(part) // 10
    if at >= 0:
        return at, at + len(part)
    least, end = most + 1, 0
    for lo, hi in _places(part, text, most) if most else ():
        for i, edits in enumerate(_edits(part, text[lo:hi]), lo + 1):
            if edits < least:
                least, end = edits, i
    if least > most:
        return None
    back = text[max(0, end - len(part) - least) : end][::-1]
    return end - max(k for k, edits in enumerate(_edits(part[::-1], back, True), 1) if edits == least), end


def text_start(page: str, title: str | None, abstract: str | None, authors: list[str]) -> int:
    """Where the text of a first page begins: behind the title, abstract and authors that stand on it end to end, misprints allowed."""
    upper = page.upper()
    parts = [title or "", abstract or ""]
    for a in authors:
        words = a.split()
        parts += [a, f"{words[-1]}, {' '.join(words[:-1])}"] if words else []
    found = [m for m in (near_match(p.upper(), upper) for p in parts if p) if m]
    if not found:
        return 0
    first = min(a for a, _ in found)
    joined = [m for m in found if m[0] == first or any(abs(m[0] - b) < 5 for _, b in found)]
    return max(b for _, b in joined)


def without_front(pages: DataFrame, docs: DataFrame, entry: str = "entry_name", text: str = "content", order: str = "seq") -> DataFrame:
    """Pages whose first one has lost the entry's own title, abstract and authors; `docs` has entry, title, abstract, authors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = [x or "" for x in b["_text"]]
            starts = [text_start(x, t, a, list(au) if au is not None else []) for x, t, a, au in zip(whole, b["title"], b["abstract"], b["authors"])]
            yield b.drop(columns=["title", "abstract", "authors"]).assign(_text=[x[s:].strip() if s else x for x, s in zip(whole, starts)])

    first = pages.where(F.col(order) == 1).join(docs.select(entry, "title", "abstract", "authors"), entry)
    others = pages.join(docs.select(entry).distinct(), entry, "left_anti").unionByName(pages.where(F.col(order) != 1).join(docs.select(entry).distinct(), entry, "left_semi"))
    rest = [c for c in pages.columns if c != text]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest) + ", _text string"
    cleaned = first.select(*rest, F.col(text).alias("_text"), "title", "abstract", "authors").mapInPandas(run, schema)
    return cleaned.withColumnRenamed("_text", text).select(*pages.columns).unionByName(others.select(*pages.columns))


def page_map(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Printed pages of pdf pages: `known` is (doc, pdf, printed), `wanted` (doc, pdf).

    A page between two known ones is counted on from the one before it; before the first known page it is counted back
    from that, after the last one on from that, and `between` is false.
    """
    both = known.select("doc", "pdf", "printed").unionByName(wanted.select("doc", "pdf", F.lit(None).cast("int").alias("printed")))
    up, down = Window.partitionBy("doc").orderBy("pdf"), Window.partitionBy("doc").orderBy(F.desc("pdf"))
    at = F.when(F.col("printed").isNotNull(), F.struct("pdf", "printed"))
    rows = both.withColumn("lo", F.last(at, True).over(up)).withColumn("hi", F.last(at, True).over(down)).where("printed is null")
    printed = F.coalesce(F.col("lo.printed") + F.col("pdf") - F.col("lo.pdf"), F.col("hi.printed") - (F.col("hi.pdf") - F.col("pdf")))
    return rows.select("doc", "pdf", printed.alias("printed"), (F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("between"))
