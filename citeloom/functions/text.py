"""Text functions: cleaning, brackets, in-text citations, contexts, terms; column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The forms of in-text citations, in the order in which they are tried; group 1 is the names, 2 the years.
_NAME = r"[A-Z][A-Za-z6'`-̈]+\s?[A-Za-z6'`-̈]*"
_FULL = rf"(?:{_NAME}(?:\s{_NAME})?|{_NAME} et al.?)"
_NAMES = rf"({_FULL}(?:, {_FULL})*(?:,? (?:and|&) {_FULL})?)"
_YEARS = r"((?:(?:\[[0-9]{4}\]\s?)?[0-9]{4}[abcdef]?(?:, )?)+)"
_PAGES = r"[0-9\-–—]+"
_BEFORE = r"(?:(?:(?:see|see also|listed in|and|e.g.|cf.|c.f.),?\s?)+ )?"
_AFTER = r"(?:,?.*)?"
CITATION_FORMS = (
    f"^{_BEFORE}{_NAMES}, {_YEARS}{_AFTER}$", rf"^{_BEFORE}{_NAMES} {_YEARS}, pp?\.? {_PAGES}{_AFTER}$", f"^{_BEFORE}{_NAMES} {_YEARS}{_AFTER}$",
    f"^{_BEFORE}{_NAMES}, {_YEARS}: {_PAGES}{_AFTER}$", rf"^{_BEFORE}{_NAMES} \[{_YEARS}\]{_AFTER}$", rf"^{_BEFORE}{_NAMES} \[{_YEARS}, [^\]]\]{_AFTER}$",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# English words that are no terms.
STOPWORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for "
    "from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out "
    "over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your yours"
).split()


def clean_scan(text: Column) -> Column:
    """Words cut by a hyphen at a line's end joined, blanks single, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"-\s*\n\s*", ""), r" +", " "))


def one_paragraph(text: Column) -> Column:
    """Hyphens at line ends dropped, lines joined by blanks, blanks single."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"-\r?\n", ""), r"\r?\n", " "), r" +", " ")


def untokenized(tokens: Column) -> Column:
    """Tokens joined by blanks but before punctuation and clitics."""
    joined = F.aggregate(tokens, F.lit(""), lambda acc, t: F.concat(acc, F.when((acc == "") | t.rlike(r"^[\p{Punct}]+$") | F.startswith(t, F.lit("'")), "").otherwise(" "), t))
    return joined


def once(df: DataFrame, name: str = "_once", /, **columns: Column) -> DataFrame:
    """The columns in a struct `name`, worked out once for each row: what stands before an explode isn't copied into what stands after it."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(name))


def bracket_rows(df: DataFrame, text: str, names: tuple[str, str, str] = ("pos", "start", "content")) -> DataFrame:
    """One row per outer bracket with its number and its place, both from 0, and what is inside; inner ones are part of it.

    `names` are those of the new columns, which replace columns of the same name.
    """
    rx = r"\([^)]*\)"
    parts = once(df.where(F.contains(text, F.lit("("))), g=F.regexp_extract_all(text, F.lit(f"({rx})"), F.lit(1)), o=F.split(text, rx, -1))
    lengths = F.transform("_once.g", lambda g, i: F.length(g) + F.length(F.get(F.col("_once.o"), i)))
    rows = parts.select("*", lengths.alias("_n"), F.posexplode("_once.g").alias("_pos", "_group"))
    before = F.aggregate(F.slice("_n", F.lit(1), F.col("_pos")), F.lit(0), lambda a, x: a + x) + F.length(F.get("_once.o", F.col("_pos")))
    content = F.substr("_group", F.lit(2), F.length("_group") - 2)
    kept = [F.col(c) for c in df.columns if c not in names]
    return rows.select(*kept, F.col("_pos").alias(names[0]), before.cast("int").alias(names[1]), content.alias(names[2]))


def _hits(part: Column) -> list[Column]:
    """For each form what it finds; parts that a form doesn't fit cost one pattern."""
    out = []
    for form in CITATION_FORMS:
        names, years = F.regexp_extract(part, form, 1), F.regexp_extract(part, form, 2)
        out.append(F.when(part.rlike(form) & ~names.isin(*MONTHS), F.struct(names.alias("names"), years.alias("years"))))
    return out


def citation_rows(df: DataFrame, text: str) -> DataFrame:
    """The rows whose `text` cites, with `cited`: array<struct<names, years>>.

    A text is read once as parts between semicolons, of which the first fitting form counts, and once as parts between
    commas, of which all fitting forms count; the second reading holds only if it has more.
    """
    flat = F.regexp_replace(F.regexp_replace(text, r"-\n", ""), r"\s+", " ")
    trimmed = lambda sep: F.transform(F.split(flat, sep), lambda p: F.trim(p))
    parts = once(df.where(F.col(text).rlike("[0-9]{4}")), semi=F.filter(trimmed(";"), lambda p: p.rlike("[0-9]{4}") & (F.size(F.split(p, ",")) < 4)), comma=F.filter(trimmed(","), lambda p: p.rlike("[0-9]{4}")))
    parts = parts.withColumnRenamed("_once", "_parts")
    first = F.filter(F.transform("_parts.semi", lambda p: F.coalesce(*_hits(p))), lambda h: h.isNotNull())
    every = F.filter(F.flatten(F.transform("_parts.comma", lambda p: F.array(*_hits(p)))), lambda h: h.isNotNull())
    read = once(parts, first=first, every=every)
    cited = F.when(F.size("_once.every") > F.size("_once.first"), F.col("_once.every")).otherwise(F.col("_once.first"))
    return read.select(*[c for c in df.columns if c != "cited"], cited.alias("cited")).where(F.size("cited") > 0)


def citation_keys(found: Column) -> Column:
    """`Name (YYYY)` of each citation and year; letters after years are dropped."""
    keys = F.transform(
        found,
        lambda h: F.transform(
            F.filter(F.transform(F.split(h["years"], ","), lambda y: F.regexp_extract(y, r"[0-9]{4}", 0)), lambda y: y != ""),
            lambda y: F.concat(F.replace(h["names"], F.lit("'s"), F.lit("")), F.lit(" ("), y, F.lit(")")),
        ),
    )
    return F.flatten(keys)


def left_context(text: Column, start: Column, width: int = 400) -> Column:
    """The last sentence of the `width` characters before a bracket, from its first whole word on."""
    begin = F.greatest(start - width + 2, F.lit(1))
    raw = F.substr(text, begin, start + 2 - begin)
    whole = F.when(raw.rlike(r"[\s.!?]"), F.regexp_replace(raw, r"(?s)^[^\s.!?]*[\s.!?]+", "")).otherwise(raw)
    last = F.element_at(F.split(whole, r"(?<=[.!?])\s+(?=\S)"), -1)
    return F.substr(last, F.lit(1), F.greatest(F.length(last) - 1, F.lit(0)))


def right_context(text: Column, end: Column, width: int = 100) -> Column:
    """The first sentence of the `width` characters after a bracket that closes at `end` (from 0), up to its last whole word."""
    raw = F.substr(text, end + 2, F.lit(width))
    whole = F.when(raw.rlike(r"[\s.!?]"), F.regexp_replace(raw, r"(?s)[\s.!?]+[^\s.!?]*$", "")).otherwise(raw)
    return F.element_at(F.split(F.regexp_replace(whole, r"^\s+", ""), r"(?<=[.!?])\s+(?=\S)"), 1)


def terms(text: Column, stopwords: tuple[str, ...] | list[str] = STOPWORDS) -> Column:
    """Distinct words without stop words, and pairs of neighbours among them, put in order and joined by a hyphen."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-zA-Z\s]", ""), r"\s+", " "))
    words = F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(*stopwords))
    n = F.size(words) - 1
    pairs = F.when(n > 0, F.zip_with(F.slice(words, F.lit(1), F.greatest(n, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.concat(F.least(a, b), F.lit("-"), F.greatest(a, b))))
    return F.array_distinct(F.concat(words, F.coalesce(pairs, F.array().cast("array<string>"))))


def line_kind(line: Column) -> Column:
    """`empty`, `page number` or `text`."""
    return F.when(F.trim(line) == "", "empty").when(F.trim(line).rlike(r"^[0-9]+$"), "page number").otherwise("text")


def before_bibliography(text: Column) -> Column:
    """(body, bibliography) cut at a heading that stands once; all is body otherwise."""
    rx = r"(?:REFERENCES|References|Literature Cited)"
    once = F.regexp_count(text, F.lit(rx)) == 1
    parts = F.split(text, rx, 2)
    return F.struct(F.when(once, parts[0]).otherwise(text).alias("body"), F.when(once, F.get(parts, F.lit(1))).alias("bibliography"))
