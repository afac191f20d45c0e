"""Normal forms of authors, references, titles and work keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Titles that are no research, by a part of them or as a whole.
TITLE_PARTS = ("book review", "review essay", "back matter", "front matter", "notes for contributors", "publication received", "errata:", "erratum:")
TITLE_WHOLE = ("commentary and debate", "erratum", "")

_YEAR = r"(?s)^(.*?)((?:18|19|20)[0-9]{2})"


def title_case(text: Column) -> Column:
    """Capital after anything but a letter, small otherwise."""
    bits = F.split(F.lower(text), r"(?<=[^\p{L}])|(?=[^\p{L}])")
    return F.array_join(F.transform(bits, F.initcap), "")


def citing_author(name: Column) -> Column:
    """`Smith, John A.` as `smith, j`: letters and commas only; names without exactly one comma stay whole."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[^a-zA-Z\s,]", "")
    parts = F.split(plain, ", ")
    first = F.substring(parts[1], 1, 1)
    return F.when(F.size(parts) != 2, plain).when(parts[1] == "", parts[0]).otherwise(F.concat(parts[0], F.lit(", "), first))


def citing_authors(field: Column) -> Column:
    """Keys of the authors of a field separated by semicolons, in order."""
    return F.filter(F.transform(F.split(field, ";"), lambda a: citing_author(a)), lambda a: a != "")


def cited_author(text: Column) -> Column:
    """`BOURDIEU P, ` as `Bourdieu, P.`; null unless it has two to four words or if it is a corporate author."""
    words = F.split(F.trim(F.lower(text)), r"\s+")
    swap = F.length(words[0]) == 1
    family, given = F.when(swap, F.get(words, F.lit(1))).otherwise(words[0]), F.when(swap, words[0]).otherwise(F.get(words, F.lit(1)))
    key = title_case(F.concat(family, F.lit(", "), F.substring(given, 1, 1), F.lit(".")))
    return F.when(F.size(words).between(2, 4) & ~F.contains(key, F.lit("*")), key)


def is_article(raw: Column) -> Column:
    return F.contains(raw, F.lit("DOI")) | raw.rlike(r", [Vv][0-9]+") | raw.rlike(r"[0-9]+, [Pp]?[0-9]+")


def parse_reference(raw: Column) -> Column:
    """author, publish, type and full_ref of a raw reference; null where it has no year or no personal author."""
    author = cited_author(F.regexp_extract(raw, _YEAR, 1))
    year = F.regexp_extract(raw, _YEAR, 2)
    fields = F.transform(F.split(F.lower(raw), ","), lambda x: F.trim(x))
    article = is_article(raw)
    rest = F.substring_index(F.array_join(F.slice(fields, F.lit(3), F.greatest(F.size(fields), F.lit(1))), ","), ",doi", 1)
    book = F.when(F.size(fields) < 3, author).otherwise(F.concat(author, F.lit("|"), F.get(fields, F.lit(2))))
    key = F.when(article, F.concat(author, F.lit("|"), year, F.lit("|"), rest)).otherwise(book)
    kind = F.when(article, "article").otherwise("book")
    parsed = F.struct(author.alias("author"), year.try_cast("int").alias("publish"), kind.alias("type"), key.alias("full_ref"))
    return F.when((year != "") & author.isNotNull(), parsed)


def looks_like_research(title: Column) -> Column:
    low = F.trim(F.lower(title))
    return ~low.rlike("|".join(TITLE_PARTS)) & ~low.isin(*TITLE_WHOLE)


def document_type(kind: Column, title: Column) -> Column:
    """The type corrected by the title."""
    low = F.lower(title)
    return (
        F.when(F.contains(low, F.lit("erratum")), "erratum")
        .when(F.contains(low, F.lit("comment on")) | (low == "commentary and debate") | F.startswith(low, F.lit("reply to")), "commentary")
        .when(low.isin("book review", "review essay"), "book-review").otherwise(kind)
    )


def work_parts(key: Column) -> Column:
    """author, type, year and title of a work key: two parts are a book, more an article."""
    parts = F.split(key, r"\|")
    article = F.size(parts) > 2
    return F.struct(
        parts[0].alias("author"), F.when(article, "article").otherwise("book").alias("type"),
        F.when(article, F.get(parts, F.lit(1)).try_cast("int")).alias("year"), F.when(article, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("title"),
    )


def work_label(key: Column, longest: int = 0) -> Column:
    """A work key for display: author, year in brackets, title; cut with dots if `longest` is given."""
    w = work_parts(key)
    label = F.concat(w["author"], F.when(w["year"].isNotNull(), F.concat(F.lit(" ("), w["year"].cast("string"), F.lit(")"))).otherwise(""), F.when(w["title"].isNotNull(), F.concat(F.lit(" "), w["title"])).otherwise(""))
    return F.when(F.length(label) > longest, F.concat(F.substring(label, 1, longest), F.lit("..."))).otherwise(label) if longest else label


def is_article_key(key: Column) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(2)).try_cast("int").isNotNull()


def record_name(path: Column) -> Column:
    """File name without folder and ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.(?:xml|txt)$", "")


def is_roman(text: Column) -> Column:
    return text.rlike(r"^[LIXMCVlixmcv]+$")


def early_year(year: Column, early: Column) -> Column:
    """The year, or the last word of the early-access date."""
    return F.coalesce(year.try_cast("int"), F.element_at(F.split(F.trim(early), " "), -1).try_cast("int"))
