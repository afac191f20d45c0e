"""Deeply nested XML records into related flat tables by shared inlining.

1. The schema graph (element, child, largest number of such children in one parent) is read from the whole column;
   partitions send only their distinct edges.
2. An element gets a table of its own if it is a root, repeats in a parent, has several kinds of parents (shared) or
   can contain itself (recursive). All others are inlined into the nearest ancestor that has a table.
3. Records are cut in one pass: every table row carries its id (position of the opening tag in the record), the
   table and id of its parent row, and the chain of open ancestors, so later queries need no join to climb.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# A schema graph lists kinds of elements, not elements; more kinds than this point to a wrong column.
MAX_EDGES = 100_000

ROWS = (
    "entry string, tab string, id int, parent_tab string, parent_id int, "
    "chain array<struct<tag:string,id:int>>, cols map<string,string>, text string"
)


def _name(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _parse(xml: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(xml.strip()) if xml else None
    except (ET.ParseError, ValueError):
        return None


@dataclass(frozen=True)
class SchemaGraph:
    """Which elements have tables (`tables`) and the edges (parent, child, largest multiplicity) behind it."""

    edges: tuple[tuple[str, str, int], ...]
    tables: frozenset[str]


def schema_graph(df: DataFrame, xml: str, own_tables: frozenset[str] = frozenset()) -> SchemaGraph:
    """Analyse the column `xml`; unreadable and null records add nothing. `own_tables` get a table in any case."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most: dict[tuple[str, str], int] = {}
        for batch in batches:
            for text in batch["x"]:
                root = _parse(text)
                if root is None:
                    continue
                most.setdefault(("", _name(root.tag)), 1)
                for node in root.iter():
                    for child, n in Counter(_name(c.tag) for c in node).items():
                        edge = (_name(node.tag), child)
                        if n > most.get(edge, 0):
                            most[edge] = n
        yield pd.DataFrame([(*e, n) for e, n in most.items()], columns=["parent", "child", "most"])

    found = (
        df.select(F.col(xml).alias("x")).mapInPandas(edges, "parent string, child string, most int")
        .groupBy("parent", "child").agg(F.max("most").alias("most")).limit(MAX_EDGES + 1).collect()
    )
    if len(found) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} kinds of edges: not a column of like records")
    graph = [(r.parent, r.child, r.most) for r in found if r.child]
    return SchemaGraph(tuple(sorted(graph)), frozenset(_tables(graph)) | own_tables)


def _tables(edges: list[tuple[str, str, int]]) -> set[str]:
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    for parent, child, _ in edges:
        parents.setdefault(child, set()).add(parent)
        children.setdefault(parent, set()).add(child)

    def reaches_itself(tag: str) -> bool:
        seen, todo = set(), list(children.get(tag, ()))
        while todo:
            at = todo.pop()
            if at == tag:
                return True
            if at not in seen:
                seen.add(at)
                todo.extend(children.get(at, ()))
        return False

    return {c for p, c, n in edges if not p or n > 1} | {c for c, p in parents.items() if len(p) > 1 or reaches_itself(c)}


def shred(df: DataFrame, entry: str, xml: str, graph: SchemaGraph) -> DataFrame:
    """All table rows of all records, as one tall DataFrame with the columns of ROWS.

    `tab` names the row's table; `cols` holds attributes (`@name`) and the deep text of inlined singletons by path;
    `text` is the element's own deep text. An unreadable or null record gives one row of table `#unreadable`.
    """
    tables = graph.tables

    def rows(root: ET.Element | None, key: str | None) -> Iterator[tuple]:
        if root is None:
            yield key, "#unreadable", 0, None, None, [], {}, None
            return
        ids = {node: i for i, node in enumerate(root.iter())}
        todo: list[tuple[ET.Element, str | None, int | None, tuple]] = [(root, None, None, ())]
        while todo:
            node, up_tab, up_id, chain = todo.pop()
            tag, me = _name(node.tag), ids[node]
            cols = {f"@{_name(k)}": v for k, v in node.attrib.items()}
            below = (*chain, {"tag": tag, "id": me})
            inner = [(child, "", below) for child in reversed(node)]
            while inner:
                at, path, above = inner.pop()
                kind = _name(at.tag)
                if kind in tables:
                    todo.append((at, tag, me, above))
                    continue
                path = f"{path}/{kind}" if path else kind
                if not len(at):
                    cols[path] = at.text or ""
                elif (at.text or "").strip() or any((c.tail or "").strip() for c in at):  # mixed content
                    cols[path] = "".join(at.itertext())
                for k, v in at.attrib.items():
                    cols[f"{path}@{_name(k)}"] = v
                deeper = (*above, {"tag": kind, "id": ids[at]})
                inner.extend((c, path, deeper) for c in reversed(at))
            yield key, tag, me, up_tab, up_id, list(chain), cols, "".join(node.itertext())

    def cut_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ("entry", "tab", "id", "parent_tab", "parent_id", "chain", "cols", "text")]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                out = [r for k, x in zip(part["k"], part["x"]) for r in rows(_parse(x), k)]
                frame = pd.DataFrame(out, columns=names)
                yield frame.astype({"id": "Int32", "parent_id": "Int32"})

    return df.select(F.col(entry).alias("k"), F.col(xml).alias("x")).mapInPandas(cut_records, ROWS)


def flat_table(shredded: DataFrame, tab: str, columns: dict[str, str]) -> DataFrame:
    """One related table: entry, id, parent_tab, parent_id, text and the named inlined columns {name: path}."""
    picked = [F.col("cols")[path].alias(name) for name, path in columns.items()]
    return shredded.where(F.col("tab") == tab).select("entry", "id", "parent_tab", "parent_id", *picked, "text")


def nearest(chain: Column, tags: tuple[str, ...]) -> Column:
    """Id of the nearest open ancestor among `tags`; null if there is none."""
    return F.try_element_at(F.filter(chain, lambda a: a["tag"].isin(*tags)), F.lit(-1))["id"]


HOLDERS = ("article", "product", "sub-article")
OWN = frozenset({"article", "product", "sub-article", "contrib", "aff", "xref", "article-title", "year"})


def contributions(df: DataFrame, entry: str = "entry_name", xml: str = "metadata_xml") -> DataFrame:
    """Titles, years and contributors of each record with their holders and affiliations.

    Columns entry_name, holder_no, field, item_no, aff_no, id. Entries listed several times count once; unreadable
    or null records and an empty table give no rows; titles and years without text are not counted.
    """
    first = df.where(F.col(entry).isNotNull()).groupBy(F.col(entry).alias("entry")).agg(F.min(xml).alias("x"))
    rows = shred(first, "entry", "x", schema_graph(first, "x", OWN)).where(F.col("tab").isin(*OWN))
    rows = rows.where(~F.col("tab").isin("article-title", "year") | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    # One record's rows are as many as its elements, so they may be gathered; no join and no second shuffle follows.
    record = rows.groupBy("entry").agg(
        F.array_sort(F.collect_list(F.struct("id", "tab", "parent_id", F.col("cols")["@id"].alias("xml_id"), F.col("cols")["@rid"].alias("rid"), F.col("cols")["@ref-type"].alias("kind"), nearest(F.col("chain"), HOLDERS).alias("holder")))).alias("els")
    )
    record = record.select(
        "entry", "els",
        F.transform(F.filter("els", lambda e: e["tab"].isin("product", "sub-article")), lambda e: e["id"]).alias("holders"),
        F.array_distinct(F.transform(F.filter("els", lambda e: (e["tab"] == "aff") & e["xml_id"].isNotNull()), lambda e: e["xml_id"])).alias("aff_ids"),
        F.filter("els", lambda e: (e["tab"] == "xref") & (e["kind"] == "aff")).alias("refs"),
        F.filter("els", lambda e: e["tab"] == "aff").alias("affs"),
    )
    items = record.select(
        "entry", "holders", "aff_ids", "refs", "affs",
        F.explode(F.filter("els", lambda e: e["tab"].isin("article-title", "year", "contrib"))).alias("e"),
    )
    words = F.flatten(F.transform(F.filter("refs", lambda r: r["parent_id"] == F.col("e.id")), lambda r: F.split(F.trim(F.coalesce(r["rid"], F.lit(""))), r"\s+")))
    own = F.size(F.filter("affs", lambda a: a["parent_id"] == F.col("e.id"))) + F.size(F.array_intersect(F.array_distinct(words), F.col("aff_ids")))
    n = F.when(F.col("e.tab") == "contrib", own).otherwise(0)
    numbered = items.select(
        F.col("entry").alias("entry_name"),
        F.coalesce(F.array_position("holders", F.col("e.holder")), F.lit(0)).cast("int").alias("holder_no"),
        F.col("e.tab").alias("field"), F.col("e.id").alias("id"), n.alias("affs"),
    )
    by = Window.partitionBy("entry_name", "holder_no", "field").orderBy("id")
    return numbered.withColumn("item_no", F.row_number().over(by)).select(
        "entry_name", "holder_no", "field", "item_no",
        F.explode(F.when(F.col("affs") > 0, F.sequence(F.lit(1), F.col("affs"))).otherwise(F.array(F.lit(0)))).alias("aff_no"), "id",
    )
