"""Graphs of works: co-citation networks, components, groups of like references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citeloom.functions.normalize import is_article_key
from citeloom.operators.relational import meet
from citeloom.runtime import cut


def cocitation_network(joined: DataFrame, entity: str = "full_ref", min_cocit: int = 5, limit: int | None = None) -> DataFrame:
    """Edges (src, dst, weight) of entities cited by the same document through different references.

    Repeated citations are put together before pairing and counted by their product. Each pair of citations counts
    once; of an entity other than the reference two equal ends are possible and kept.
    """
    rows = joined.where(F.col("full_ref").isNotNull() & F.col(entity).isNotNull()).select("doc_id", "full_ref", F.col(entity).alias("e"))
    rows = rows.groupBy("doc_id", "full_ref", "e").agg(F.count("*").alias("m"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, "doc_id").where("a.full_ref < b.full_ref").select(F.least("a.e", "b.e").alias("src"), F.greatest("a.e", "b.e").alias("dst"), (F.col("a.m") * F.col("b.m")).alias("w"))
    edges = pairs.groupBy("src", "dst").agg(F.sum("w").alias("weight")).where(F.col("weight") >= min_cocit)
    return edges if limit is None else edges.orderBy(F.desc("weight"), "src", "dst").limit(limit)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): component is the smallest node reached; lone nodes are their own.

    Labels take the smallest of their neighbours' and are then followed to their own label (pointer jumping), so long
    chains take a number of rounds that is logarithmic in their length. Lineage is cut by checkpoints that survive
    the loss of executors.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select(F.col(node).alias("n"), F.col(node).alias("l")).distinct())
    while True:
        near = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("l").alias("m"))
        lower = labels.join(near, labels["n"] == near["a"], "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("k"))
        to = lower.select(F.col("n").alias("x"), F.col("k").alias("y"))
        jumped = cut(lower.join(to, lower["k"] == to["x"], "left").select("n", "l", F.least("k", F.coalesce("y", "k")).alias("k")))
        changed = jumped.where("l <> k").head(1)
        labels = jumped.select("n", F.col("k").alias("l"))
        if not changed:
            return labels.select(F.col("n").alias(node), F.col("l").alias("component"))


def representatives(members: DataFrame, counts: DataFrame, node: str = "node") -> DataFrame:
    """(node, rep): the most counted member of each component, ties to the larger name; counts is (node, n)."""
    sized = members.join(counts, node, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reps = sized.groupBy("component").agg(F.max_by(node, F.struct("n", node)).alias("rep"))
    return sized.join(reps, "component").select(node, "rep")


def alike_pairs(strings: DataFrame, column: str, least: float, max_edits: int, gram: int = 3) -> DataFrame:
    """(a, b, cosine): strings of TF-IDF n-gram cosine at least `least` and at most `max_edits` edits, a < b.

    A pair within `max_edits` edits shares one of `max_edits` + 1 pieces at a place shifted by no more than the edits
    (pigeonhole), so pieces are the join keys and no pair is lost, however common its n-grams are. Common pieces are cut
    into blocks.
    """
    base = strings.select(F.col(column).alias("s")).where("s is not null").distinct()
    grams = base.withColumn("g", F.explode(F.expr(f"transform(sequence(1, greatest(length(s) - {gram - 1}, 1)), i -> substring(s, i, {gram}))")))
    tf = grams.groupBy("s", "g").agg(F.count("*").alias("tf"))
    total = base.count()
    idf = tf.groupBy("g").agg((F.log(F.lit(float(total)) / F.count("*")) + 1.0).alias("idf"))
    weights = tf.join(idf, "g").select("s", "g", (F.col("tf") * F.col("idf")).alias("w"))
    vectors = cut(weights.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    k = max_edits + 1
    # Pieces of a string by its length; the partner looks them up at shifted places for each length it may have.
    cuts = f"transform(sequence(0, {k - 1}), p -> struct(p as p, cast(floor(p * n / {k}) as int) as at, cast(floor((p + 1) * n / {k}) as int) - cast(floor(p * n / {k}) as int) as len))"
    own = base.withColumn("n", F.length("s")).withColumn("x", F.explode(F.expr(cuts))).select("s", "n", F.col("x.p").alias("p"), F.expr("substring(s, x.at + 1, x.len)").alias("piece"))
    probe = base.withColumn("m", F.length("s")).withColumn("n", F.explode(F.expr(f"sequence(greatest(m - {max_edits}, 0), m + {max_edits})")))
    probe = probe.withColumn("x", F.explode(F.expr(cuts))).withColumn("d", F.explode(F.expr(f"sequence(-{max_edits}, {max_edits})"))).where("x.at + d >= 0 and x.at + d + x.len <= m")
    probe = probe.select(F.col("s").alias("t"), "n", F.col("x.p").alias("p"), F.expr("substring(s, x.at + d + 1, x.len)").alias("piece")).distinct()
    met = meet(own, probe, ["n", "p", "piece"]).where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    met = met.where(F.levenshtein("a", "b", max_edits) >= 0)
    left, right = (vectors.select(F.col("s").alias(x), F.col("v").alias(f"v{x}"), F.col("norm").alias(f"n{x}")) for x in "ab")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at(F.col("vb"), x["key"]), F.lit(0.0)))
    return met.join(left, "a").join(right, "b").withColumn("cosine", dot / (F.col("na") * F.col("nb"))).where(F.col("cosine") >= least).select("a", "b", "cosine")


def resolve_references(joined: DataFrame, min_docs: int = 2) -> DataFrame:
    """(full_ref, rep): references of enough documents grouped with their near spellings, books and articles apart.

    Books (author|title) need cosine 0.7 and at most one edit, articles (author|year|source) cosine 0.8 and at most two.
    """
    counts = joined.where("full_ref is not null").select("full_ref", "doc_id").distinct().groupBy("full_ref").agg(F.count("*").alias("n"))
    often = cut(counts.where(F.col("n") >= min_docs))
    article = is_article_key(F.col("full_ref"))
    titled = ~F.contains("full_ref", F.lit("[no title captured]"))
    books = alike_pairs(often.where(~article & titled), "full_ref", 0.7, 1)
    articles = alike_pairs(often.where(article & titled), "full_ref", 0.8, 2)
    edges = books.unionByName(articles).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = components(often.select("full_ref"), edges, "full_ref")
    return representatives(groups, often, "full_ref")
