"""Variant spellings of names: weighted character n-grams, a sparse top cosine join and average linkage.

A spelling is read into a family name (or the place of a corporate author) and a mark (first initial, or the kinds of
words in the corporate name), and becomes a vector of character n-grams of the first together with the second. Letters
inside an n-gram are put in order, so that two letters swapped change no more n-grams than one letter wrong. Spellings with the same vector are one node, so a name
written a million times is compared once.

The weight of an n-gram is its inverse frequency over all rows times its reliability: an n-gram that next to no rows
hold is mostly a typing error's, and must not part the error from the name.

The join is exact: of each vector only the rarest features that are needed to reach the threshold are indexed (prefix
filtering); what many vectors share is cut into blocks that meet in separate tasks. Clusters are merged by average
linkage over the cosines of all pairs of occurrences, so that the usual spelling of a name, not its errors, decides
who belongs to it; clusters that are each other's nearest merge in the same round, until none is left.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from citeloom.operators.packed import WOS_FIELDS, latest_records, split_packed
from citeloom.runtime import cut

MIN_COSINE = 0.6  # of the pairs that count in the linkage
LINK = 0.71  # average similarity up to which clusters merge
DOUBT = 1e-4  # share of the rows at which an n-gram is half reliable
COMMON = 0.02  # added to frequencies: rarer n-grams weigh about alike
BLOCK = 2000  # vectors that share a feature and meet in one task

# Short forms of given names whose first letter is not that of the full name.
NICKNAMES = {
    "bill": "william", "billy": "william", "will": "william", "bob": "robert", "bobby": "robert", "rob": "robert",
    "dick": "richard", "ted": "theodore", "teddy": "theodore", "ned": "edward", "peggy": "margaret", "peg": "margaret",
    "meg": "margaret", "daisy": "margaret", "polly": "mary", "molly": "mary", "betty": "elizabeth", "betsy": "elizabeth",
    "bess": "elizabeth", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth",
    "lisa": "elizabeth", "nell": "eleanor", "nellie": "eleanor", "nora": "eleanor", "jack": "john", "hal": "henry",
    "hank": "henry", "harry": "henry", "jim": "james", "jimmy": "james", "sandy": "alexander", "alec": "alexander",
    "sasha": "alexander", "xander": "alexander", "tony": "anthony", "gus": "augustus", "kate": "katherine",
    "kitty": "katherine", "kit": "christopher", "topher": "christopher", "nat": "nathaniel", "nate": "nathaniel",
    "sally": "sarah", "sukie": "susannah", "trudy": "gertrude", "gert": "gertrude", "zeke": "ezekiel", "eben": "ebenezer",
    "bella": "isabella", "izzy": "isabella", "becky": "rebecca", "ginny": "virginia", "vince": "vincent", "fritz": "frederick",
    "ricky": "frederick", "eddie": "edmund", "ed": "edmund", "jo": "josephine", "chuck": "charles", "charlie": "charles",
    "tamsin": "thomasina", "zack": "zachary", "ozzie": "oswald", "jenny": "genevieve", "gen": "genevieve", "nan": "anne",
    "nancy": "anne", "bart": "bartholomew", "wat": "walter", "mick": "michael", "lottie": "charlotte", "tilda": "matilda",
    "zhenya": "yevgenia", "jenya": "yevgenia", "genia": "yevgenia", "evgenia": "yevgenia", "rike": "ulrike", "zanna": "susannah",
    "sanna": "susannah", "greta": "margaret", "rita": "margaret", "viv": "genevieve", "waldo": "oswald", "freda": "winifred",
    "sina": "thomasina", "fina": "josephine", "than": "nathaniel", "lex": "alexander", "belle": "isabella", "bec": "rebecca",
    "bertie": "robert", "trude": "gertrude", "nabby": "abigail", "drew": "andrew", "tina": "christina", "mina": "wilhelmina",
    "gail": "abigail", "flo": "florence", "flossie": "florence", "millie": "millicent", "milly": "millicent",
}

# Words of corporate names in full, and short forms that do not begin like the word.
ORGANISATION_WORDS = (
    "academy", "administration", "agency", "association", "board", "bureau", "census", "centre", "center", "civic",
    "college", "commission", "committee", "conduct", "council", "department", "division", "economic", "education",
    "federation", "foundation", "household", "institute", "institution", "international", "labor", "labour", "laboratory",
    "libraries", "library", "ministry", "national", "office", "organisation", "organization", "polytechnic", "public",
    "records", "research", "rural", "school", "service", "social", "society", "statistics", "studies", "survey",
    "trust", "union", "university", "welfare",
)
ORGANISATION_SHORT = {"ctr": "centre", "dept": "department", "natl": "national", "intl": "international", "govt": "government", "lib": "library"}
CORPORATE = frozenset(
    "academy agency association board bureau centre center college commission committee council department division federation "
    "foundation institute institution ministry office polytechnic society university union laboratory".split()
)
LINKING = frozenset(("of", "for", "on", "and", "the", "in", "&", "und", "de", "la"))
SUFFIXES = frozenset(("jr", "sr", "ii", "iii", "iv"))
PARTICLES = frozenset(("van", "von", "de", "der", "den", "mac", "mc", "la", "le", "du", "di", "da", "del", "st", "ter", "ten", "o"))


def spelling(text):
    """A column of names as spellings: lower case, no full stops, blanks trimmed and single."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("."), F.lit("")), r"\s+", " "))


def _fold(text: str) -> str:
    for long, short in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("ø", "oe"), ("å", "aa")):
        text = text.replace(long, short)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _word_kind(word: str) -> str | None:
    """The corporate word that a word is or abbreviates."""
    word = ORGANISATION_SHORT.get(word, word)
    if len(word) < 3:
        return None
    return next((w for w in ORGANISATION_WORDS if w == word or (w.startswith(word) and len(word) <= 6)), None)


def read_name(name: str) -> tuple[str, str, str]:
    """(kind, body, mark) of a spelling: a person's family name and first initial, or a place and kinds of words."""
    plain = re.sub(r"[^\w,&' -]+", " ", name)
    words = re.sub(r"[,'-]+", " ", plain).split()
    kinds = [_word_kind(w) for w in words]
    if sum(k is not None for k in kinds) >= 2 and any(k in CORPORATE for k in kinds):
        place = [w for w, k in zip(words, kinds) if k is None and w not in LINKING]
        return "o", _fold("".join(place)), " ".join(sorted({k[:4] for k in kinds if k}))
    parts = [p.replace("-", " ").replace("'", "").split() for p in re.split(r"\s*,[\s,]*", plain)]
    parts = [p for p in parts if p and not (len(p) == 1 and p[0] in SUFFIXES)]
    if not parts:
        return "x", _fold(name), ""
    if len(parts) > 1:
        family, given = parts[0], parts[1]
    else:
        ws = [w for w in parts[0] if w not in SUFFIXES] or parts[0]
        if len(ws) == 1:
            return "p", _fold(ws[0]), ""
        if len(ws[-1]) <= 2 and len(ws[0]) > 1:
            cut_at = next(i for i, w in enumerate(ws) if i and len(w) <= 2 and w not in PARTICLES) if any(len(w) <= 2 and w not in PARTICLES for w in ws[1:]) else len(ws) - 1
            family, given = ws[:cut_at], ws[cut_at:]
        else:
            first = next((i for i, w in enumerate(ws) if i and len(w) > 1), len(ws) - 1)
            family, given = ws[first:], ws[:first]
            while len(family) > 1 and family[0] not in PARTICLES:
                given, family = [*given, family[0]], family[1:]
    full = NICKNAMES.get(given[0], given[0]) if given else ""
    return "p", _fold("".join(family)), _fold(full)[:1]


def _grams(body: str) -> list[str]:
    """N-grams of two and three letters, each with its letters in order; edges count as often as the middle."""
    out = set()
    for n in (2, 3):
        padded = "^" * (n - 1) + body + "$" * (n - 1)
        out |= {"".join(sorted(padded[i : i + n])) for i in range(len(padded) - n + 1)}
    return sorted(out)


def name_vectors(nodes: DataFrame) -> DataFrame:
    """(id, own, v) of `nodes` (id, kind, body, mark, n): unit vectors as array<struct<f, g, w>>, rarest n-grams first.

    An n-gram g (a number) counts together with `own`, the kind and mark: names of other marks share none.
    """

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "own": b["kind"] + b["mark"], "n": b["n"], "grams": [_grams(x) for x in b["body"]]})

    listed = cut(nodes.select("id", "kind", "body", "mark", "n").mapInPandas(grams, "id bigint, own string, n bigint, grams array<string>"))
    total = float(listed.agg(F.sum("n")).head()[0] or 1)
    held = listed.select("n", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("n").alias("d")).withColumn("f", F.col("d") / total)
    # The row that asks for the weight is no evidence for its n-grams: half of it counts, so that small tables work alike.
    reliable = (F.col("d") - 0.5) / (F.col("d") + 0.5 + DOUBT * total)
    weights = held.select("gram", "f", (F.log(2.0 + 1.0 / (F.col("f") + COMMON)) * reliable).alias("w"))
    # There are at most as many n-grams as triples of letters; the optimizer sees how few, and sends them to all tasks.
    weights = cut(weights).withColumn("g", F.monotonically_increasing_id())
    spread = listed.select("id", "own", F.explode("grams").alias("gram")).join(weights, "gram")
    whole = spread.groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct("f", "g", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = F.transform("v", lambda x: F.struct(x["f"].alias("f"), x["g"].alias("g"), (x["w"] / F.col("norm")).alias("w")))
    return whole.where("norm > 0").select("id", "own", unit.alias("v"))


def near_pairs(nodes: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, cosine) of `nodes` (id, kind, body, mark, n), exact from the threshold on."""
    vectors = cut(name_vectors(nodes))
    # A pair above the threshold shares a feature of this prefix: what follows it has a norm below the threshold.
    upto = F.aggregate("v", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, x: F.when(1.0 - a["s"] >= min_cosine * min_cosine - 1e-9, F.struct((a["s"] + x["w"] * x["w"]).alias("s"), (a["k"] + 1).alias("k"))).otherwise(a))
    prefix = cut(vectors.select("id", "own", F.explode(F.transform(F.slice("v", F.lit(1), upto["k"]), lambda x: x["g"])).alias("g")))
    # A feature of many vectors is cut into blocks; each pair of blocks is a task's work, every pair of vectors meets once.
    sizes = prefix.groupBy("own", "g").agg(F.count("*").alias("m")).where("m > 1").select("own", "g", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    placed = prefix.join(sizes, ["own", "g"]).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    left = placed.select("own", "g", F.col("id").alias("a"), F.col("blk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    right = placed.select("own", "g", F.col("id").alias("b"), F.col("blk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"))
    met = left.join(right, ["own", "g", "i", "j"]).where("a < b").select("a", "b").distinct()
    # Beside each pair stand only two short maps of numbers.
    one, two = (vectors.select(F.col("id").alias(n), F.map_from_entries(F.transform("v", lambda x: F.struct(x["g"], x["w"]))).alias(f"v{n}")) for n in "ab")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at(F.col("vb"), x["key"]), F.lit(0.0)))
    return met.join(one, "a").join(two, "b").select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= min_cosine)


def average_linkage(nodes: DataFrame, edges: DataFrame, link: float = LINK) -> DataFrame:
    """Clusters (id, cluster) of `nodes` (id, and n, how often it occurs) under similarities `edges` (a, b, s).

    Pairs without an edge count 0. Merging all mutually nearest clusters at once gives the same tree as one pair at a
    time; rounds go on until nothing merges.
    """
    member = nodes.select("id", F.col("id").alias("cluster"))
    # A mean is never above its largest edge, so nodes without an edge as high as `link` stay alone.
    held = edges.where(F.col("s") >= link).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sizes = cut(nodes.join(held, "id", "left_semi").select(F.col("id").alias("c"), F.col("n").cast("double").alias("size") if "n" in nodes.columns else F.lit(1.0).alias("size")))

    def weighed(e: DataFrame) -> DataFrame:
        return e.join(sizes.select(F.col("c").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("c").alias("b"), F.col("size").alias("nb")), "b")

    now = cut(weighed(edges).select("a", "b", (F.col("s") * F.col("na") * F.col("nb")).alias("s")))
    moves = None
    while True:
        scored = weighed(now).withColumn("mean", F.col("s") / (F.col("na") * F.col("nb"))).where(F.col("mean") >= link)
        both = scored.select("a", "b", "mean").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean"))
        # Ties go to the pair with the smaller ids, seen alike from both ends.
        best = both.groupBy("a").agg(F.max_by("b", F.struct("mean", -F.least("a", "b"), -F.greatest("a", "b"))).alias("b"))
        merged = cut(best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select(F.col("x.a").alias("keep"), F.col("x.b").alias("gone")))
        if not merged.head(1):
            break

        def moved(df: DataFrame, column: str) -> DataFrame:
            to = merged.select(F.col("gone").alias(column), "keep")
            return df.join(to, column, "left").withColumn(column, F.coalesce("keep", column)).drop("keep")

        sizes = cut(moved(sizes, "c").groupBy("c").agg(F.sum("size").alias("size")))
        gone = merged.select(F.col("gone").alias("id"), F.col("keep").alias("cluster"))
        moves = cut(gone if moves is None else moved(moves, "cluster").unionByName(gone))
        now = moved(moved(now, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
        now = cut(now.groupBy("a", "b").agg(F.sum("s").alias("s")))
    if moves is None:
        return member
    return member.drop("cluster").join(moves, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def link_variants(names: DataFrame, column: str = "name", min_cosine: float = MIN_COSINE, link: float = LINK) -> DataFrame:
    """Rows (spelling, cluster) of the distinct spellings in `column`; equal clusters name the same author.

    Null and blank names are left out; a name repeated in many rows weighs more, but is one spelling. With a column
    `n` in `names` a row counts so often. An empty table gives no rows. Names without any letter keep to themselves.
    `cluster` is one of the cluster's node ids and means nothing beyond the call.
    """
    times = F.sum("n") if "n" in names.columns and column != "n" else F.count("*")
    spellings = names.withColumn("_s", spelling(F.col(column))).where("_s <> ''").groupBy(F.col("_s").alias("spelling")).agg(times.cast("bigint").alias("n"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [read_name(s) for s in b["spelling"]]
            yield b.assign(kind=[o[0] for o in out], body=[o[1] for o in out], mark=[o[2] for o in out])

    parsed = cut(spellings.mapInPandas(read, "spelling string, n bigint, kind string, body string, mark string"))
    nodes = cut(parsed.groupBy("kind", "body", "mark").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    pairs = cut(near_pairs(nodes.where("body <> '' and kind <> 'x'"), min_cosine).withColumnRenamed("cosine", "s"))
    return parsed.drop("n").join(nodes.drop("n"), ["kind", "body", "mark"]).join(average_linkage(nodes, pairs, link), "id").select("spelling", "cluster")


def author_names(cit: DataFrame, doc: DataFrame, records: DataFrame) -> DataFrame:
    """All author names of the three tables and how often they occur: name, n; `records.au` is split by the packed-value operator."""
    single = split_packed(latest_records(records.select("ut", "au", "loaded_at")), "_own", {"au": WOS_FIELDS["au"]})
    columns = (cit.select(F.col("author").alias("name")), doc.select(F.col("first_author").alias("name")), single.select(F.col("item").alias("name")))
    return reduce(DataFrame.unionByName, (c.where("name is not null").groupBy("name").agg(F.count("*").alias("n")) for c in columns))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """Every pair of spellings of one cluster, smaller first: name_a, name_b."""
    a, b = linked.select(F.col("spelling").alias("name_a"), "cluster"), linked.select(F.col("spelling").alias("name_b"), "cluster")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
