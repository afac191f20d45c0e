import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import cube, facts, graph, matrix, relational, trend


@pytest.fixture(scope="module")
def mini(spark):
    docs = spark.createDataFrame([("D1", "J1", 2001, ["a1", "a2"]), ("D2", "J1", 2003, ["a2"])], "doc string, fj string, fy int, authors array<string>")
    refs = spark.createDataFrame([("D1", "W1", "X", 1990), ("D1", "W2", "Y", 1991), ("D1", "W1", "X", 1990), ("D2", "W1", "X", 1990)], "doc string, c string, ta string, ty int")
    return docs, facts.citations(docs, refs)


def counted(df):
    return {tuple(r[:-2]): (r.ind, r.doc) for r in df.collect()}


def test_cubes(mini):
    docs, f1 = mini
    assert counted(cube.count_space(f1, "c")) == {("W1",): (3, 2), ("W2",): (1, 1)}
    assert counted(cube.count_space(f1, "fj")) == {("J1",): (4, 2)}
    assert counted(cube.count_space(facts.by_author(f1), "fa")) == {("a1",): (3, 1), ("a2",): (4, 2)}
    assert counted(cube.count_space(f1, "ffa")) == {("a1",): (3, 1), ("a2",): (1, 1)}
    assert counted(cube.count_space(facts.aged(f1), "cAge.fy")) == {(0, 2001): (3, 1), (2, 2003): (1, 1)}
    assert counted(cube.count_space(facts.aged_by_author(f1), "faAge")) == {(0,): (4, 2), (-2,): (3, 1)}
    assert counted(cube.count_space(facts.reference_pairs(f1, ["c"]), "c1age.c2age")) == {(0, 0): (3, 1)}
    assert counted(cube.count_space(facts.cocitations(f1), "c1.c2")) == {("W1", "W2"): (2, 1)}
    assert counted(cube.count_space(facts.coauthors(docs), "fa1.fa2")) == {("a1", "a2"): (1, 1), ("a2", "a1"): (1, 1)}


def test_many_spaces_agree_with_each(mini):
    _, f1 = mini
    spaces = ["c", "fj", "c.fy", "fy.ta", "ta", "ty", "c.fj.fy", "ffa", "c.ffa", "fj.ty"]
    whole = cube.count_spaces(f1, spaces).cache()
    for s in spaces:
        dims = s.split(".")
        assert counted(whole.where(F.col("space") == s).select(*dims, "ind", "doc")) == counted(cube.count_space(f1, s))


def test_nulls_are_values_of_their_own(spark):
    fact = spark.createDataFrame([("d", None, 1), ("e", "x", 1)], "doc string, c string, fy int")
    got = cube.count_spaces(fact, ["c", "fy"]).collect()
    assert {(r.space, r.c, r.fy, r.ind) for r in got} == {("c", None, None, 1), ("c", "x", None, 1), ("fy", None, 1, 2)}


def test_groups(mini, spark):
    _, f1 = mini
    groups = spark.createDataFrame([("W1", "W"), ("W2", "W")], "value string, rep string")
    assert counted(cube.count_space(cube.regroup(f1, "c", groups), "c")) == {("W",): (4, 2)}
    assert counted(cube.regroup_counts(cube.count_space(f1, "c"), "c", groups)) == {("W",): (4, 3)}


def test_trends(spark):
    counts = spark.createDataFrame([("c", 2000, 2), ("c", 2002, 2), ("o", 2000, 2), ("o", 2002, 6)], "c string, fy int, ind int")
    series = trend.dense_series(counts, "c", 2000, 2002)
    assert [(r.count_, r.share) for r in series.where("c = 'c'").orderBy("year").withColumnRenamed("count", "count_").collect()] == [(2, 0.5), (0, 0.0), (2, 0.25)]
    s = trend.trend_stats(series, "c").where("c = 'c'").head()
    assert (s.first, s.last, s.maxcounty, s.maxcount, s.maxpropy, s.maxprop, s.total, s.totalprop) == (2000, 2002, 2002, 2, 2000, 0.5, 4, 0.75)
    with pytest.raises(ValueError):
        trend.between(series, "c", 2002, 2000)


def life(counts, start, birth=0.5, death=0.1, forward=10, backward=5):
    end = start + len(counts) - 1
    n = dict(zip(range(start, end + 1), counts))
    first = next((y for y in n if n[y] > 0), None)
    if first is None:
        return [], []
    births, deaths, last = [first], [], None
    for y in range(first + backward, end + 1 - forward):
        ahead = sum(n[k] for k in range(y, y + forward)) / forward
        if len(births) > len(deaths):
            if y < births[-1] + backward:
                continue
            before = sum(n[k] for k in range(births[-1], y)) / (y - births[-1])
            if ahead <= death * before:
                last = before
                deaths.append(y)
        elif y >= deaths[-1] + forward and n[y] and ahead > birth * last:
            births.append(y)
    return births, deaths


def test_births_and_deaths(spark):
    rng = random.Random(3)
    cases = {"gold": [10] * 10 + [0] * 15 + [10] * 15}
    for k in range(25):
        cases[f"r{k}"] = [rng.choice((0, 0, 1, rng.randint(0, 30))) if (y // rng.randint(6, 14)) % 2 else rng.randint(0, 2) for y in range(70)]
    cases["none"] = [0] * 30
    rows = [(k, 2000 + i, n) for k, c in cases.items() for i, n in enumerate(c)]
    got = trend.births_deaths(spark.createDataFrame(rows, "c string, year int, count int"), "c").collect()
    for k, c in cases.items():
        b = sorted(r.year for r in got if r.c == k and r.event == "birth")
        d = sorted(r.year for r in got if r.c == k and r.event == "death")
        assert (b, d) == life(c, 2000), k
    assert life(cases["gold"], 2000) == ([2000, 2025], [2009])


def test_rolling_tops(spark):
    counts = spark.createDataFrame([("a", 2000, 5), ("b", 2005, 7), ("a", 2011, 1)], "c string, fy int, ind int")
    w = trend.rolling_windows(counts, "c", 2000, 2011)
    assert {(r.window, r.c, r.n) for r in w.collect()} == {(2000, "a", 5), (2000, "b", 7), (2001, "b", 7), (2002, "b", 7), (2002, "a", 1)}
    assert {(r.window, r.c) for r in trend.top_count(w, "c", 1).collect()} == {(2000, "b"), (2001, "b"), (2002, "b")}
    assert trend.top_count(w, "c", 1, max_share=0.5).select("window").distinct().count() == 2
    assert {r.c: r.first_added for r in trend.first_added(trend.top_share(w, "c", 0.5), "c").collect()} == {"b": 2000}


def test_matrix(spark):
    counts = spark.createDataFrame([(2000, 1, 3), (2001, -1, 9), (2000, 5, 2)], "fy int, cAge int, ind int")
    cells = matrix.matrix(counts, ("fy", (2000, 2001)), ("cAge", (-1, 1)), keep=F.col("cAge") >= 0)
    assert {(r.fy, r.cAge): r.ind for r in cells.collect()} == {(2000, -1): 0, (2000, 1): 3, (2001, -1): 0, (2001, 1): 0}
    shares = {(r.fy, r.cAge): r.share for r in matrix.normalised(cells, "fy").collect()}
    assert shares[2000, 1] == 1.0 and shares[2001, 1] is None
    whole = {(r.fy, r.cAge): r.ind for r in matrix.complemented(counts, ("fy", (2000,)), ("cAge", (1,))).collect()}
    assert whole == {("2000", "1"): 3, ("2000", "other"): 2, ("other", "other"): 9}


def test_components_of_long_chain(spark):
    n = 70
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(n + 2)], "node string")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)], "src string, dst string")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert set(got.values()) == {"n000", f"n{n + 1:03}"} and len(got) == n + 2


def test_alike_pairs_lose_none(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcd") for _ in range(9)) for _ in range(12)]
    words = set(base)
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(w))
                rng.choice((lambda: w.insert(i, rng.choice("abcd")), lambda: w.pop(i) if len(w) > 3 else None, lambda: w.__setitem__(i, rng.choice("abcd"))))()
            words.add("".join(w))
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {(r.a, r.b) for r in graph.alike_pairs(df, "s", 0.0, 2).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert got == {(a, b) for a in words for b in words if a < b and edits(a, b) <= 2}


def test_filters():
    with pytest.raises(TypeError):
        relational.predicate(3)


def test_relational(spark):
    doc = spark.createDataFrame([(1, "a", "J", 2000), (2, "b", "K", 2001)], "id long, first_author string, journal string, year int")
    cit = spark.createDataFrame([(1, 1, "r", "x", 1990), (2, 1, "s", "y", 1991), (3, 2, "r", "x", 1990)], "id long, doc_id long, full_ref string, author string, year int")
    joined = relational.documents_with_citations(doc, cit)
    assert {(r.full_ref, r.n) for r in relational.count_table(joined, ["full_ref"], True).collect()} == {("r", 2), ("s", 1)}
    assert {(r.full_ref, r.n) for r in relational.count_table(joined, ["full_ref"], False, [("journal", ["J"]), ("author", "X*")]).collect()} == {("r", 1)}
    assert {tuple(r) for r in graph.cocitation_network(joined, "full_ref", 1).collect()} == {("r", "s", 1)}


def test_hot_keys_meet_once(spark):
    """Every pair of a key meets exactly once, however the sides are cut."""
    from citeloom.operators.relational import meet

    left = spark.createDataFrame([("h", i) for i in range(25)] + [("c", 1), ("l", 1)], "k string, x int")
    right = spark.createDataFrame([("h", i) for i in range(11)] + [("c", 2), ("r", 1)], "k string, y int")
    for block in (1, 4, 100):
        got = sorted((r.k, r.x, r.y) for r in meet(left, right, ["k"], block).collect())
        assert got == sorted([("h", x, y) for x in range(25) for y in range(11)] + [("c", 1, 2)])
    assert meet(left.limit(0), right, ["k"]).count() == 0
