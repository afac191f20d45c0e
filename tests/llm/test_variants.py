import random

from citeloom.llm.variants import LINK, average_linkage, link_variants, name_vectors, near_pairs, read_name, variant_pairs


def test_reading():
    assert read_name("doe, jane b") == read_name("j doe") == read_name("doe jb") == read_name("jane doe") == ("p", "doe", "j")
    assert read_name("bill quillforthe")[2] == "w" and read_name("van hoduniraven, m, jr") == read_name("m van hoduniraven")
    assert read_name("wexmoor institute for social research") == read_name("inst soc res, wexmoor") == read_name("*wexmoor inst soc res")
    assert read_name("--")[0] == "x"


def test_links(spark):
    names = ["Doe, Jane", "DOE, J.", "doe j", "Jane Doe", "J. Doe", "Lasibaraven, T.", "lasibaravn, t", "Lasibaraven, Thomasina", "Lasibaraven, E.", None, "", " ", "--", "Doe, Jane", "x" * 5000]
    df = spark.createDataFrame([(n, "c") for n in names], "name string, cluster string")
    got = {(r.name_a, r.name_b) for r in variant_pairs(link_variants(df)).collect()}
    one = {"doe, jane", "doe, j", "doe j", "jane doe", "j doe"}
    two = {"lasibaraven, t", "lasibaravn, t", "lasibaraven, thomasina"}
    assert got == {(a, b) for g in (one, two) for a in g for b in g if a < b}
    assert link_variants(df.limit(0)).count() == 0


def test_join_is_exact(spark):
    rng = random.Random(8)
    bodies = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(60)}
    df = spark.createDataFrame([(i, "p", b, "xy"[i % 2], 1 + i % 3) for i, b in enumerate(sorted(bodies))], "id long, kind string, body string, mark string, n long")
    vectors = {r.id: {(r.own, x.g): x.w for x in r.v} for r in name_vectors(df).collect()}
    assert all(abs(sum(w * w for w in v.values()) - 1.0) < 1e-9 for v in vectors.values())
    brute = {(a, b): sum(w * vectors[b].get(g, 0.0) for g, w in vectors[a].items()) for a in vectors for b in vectors if a < b}
    for least, block in ((0.15, 2000), (0.5, 2000), (0.5, 3)):
        got = {(r.a, r.b): r.cosine for r in near_pairs(df, least, block).collect()}
        assert set(got) == {k for k, c in brute.items() if c >= least} and len(got) > 3
        assert all(abs(c - brute[k]) < 1e-9 for k, c in got.items())


def linkage(n, sims, link):
    groups = [{i} for i in range(n)]
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                s = sum(sims.get((min(x, y), max(x, y)), 0.0) for x in groups[i] for y in groups[j]) / (len(groups[i]) * len(groups[j]))
                if s >= link and (best is None or s > best[0]):
                    best = (s, i, j)
        if best is None:
            return {frozenset(g) for g in groups}
        groups[best[1]] |= groups.pop(best[2])


def test_average_linkage(spark):
    rng = random.Random(4)
    n = 14
    sims = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a long, b long, s double")
    got = {}
    for r in average_linkage(nodes, edges, 0.4).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == linkage(n, sims, 0.4)


def test_linkage_of_occurrences(spark):
    """A node that occurs k times is like k nodes of similarity 1; a long chain of rounds comes to its end."""
    rng = random.Random(5)
    times = [rng.randint(1, 3) for _ in range(7)]
    owner = [i for i, k in enumerate(times) for _ in range(k)]
    sims = {(i, j): rng.random() for i in range(7) for j in range(i + 1, 7)}
    whole = {(x, y): 1.0 if owner[x] == owner[y] else sims[min(owner[x], owner[y]), max(owner[x], owner[y])] for x in range(len(owner)) for y in range(x + 1, len(owner))}
    nodes = spark.createDataFrame(list(enumerate(times)), "id long, n long")
    got = {}
    for r in average_linkage(nodes, spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a long, b long, s double"), 0.5).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == {frozenset(owner[x] for x in g) for g in linkage(len(owner), whole, 0.5)}


def test_many_typos_of_one_name(spark):
    typos = ["lasibaraven, t", "lasibaravn, t", "lsibaraven, t", "lasbaraven, t", "lasibraven, t", "lasibarxven, t"]
    df = spark.createDataFrame([(n,) for n in [*typos, "lasibaraven, e", "doruntogarth, t"]], "name string")
    groups = {}
    for r in link_variants(df).collect():
        groups.setdefault(r.cluster, set()).add(r.spelling)
    assert sorted(map(len, groups.values())) == [1, 1, 6] and set(typos) in groups.values()


def test_letters_of_errors_cost_less(spark):
    """Weights decide, not edits: a letter that only an error has parts two names less than one that many rows have."""
    rng = random.Random(2)
    others = ["".join(rng.choice(["hip", "bri", "gin", "tor", "und", "ell", "mas", "kog", "wal", "sen", "fa", "lo"]) for _ in range(4)) for _ in range(40)]
    bodies = [(b, 50) for b in [*dict.fromkeys(others), "lasibaraven", "lasigaraven"]] + [("lasixaraven", 1)]
    nodes = spark.createDataFrame([(i, "p", b, "h", n) for i, (b, n) in enumerate(bodies)], "id long, kind string, body string, mark string, n long")
    got = {(r.a, r.b): r.cosine for r in near_pairs(nodes, 0.3).collect()}
    one, two, error = len(bodies) - 3, len(bodies) - 2, len(bodies) - 1
    assert min(got[one, error], got[two, error]) > LINK > 0.65 > max(c for (a, b), c in got.items() if a < one)
    assert min(got[one, error], got[two, error]) > got[one, two] + 0.08
