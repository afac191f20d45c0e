import random

import pytest

from citeloom.llm.scans import find_flaws, paragraphs

WORDS = "guild ritual harbour network census clerkship modern learned barn among defended showed thrift charter settlement congregation household parish laboratory interview".split()


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(6)
    rows = []
    for e in range(40):
        title, author = f"On {rng.choice(WORDS)} and {rng.choice(WORDS)}", f"Jane {'bcdfghjklm'[e % 10]}astor{'aeiou'[e % 5]}v"
        for s in range(1, 4):
            text = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(12)]
            if s == 1:
                body = [title, author, "", *text, f"{100 + e}", "Digitised for the Wexmoor Archive, copy 3"]
            else:
                body = [author.upper() if s == 2 else "Annals of Social Theory, Vol. 7", "", *text, f"[{100 + e + s}]", "Digitised for the Wexmoor Archive, copy 3"]
            rows.append((f"e{e}", "page", s, "\r\n".join(body) if e % 2 else "\n".join(body), 1))
    rows += [
        ("x", "page", 1, "A title here\nJane Doe\n\nguild ritual harb0ur lahoratory con-\ngregation house\xad\n\nhold ~ parish (l952) among\nsettle-\n", 1),
        ("x", "page", 2, "Digitised for the Wexnoor Archive, copy 3\nment thrift rnodern census", 1), ("n", "page", 1, None, 1), ("e0", "page", 1, rows[0][3], 1),
    ]
    return spark.createDataFrame(rows, "entry_name string, elem string, seq int, content string, flaw int")


def test_flaws(pages):
    flaws, *_ = find_flaws(pages)
    got = {}
    for r in flaws.collect():
        got.setdefault((r.entry_name, r.seq), set()).add((r.line_no, r.flaw))
    assert got["x", 1] == {(4, "misread"), (4, "hyphen"), (5, "hyphen"), (7, "misread"), (8, "hyphen")}
    assert got["x", 2] == {(1, "furniture"), (2, "misread")}
    for e in range(40):
        assert got[f"e{e}", 1] == {(16, "furniture"), (17, "furniture")}
        assert got[f"e{e}", 2] == got[f"e{e}", 3] == {(1, "furniture"), (15, "furniture"), (16, "furniture")}
    assert ("n", 1) not in got


def test_paragraphs(pages):
    text = [r.text for r in paragraphs(pages).where("entry_name = 'x'").orderBy("par_no").collect()]
    assert text[0] == "A title here Jane Doe"
    assert text[1].startswith("guild ritual harbour laboratory congregation")
    assert text[-1].endswith("settlement thrift modern census")


def test_empty(pages):
    assert find_flaws(pages.limit(0))[0].count() == 0


def test_rare_heads_and_heads_in_sections(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(8))
    rows = []
    for e in range(8):  # no page rows: the head and the stamp are met in sections only
        body = [f"On {rng.choice(WORDS)} {e}", f"Jane Nastor{'aeioulmn'[e]}v", ""]
        for p in range(3):
            body += [*(line() for _ in range(9)), line() + " because", f"{200 + 3 * e + p}", "Digitised for the Wexmoor Archive, copy 3", "Annals of Social Theory", *(line() for _ in range(4)), line() + ".", "", "DATA AND METHODS", ""]
        rows.append((f"s{e}", "sec", 1, "\n".join(body)))
    rare = ["On barn", "Jane Bastorav", "", line(), "Quarterly of Lost Parishes", line(), "55", line(), line(), line(), "Quarterly of Lost Parishes", line(), "56", line()]
    rows.append(("rare", "sec", 1, "\n".join(rare)))
    rows += [("once", "page", 1, "On ritual\nJane Castorev\n\n" + line()), ("once", "page", 2, "Karrandale Studies in Modern Thrift, Vo1. 61\n" + "\n".join([line() for _ in range(5)] + ["DATA AND METHODS", line()]))]
    rows.append(("text", "page", 1, "On barns\nJane Dastoriv\n\n" + "\n".join([line(), line(), "as we saw in his census, Vol. 3"])))
    rows.append(("misread", "sec", 1, "\n".join(["On dowry", "Jane Fastorov", "", line(), line() + " because", "Dlgitised for the Wexmoor Archive, copy 3", line(), line()])))
    df = spark.createDataFrame(rows, "entry_name string, elem string, seq int, content string")
    got = {}
    for r in find_flaws(df)[0].where("flaw = 'furniture'").collect():
        got.setdefault((r.entry_name, r.seq), set()).add(r.line_no)
    for e in range(8):
        lines = rows[e][3].split("\n")
        assert got[f"s{e}", 1] == {i for i, x in enumerate(lines, 1) if x.isdigit() or x.startswith(("Digitised", "Annals"))}
    assert got["rare", 1] == {5, 7, 11, 13} and got["once", 2] == {1} and got["misread", 1] == {6}
    assert ("text", 1) not in got and ("once", 1) not in got


def test_context_decides_each_occurrence(spark):
    """"bam" is a misread "barn" on a farm and itself in a comic; by counts alone all or none would be flagged."""
    import random

    from pyspark.sql import functions as F

    from citeloom.llm import scans

    rng = random.Random(4)
    farm, comic = "hay corn cow sheep plough field horse wheat milk fence".split(), "pow hero mask cape villain zap punch rocket city laser".split()

    def line(words, extra, k=9):
        out = [rng.choice(words) for _ in range(k)]
        if extra:
            out[4] = extra
        return " ".join(out)

    pages, n = [], 0
    for kind, words in (("farm", farm), ("comic", comic)):
        for _ in range(150):
            n += 1
            body = [line(words, "barn" if kind == "farm" and rng.random() < 0.35 else None) for _ in range(12)]
            if n % 15 == 0:
                body[6] = line(words, "bam")
            pages.append((f"{kind}{n}", "page", 2, "\n".join(body)))
    df = spark.createDataFrame(pages, "entry_name string, elem string, seq int, content string")
    flaws, flows, fixes = scans.find_flaws(df)
    got = [r.entry_name for r in flaws.where("flaw = 'misread'").collect()]
    own = sum(1 for e, *_ in pages if "bam" in _[2] and e.startswith("farm"))
    assert own >= 9 and sum(e.startswith("farm") for e in got) >= own - 1 and sum(e.startswith("comic") for e in got) <= 1
    assert {(r.word, r.right) for r in fixes.collect()} == {("bam", "barn")}
    links = scans.glyph_links(scans.word_counts(flows))
    found = flows.limit(1).select(*scans.KEYS, F.lit(1).alias("line_no"), F.lit("word").alias("kind"), F.lit("bam").alias("word"), F.lit(None).cast("array<float>").alias("context"))
    assert (scans._in_context(found, links, None).count() == 1) == (links.where("word = 'bam'").head().n_right >= scans.RATIO * links.where("word = 'bam'").head().n)


def test_each_line_is_corrected_by_itself(spark):
    from citeloom.llm import scans

    body = "\n".join(["the common modern summer number remained among members"] * 150)
    text = body + "\n\nthe cornmon sum-\nrner nurnber\n"
    out = {r.par_no: r.text for r in scans.paragraphs(spark.createDataFrame([("e", "page", 2, text)], "entry_name string, elem string, seq int, content string")).collect()}
    assert out[max(out)] == "the common summer number"


def test_worth_is_measured_on_every_place(spark):
    """Long pages whose words depend on their neighbours only after the first two thousand: each place counts, with its own word and a dealt one."""
    import numpy as np

    from citeloom.llm import scans

    rng = random.Random(8)
    farm, comic = "hay corn cow sheep plough field horse wheat milk fence".split(), "pow hero mask cape villain zap punch rocket city laser".split()
    pages = []
    for n in range(12):
        body = [" ".join(rng.choice(farm + comic) for _ in range(10)) for _ in range(200)]
        for k in range(400):
            body.append(" ".join(rng.choice((farm, comic)[k // 20 % 2]) for _ in range(10)))
        pages.append((f"e{n}", "page", 2, "\n".join(body)))
    df = spark.createDataFrame(pages, "entry_name string, elem string, seq int, content string").repartition(3)
    flows = scans._flows(scans.single_pages(df))
    counts = scans.word_counts(flows).cache()
    contexts = scans.learn_contexts(flows, counts, 72_000)
    assert max(contexts.worth) > 0.6
    sentences = scans.cut(scans._sentences(flows, spark.sparkContext.broadcast(frozenset(contexts.place))))
    own, other = scans._likeness_counts(sentences, contexts)
    want, texts = np.zeros(scans.BINS, int), [r.words for r in sentences.collect()]
    for words in texts:
        for i, w in enumerate(words):
            want[scans._step(contexts.around(words, i) @ contexts.vectors[contexts.place[w]])] += 1
    assert own.sum() == other.sum() == sum(map(len, texts)) == 72_000 and np.abs(own - want).sum() <= 72
    # Words of any place are dealt to any other: the chance of the step of each pair of a place and a word, all pairs counted.
    means = np.array([contexts.around(words, i) for words in texts for i in range(0, len(words), 7)])
    often = np.array([sum(ws.count(w) for ws in texts) for w in sorted(contexts.place, key=contexts.place.get)])
    chance = sum(np.bincount(scans._step(means @ v), minlength=scans.BINS) * n for v, n in zip(contexts.vectors, often))
    assert np.abs(other / other.sum() - chance / chance.sum()).max() < 0.01
