import random

import numpy as np
import pytest

from citeloom.llm import leakage
from citeloom.llm.leakage import find_leaks, plain_words

LEXICON = [f"{a}{b}" for a in ("mar", "tel", "von", "lis", "dar", "quo", "ber", "san", "pil", "rud") for b in ("ket", "en", "dis", "or", "ling", "ance", "ship", "al", "ward", "ment", "ic", "ous")]


def sentence(rng, n):
    return [rng.choice(LEXICON) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    items = [(i, "s", " ".join(sentence(rng, rng.randint(12, 60))).capitalize() + "?", "an answer") for i in range(40)]
    items += [(100, "s", items[0][2] + " more words follow here", "x"), (101, "s", "too short", "x"), (102, "s", None, None)]
    docs, d = [], 0
    for _ in range(400):
        body = sentence(rng, rng.randint(0, 120))
        if rng.random() < 0.5:
            words = rng.choice(items[:40])[2].rstrip("?").lower().split()
            k = rng.randint(8, 20)
            at = rng.randrange(max(1, len(words) - k + 1))
            piece = words[at : at + k]
            if len(piece) > 3 and rng.random() < 0.5:
                piece[2] = piece[2][:2] + "-\n" + piece[2][2:] if len(piece[2]) > 4 else piece[2]
                piece.insert(3, "(Doe and Roe 1990; Poe 2001)")
            spot = rng.randint(0, len(body))
            body[spot:spot] = [piece[0].upper() + ",", *piece[1:]]
        docs.append((d, " ".join(body), 1))
        d += 1
    docs += [(d, None, 1), (d + 1, "", 1), (d + 2, " ".join(sentence(rng, 30_000)) + " " + items[5][2], 1), docs[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, words int"), spark.createDataFrame(items, "item_id long, suite string, item_text string, answer string"), docs, items


def brute(docs, items):
    runs = {}
    for i, _, t, _ in items:
        w = plain_words(t)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t, _ in docs:
        w = plain_words(t)
        for k in range(len(w) - 11):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + 12]), ())}
    return out


def test_all_leaks_are_found(tables):
    documents, items, docs, rows = tables
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents, items).collect()}
    want = brute(docs, rows)
    assert len(want) > 80 and got <= want and len(got & want) >= 0.99 * len(want)


def test_empty(tables):
    documents, items, *_ = tables
    assert find_leaks(documents.limit(0), items).count() == 0
    assert find_leaks(documents, items.limit(0)).count() == 0


def test_paraphrases_are_told_apart(spark, tables):
    _, items, _, rows = tables
    words = rows[3][2].rstrip("?").lower().split()
    mixed = [w if k % 6 else "elsewhere" for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(mixed) + " an answer"), (2, rows[3][2])], "doc_id long, text string")
    got = {r.doc_id: r for r in find_leaks(df, items, paraphrases=True).where("item_id = 3").collect()}
    assert got[2].kind == "verbatim" and got[1].kind == "reworded" and got[1].has_answer


def test_recall_of_rewordings(spark, tables):
    """Nine of ten rewordings among other words are found: words changed, left out, put in or swapped with their neighbour."""
    _, items, _, rows = tables
    rng, docs, want = random.Random(11), [], set()
    for d in range(150):
        i, _, text, _ = rows[rng.randrange(40)]
        words = text.rstrip("?").lower().split()[:40]
        if len(words) < 15:
            continue
        out, k = [], 0
        while k < len(words):
            change = rng.choice(("change", "drop", "add", "swap")) if k % 6 == 5 else ""
            if change == "swap" and k + 1 < len(words):
                out += [words[k + 1], words[k]]
                k += 1
            elif change == "change":
                out.append(rng.choice(LEXICON) + "x")
            elif change == "add":
                out += [words[k], rng.choice(LEXICON)]
            elif change != "drop":
                out.append(words[k])
            k += 1
        body = sentence(rng, 90)
        spot = rng.randint(0, 90)
        docs.append((d, " ".join(body[:spot] + out + body[spot:])))
        want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, paraphrases=True).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(want) > 100


def test_retrieval_does_the_work(tables):
    """Only candidates are read word by word: all but a thousandth of planted runs are candidates, few strange pairs are."""
    documents, items, *_ = tables
    index = leakage.index_items(items, "item_id", "item_text", "answer")
    coded = leakage.encode_documents(documents, "doc_id", "text", index).cache()
    table = leakage.singular_vectors(coded, leakage.inverse_document_frequency(coded, index.size), index.words)
    queries, owners = leakage._item_passages(index, table)
    cells = leakage._index_cells(coded, index, table, queries, owners, 0.4)
    assert sorted(np.concatenate(cells.members)) == list(range(len(queries)))
    planted, wanted = leakage._planted(coded, index, table)
    p, q, _ = cells.candidates(planted, queries)
    found = {(a, owners[b]) for a, b in zip(p, q)}
    assert np.mean([(k, j) in found for k, j in enumerate(wanted)]) > 0.998
    rng = np.random.default_rng(3)
    strange = leakage._unit(table[rng.integers(index.size, size=(2000, 24))].sum(1))
    assert len(cells.candidates(strange, queries)[0]) < 0.2 * 2000 * len(queries)


def test_words():
    long = "(" + "; ".join(f"Doe {1900 + k}" for k in range(90)) + ")"
    assert plain_words(f"One {long} two [three four] five (in 1990 six)") == ["one", "two", "three", "four", "five"]
    assert plain_words("One (" + "word " * 100 + "1990)")[:2] == ["one", "word"]
    assert plain_words("(" * 5000 + "1990") == ["1990"]
    assert plain_words("Second-\nhand, (Doe 1990) WARD") == ["secondhand", "ward"]


def test_reworded_passages_are_found(spark, tables):
    _, items, _, rows = tables
    long = [r for r in rows[:40] if len(r[2].split()) >= 20]
    docs = []
    for i, _, text, _ in long:
        words = text.rstrip("?").lower().split()
        docs.append((i, " ".join(w if k % 5 else "elsewhere" for k, w in enumerate(words)) + " an answer"))
    docs.append((1000, " ".join(sentence(random.Random(5), 400))))
    got = {(r.doc_id, r.item_id): r for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, paraphrases=True).collect()}
    assert all(got[i, i].kind == "reworded" and got[i, i].has_answer for i, *_ in long)
    assert not any(d == 1000 or i == 101 for d, i in got)


def test_singular_vectors_are_those_of_all_passages(spark, monkeypatch):
    """Eight long texts of unlike words, 66,000 passages together: each of them shapes the vectors."""
    rng, size = np.random.default_rng(1), 30
    texts = [rng.choice(size, 100_000, p=rng.dirichlet(np.full(size, 0.3))).astype(np.int32) for _ in range(8)]
    coded = spark.createDataFrame([(d, t.tobytes()) for d, t in enumerate(texts)], "d long, words binary").cache()
    idf = np.append(rng.uniform(0.5, 2.0, size), 0.0).astype(np.float32)
    items = [rng.integers(size, size=40).astype(np.int32)]
    gram = np.zeros((size, size))
    for words in texts + items:
        passages = [words[a : a + 24] for a in range(0, max(1, len(words) - 12), 12)]
        x = np.array([np.bincount(p, minlength=size) for p in passages]) * idf[:size]
        gram += x.T @ x
    values, vectors = np.linalg.eigh(gram)
    want = vectors * values**-0.25 / values.min() ** -0.25
    for most in (leakage.MOST_PAIRS, 0):  # pairs counted once, and products of each round
        monkeypatch.setattr(leakage, "MOST_PAIRS", most)
        got = leakage.singular_vectors(coded, idf, items)[:size]
        assert np.abs(got @ got.T - want @ want.T).max() < 0.001


def test_pairs_and_products_agree():
    rng, size = np.random.default_rng(2), 40
    texts = [rng.integers(size + 1, size=n).astype(np.int32) for n in (0, 1, 11, 12, 13, 23, 24, 25, 37, 120_000)] * 2
    table = np.vstack([rng.standard_normal((size, 5)), np.zeros((1, 5))]).astype(np.float32)
    x = np.array([np.bincount(w[a : a + 24], minlength=size + 1) for w in texts if len(w) for a in range(0, max(1, len(w) - 12), 12)])
    assert (leakage._pairs(texts, size) == x.T @ x)[:size, :size].all()
    assert np.allclose(leakage._product(texts, table, size)[:size], (x.T @ (x @ table))[:size], rtol=1e-3, atol=0.5)


def test_limits_come_from_every_document(spark):
    """A few documents hide their leaks among words of much weight; the limits must let these be found too."""
    rng = random.Random(5)
    heavy = [f"zy{c}x" for c in "abcdefghijkl"]
    items = [(i, " ".join(sentence(rng, 30)), "an answer") for i in range(40)] + [(40, " ".join(heavy + heavy), "x")]
    docs = [(d, " ".join(sentence(rng, 60))) for d in range(3000)]
    for k in range(6):
        words = [rng.choice(heavy[:2]) for _ in range(240)]
        for n in range(8):
            run = items[rng.randrange(40)][1].split()[9:21]
            words[24 * n + 6 : 24 * n + 18] = run
        docs.append((3000 + k, " ".join(words)))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents, spark.createDataFrame(items, "item_id long, item_text string, answer string")).collect()}
    want = brute([(*d, 1) for d in docs], [(i, "s", t, a) for i, t, a in items])
    assert len(want) > 30 and got == want


def test_each_run_and_each_block_is_planted(spark, tables):
    documents, items, _, rows = tables
    for some in (documents, documents.where("doc_id in (3, 5)")):  # more blocks than runs, and fewer
        index = leakage.index_items(items, "item_id", "item_text", "answer")
        coded = leakage.encode_documents(some, "doc_id", "text", index).cache()
        table = np.eye(index.size + 1, dtype=np.float32)
        vectors, wanted = leakage._planted(coded, index, table)
        blocks = sum(-(-len(leakage._numbers(r.words)) // 12) for r in coded.collect())
        runs = sum(max(0, len(w) - 11) for w in index.words)
        assert len(vectors) == blocks * -(-runs // blocks) and len(np.unique(wanted)) == sum(len(w) > 11 for w in index.words)
        queries, owners = leakage._item_passages(index, table)
        cells = leakage._index_cells(coded, index, table, queries, owners, 0.9)
        best = np.array([(v @ queries[owners == j].T).max() for v, j in zip(vectors, wanted)])
        assert abs(cells.least + 0.02 - np.quantile(best, 0.0005, method="lower")) < 0.0002
