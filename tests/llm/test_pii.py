from citeloom.llm.pii import find_places, redact, tag, train
from citeloom.llm.pii_examples import NEGATIVE, POSITIVE, UNSEEN_NEGATIVE, UNSEEN_POSITIVE, labelled_sentences


def scores(cases):
    found = tag(train(), [t for t, _ in cases])
    want = {(k, a, c) for k, (_, ps) in enumerate(cases) for a, _, c in ps}
    got = {(k, a, c) for k, ps in enumerate(found) for a, _, c in ps}
    return len(want & got) / len(want), len(want & got) / len(got)


def test_accuracy_on_new_fillers():
    recall, precision = scores(labelled_sentences(3, seed=1234))
    assert recall > 0.95 and precision > 0.97


def test_accuracy_on_patterns_never_trained_on():
    assert not set(UNSEEN_POSITIVE + UNSEEN_NEGATIVE) & set(POSITIVE + NEGATIVE)
    recall, precision = scores(labelled_sentences(20, 99, UNSEEN_POSITIVE, UNSEEN_NEGATIVE))
    assert recall > 0.9 and precision > 0.95


def test_segments_make_no_difference():
    texts = [" ".join(t for t, _ in labelled_sentences(1, seed)) for seed in (1, 2)]
    assert tag(train(), texts) == tag(train(), texts, segment=10**9) and len(tag(train(), texts)[0]) > 200
    names = " and ".join(f"{a} {b}" for a in ("Anna", "Paul") for b in ("Smith", "Miller", "Walker", "Cooper")) + " "
    assert tag(train(), [names * 200]) == tag(train(), [names * 200], segment=10**9)


TEXT = "We thank Mrs. Jane B. Doe, who can be reached under 313-555-0175.\nContact: jane.doe@example.org"


def test_places_and_placeholders(spark):
    long = "The ward of clerks was measured in 1990. " * 20_000 + TEXT
    df = spark.createDataFrame([(1, TEXT, "a"), (2, None, "a"), (3, "", "a"), (4, long, "a"), (1, TEXT, "a"), (5, "Contrary to Doe (1990), wards rose.", "a")], "doc_id long, text string, pii_type string")
    rows = [(r.doc_id, r.pii_type, r.start_pos) for r in find_places(df).collect()]
    own = [("name", TEXT.index("Jane")), ("phone", TEXT.index("313")), ("email", TEXT.index("jane.doe"))]
    assert sorted(r[1:] for r in rows if r[0] == 1) == sorted(own * 2)
    shift = len(long) - len(TEXT)
    assert sorted(r[1:] for r in rows if r[0] == 4) == sorted((k, a + shift) for k, a in own)
    assert not [r for r in rows if r[0] in (2, 3, 5)]
    texts = {r.doc_id: (r.text, r.n_places) for r in redact(df).collect()}
    assert texts[1] == ("We thank Mrs. [NAME], who can be reached under [PHONE].\nContact: [EMAIL]", 3)
    assert texts[2] == (None, 0) and texts[3] == ("", 0) and texts[5][0].startswith("Contrary to Doe")
    assert find_places(df.limit(0)).count() == 0
