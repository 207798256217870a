import random

import pytest

from letterloom.llm import spans


def brute(docs, least):
    seen = {}
    for i, t in docs:
        for p in range(len(t or "") - least + 1):
            seen.setdefault(t[p : p + least], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def found(spark, docs, least=400):
    df = spark.createDataFrame(docs, "doc_id long, text string, doc string")
    return {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", least).collect()}


def noise(rng, n, alphabet="abcdefghij äöü\n漢"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_pairs_match_brute_force_at_every_length_and_place(spark):
    rng = random.Random(1)
    docs = []
    for k in range(40):
        core = noise(rng, rng.choice([380, 399, 400, 401, 450, 900]))
        for _ in range(rng.choice([2, 3])):
            docs.append((len(docs), noise(rng, rng.randint(0, 700)) + core + noise(rng, rng.randint(0, 700))))
    docs += [(len(docs) + i, t) for i, t in enumerate([None, "", " ", "a" * 399, "a" * 500, "b" * 20_000 + "a" * 400, docs[0][1], docs[0][1]])]
    assert found(spark, [(i, t, "x") for i, t in docs]) == brute(docs, 400)


def test_hot_blocks_below_and_above_the_length(spark, monkeypatch):
    monkeypatch.setattr(spans, "MANY", 4)
    rng = random.Random(2)
    near, over = noise(rng, 390), noise(rng, 405)
    docs = [(i, noise(rng, rng.randint(0, 300)) + near + noise(rng, 200)) for i in range(12)]
    docs += [(100 + i, noise(rng, rng.randint(0, 300)) + over + noise(rng, 200)) for i in range(12)]
    docs += [(200 + i, near + noise(rng, 100) + over) for i in range(3)]
    assert found(spark, [(i, t, None) for i, t in docs]) == brute(docs, 400)


def test_repeats_within_a_text(spark):
    rng = random.Random(3)
    v, u = noise(rng, 330), noise(rng, 420)
    docs = [(1, v + "x" * 30 + v + u), (2, v + "y" * 77 + v + u), (3, u + v + u), (4, v + v), (5, v)]
    assert found(spark, [(i, t, None) for i, t in docs]) == brute(docs, 400)


def test_passage_alone_before_the_shared_span(spark):
    rng = random.Random(4)
    docs = []
    for k in range(12):
        span = noise(rng, 410)
        part = span[15:395]
        docs += [(2 * k, noise(rng, 60) + part + noise(rng, 60) + span + noise(rng, 60)), (2 * k + 1, noise(rng, 90) + span)]
    docs += [(50, "-" * 900 + docs[0][1]), (51, "x" + "-" * 450), (52, "-=" * 300), (53, "=-" * 210)]
    assert found(spark, [(i, t, None) for i, t in docs]) == brute(docs, 400)


@pytest.mark.parametrize("many", [64, 3])
def test_parts_of_a_passage_before_the_passage(spark, monkeypatch, many):
    """A unit of the shared span stands in the same text before, where less around it is shared; in either text."""
    monkeypatch.setattr(spans, "MANY", many)
    rng = random.Random(11)
    texts = []
    for n, parts in ((400, [(0, 399)]), (410, [(20, 410), (0, 390)]), (420, [(0, 395)]), (405, [(3, 402), (0, 399), (6, 405)])):
        for k in range(10):
            p = noise(rng, n)
            lead = "".join(noise(rng, 50) + p[a:b] for a, b in parts) + noise(rng, 60)
            one, other = noise(rng, 120) + p + noise(rng, 80), lead + p + noise(rng, 90)
            texts += [other, noise(rng, 30) + other[20:], one] if k % 3 == 0 else [one, other] if k % 2 else [other, one]
    docs = list(enumerate(texts))
    assert found(spark, [(i, t, None) for i, t in docs]) == brute(docs, 400)


def test_empty_table_and_repeated_rows(spark):
    assert found(spark, []) == set()
    t = "".join(map(str, range(400)))
    assert found(spark, [(1, t, ""), (1, t, ""), (2, "q" + t, "")]) == {(1, 2)}


def test_spans_elsewhere_match_brute_force(spark):
    rng = random.Random(8)
    core, other, small = noise(rng, 450), noise(rng, 900), noise(rng, 399)
    docs = [(1, noise(rng, 300) + core + noise(rng, 90)), (2, core + noise(rng, 200) + core + small), (3, noise(rng, 50) + other + core), (4, other[100:700] + small), (5, other[300:] + "漢"), (6, None), (7, ""), (8, small)]
    docs += [(9, docs[3][1]), (10, noise(rng, 500) * 2), (11, core * 2)]
    places = {}
    for i, t in docs:
        for p in range(len(t or "") - 399):
            places.setdefault(t[p : p + 400], []).append((i, p))
    want = {(i, p + k) for at in places.values() for i, p in at if {j for j, _ in at} - {i} for k in range(400)}
    texts = dict(docs)
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    got = spans.spans_elsewhere(df, "doc_id", "text").cache()
    for r in got.collect():
        n = r["bis"] - r["von"]
        assert n >= 400 and r["doc"] != r["dort"] and texts[r["doc"]][r["von"] : r["bis"]] == texts[r["dort"]][r["dort_von"] : r["dort_von"] + n]
    assert {(r["doc"], k) for r in got.collect() for k in range(r["von"], r["bis"])} == want
    assert {r["doc"]: r["n"] for r in spans.covered(got).collect()} == {i: sum(j == i for j, _ in want) for i in {j for j, _ in want}}
    assert {1, 2, 3, 4, 5, 9, 11} == {i for i, _ in want}


def test_lines_keep_offsets(spark):
    text = "Erste Zeile\n\n  ERSTE   zeile \nÄndern 漢字\nÄndern 漢字"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ändern 漢字")], "doc_id long, text string")
    got = {(r["doc"], text[r["von"] : r["bis"]] if r["doc"] == 1 else "", r["zuerst"]) for r in spans.removed_lines(df, "doc_id", "text").collect()}
    assert got == {(1, "  ERSTE   zeile ", 1), (1, "Ändern 漢字", 1), (4, "", 1)}


def test_too_short_spans_are_refused(spark):
    with pytest.raises(ValueError):
        spans.shared_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", 50)
