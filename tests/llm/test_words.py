import random
from pathlib import Path

import numpy as np
import pytest

from letterloom.llm import canonical, names, pii, pii_table, scans, variants
from letterloom.runtime import shared_folder


def slow_distance(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            best = d[i - 1, j - 1] + (0 if x == y else 0.5 if (x, y) in names._ALIKE or (y, x) in names._ALIKE else 1)
            best = min(best, d[i - 1, j] + (0.7 if i > 1 and x == a[i - 2] else 1), d[i, j - 1] + (0.7 if j > 1 and y == b[j - 2] else 1))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, d[i - 2, j - 2] + 0.8)
            d[i, j] = best
    return d[len(a), len(b)]


def test_distance_within_the_bound_matches_the_full_table():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abcile") for _ in range(rng.randint(1, 9)))
        b = "".join(rng.choice("abcile") for _ in range(rng.randint(1, 9))) if rng.random() < 0.3 else "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", "a", "l"])
        full = slow_distance(a, b)
        got = names.distance(a, b, 2.05)
        assert got == pytest.approx(full) if full <= 2.05 else got > 2.05


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Rivegodokb Sàrl", ("rivegodokb",)),
        ('"Hauptsitz  Zahnarztpraxis AG Hunebefu."', ("hauptsitz", "zahnarztpraxis", "hunebefu")),
        ("Muvibuna Pens.-Kasse AG in Feldingen", ("muvibuna", "penskasse")),
        ("T0nigradi E-Werk (Schweiz) 12", ("tonigradi", "ewerk")),
        ("Fam. MUSTER, O.", ("muster", "o")),
        (None, ()),
        (" * ", ()),
    ],
)
def test_words_of_names(raw, want):
    assert names.words(raw) == want


def test_words_that_stand_for_each_other():
    for pair in ("kk krankenkasse", "opt optik", "optiker optik", "druck druckerei", "gaertnerei gartnerei", "basti sebastian", "lisbeth elisabeth", "thea dorothea", "o oskar", "sepp josef", "baeck baeckerei", "tom thomas", "toni antonio", "klaus nikolaus"):
        assert names.related(*pair.split()), pair
    for pair in ("optik garage", "barbara verena", "apotheke kantonalbank", "druckerei baeckerei", "a oskar", "thomas tobias", "marco luca"):
        assert not names.related(*pair.split()), pair
    assert names.short_cost("zbhgi", "zabohugi") == 0 and names.short_cost("zbhgi", "mirelodu") is None


# Nothing of this occurs in the test tables: lines of business, given names, places and cores.
BUSINESS = {"Druckerei": "Druck.", "Bäckerei": "Baeckerei", "Molkerei": "Molk.", "Spenglerei": "Spengl.", "Buchhandlung": "Buchh.", "Brauerei": "Brau."}
GIVEN = {"Thomas": "Tom", "Antonio": "Toni", "Friederike": "Rike", "Alexander": "Alex", "Josephine": "Josie", "Maximilian": "Max"}
ASIDES = ("Redaktion", "Lager Nord", "Zentrale", "Empfang")


def planted(rng, n):
    """(entity, spelling, other spellings): organisations and persons that the tables don't have."""
    core = lambda: "".join(rng.choice(["mor", "lan", "pes", "tik", "var", "ond", "sul", "gre", "pla", "ek", "wis", "jur"]) for _ in range(3)).capitalize()
    slip = lambda w: w[: (i := rng.randrange(1, len(w) - 1))] + rng.choice([w[i] * 2, "", rng.choice("aeiou")]) + w[i + 1 :]
    out = []
    for e in range(n):
        c = core() + rng.choice(["a", "o", "i"])
        if e % 3:
            b = rng.choice(sorted(BUSINESS))
            forms = [f"{c} {b} AG", f"{b} {c}", f"{slip(c)} {b}", f"{c} {BUSINESS[b]}", f"{c} {b} - {rng.choice(ASIDES)}", f"{c}-{b} GmbH", f"{c.upper()} {b.upper()}", f"{rng.choice(ASIDES)} {c} {b}"]
        else:
            g = rng.choice(sorted(GIVEN))
            forms = [f"{g} {c}", f"{c}, {g}", f"{GIVEN[g]} {c}", f"{g[0]}. {c}", f"{c.upper()} {g}", f"{g} {slip(c)}"]
        out += [(e, f, forms) for f in rng.sample(forms, 4)]
    return out


def rates(got, want):
    return len(got & want) / max(1, len(want)), len(got & want) / max(1, len(got))


def test_unseen_organisations_and_persons_are_linked(spark):
    rows = planted(random.Random(21), 150)
    df = spark.createDataFrame([("q", i, f, forms if i % 2 else None) for i, (_, f, forms) in enumerate(rows)], "quelle string, id long, name string, others array<string>")
    got = {(r["id_a"], r["id_b"]) for r in variants.linked_pairs(variants.link(df)).collect()}
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0]}
    recall, precision = rates(got, want)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_unseen_values_are_mapped(spark):
    rows = planted(random.Random(22), 200)
    entries = {e: (f, forms) for e, f, forms in rows if e < 140}
    ref = spark.createDataFrame([(e, f, None, rforms[:5]) for e, (f, rforms) in entries.items()], "pos long, name string, kurz string, formen array<string>")
    df = spark.createDataFrame([(i, f) for i, (_, f, _) in enumerate(rows)], "id long, wert string")
    got = {(r["id"], r["ziel"]) for r in canonical.match_values(df, ref, canonical.NameMatcher).collect()}
    want = {(i, entries[e][0] if e in entries else "") for i, (e, _, _) in enumerate(rows)}
    recall, precision = rates(got, want)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, sorted(want - got)[:9])


def test_a_common_word_alone_links_nothing(spark):
    ref = spark.createDataFrame([(1, "Zabohugi Druckerei AG", None, None), (2, "Mirelo Druckerei AG", None, None), (3, "Pavuno Bäckerei AG", None, None)], "pos long, name string, kurz string, formen array<string>")
    df = spark.createDataFrame([(1, "Mirelo Druckerei"), (2, "Sorteli Baeckerei"), (3, "Druckerei")], "id long, wert string")
    assert {r["id"]: r["ziel"] for r in canonical.match_values(df, ref, canonical.NameMatcher).collect()} == {1: "Mirelo Druckerei AG", 2: "", 3: ""}
    firms = spark.createDataFrame([("q", i, f"{c} Druckerei", None) for i, c in enumerate(["Zabohugi", "Mirelo", "Sorteli"])], "quelle string, id long, name string, others array<string>")
    assert variants.linked_pairs(variants.link(firms)).count() == 0


def test_symmetric_delete_misses_nothing_within_its_bound():
    rng = random.Random(7)
    words = {"".join(rng.choice("abdegiklmnoprtu") for _ in range(rng.randint(7, 12))) for _ in range(150)}
    index = canonical.SymmetricDelete(words, lambda n: 2)
    for w in sorted(words)[:60]:
        i, j = rng.randrange(len(w)), rng.randrange(len(w))
        typed = w[:i] + rng.choice("aeiou") + w[i + 1 :]
        typed = typed[:j] + typed[j + 1 :] if rng.random() < 0.5 else typed
        expected = {x for x in words if names.distance(typed, x, 2) <= 2 and _plain(typed, x) <= 2}
        assert expected <= {x for _, x in index.near(typed)}


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_matching_reports_misses_and_is_the_same_in_blocks(spark):
    ref = spark.createDataFrame([(1, "Zabohugi Musikschule AG", "ZBHGI", ["Zabohugi MS"]), (2, "Lirevili Kabelnetz", None, None), (3, "Lirevili Treuhand", None, [])], "pos long, name string, kurz string, formen array<string>")
    rows = [(1, "MUSIKSCHULE zab0hugi - Filiale"), (2, "ZBHGI Musikschule"), (3, "Lirevilli Kabelnetz AG"), (4, "Lirevili Optik"), (5, None), (6, ""), (6, ""), (7, "x" * 5000)]
    df = spark.createDataFrame(rows, "name long, wert string")
    want = {(1, "Zabohugi Musikschule AG"), (2, "Zabohugi Musikschule AG"), (3, "Lirevili Kabelnetz"), (4, ""), (5, ""), (6, ""), (7, "")}
    for block in (canonical.BLOCK, 1):
        got = canonical.match_values(df, ref, canonical.NameMatcher, block)
        assert {(r["name"], r["ziel"]) for r in got.collect()} == want
    assert {r["ziel"] for r in canonical.match_values(df, ref.limit(0), canonical.NameMatcher).collect()} == {""}


def test_types_are_found_under_errors():
    m = canonical.TermMatcher([canonical.Entry(0, "Lohnausweis", None, ("Jahreslohnausweis ",)), canonical.Entry(1, "Rechnung", None, ("Faktura",))])
    assert [m(x)[1] for x in ("L0hnausweis (Kopie)", "neue Fackturra", "1. jahreslohnauswels 2023", "Kreuzworträtsel", "???")] == ["Lohnausweis", "Rechnung", "Lohnausweis", "", ""]


def test_linking_by_rounds_equals_linking_in_one_task(spark):
    rows = [("q", i, n, None) for i, n in enumerate(["Zabohugi Musikschule AG", "zabohugi MS", "Zabohugl Musikschule", "Musikschule Zabbohugi", "Zabohugi Treuhand", "Ottilia Birnbinder", "Birnbinder, O.", "Heidi Birnbinder", "ZBHGI Musikschule", None, "", "*"])]
    # Weights come from the rows, so there have to be some that say which words are common.
    rest = [("q", 100 + i, f"{c} {b}", None) for i, c in enumerate("Mirelo Sorteli Pavuno Lirevo Gadumi Fenosta Kilubra".split()) for b in (("Musikschule", "Treuhand")[i % 2],)]
    rest += [("q", 200 + i, f"{g} {c}", None) for i, c in enumerate("Quellmann Grabner Hallinger Rosskopf".split()) for g in (("Ottilia", "Heidi")[i % 2],)]
    df = spark.createDataFrame(rows + rows[:3] + rest, "quelle string, id long, name string, others array<string>")
    want = {(a, b) for g in ({0, 1, 2, 3, 8}, {5, 6}) for a in g for b in g if a < b}
    for together in (variants.TOGETHER, 1):
        got = {(r["id_a"], r["id_b"]) for r in variants.linked_pairs(variants.link(df, together=together), cell=2).collect()}
        assert got == want
    assert variants.link(df.limit(0)).count() == 0


def test_rounds_give_the_groups_of_one_task(spark):
    rng = random.Random(9)
    links = {(f"n{a:02d}", f"n{b:02d}"): round(rng.random(), 1) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.15}
    items = sorted({x for k in links for x in k})
    nodes, edges = spark.createDataFrame([(x,) for x in items], "node string"), spark.createDataFrame([(a, b, s) for (a, b), s in links.items()], "a string, b string, s double")
    assert {r["node"]: r["label"] for r in variants.linkage_rounds(nodes, edges, 0.3).collect()} == variants.average_linkage(items, links, 0.3)


def test_many_rounds_of_linkage_leave_a_small_plan(spark):
    """One pair is merged in each round; the plan of a round doesn't carry the sizes of all rounds before, and their files
    are removed."""
    links = {(f"n{a}", f"n{b}"): 1 - b / 40 for b in range(5) for a in range(b)}
    nodes, edges = spark.createDataFrame([(f"n{x}",) for x in range(5)], "node string"), spark.createDataFrame([(a, b, s) for (a, b), s in links.items()], "a string, b string, s double")
    there = set(Path(shared_folder(spark)).glob("linkage-*"))
    got = variants.linkage_rounds(nodes, edges, 0.3)
    assert {r["node"]: r["label"] for r in got.collect()} == {f"n{x}": "n0" for x in range(5)}
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**9
    assert len(set(Path(shared_folder(spark)).glob("linkage-*")) - there) == 1


def test_average_linkage_merges_by_the_mean():
    # a-b and c-d are close; the one strong link between the two pairs is not enough on average.
    assert variants.average_linkage(list("abcd"), {("a", "b"): 0.9, ("c", "d"): 0.9, ("b", "c"): 0.8}, 0.5) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert variants.average_linkage(list("abc"), {("a", "b"): 0.9, ("b", "c"): 0.8, ("a", "c"): 0.4}, 0.5) == {"a": "a", "b": "a", "c": "a"}
    assert variants.average_linkage([], {}, 0.5) == {}


def test_lines_are_told_apart():
    for x in ("[3]", "- 2 -", "Seite 4 von 7", "S. 1/2", "  12", "Blatt 3"):
        assert scans.is_number(x), x
    for x in ("12.", "Raum 02.", "--- Seite 3 ---", "7560943544472", "Note 4", ""):
        assert not scans.is_number(x), x
    assert scans.broken("wird voll¬ ", "ständig erreicht") == ("voll", "ständig", "¬")
    assert scans.broken("Die Lese-", "und Schreibförderung") is None
    assert scans.joined("Eltern", "Gespräch") == "Eltern-Gespräch" and scans.joined("voll", "ständig") == "vollständig"
    assert "Schwierigkeiten" in scans.undone("Scliwierigkeiten") and "Unterricht" in scans.undone("Unferricht")


def test_repair_of_a_small_corpus(spark):
    body = "Der Unterricht ist wichtig.\nDie Klasse ist vollständig und wichtig.\nDer Unterricht ist freundlich.\nDie Klasse bleibt vollständig.\nDer Unterricht bleibt freundlich und wichtig.\nDie Klasse ist erreicht."
    page = "--- Seite {n} ---\nSchulgemeinde Moosau\n" + body + "\nDer Unterricht wurde voll-\nständig erreicht und die Klasse ist\nfreundlich. Die Lese-\nund Schreibförderung bleibt wich-\n[{n}]"
    end = "--- Seite 9 ---\nSchulgemeinde Moosau\ntig. Der Unterricht ist wichtig und vollständig.\n" + body + "\n[9]"
    texts = ["\n".join([page.format(n=1), end])] * 1 + ["\n".join([page.format(n=k), end]) for k in range(2, 12)]
    texts[3] = texts[3].replace("Der Unterricht wurde", "Der Unferricht wurde")
    rows = [(i, t, ["Das ist freund-", None, "lich."]) for i, t in enumerate(texts)] + [(50, None, None), (51, "", []), (52, " n/a ", [None])]
    df = spark.createDataFrame(rows, "document_id long, volltext string, handschrift_zeilen array<string>")
    cases = scans.repairs(scans.pages(df.unionByName(df), "document_id", ["volltext"], ["handschrift_zeilen"])).cache()
    got = {(r["doc"], r["feld"], r["art"], r["wert"]) for r in cases.collect()}
    for i in range(len(texts)):
        assert {(i, "volltext", "trennung", "vollständig"), (i, "volltext", "trennung", "wichtig"), (i, "volltext", "kopf", "Schulgemeinde Moosau"), (i, "volltext", "seitenzahl", "[9]"), (i, "handschrift_zeilen", "trennung", "freundlich")} <= got
    assert (3, "volltext", "zeichen", "Unterricht") in got
    assert not {x for x in got if x[0] >= 50} and not {x for x in got if "Lese" in x[3]}
    text = {(r["doc"], r["feld"]): r["text"] for r in scans.reflow(scans.pages(df, "document_id", ["volltext"], ["handschrift_zeilen"]), cases).collect()}
    flat = body.replace("\n", " ")
    assert text[3, "volltext"] == f"{flat} Der Unterricht wurde vollständig erreicht und die Klasse ist freundlich. Die Lese- und Schreibförderung bleibt wichtig. Der Unterricht ist wichtig und vollständig. {flat}"
    assert text[0, "handschrift_zeilen"] == "Das ist freundlich."


def test_heads_are_told_by_all_words(spark, monkeypatch):
    body = "Die Klasse lernt Musik und Malen.\nDas Kind malt und singt gern.\nKlasse und Kind sind wach"
    body = "\n".join([body] * 4)
    texts = [f"--- Seite 1 ---\nOberstufe {'Birkcntal' if k == 4 else 'Birkental'}\n{body}\n--- Seite 2 ---\nSekundar Lindenhof\n{body}" for k in range(9)]
    rows = scans.pages(spark.createDataFrame(list(enumerate(texts)), "document_id long, volltext string").withColumn("h", scans.F.lit(None).cast("array<string>")), "document_id", ["volltext"], ["h"])
    heads = lambda: {(r["doc"], r["wert"]) for r in scans.repairs(rows).where("art = 'kopf'").collect()}
    want = {(k, x) for k in range(9) for x in (f"Oberstufe {'Birkcntal' if k == 4 else 'Birkental'}", "Sekundar Lindenhof")}
    for name in ("VECTOR_WORDS", "FURNITURE_WORDS", "HEAD_BLOCK"):
        monkeypatch.setattr(scans, name, 1, raising=False)
    assert heads() == want


def test_skip_grams_bring_words_of_one_context_together(spark):
    rng = random.Random(6)
    groups = [[f"{g}wort{i}" for i in range(12)] for g in "abc"]
    pairs = [(*rng.sample(rng.choice(groups), 2), rng.randint(1, 5)) for _ in range(3000)]
    reader = scans.Reader(set(), scans.skip_grams(spark.createDataFrame(pairs, "a string, b string, n long").repartition(3), 6))
    near = lambda a, b: float(reader.vector(a) @ reader.vector(b))
    own = np.mean([near(*rng.sample(g, 2)) for g in groups for _ in range(20)])
    other = np.mean([near(rng.choice(groups[i]), rng.choice(groups[i - 1])) for i in range(3) for _ in range(20)])
    assert own > other + 0.3
    assert reader.fit("x", "awort1", 5, ["awort2", "awort3"]) > reader.fit("x", "bwort1", 5, ["awort2", "awort3"])
    assert scans.skip_grams(spark.createDataFrame([], "a string, b string, n long"), 1).shape == (2, scans.BUCKETS, scans.DIMENSIONS)


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    pair, start = rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32)
    seqs = [rng.normal(size=(n, k)).astype(np.float32) for n in (3, 1, 4, 0, 3)]
    for e, path in zip(seqs, pii.viterbi(seqs, pair, start), strict=True):
        if not len(e):
            assert len(path) == 0
            continue
        total = (e[0] + start)[:, None]
        paths = [[i] for i in range(k)]
        scores = total[:, 0].tolist()
        for t in range(1, len(e)):
            paths, scores = [p + [j] for p in paths for j in range(k)], [s + pair[p[-1], j] + e[t, j] for p, s in zip(paths, scores, strict=True) for j in range(k)]
            keep = sorted(range(len(paths)), key=lambda i: -scores[i])[:3000]
            paths, scores = [paths[i] for i in keep], [scores[i] for i in keep]
        assert path.tolist() == paths[int(np.argmax(scores))]


def accuracy(field, data):
    hit = wrong = missed = 0
    for (text, spans), got in zip(data, pii.find([t for t, _ in data], field), strict=True):
        want = {s for s in spans if s[2] != "ahv" or pii.valid_ahv(text[s[0] : s[1]])}
        hit, wrong, missed = hit + len(want & set(got)), wrong + len(set(got) - want), missed + len(want - set(got))
    return hit / (hit + missed), hit / (hit + wrong)


def test_accuracy_on_held_out_sentences():
    recall, precision = accuracy(pii.train(), pii_table.labelled(4, 99, held_out=True))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_kept_weights_are_those_of_training():
    recall, precision = accuracy(pii.load(), pii_table.labelled(2, 98, held_out=None))
    assert pii.WEIGHTS.exists() and recall > 0.97 and precision > 0.97


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Am Montag rief Thomas Brunner an", ["Thomas Brunner"]),
        ("Bitte schreiben Sie Marco Ferrari oder Aisha Khan", ["Marco Ferrari", "Aisha Khan"]),
        ("Herr Nowak hat bezahlt", ["Nowak"]),
        ("Der Unterricht bei Lukas Odermatt war gut", ["Lukas Odermatt"]),
        ("Wohnt an der Seefeldquai 12, 8008 Zürich", ["Seefeldquai 12, 8008 Zürich"]),
        ("Im Grund 5, 3000 Bern", ["Im Grund 5, 3000 Bern"]),
        ("12 rue de Lausanne, 1201 Genève", ["12 rue de Lausanne, 1201 Genève"]),
    ],
)
def test_ordinary_sentences(text, want):
    assert [text[a:b] for a, b, _ in pii.find([text], pii.load())[0]] == want


def test_personal_data_of_odd_rows(spark):
    rows = [(1, "Kontakt: N. Birnbruder (Sachb.), Tel. 0910850442"), (2, None), (3, ""), (4, "Die Garage Moosacher & Söhne GmbH spendete den Kuchen."), (5, "Mail genügt: anna@x.example. " * 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, notiz string, text string")
    got = {r["id"]: r for r in pii.personal_data(df, "id", "notiz").collect()}
    assert got[1]["maskiert"] == "Kontakt: [NAME] (Sachb.), Tel. [TELEFON]"
    assert got[2]["maskiert"] is None and got[3]["maskiert"] == "" and not got[4]["funde"]
    assert len(got[5]["funde"]) == 400
    assert pii.valid_ahv("756.9217.0769.85") and not pii.valid_ahv("756.9217.0769.84")
