import json
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions.void import is_void
from letterloom.operators import audit, history, matching, nested, queues
from letterloom.operators import timestamps as ts
from letterloom.plans import core_problems
from letterloom.sources import files
from letterloom.streaming import review


def normal(spark, rows):
    df = spark.createDataFrame(rows, "text string, zone string").withColumn("n", ts.normalised(F.col("text"), F.col("zone")))
    return [(r["n"]["kind"], r["n"]["day"], r["n"]["utc"]) for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "kind", "day"),
    [
        ("2019-10-18", "day", "2019-10-18"),
        (" 13 . 11 . 2020 ", "day", "2020-11-13"),
        ("09.12.23", "day", "2023-12-09"),
        ("1.2.70", "day", "1970-02-01"),
        ("25/07/2023", "day", "2023-07-25"),
        ("20250103", "day", "2025-01-03"),
        ("12. Januar 2025", "day", "2025-01-12"),
        ("13 février 2020", "day", "2020-02-13"),
        ("March 3, 2025", "day", "2025-03-03"),
        ("2019-05-27T23:08:44Z", "instant", "2019-05-28"),
        ("1668557742", "instant", "2022-11-16"),
        ("29.2.2023", None, None),
        ("2023-13-05", None, None),
        ("0000-00-00", None, None),
        ("Q3", None, None),
        ("letzten Dienstag", None, None),
        ("", None, None),
        (None, None, None),
        ("1" * 5000, None, None),
    ],
)
def test_days(spark, text, kind, day):
    assert normal(spark, [(text, "Europe/Zurich")])[0][:2] == (kind, day)


def test_instants(spark):
    got = normal(spark, [("2024-03-31T02:30:00", None), ("2024-10-27 02:30:00", "Europe/Zurich"), ("2023-09-12T13:51:15", "UTC"), ("2023-03-22T09:25:59.591870987Z", None), ("Sun, 31 Mar 2024 04:03:20 +0200", "UTC"), ("24.05.22, 16.08 Uhr", None), ("1699448148873", "UTC"), ("2023-07-05 14:51:55 CEST", None), ("2019-04-24 19:30:56 +05:30", None)])
    assert [x[2] for x in got] == ["2024-03-31T01:30:00.000000Z", "2024-10-27T00:30:00.000000Z", "2023-09-12T13:51:15.000000Z", "2023-03-22T09:25:59.591870Z", "2024-03-31T02:03:20.000000Z", "2022-05-24T14:08:00.000000Z", "2023-11-08T12:55:48.873000Z", "2023-07-05T12:51:55.000000Z", "2019-04-24T14:00:56.000000Z"]


def test_zone_table_equals_the_zone_rules():
    table, zone = ts.zone_table("Europe/Zurich"), ZoneInfo("Europe/Zurich")
    rng = np.random.default_rng(1)
    for s in rng.integers(-2_000_000_000, 4_000_000_000, 400).tolist():
        utc = np.array([s * ts.MICROS])
        assert table.to_wall(utc)[0] // ts.MICROS - s == int(datetime.fromtimestamp(s, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    for wall in ("2024-03-31T02:15:00", "2024-10-27T02:15:00", "2024-06-01T12:00:00", "1999-12-31T23:59:59"):
        w = datetime.fromisoformat(wall)
        got = table.to_utc(np.array([np.datetime64(wall, "us").astype(np.int64)]))[0] // ts.MICROS
        assert got == int(w.replace(tzinfo=zone).timestamp())


def test_batches_of_any_order_agree():
    texts = ["2019-10-18", None, "x", "15.03.2020", "2019-10-19", ""] * 50
    kind, wall, utc = ts.parse_batch(pd.Series(texts))
    one = [ts.parse_batch(pd.Series([t])) for t in texts[:6]]
    assert kind.tolist() == [int(o[0][0]) for o in one] * 50 and wall.tolist() == [int(o[1][0]) for o in one] * 50


def test_void_values(spark):
    rows = ["", " ", "NULL", "n/A", "–", " -", "none", None, "0", "x", "null.", " "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(is_void(F.col("v"))).collect()]
    assert got == [True] * 8 + [False, False, False, True]


def test_typed_records_keep_their_parents(spark):
    schema = "id long, pfad string, a array<struct<n:string,b:array<struct<x:string>>,m:map<string,struct<y:string>>>>"
    rows = [(1, "p", [("u", [("1",), None], {"k": ("-",)}), None, (None, [], None)]), (2, None, None), (3, "q", [])]
    t = nested.flatten(spark.createDataFrame(rows, schema), "id", ["a"])
    assert sorted(t) == ["a[]", "a[].b[]", "a[].m{}"]
    a = {r["pfad"]: r for r in t["a[]"].df.collect()}
    assert {p: (r["ordinal"], r["filled"]) for p, r in a.items()} == {"a[0]": (0, True), "a[1]": (1, False), "a[2]": (2, False)}
    b = t["a[].b[]"].df.collect()
    assert {(r["pfad"], r["filled"], r["parent_sk"]) for r in b} == {("a[0].b[0]", True, a["a[0]"]["sk"]), ("a[0].b[1]", False, a["a[0]"]["sk"])}
    assert [(r["pfad"], r["key"], r["filled"]) for r in t["a[].m{}"].df.collect()] == [("a[0].m.k", "k", False)]
    assert nested.flat_columns(t["a[]"]).columns[-1] == "v_n"
    assert nested.flatten(spark.createDataFrame([], schema), "id", ["a"])["a[]"].df.count() == 0


def test_json_records_of_varying_shape(spark):
    lines = ['{"v": [{"f": {"r": {"s": 1}}}, null, {"f": {"r": {"s": "-"}}}]}', '{"v": {"k.1": {"f": {"r": {"s": "x", "t": [null, "n/a"]}}}}}', "[]", "null", '{"v": ', None, '{"v": []}', '{"w": "a\\": \\"b", "v": [{"f": {"r": "text"}}]}']
    df = spark.createDataFrame([(i, z, "clash") for i, z in enumerate(lines)], "id long, z string, pfad string")
    t = nested.flatten_json(df, "id", "z", free_keys=("v",))
    rows = nested.struct_rows(t["v*"], [("f", "r")])
    assert {(r["root"], r["pfad"], r["filled"]) for r in rows.collect()} == {(0, "v[0].f.r", True), (0, "v[2].f.r", False), (1, "v.k.1.f.r", True), (7, "v[0].f.r", False)}
    assert nested.flatten_json(df.limit(0), "id", "z") == {}


def test_raw_lines_of_any_keys_give_all_eyes(spark, tmp_path):
    """Above MAP_KEYS distinct keys the tables differ, the rows don't; keys may hold either kind of quotes."""
    eye = {"fern": {"rechts": {"sph": 1}, "links": {"sph": "-"}}}
    some = [{"versionen": [eye], f"k{i}": {"a": [1]}} for i in range(10)]
    many = [{"versionen": {"v": eye}, f"k{i}": {"a": [1]}, "l'or": {"versionen": [eye]}, "a\"b'c": {"eintraege": [{"versionen": [eye]}]}} for i in range(45)]
    for lines in (some, many):
        spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "record_id long, zeile string").write.mode("overwrite").parquet(str(tmp_path / "brillenpass_roh.parquet"))
        for t in ("brillenpaesse", "correspondents"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
        got = {(r["satz_id"], r["pfad"]) for r in core_problems.p1_found(spark, str(tmp_path)).collect()}
        paths = ("versionen[0]",) if lines is some else ("versionen.v", "l'or.versionen[0]", "a\"b'c.eintraege[0].versionen[0]")
        assert got == {(i, p + ".fern.rechts") for i in range(len(lines)) for p in paths}


def test_shapes_merge_in_any_order():
    a, b = nested._shape({"x": [1, {"y": None}], "z": {"q": 1}}, 40, frozenset()), nested._shape({"x": {"k": {"y": 2}}, "z": 5}, 40, frozenset())
    assert nested.merge_shapes(a, b) == nested.merge_shapes(b, a)
    many = nested._shape({f"k{i}": {"v": i} for i in range(60)}, 40, frozenset())
    assert list(many) == ["m"] and json.dumps(many)


def brute_history(rows):
    best = {}
    for k, day, value, rank in rows:
        if k is not None and day is not None and ((k, day) not in best or rank > best[k, day][0]):
            best[k, day] = (rank, value)
    out = []
    for k in sorted({x for x, _ in best}):
        start = None
        for day in sorted(d for x, d in best if x == k):
            value = best[k, day][1]
            if start is None or value != start[1]:
                if start:
                    out.append((k, start[0], day, start[1]))
                start = (day, value)
        out.append((k, start[0], None, start[1]))
    return out


def test_history_and_merge_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{rng.integers(4)}", f"2020-01-{rng.integers(1, 28):02d}", [None, "a", "b"][rng.integers(3)], int(r)) for r in range(200)]
    rows += [("p1", None, "a", 999)]
    df = spark.createDataFrame(rows, "k string, day string, value string, rank int")
    dated = history.latest_per_date(df.where("k is not null"), ["k"], "day", ["value"], [F.col("rank")])
    got = sorted((r["k"], r["von"], r["bis"], r["value"]) for r in history.history(dated, ["k"], "day", ["value"]).collect())
    assert got == sorted(brute_history(rows), key=str) or sorted(got, key=str) == sorted(brute_history(rows), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_the_rebuild_from_all_rows(spark, seed):
    """Late corrections of folded dates, updates older and newer than what is kept, new and untouched keys."""
    rng = np.random.default_rng(seed)
    draw = lambda n, keys: [(f"p{rng.integers(keys)}", f"2020-01-{rng.integers(1, 12):02d}", [None, "a", "b"][rng.integers(3)], int(rng.integers(1000))) for _ in range(n)]
    # A rank decides between rows of one date; rows of equal rank differ in nothing.
    rows = list({(k, d, r): (k, d, v, r) for k, d, v, r in draw(120, 6) + draw(40, 4)}.values())
    before, after = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    schema = "k string, day string, value string, rank int"
    dated = history.latest_per_date(spark.createDataFrame(before, schema), ["k"], "day", ["value", "rank"], [F.col("rank")])
    old = history.history(dated, ["k"], "day", ["value"])
    new = history.latest_per_date(spark.createDataFrame(after, schema), ["k"], "day", ["value", "rank"], [F.col("rank")])
    got = history.merge(old, dated, new, ["k"], "day", ["value"], ["rank"])
    assert sorted((tuple(r)[:4] for r in got.select("k", "von", "bis", "value").collect()), key=str) == sorted(brute_history(rows), key=str)


def test_late_version_between_two_equal_dates(spark):
    rows = [("p", "2020-01-01", "a"), ("p", "2020-01-03", "a"), ("q", "2020-01-01", "a"), ("q", "2020-01-05", "a"), ("q", "2020-01-09", "b"), ("r", "2020-01-01", "a"), ("r", "2020-01-02", "a")]
    late = [("p", "2020-01-02", "b"), ("q", "2020-01-05", "c"), ("q", "2020-01-07", "b")]
    schema = "k string, day string, value string, rank int"
    dated, new = spark.createDataFrame([(*r, 0) for r in rows], schema), spark.createDataFrame([(*r, 1) for r in late], schema)
    old = history.history(dated, ["k"], "day", ["value"])
    got = history.merge(old, dated, new, ["k"], "day", ["value"], ["rank"])
    want = brute_history([(*r, 0) for r in rows] + [(*r, 1) for r in late])
    assert sorted((tuple(r)[:4] for r in got.select("k", "von", "bis", "value").collect()), key=str) == sorted(want, key=str)
    assert ("p", "2020-01-03", None, "a") in want and ("r", "2020-01-01", None, "a") in want


def test_queues(spark):
    q = spark.createDataFrame([(1, 1, ["a", "b"], "", "t1", 5), (2, 1, ["b", "c"], "p", "t2", 3), (3, 2, None, None, "", 9)], "pos int, doc int, grund array<string>, pfad string, title string, at int")
    got = {r["doc"]: (r["grund"], r["pfad"], r["title"], r["at"], r["rows"]) for r in queues.compact(q, "doc", "pos", "grund", ["pfad", "title"], "at").collect()}
    assert got == {1: (["a", "b", "c"], "p", "t1", 5, 2), 2: (None, None, None, 9, 1)}
    cur, new = spark.createDataFrame([(1, "pending", "x"), (2, "approved", "y"), (3, "approved", "z")], "k int, status string, p string"), spark.createDataFrame([(1, "n", None), (2, "n", "w"), (4, "n", "v")], "k int, status string, p string")
    assert {tuple(r) for r in queues.upsert(cur, new, "k", "status").collect()} == {(1, "pending", "x", "updated"), (2, "pending", "w", "reopened"), (3, "approved", "z", "kept"), (4, "pending", "v", "inserted")}
    words = spark.createDataFrame([(1, t, x) for t, x in ((10, 1), (20, 2), (22, 3), (23, 1), (36, 1))], "doc int, top int, left int")
    assert [r["row"] for r in queues.grouped_rows(words, "doc", "top", "left", 12).orderBy("top").collect()] == [1, 1, 1, 2, 3]


def test_identifiers_abort_or_fall_through(spark):
    entries = spark.createDataFrame([("A", "uid", "1"), ("B", "uid", "1"), ("A", "email", "x")], "name string, kind string, key string")
    docs = spark.createDataFrame([(1, "uid", "1"), (1, "email", "x"), (2, "email", "x"), (3, "uid", "9")], "doc int, kind string, key string")
    assert {tuple(r) for r in matching.by_identifier(docs, entries, ["uid", "email"]).collect()} == {(2, "A", "email")}
    assert {tuple(r) for r in matching.fall_through(docs, entries, ["uid", "email"]).collect()} == {(1, "A", "email"), (2, "A", "email")}


def test_nearest_in_blocks_and_days_in_buckets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(99, [0.0] * 8), (98, None)]
    v = spark.createDataFrame(rows, "id int, vector array<double>")
    one = {tuple(r) for r in matching.nearest(v.where("id % 20 = 0"), v.where("vector is not null"), 3).collect()}
    assert one == {tuple(r) for r in matching.nearest(v.where("id % 20 = 0"), v.where("vector is not null"), 3, limit=1).collect()} and len(one) == 9
    score = lambda a, b: 0.0 if b is None or not np.linalg.norm(a) * np.linalg.norm(b) else round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    want = {q: sorted((-score(x, y), t) for t, y in rows if t != q)[:3] for q, x in rows if q % 20 == 0}
    every = matching.nearest(v.where("id % 20 = 0").repartition(3), v.repartition(5), 3).collect()
    assert {(r["query"], r["rank"]): (-r["score"], r["target"]) for r in every} == {(q, i + 1): p for q, top in want.items() for i, p in enumerate(top)}
    assert matching.nearest(v.limit(0), v, 3).count() == matching.nearest(v, v.limit(0), 3).count() == 0
    days = [(k, i, f"2020-{1 + i % 12:02d}-{1 + (i * 7) % 28:02d}") for k in "ab" for i in range(40)]
    df = spark.createDataFrame(days, "k string, id int, d string").withColumn("d", F.to_date("d"))
    want = {(k, a, b) for k, a, x in days for q, b, y in days if k == q and a < b and abs((pd.Timestamp(x) - pd.Timestamp(y)).days) <= 21}
    assert {tuple(r) for r in matching.within_days(df, ["k"], "d", "id", 21).collect()} == want


def test_empty_inventories(spark):
    none = spark.createDataFrame([], "relpath string, hash string, name string, doc_id int")
    assert audit.summary(none).collect()[0].asDict() == {"files": 0, "contents": 0, "in_groups": 0, "groups": 0, "surplus": 0}
    assert audit.missing(none, none).count() == audit.orphans(none, none).count() == audit.duplicates(none).count() == 0


def test_sources(spark, tmp_path):
    schema = spark.createDataFrame([], "name string, n int").schema
    (tmp_path / "a.json").write_text('{"version": 1, "eintraege": [{"name": "x", "n": 1}, {"name": "y"}]}')
    (tmp_path / "b.json").write_text('[{"name": "z", "n": 3}]')
    read = lambda f: [(r["pos"], r["name"], r["n"]) for r in files.json_list(spark, str(tmp_path / f), "eintraege", schema).collect()]
    assert read("a.json") == [(0, "x", 1), (1, "y", None)] and read("b.json") == [(0, "z", 3)]
    (tmp_path / "log.jsonl").write_text('# head\n{"name": "x", "n": 1}\n{"name": \n\n[1]\n{"name": "y"}\n')
    assert [r["name"] for r in files.json_lines(spark, str(tmp_path / "log.jsonl"), schema).collect()] == ["x", "y"]
    tree = tmp_path / "tree" / "sub"
    tree.mkdir(parents=True)
    (tree / "one.pdf").write_bytes(b"one")
    (tree / "two.txt").write_bytes(b"two")
    inv = files.file_tree(spark, str(tmp_path / "tree"), "*.pdf")
    assert [r["relpath"] for r in inv.collect()] == ["sub/one.pdf"]
    files.write_inventory(inv, str(tmp_path / "inv"))
    old = files.inventory(spark, str(tmp_path / "inv")).withColumn("hash", F.lit("kept"))
    (tree / "new.pdf").write_bytes(b"new")
    got = {r["relpath"]: r["hash"] for r in files.file_tree(spark, str(tmp_path / "tree"), "*.pdf", old).collect()}
    assert got["sub/one.pdf"] == "kept" and len(got["sub/new.pdf"]) == 64


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 5, i % 24), ["a", "b"][i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = review.arrivals(spark, str(tmp_path / "in"), df.schema, 1)
    review.run_available(review.daily_counts(stream), str(tmp_path / "c1"), lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / "counts")), "complete")
    key = lambda d: sorted((str(r["w"]["start"]), r["event_type"], r["n"], r["total"]) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "counts"))) == key(review.daily_counts(df))
    review.run_available(review.distinct_rows(stream, ["event_id"], "ts", "60 days"), str(tmp_path / "c2"), review.to_files(str(tmp_path / "rows")))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 60


def test_every_query_has_a_name_and_sql_where_claimed():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_candidate_stands_once_in_its_check(spark):
    """A check of a check of a day is not many times as long as a check, and gives the same."""
    check = lambda c: dates.valid_issue_date(c, F.lit(2020), F.array(F.lit("1999-01-01")))["iso"]
    once, twice = check(F.col("raw")), check(check(F.col("raw")))
    assert len(str(twice)) < 3 * len(str(once))
    raw = ["2019-03-04", " 4.3.2019 ", "2021-01-01", "2022-01-01", "1989-12-31", "1999-01-01", "1.1.1999", "31.2.2019", "4.3.2019 in Bern", "", "null", None]
    want = ["2019-03-04", "2019-03-04", "2021-01-01", None, None, None, None, None, "2019-03-04", None, None, None]
    got = spark.createDataFrame(list(enumerate(raw)), "k int, raw string").select("k", once.alias("a"), twice.alias("b")).orderBy("k").collect()
    assert [r["a"] for r in got] == want and [r["b"] for r in got] == want
