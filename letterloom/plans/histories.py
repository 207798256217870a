"""Queues, version histories and semi-structured records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterloom.functions import text as X
from letterloom.functions.void import is_void
from letterloom.operators import queues as Q


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queue_compact(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "document_review_queue").where("document_id is not null")
    out = Q.compact(q, "document_id", "queue_id", "grund", ["pfad", "title"], "eingang")
    return out.select("document_id", F.array_join("grund", "|").alias("reasons"), "pfad", "title", "eingang", "rows")


def queue_upsert(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "document_review_queue").where("document_id is not null")
    old = q.where("dienst = 'post_consume'").groupBy("document_id").agg(F.max_by(F.struct("status", "pfad"), "queue_id").alias("m")).select("document_id", "m.status", "m.pfad")
    new = q.where("dienst = 'paper_manager'").groupBy("document_id").agg(F.max_by(F.struct("status", "pfad"), "queue_id").alias("m")).select("document_id", "m.status", "m.pfad")
    return Q.upsert(old, new, "document_id", "status")


def versions_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest and previous order, and how many there are."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.coalesce(F.lag("o_orderkey").over(w), F.lit(0)).alias("previous"), F.lead("o_orderkey").over(w).alias("_next"), F.row_number().over(w).alias("versions"))
    return o.where("_next is null").select("o_custkey", F.col("o_orderkey").alias("latest"), "previous", "versions")


def versions_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changed from order to order of a customer: one row per changed attribute."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", fields.alias("new"), F.lag(fields).over(w).alias("old")).where("old is not null")
    both = F.map_filter(F.map_zip_with("old", "new", lambda k, a, b: F.struct(a.alias("old"), b.alias("new"))), lambda k, v: ~v["old"].eqNullSafe(v["new"]))
    return o.select("o_orderkey", F.explode(both).alias("field", "v")).select("o_orderkey", "field", "v.old", "v.new")


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events without those that repeat the one before of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).where("before is null or before <> event_type")
    return e.groupBy("event_type").agg(F.count("*").alias("runs"), F.countDistinct("user_id").alias("users"))


def unique_titles(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "document_review_queue").where("title <> '' and pfad is not null").select("queue_id", "pfad", "title").distinct()
    return Q.unique_titles(q, "pfad", "title", "queue_id").select("queue_id", "unique_title")


def key_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "correspondents")
    rows = c.select("name", F.lit("name").alias("kind"), X.name_key(F.col("name")).alias("key")).unionByName(c.select("name", F.lit("match").alias("kind"), F.explode("match").alias("k")).select("name", "kind", X.name_key(F.col("k")).alias("key"))).unionByName(c.select("name", F.lit("kuerzel").alias("kind"), F.upper("kuerzel").alias("key")))
    return Q.conflicts(rows)


def list_unions(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "correspondents")
    both = Q.ordered_union(F.col("match"), F.transform("varianten", lambda x: F.lower(F.trim(x))))
    return c.select("corr_id", F.array_join(both, "|").alias("keys"), F.size(both).alias("n"), F.coalesce(F.size("match") != F.size(F.array_distinct("match")), F.lit(False)).alias("repeats"))


def case_unions(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "correspondents").select("corr_id", F.array_compact(F.coalesce("varianten", F.array().cast("array<string>"))).alias("v"))
    return c.select("corr_id", F.array_join(Q.union_ignoring_case(F.col("v")), "|").alias("variants"))


def tags_without(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "document_review_queue").where("tags is not null")
    return q.select("queue_id", F.array_join(Q.without(F.col("tags"), F.array(F.lit("Brille"), F.split("pfad", "/")[1])), "|").alias("tags"))


def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Confidence on one scale from numbers on two: values above 1 are percentages."""
    c = F.col("llm_confidence")
    v = F.when(c > 1, c / 100).otherwise(c)
    bucket = F.when(v >= 0.8, "hoch").when(v >= 0.5, "mittel").when(v.isNotNull(), "tief").otherwise("unbekannt")
    return _t(spark, d, "pending_correspondents").groupBy("aktion", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"))


def json_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Raw store lines by what can be read from them."""
    z = F.trim("zeile")
    v = F.try_parse_json(z)
    kind = F.when(v.isNull(), "broken").when(z.startswith("{"), "object").when(z.startswith("["), "array").otherwise("other")
    return _t(spark, d, "brillenpass_roh").where("zeile is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.try_variant_get(v, "$.person_id", "string").isNotNull()).alias("persons"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by a field of their JSON properties, parsed with an explicit schema."""
    return _t(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p")).groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n"))


def page_merge(spark: SparkSession, d: str) -> DataFrame:
    """Handwritten lines of a report without repeats, joined; and what is known of the pages."""
    r = _t(spark, d, "schulbericht_vision").where("document_id is not null").dropDuplicates(["document_id", "erfasst"])
    lines = F.filter(F.transform("handschrift_zeilen", lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: ~is_void(x))
    return r.select("document_id", F.array_join(F.array_distinct(lines), "\n").alias("text"), F.greatest(F.coalesce("seiten_anzahl", F.lit(0)) - F.coalesce("pages_failed", F.lit(0)), F.lit(0)).alias("pages_read"), F.bround("modell_confidence", 2).alias("confidence")).distinct()


def eye_plausible(spark: SparkSession, d: str) -> DataFrame:
    """Distance measurements by whether they lie on the quarter grid within range."""
    v = _t(spark, d, "brillenpaesse").select(F.explode("versionen").alias("v")).where("v is not null").select(F.explode(F.array("v.fern.rechts.sph", "v.fern.links.sph")).alias("t"))
    t = F.regexp_replace(F.translate(F.col("t"), "−,", "-."), "[^0-9.+-]", "")
    n = F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), t.cast("double"))
    kind = F.when(n.isNull(), "none").when((F.abs(n * 4 - F.round(n * 4)) < 0.01) & (F.abs(n) <= 20), "plausible").otherwise("odd")
    return v.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(n), 2).alias("total"))


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of text on a page from the places of its words: order lines as words."""
    w = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("top"), F.col("l_linenumber").alias("left"))
    rows = Q.grouped_rows(w, "l_orderkey", "top", "left", 12)
    return rows.groupBy("l_orderkey").agg(F.max("row").alias("rows"), F.count("*").alias("words"))


def late_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type: the batch twin of the streaming count."""
    e = _t(spark, d, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (queue_compact, queue_upsert, versions_latest, versions_diff, event_runs, unique_titles, key_conflicts, list_unions, case_unions, tags_without, confidence_buckets, json_tolerant, event_props, page_merge, eye_plausible, text_rows, late_windows)}

_LAST = "arg_max({'s': status, 'p': pfad}, queue_id)"
SQL = {
    "queue_compact": """WITH q AS (SELECT * FROM document_review_queue WHERE document_id IS NOT NULL),
r AS (SELECT document_id, string_agg(g, '|' ORDER BY k) reasons FROM (SELECT document_id, g, min((queue_id, i)) k FROM (SELECT document_id, queue_id, unnest(grund) g, generate_subscripts(grund, 1) i FROM q) GROUP BY 1, 2) GROUP BY 1)
SELECT document_id, reasons, pfad, title, eingang, rows FROM (SELECT document_id, arg_min(pfad, queue_id) FILTER (pfad <> '') pfad, arg_min(title, queue_id) FILTER (title <> '') title, max(eingang) eingang, count(*) AS rows FROM q GROUP BY 1) LEFT JOIN r USING (document_id)""",
    "queue_upsert": f"""WITH o AS (SELECT document_id, {_LAST} m FROM document_review_queue WHERE document_id IS NOT NULL AND dienst = 'post_consume' GROUP BY 1),
n AS (SELECT document_id, {_LAST} m FROM document_review_queue WHERE document_id IS NOT NULL AND dienst = 'paper_manager' GROUP BY 1)
SELECT coalesce(o.document_id, n.document_id) document_id, CASE WHEN n.document_id IS NOT NULL THEN 'pending' ELSE o.m.s END status, coalesce(n.m.p, o.m.p) pfad,
CASE WHEN n.document_id IS NULL THEN 'kept' WHEN o.document_id IS NULL THEN 'inserted' WHEN o.m.s = 'pending' THEN 'updated' ELSE 'reopened' END AS change FROM o FULL JOIN n ON o.document_id = n.document_id""",
    "versions_latest": "SELECT o_custkey, o_orderkey latest, previous, versions::INTEGER versions FROM (SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER w, 0) previous, lead(o_orderkey) OVER w nx, row_number() OVER w versions FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE nx IS NULL",
    "versions_diff": "WITH o AS (SELECT o_orderkey, o_orderstatus s, o_orderpriority p, lag(o_orderstatus) OVER w os, lag(o_orderpriority) OVER w op, row_number() OVER w r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, 'status' field, os AS old, s AS new FROM o WHERE r > 1 AND s IS DISTINCT FROM os UNION ALL SELECT o_orderkey, 'priority', op, p FROM o WHERE r > 1 AND p IS DISTINCT FROM op",
    "event_runs": "SELECT event_type, count(*) runs, count(DISTINCT user_id) users FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) WHERE b IS NULL OR b <> event_type GROUP BY 1",
    "unique_titles": "SELECT queue_id, CASE WHEN r = 1 THEN title ELSE title || '_' || r END unique_title FROM (SELECT *, row_number() OVER (PARTITION BY pfad, lower(title) ORDER BY queue_id) r FROM (SELECT DISTINCT queue_id, pfad, title FROM document_review_queue WHERE title <> '' AND pfad IS NOT NULL))",
    "key_conflicts": r"WITH r AS (SELECT name, 'name' kind, trim(regexp_replace(lower(trim(name)), '[ \t\n\r]+', ' ', 'g')) AS key FROM correspondents UNION ALL SELECT name, 'match', trim(regexp_replace(lower(trim(k)), '[ \t\n\r]+', ' ', 'g')) FROM (SELECT name, unnest(match) k FROM correspondents) UNION ALL SELECT name, 'kuerzel', upper(kuerzel) FROM correspondents) SELECT kind, key, count(DISTINCT name) entries, max(name) AS owner FROM r WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT name) > 1",
    "list_unions": "WITH u AS (SELECT corr_id, match, list_filter(list_concat(coalesce(match, []), coalesce(list_transform(varianten, lambda x: lower(trim(x))), [])), lambda x: x IS NOT NULL) l FROM correspondents), v AS (SELECT corr_id, match, list_filter(l, lambda x, i: list_position(l, x) = i) l FROM u) SELECT corr_id, array_to_string(l, '|') AS keys, len(l)::INTEGER n, coalesce(len(match) <> len(list_distinct(match)), false) repeats FROM v",
    "case_unions": "WITH v AS (SELECT corr_id, list_filter(coalesce(varianten, []), lambda x: x IS NOT NULL) l FROM correspondents), w AS (SELECT corr_id, l, list_transform(l, lambda x: lower(trim(x))) k FROM v) SELECT corr_id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(k, lower(trim(x))) = i AND trim(x) <> ''), lambda x: trim(x)), '|') variants FROM w",
    "tags_without": "SELECT queue_id, array_to_string(list_filter(tags, lambda t: t IS NULL OR NOT coalesce(list_contains(['Brille', string_split(pfad, '/')[2]], t), false)), '|') tags FROM document_review_queue WHERE tags IS NOT NULL",
    "confidence_buckets": "WITH c AS (SELECT aktion, CASE WHEN llm_confidence > 1 THEN llm_confidence / 100 ELSE llm_confidence END v FROM pending_correspondents) SELECT aktion, CASE WHEN v >= 0.8 THEN 'hoch' WHEN v >= 0.5 THEN 'mittel' WHEN v IS NOT NULL THEN 'tief' ELSE 'unbekannt' END bucket, count(*) n, round(avg(v), 6) mean FROM c GROUP BY 1, 2",
    "json_tolerant": "WITH z AS (SELECT trim(zeile) z FROM brillenpass_roh WHERE zeile IS NOT NULL) SELECT CASE WHEN NOT json_valid(z) THEN 'broken' WHEN starts_with(z, '{') THEN 'object' WHEN starts_with(z, '[') THEN 'array' ELSE 'other' END kind, count(*) n, count(*) FILTER (json_valid(z) AND json_extract_string(CASE WHEN json_valid(z) THEN z END, '$.person_id') IS NOT NULL) persons FROM z GROUP BY 1",
    "event_props": "SELECT event_type, (json_extract_string(props, '$.k')::INTEGER % 10) k, count(*) n FROM events GROUP BY 1, 2",
    "eye_plausible": r"WITH t AS (SELECT regexp_replace(translate(t, '−,', '-.'), '[^0-9.+-]', '', 'g') t FROM (SELECT unnest([v.fern.rechts.sph, v.fern.links.sph]) t FROM (SELECT unnest(versionen) v FROM brillenpaesse) WHERE v IS NOT NULL)), n AS (SELECT CASE WHEN regexp_full_match(t, '[+-]?[0-9]+(\.[0-9]+)?') THEN t::DOUBLE END n FROM t) SELECT CASE WHEN n IS NULL THEN 'none' WHEN abs(n * 4 - round(n * 4)) < 0.01 AND abs(n) <= 20 THEN 'plausible' ELSE 'odd' END kind, count(*) n, round(sum(n), 2) total FROM n GROUP BY 1",
    "late_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) n, round(sum(value), 2) total FROM events GROUP BY 1, 2",
}
