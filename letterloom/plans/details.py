"""Smaller operators: keyed lookups, scores, caps, list edits, records in text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterloom.functions import text as X
from letterloom.functions.void import is_void
from letterloom.operators import graph


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(c):  # noqa: ANN001, ANN202
    return F.coalesce(c, F.array().cast("array<string>"))


def iban_check(spark: SparkSession, d: str) -> DataFrame:
    """Account numbers made of customer keys, some with the right check digits."""
    key = F.col("c_custkey").cast("string")
    iban = F.concat(F.lit("CH"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lit(" 0076 2"), F.lpad(key, 12, "0"))
    return _t(spark, d, "customer").select("c_custkey", X.iban_valid(iban).alias("valid"))


def swift_valid(spark: SparkSession, d: str) -> DataFrame:
    raw = _t(spark, d, "correspondents").select("corr_id", F.explode("identifikatoren.swift").alias("raw"))
    key = F.regexp_replace(F.upper("raw"), "[^A-Z0-9]", "")
    return raw.select("corr_id", key.alias("key"), key.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$").alias("valid"))


def phone_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose digits hold the phone number of some sender: numbers are cut from the notes, so the join is on equality."""
    c = _t(spark, d, "correspondents")
    known = c.select(F.col("corr_id").alias("owner"), F.explode("identifikatoren.telefon").alias("t")).select("owner", X.phone_key(F.col("t")).alias("key")).where(F.length("key") >= 9).distinct()
    notes = c.select("corr_id", F.explode(X.phones(F.coalesce("notiz", F.lit("")))).alias("key")).distinct()
    return notes.join(known, "key").select("corr_id", "owner", "key")


def tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each entry that the ten most used tags hold, in their order; unknown tags fall away."""
    q = _t(spark, d, "document_review_queue").where("tags is not null").select("queue_id", F.posexplode("tags").alias("pos", "tag")).distinct()
    known = q.groupBy(F.lower("tag").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)
    hit = q.withColumn("key", F.lower("tag")).join(F.broadcast(known), "key")
    return hit.groupBy("queue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]), "|").alias("tags"))


def reconcile_queue(spark: SparkSession, d: str) -> DataFrame:
    """Entries in flight: done where the document is there, others go back ahead of the waiting ones."""
    q = _t(spark, d, "document_review_queue").where("document_id is not null").select("queue_id", "document_id", "status").distinct()
    there = _t(spark, d, "documents").where("text is not null").select("doc_id")
    flight = q.where("status = 'pending'")
    done = flight.join(there, flight["document_id"] == there["doc_id"], "left_semi").select("queue_id", F.lit(2).alias("place"))
    back = flight.join(there, flight["document_id"] == there["doc_id"], "left_anti").select("queue_id", F.lit(0).alias("place"))
    return done.unionByName(back).unionByName(q.where("status = 'rejected'").select("queue_id", F.lit(1).alias("place")))


def merge_senders(spark: SparkSession, d: str) -> DataFrame:
    """Senders of one firm key merged into the first: their documents and the number of their spellings."""
    c = _t(spark, d, "correspondents").select("corr_id", "name", "varianten", X.firm_key(F.col("name")).alias("key"))
    keep = c.groupBy("key").agg(F.min("corr_id").alias("keep"), F.count("*").alias("merged"))
    named = c.join(keep, "key")
    spelt = named.select("keep", F.explode(F.concat(F.array("name"), _texts(F.col("varianten")))).alias("v")).groupBy("keep").agg(F.countDistinct(F.lower(F.trim("v"))).alias("spellings"))
    docs = _t(spark, d, "documents").groupBy("korrespondent").agg(F.count("*").alias("n"))
    moved = named.join(docs, named["name"] == docs["korrespondent"], "left").groupBy("keep").agg(F.first("merged").alias("merged"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
    return moved.join(spelt, "keep").where("merged > 1").select("keep", "merged", "documents", "spellings")


def batch_flags(spark: SparkSession, d: str) -> DataFrame:
    """Names of the documents' senders that the list has and has not."""
    names = _t(spark, d, "documents").select(F.col("korrespondent").alias("name")).distinct()
    known = _t(spark, d, "correspondents").select("name", F.lit(True).alias("found"), "platzhalter").distinct()
    return names.join(F.broadcast(known), "name", "left").groupBy(F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("platzhalter", F.lit(False)).alias("placeholder")).agg(F.count("*").alias("n"))


def best_line(spark: SparkSession, d: str) -> DataFrame:
    """The line of highest price of each order, the first on ties."""
    line = _t(spark, d, "lineitem")
    return line.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("line"), F.max("l_extendedprice").alias("price"))


def completeness(spark: SparkSession, d: str) -> DataFrame:
    """How many of the fields of each version are filled."""
    v = _t(spark, d, "brillenpaesse").select("satz_id", F.posexplode("versionen").alias("pos", "v")).where("v is not null").distinct()
    score = sum((F.when(is_void(F.col(f"v.{f}")), 0).otherwise(1) for f in ("id", "gueltig_ab", "korrespondent", "auftrag", "pd", "bemerkung")), F.lit(0))
    return v.select("satz_id", "pos", score.alias("score")).groupBy("score").agg(F.count("*").alias("versions"))


def version_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents that belong together: connected through the snapshots that name them."""
    v = _t(spark, d, "brillenpaesse").select("satz_id", F.explode("versionen.document_id").alias("doc")).where("doc is not null").distinct()
    edges = v.select(F.concat(F.lit("s"), F.col("satz_id").cast("string")).alias("a"), F.concat(F.lit("d"), F.col("doc").cast("string")).alias("b"))
    labels = graph.components(edges)
    return labels.where("node like 'd%'").groupBy("label").agg(F.count("*").alias("documents")).groupBy("documents").agg(F.count("*").alias("groups"))


def type_list(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("dokumenttyp").alias("name")).where("name is not null")
    return docs.unionByName(_t(spark, d, "document_types").select("name")).distinct()


def last_entries(spark: SparkSession, d: str) -> DataFrame:
    """The five entries that arrived last (a report of five is the feature)."""
    q = _t(spark, d, "document_review_queue").select("queue_id", "eingang", "status").distinct()
    return q.orderBy(F.desc_nulls_last("eingang"), F.desc("queue_id")).limit(5)


def capped_tags(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "document_review_queue").where("tags is not null").select("queue_id", F.array_join(F.slice("tags", 1, 2), "|").alias("tags"), F.size("tags").alias("n"))


def delete_either(spark: SparkSession, d: str) -> DataFrame:
    """Senders without those whose id or whose name is on the list of deletions: two anti joins in place of an OR."""
    c = _t(spark, d, "correspondents").select("corr_id", "name")
    ids = _t(spark, d, "pending_correspondents").select(F.col("pending_id").alias("corr_id")).where("corr_id % 7 = 0")
    bad = _t(spark, d, "document_types").select("name").unionByName(_t(spark, d, "documents").groupBy("korrespondent").agg(F.count("*").alias("n")).where("n > 9").select(F.col("korrespondent").alias("name")))
    return c.join(ids, "corr_id", "left_anti").join(bad.where("name is not null"), "name", "left_anti").select("corr_id", "name")


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """First line with any content of each document, as the sender to fall back on."""
    line = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _t(spark, d, "documents").select("doc_id", F.md5(F.coalesce(F.trim(F.get(line, F.lit(0))), F.lit(""))).alias("line"))


def years_in_text(spark: SparkSession, d: str) -> DataFrame:
    """The year that each document names most often, the later one on ties."""
    y = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(20[12][0-9])\b"), F.lit(1))).alias("year"))
    n = y.groupBy("doc_id", "year").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max(F.struct("n", "year")).alias("m")).select("doc_id", "m.year", "m.n")


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    """What broken lines still tell: the person and the versions' names."""
    r = _t(spark, d, "brillenpass_roh").where("zeile is not null").distinct().where(F.try_parse_json("zeile").isNull())
    return r.select("record_id", F.regexp_extract("zeile", r'"person_id":\s*"([^"]*)"', 1).alias("person"), F.size(F.regexp_extract_all("zeile", F.lit(r'"gueltig_ab":\s*"([^"]*)"'), F.lit(1))).alias("versions"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "correspondents")
    text = F.concat_ws("|", "name", "kuerzel", F.array_join(_texts(F.col("varianten")), ";"), F.array_join(_texts(F.col("match")), ";"))
    return c.select("corr_id", F.left(F.sha2(text, 256), F.lit(16)).alias("hash"))


def field_merge(spark: SparkSession, d: str) -> DataFrame:
    """Maps of fields merged: values of the later map win, empty values delete."""
    o = _t(spark, d, "orders")
    base = F.map_from_arrays(F.array(F.lit("status"), F.lit("priority")), F.array("o_orderstatus", "o_orderpriority"))
    patch = F.map_from_arrays(F.array(F.lit("status"), F.lit("note")), F.array(F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.col("o_orderstatus")), F.left("o_orderpriority", F.lit(1))))
    merged = F.map_filter(F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch), lambda k, v: v != "")
    return o.select("o_orderkey", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"]))), " ").alias("fields"))


def id_lists(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each version: its list and the single id it may still have, once each, in ascending order."""
    v = _t(spark, d, "brillenpaesse").select("satz_id", F.posexplode("versionen").alias("pos", "v")).where("v is not null")
    ids = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("v.document_ids", F.array().cast("array<bigint>")), F.array("v.document_id")))))
    return v.select("satz_id", "pos", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids")).distinct()


def own_emails(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses in notes that are no senders' own and no machine's."""
    c = _t(spark, d, "correspondents")
    found = c.select("corr_id", F.explode(X.emails(F.coalesce("notiz", F.lit("")))).alias("email"))
    own = c.select(F.explode("identifikatoren.email").alias("e")).select(F.lower(F.trim("e")).alias("email"))
    return found.join(own, "email", "left_anti").where(~F.col("email").rlike("noreply|no-reply|donotreply|mailer-daemon|sekretariat")).distinct()


def trivial_tags(spark: SparkSession, d: str) -> DataFrame:
    """Words of folders and types as tags, by whether they say nothing: years, months, single letters."""
    words = _t(spark, d, "documents").select(F.explode(F.split(F.concat_ws(" ", "source", "dokumenttyp", "lang", F.date_format("added", "yyyy MM.yyyy")), "[ -]")).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).select("w", "n", F.col("w").rlike(r"^(?:[0-9]{4}|[0-9]{2}\.[0-9]{4}|.)$").alias("trivial"))


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Handwritten lines that are neither void, nor only signs, nor repeats of an earlier line but for case and blanks."""
    r = _t(spark, d, "schulbericht_vision").select("document_id", "erfasst", F.posexplode("handschrift_zeilen").alias("pos", "line")).distinct()
    key = F.lower(F.trim(F.regexp_replace("line", "[ \t]+", " ")))
    r = r.withColumn("key", key).where(~is_void(F.col("line")) & F.col("line").rlike("[A-Za-zÄÖÜäöü0-9]"))
    return r.groupBy("document_id", "erfasst", "key").agg(F.min("pos").alias("pos")).groupBy("document_id", "erfasst").agg(F.count("*").alias("lines"), F.min("pos").alias("first"))


def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    """For each line of an order, the nearest other line by quantity (the nearest column of a table row)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber")
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - F.lag("l_quantity").over(w)).alias("a"), (F.lead("l_quantity").over(w) - F.col("l_quantity")).alias("b"))
    return x.select("l_orderkey", "l_linenumber", F.coalesce(F.least("a", "b"), F.lit(-1.0)).alias("gap"))


def queue_rollup(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "document_review_queue").select("dienst", F.coalesce("confidence", F.lit("?")).alias("confidence"))
    return q.rollup("dienst", "confidence").agg(F.count("*").alias("n")).select(F.coalesce("dienst", F.lit("all")).alias("dienst"), F.coalesce("confidence", F.lit("all")).alias("confidence"), "n")


QUERIES = {f.__name__: f for f in (iban_check, swift_valid, phone_in_text, tag_lookup, reconcile_queue, merge_senders, batch_flags, best_line, completeness, version_groups, type_list, last_entries, capped_tags, delete_either, first_lines, years_in_text, json_salvage, content_hash, field_merge, id_lists, own_emails, trivial_tags, clean_lines, line_gaps, queue_rollup)}


def _sql() -> dict[str, str]:
    from letterloom.plans.texts import _firm_sql, _phone_sql

    void = "('', 'null', 'none', 'n/a', '-', '–', '—')"
    phone = r"(?:\+41|0041)[ ]?(?:\(0\))?[ -]?[0-9]{2}(?:[ .-]?[0-9]){7}|\(?0[0-9]{2}\)?[ /-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}"
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    filled = " + ".join(f"CASE WHEN lower(trim(coalesce(v.{f}, ''))) IN {void} THEN 0 ELSE 1 END" for f in ("id", "gueltig_ab", "korrespondent", "auftrag", "pd", "bemerkung"))
    return {
        "iban_check": "SELECT c_custkey, ('00762' || lpad(c_custkey::VARCHAR, 12, '0') || '1217' || lpad((c_custkey % 97)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS valid FROM customer",
        "swift_valid": "SELECT corr_id, key, regexp_full_match(key, '[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?') AS valid FROM (SELECT corr_id, regexp_replace(upper(unnest(identifikatoren.swift)), '[^A-Z0-9]', '', 'g') AS key FROM correspondents)",
        "phone_in_text": f"WITH k AS (SELECT DISTINCT corr_id AS owner, {_phone_sql('t')} AS key FROM (SELECT corr_id, unnest(identifikatoren.telefon) t FROM correspondents)), n AS (SELECT DISTINCT corr_id, {_phone_sql('t')} AS key FROM (SELECT corr_id, unnest(regexp_extract_all(notiz, '{phone}')) t FROM correspondents)) SELECT corr_id, owner, key FROM n JOIN k USING (key) WHERE length(key) >= 9",
        "tag_lookup": "WITH q AS (SELECT DISTINCT queue_id, unnest(tags) tag, generate_subscripts(tags, 1) pos FROM document_review_queue WHERE tags IS NOT NULL), k AS (SELECT lower(tag) AS key, count(*) n FROM q GROUP BY 1 ORDER BY n DESC, key LIMIT 10) SELECT queue_id, string_agg(lower(tag), '|' ORDER BY pos) tags FROM q WHERE lower(tag) IN (SELECT key FROM k) GROUP BY 1",
        "reconcile_queue": "WITH q AS (SELECT DISTINCT queue_id, document_id, status FROM document_review_queue WHERE document_id IS NOT NULL) SELECT queue_id, CASE WHEN document_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) THEN 2 ELSE 0 END place FROM q WHERE status = 'pending' UNION ALL SELECT queue_id, 1 FROM q WHERE status = 'rejected'",
        "merge_senders": f"WITH c AS (SELECT corr_id, name, varianten, {_firm_sql('name')} AS key FROM correspondents), k AS (SELECT *, min(corr_id) OVER (PARTITION BY key) keep, count(*) OVER (PARTITION BY key) merged FROM c), s AS (SELECT keep, count(DISTINCT lower(trim(v))) spellings FROM (SELECT keep, unnest(list_concat([name], coalesce(varianten, []))) v FROM k) GROUP BY 1), d AS (SELECT korrespondent, count(*) n FROM documents GROUP BY 1) SELECT keep, any_value(merged) merged, coalesce(sum(n), 0)::BIGINT documents, any_value(spellings) spellings FROM k LEFT JOIN d ON name = korrespondent JOIN s USING (keep) WHERE merged > 1 GROUP BY 1",
        "batch_flags": "SELECT c.name IS NOT NULL AS found, coalesce(platzhalter, false) placeholder, count(*) n FROM (SELECT DISTINCT korrespondent AS name FROM documents) d LEFT JOIN (SELECT DISTINCT name, platzhalter FROM correspondents) c USING (name) GROUP BY 1, 2",
        "best_line": "SELECT l_orderkey, l_linenumber line, l_extendedprice price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) r FROM lineitem) WHERE r = 1",
        "completeness": f"SELECT score, count(*) AS versions FROM (SELECT {filled} score FROM (SELECT DISTINCT satz_id, unnest(versionen) v, generate_subscripts(versionen, 1) pos FROM brillenpaesse) WHERE v IS NOT NULL) GROUP BY 1",
        "type_list": "SELECT dokumenttyp AS name FROM documents WHERE dokumenttyp IS NOT NULL UNION SELECT name FROM document_types",
        "last_entries": "SELECT DISTINCT queue_id, eingang, status FROM document_review_queue ORDER BY eingang DESC NULLS LAST, queue_id DESC LIMIT 5",
        "capped_tags": "SELECT queue_id, array_to_string(tags[:2], '|') tags, len(tags)::INTEGER n FROM document_review_queue WHERE tags IS NOT NULL",
        "delete_either": "SELECT corr_id, name FROM correspondents WHERE corr_id NOT IN (SELECT pending_id FROM pending_correspondents WHERE pending_id % 7 = 0) AND name NOT IN (SELECT name FROM document_types) AND name NOT IN (SELECT korrespondent FROM documents WHERE korrespondent IS NOT NULL GROUP BY 1 HAVING count(*) > 9)",
        "first_lines": "SELECT doc_id, md5(coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), '')) AS line FROM documents",
        "years_in_text": r"WITH y AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(20[12][0-9])\b', 1)) AS year FROM documents), n AS (SELECT doc_id, year, count(*) n FROM y GROUP BY 1, 2) SELECT doc_id, year, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, year DESC) r FROM n) WHERE r = 1",
        "json_salvage": r"""SELECT record_id, regexp_extract(zeile, '"person_id":\s*"([^"]*)"', 1) person, len(regexp_extract_all(zeile, '"gueltig_ab":\s*"([^"]*)"', 1))::INTEGER AS versions FROM (SELECT DISTINCT * FROM brillenpass_roh) WHERE zeile IS NOT NULL AND NOT json_valid(zeile)""",
        "content_hash": "SELECT corr_id, sha256(concat_ws('|', name, kuerzel, coalesce(array_to_string(varianten, ';'), ''), coalesce(array_to_string(match, ';'), '')))[:16] AS hash FROM correspondents",
        "field_merge": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'note=' || o_orderpriority[1] || ' priority=' || o_orderpriority ELSE 'note=' || o_orderpriority[1] || ' priority=' || o_orderpriority || ' status=' || o_orderstatus END AS fields FROM orders",
        "id_lists": "SELECT DISTINCT satz_id, (pos - 1)::INTEGER pos, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(v.document_ids, []), [v.document_id]), lambda x: x IS NOT NULL))), ' '), '') ids FROM (SELECT satz_id, unnest(versionen) v, generate_subscripts(versionen, 1) pos FROM brillenpaesse) WHERE v IS NOT NULL",
        "own_emails": f"SELECT DISTINCT corr_id, email FROM (SELECT corr_id, lower(unnest(regexp_extract_all(notiz, '{mail}'))) email FROM correspondents) WHERE email NOT IN (SELECT lower(trim(e)) FROM (SELECT unnest(identifikatoren.email) e FROM correspondents) WHERE e IS NOT NULL) AND NOT regexp_matches(email, 'noreply|no-reply|donotreply|mailer-daemon|sekretariat')",
        "trivial_tags": r"SELECT w, count(*) n, regexp_full_match(w, '[0-9]{4}|[0-9]{2}\.[0-9]{4}|.') trivial FROM (SELECT unnest(regexp_split_to_array(concat_ws(' ', source, dokumenttyp, lang, strftime(added, '%Y %m.%Y')), '[ -]')) w FROM documents) GROUP BY 1",
        "clean_lines": f"WITH r AS (SELECT DISTINCT document_id, erfasst, unnest(handschrift_zeilen) AS line, generate_subscripts(handschrift_zeilen, 1) - 1 pos FROM schulbericht_vision), k AS (SELECT document_id, erfasst, lower(trim(regexp_replace(line, '[ \\t]+', ' ', 'g'))) AS key, min(pos) pos FROM r WHERE lower(trim(line)) NOT IN {void} AND regexp_matches(line, '[A-Za-zÄÖÜäöü0-9]') GROUP BY ALL) SELECT document_id, erfasst, count(*) AS lines, min(pos)::INTEGER AS first FROM k GROUP BY 1, 2",
        "line_gaps": "SELECT l_orderkey, l_linenumber, coalesce(least(a, b), -1.0) gap FROM (SELECT l_orderkey, l_linenumber, l_quantity - lag(l_quantity) OVER w a, lead(l_quantity) OVER w - l_quantity b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber))",
        "queue_rollup": "SELECT coalesce(dienst, 'all') dienst, coalesce(confidence, 'all') confidence, count(*) n FROM (SELECT dienst, coalesce(confidence, '?') confidence FROM document_review_queue) GROUP BY ROLLUP (dienst, confidence)",
    }


SQL = _sql()
