"""Reconciliation queries: the documents as an inventory of files, two thirds of them as the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.operators import audit as A


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.concat_ws("/", F.coalesce("source", F.lit("?")), F.col("doc_id").cast("string")).alias("relpath"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "doc_id")


def _store(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds: the documents with a known sender that are no school reports."""
    return _docs(spark, d).where("dokumenttyp <> 'Schulbericht'").select(F.col("doc_id").cast("string").alias("name"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))


INVENTORY = "inv AS (SELECT concat_ws('/', coalesce(source, '?'), doc_id::VARCHAR) AS relpath, md5(coalesce(text, '')) AS hash, doc_id FROM documents), store AS (SELECT doc_id::VARCHAR AS name, md5(coalesce(text, '')) AS hash FROM documents WHERE dokumenttyp <> 'Schulbericht')"

QUERIES = {
    "inventory_summary": lambda s, d: A.summary(_inventory(s, d)),
    "inventory_by_folder": lambda s, d: _inventory(s, d).groupBy(A.top_folder(F.col("relpath")).alias("folder")).agg(F.count("*").alias("files"), F.countDistinct("hash").alias("contents")).withColumn("copies", F.col("files") - F.col("contents")),
    "inventory_duplicates": lambda s, d: A.duplicates(_inventory(s, d)),
    "store_overlap": lambda s, d: _inventory(s, d).join(_store(s, d).select("hash").distinct().withColumn("known", F.lit(True)), "hash", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("files"), F.countDistinct("hash").alias("contents")),
    "missing_import": lambda s, d: A.missing(_inventory(s, d), _store(s, d)),
    "orphan_files": lambda s, d: A.orphans(_inventory(s, d), _store(s, d)),
    "queue_pop": lambda s, d: A.pop(_inventory(s, d).withColumn("pos", F.col("doc_id")), _inventory(s, d).join(_store(s, d), "hash", "left_semi"), 25).select("relpath", "pos"),
    "dedupe_keep_lowest": lambda s, d: A.keep_lowest(_inventory(s, d), "hash", "doc_id"),
    "hash_agreement": lambda s, d: A.agreement(_docs(s, d).select(F.coalesce("korrespondent", F.lit("?")).alias("sender"), F.when(F.col("text") != "", F.md5("text")).alias("hash")), "sender", "hash"),
    "mixed_provenance": lambda s, d: _docs(s, d).groupBy("korrespondent").agg(F.bool_or(F.col("source") == "mail-bridge").alias("mail"), F.bool_or(F.col("source") != "mail-bridge").alias("other")).where("mail and other").select("korrespondent"),
    "storage_buckets": lambda s, d: _docs(s, d).groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("lang") == "de").alias("german"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("void")),
    "status_counts": lambda s, d: s.read.parquet(f"{d}/document_review_queue.parquet").groupBy("dienst").pivot("status", ["pending", "approved", "rejected"]).count().na.fill(0),
    "reason_audit": lambda s, d: s.read.parquet(f"{d}/document_review_queue.parquet").select("document_id", F.explode("grund").alias("reason")).groupBy(F.regexp_replace("reason", "=.*$", "").alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("docs"), F.count_if(F.col("document_id") < 1000).alias("low")),
    "top_folders": lambda s, d: s.read.parquet(f"{d}/document_review_queue.parquet").groupBy("pfad").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("pfad")).limit(15),
    "hash_sets": lambda s, d: _inventory(s, d).select("hash").intersect(_store(s, d).select("hash")).withColumn("side", F.lit("both")).unionByName(_inventory(s, d).select("hash").distinct().exceptAll(_store(s, d).select("hash").distinct()).withColumn("side", F.lit("disk only"))).groupBy("side").agg(F.count("*").alias("n")),
    "rehash_incremental": lambda s, d: A.reused_hashes(
        _docs(s, d).select("source", F.col("doc_id"), F.col("n_chars").alias("size"), F.col("added").alias("mtime")).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relpath"), "size", "mtime"),
        _docs(s, d).where("lang = 'de'").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relpath"), F.col("n_chars").alias("size"), F.col("added").alias("mtime"), F.md5(F.coalesce("text", F.lit(""))).alias("hash")),
    ).groupBy(F.col("hash").isNull().alias("to_hash")).agg(F.count("*").alias("files")),
    "page_ranges": lambda s, d: A.page_ranges(s.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber > 1 and l_returnflag <> 'N'").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("page"), F.lit(9).alias("pages")).groupBy("doc", "page", "pages").agg(F.min("name").alias("name")), "pages").groupBy("name").agg(F.count("*").alias("parts"), F.sum(F.col("last") - F.col("first") + 1).alias("n_pages")),
}

SQL = {
    "inventory_summary": f"WITH {INVENTORY}, g AS (SELECT count(*) n FROM inv GROUP BY hash) SELECT sum(n)::BIGINT files, count(*) contents, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT in_groups, count(*) FILTER (n > 1) AS \"groups\", coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT surplus FROM g",
    "inventory_by_folder": f"WITH {INVENTORY} SELECT split_part(relpath, '/', 1) folder, count(*) files, count(DISTINCT hash) contents, count(*) - count(DISTINCT hash) copies FROM inv GROUP BY 1",
    "inventory_duplicates": f"WITH {INVENTORY} SELECT hash, copies, relpath FROM (SELECT *, count(*) OVER (PARTITION BY hash) copies FROM inv) WHERE copies >= 2",
    "store_overlap": f"WITH {INVENTORY} SELECT hash IN (SELECT hash FROM store) AS known, count(*) files, count(DISTINCT hash) contents FROM inv GROUP BY 1",
    "missing_import": f"WITH {INVENTORY}, f AS (SELECT hash, min(relpath) relpath, count(*) copies FROM inv GROUP BY hash) SELECT relpath, hash, copies FROM f WHERE hash NOT IN (SELECT hash FROM store) AND lower(split_part(relpath, '/', -1)) NOT IN (SELECT lower(name) FROM store)",
    "orphan_files": f"WITH {INVENTORY} SELECT relpath, 'dead' kind FROM inv WHERE hash NOT IN (SELECT hash FROM store) UNION ALL SELECT relpath, 'safe' FROM (SELECT *, min(relpath) OVER (PARTITION BY hash) m FROM inv WHERE hash IN (SELECT hash FROM store)) WHERE relpath <> m",
    "queue_pop": f"WITH {INVENTORY} SELECT relpath, doc_id pos FROM inv WHERE hash NOT IN (SELECT hash FROM store) ORDER BY pos LIMIT 25",
    "dedupe_keep_lowest": f"WITH {INVENTORY} SELECT hash, doc_id, kept FROM (SELECT *, min(doc_id) OVER (PARTITION BY hash) kept FROM inv) WHERE doc_id <> kept",
    "hash_agreement": "SELECT coalesce(korrespondent, '?') sender, count(*) n, CASE WHEN count(DISTINCT CASE WHEN text <> '' THEN md5(text) END) = 1 THEN 'same' ELSE 'different' END kind FROM documents GROUP BY 1 HAVING count(*) > 1",
    "mixed_provenance": "SELECT korrespondent FROM documents GROUP BY 1 HAVING bool_or(source = 'mail-bridge') AND bool_or(source <> 'mail-bridge')",
    "storage_buckets": "SELECT source, count(*) docs, count(*) FILTER (lang IS NULL) no_lang, count(*) FILTER (lang = 'de') german, count(*) FILTER (coalesce(trim(text), '') = '') AS void FROM documents GROUP BY 1",
    "status_counts": "SELECT dienst, count(*) FILTER (status = 'pending') pending, count(*) FILTER (status = 'approved') approved, count(*) FILTER (status = 'rejected') rejected FROM document_review_queue GROUP BY 1",
    "reason_audit": "SELECT regexp_replace(reason, '=.*$', '') reason, count(*) n, count(DISTINCT document_id) docs, count(*) FILTER (document_id < 1000) low FROM (SELECT document_id, unnest(grund) reason FROM document_review_queue) GROUP BY 1",
    "top_folders": "SELECT pfad, count(*) n FROM document_review_queue GROUP BY 1 ORDER BY n DESC, pfad NULLS LAST LIMIT 15",
    "hash_sets": f"WITH {INVENTORY} SELECT side, count(*) n FROM (SELECT DISTINCT hash, CASE WHEN hash IN (SELECT hash FROM store) THEN 'both' ELSE 'disk only' END side FROM inv) GROUP BY 1",
    "rehash_incremental": "SELECT lang IS DISTINCT FROM 'de' OR n_chars IS NULL OR added IS NULL AS to_hash, count(*) files FROM documents GROUP BY 1",
    "page_ranges": """WITH m AS (SELECT l_orderkey doc, l_linenumber page, min(l_returnflag) name FROM lineitem WHERE l_linenumber > 1 AND l_returnflag <> 'N' GROUP BY 1, 2),
p AS (SELECT doc, name, page, coalesce(lead(page) OVER w - 1, 9) AS last, lag(page) OVER w AS b FROM m WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT name, count(*) parts, sum(last - page + 1)::BIGINT n_pages FROM (SELECT name, page, last FROM p UNION ALL SELECT '(none)', 1, page - 1 FROM p WHERE b IS NULL AND page > 1) GROUP BY 1""",
}
