"""Queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.void import is_void
from letterloom.llm import canonical, packing, pii, scans, spans, tokenizer, variants
from letterloom.runtime import written

CAPACITY = 2048


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and token ids of every text."""
    return tokenizer.encode_column(_documents(spark, d).select("doc_id", "text"), "text")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenizer.encode_column(_documents(spark, d).select("doc_id", "text"), "text", counts_only=True)
    return written(sizes, "token-sizes")


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container of every text (of every piece of a text that exceeds the capacity)."""
    return packing.pack(_sizes(spark, d), "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and tokens by tenth of the capacity that is used."""
    used = p9_packing(spark, d).groupBy("behaelter").agg(F.sum("laenge").alias("n"))
    return used.groupBy(F.floor(F.col("n") * 10 / CAPACITY).cast("int").alias("zehntel")).agg(F.count("*").alias("behaelter"), F.sum("n").alias("tokens"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a verbatim span of at least 400 characters."""
    return spans.shared_spans(_documents(spark, d), "doc_id", "text")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of at least 400 characters of each document that stand in another one, and where."""
    return spans.spans_elsewhere(_documents(spark, d), "doc_id", "text").select(F.col("doc").alias("doc_id"), "von", "bis", "dort", "dort_von")


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document in such spans, whichever of the documents is the earlier one, and their share."""
    docs = _documents(spark, d)
    there = spans.covered(spans.spans_elsewhere(docs, "doc_id", "text"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    every = docs.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("zeichen"))
    return every.join(there, F.col("doc_id") == F.col("doc"), "left").select("doc_id", n.alias("anderswo"), F.when(F.col("zeichen") > 0, F.round(n / F.col("zeichen"), 6)).otherwise(F.lit(0.0)).alias("anteil"))


def p10_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document in lines that stand earlier elsewhere, and their share."""
    docs = _documents(spark, d)
    gone = spans.removed_lines(docs, "doc_id", "text").groupBy("doc").agg(F.sum(F.col("bis") - F.col("von")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return docs.select("doc_id", F.char_length("text").alias("zeichen")).join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", n.cast("long").alias("anderswo"), F.when(F.col("zeichen") > 0, F.round(n / F.col("zeichen"), 6)).otherwise(F.lit(0.0)).alias("anteil"))


def _senders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/correspondents.parquet")


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pending_correspondents.parquet")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/schulbericht_vision.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken and misread words, running heads and page numbers of the school reports."""
    rows = scans.pages(_reports(spark, d), "document_id", ["volltext"], ["handschrift_zeilen"])
    return scans.repairs(rows).select(F.col("doc").alias("document_id"), "feld", "art", "wert").distinct()


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """The school reports as continuous paragraphs."""
    rows = scans.pages(_reports(spark, d), "document_id", ["volltext"], ["handschrift_zeilen"])
    found = written(scans.repairs(rows), "scan-cases")
    return scans.reflow(rows, found).select(F.col("doc").alias("document_id"), "feld", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry that each typed sender and each typed document type means, '' for none."""
    pending = _pending(spark, d).where(F.col("pending_id").isNotNull())
    senders = _senders(spark, d).select(F.col("corr_id").alias("pos"), "name", F.col("kuerzel").alias("kurz"), F.concat(F.coalesce("varianten", F.array()), F.coalesce("match", F.array())).alias("formen"))
    types = spark.read.parquet(f"{d}/document_types.parquet").select(F.col("name").alias("pos"), "name", F.lit(None).cast("string").alias("kurz"), F.col("synonyme").alias("formen"))
    typed = pending.where(F.coalesce(F.col("aktion") != "neu", F.lit(True))).select("pending_id", F.lit("llm_raw").alias("feld"), F.col("llm_raw").alias("wert"))
    kind = F.col("vorgeschlagener_eintrag.default_dokumenttyp")
    kinds = pending.where(~is_void(kind)).select("pending_id", F.lit("default_dokumenttyp").alias("feld"), kind.alias("wert"))
    found = canonical.match_values(typed, senders, canonical.NameMatcher).unionByName(canonical.match_values(kinds, types, canonical.TermMatcher))
    return found.select("pending_id", "feld", "ziel").distinct()


def p4_misses(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean no entry, by how often they occur."""
    found = p4_found(spark, d).where("ziel = ''").select("pending_id", "feld")
    rows = _pending(spark, d).select("pending_id", F.explode(F.array(F.struct(F.lit("llm_raw").alias("feld"), F.col("llm_raw").alias("wert")), F.struct(F.lit("default_dokumenttyp").alias("feld"), F.col("vorgeschlagener_eintrag.default_dokumenttyp").alias("wert")))).alias("x")).select("pending_id", "x.*").distinct()
    return rows.join(found, ["pending_id", "feld"]).groupBy("feld", "wert").agg(F.count("*").alias("n"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    reports = pii.personal_data(_reports(spark, d), "document_id", "volltext").withColumn("quelle", F.lit("schulbericht_vision"))
    return reports.unionByName(pii.personal_data(_senders(spark, d), "corr_id", "notiz").withColumn("quelle", F.lit("correspondents")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses, phone and insurance numbers, street addresses and names in reports and notes."""
    return _personal(spark, d).select("quelle", F.col("id").alias("satz_id"), F.explode("funde").alias("x")).select("quelle", "satz_id", "x.art", "x.fund").where("satz_id is not null").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with typed placeholders in place of the personal data."""
    return _personal(spark, d).select("quelle", F.col("id").alias("satz_id"), "maskiert").distinct()


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group of each sender and of each new sender's row."""
    none = F.array().cast("array<string>")
    senders = _senders(spark, d).select(F.lit("correspondents").alias("quelle"), F.col("corr_id").alias("id"), "name", F.coalesce("varianten", none).alias("others"))
    new = _pending(spark, d).where("aktion = 'neu'").select(F.lit("pending_correspondents").alias("quelle"), F.col("pending_id").alias("id"), F.col("llm_raw").alias("name"), none.alias("others"))
    return variants.link(senders.unionByName(new).where("id is not null"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows that mean the same sender."""
    return variants.linked_pairs(p7_groups(spark, d))


QUERIES = {
    "p2_found": p2_found,
    "p2_text": p2_text,
    "p4_found": p4_found,
    "p4_misses": p4_misses,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_packing": p9_packing,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_spans": p10_spans,
    "p10_share": p10_share,
    "p10_elsewhere": p10_elsewhere,
}

SQL: dict[str, str] = {
    "p10_elsewhere": r"""
WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
norm AS (SELECT doc_id, pos, length(line) AS n, trim(regexp_replace(lower(line), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+', ' ', 'g')) AS k FROM parts),
ranked AS (SELECT doc_id, n, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM norm WHERE k <> ''),
gone AS (SELECT doc_id, sum(n) AS n FROM ranked WHERE r > 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0)::BIGINT AS anderswo,
       CASE WHEN length(d.text) > 0 THEN round(coalesce(g.n, 0)::DOUBLE / length(d.text), 6) ELSE 0.0 END AS anteil
FROM documents d LEFT JOIN gone g USING (doc_id)
""",
}
