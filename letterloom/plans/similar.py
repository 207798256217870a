"""Similarity joins over names and values read from running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import text as X

#: Least score of a match, of 100.
LEAST = 60


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """The sender most like each new name: edit distance of the firm keys over the longer length, in percent.

    Distinct keys only, so that a name typed very often is scored once. Two keys of a score of 60 or more whose lengths
    differ by at most two thirds share a piece of three letters in most cases but not in all; so the short list of
    senders is compared as a whole, against each distinct key.
    """
    senders = _t(spark, d, "correspondents").select("corr_id", X.firm_key(F.col("name")).alias("b")).where("b <> ''")
    typed = _t(spark, d, "pending_correspondents").where("aktion = 'neu'").select(X.firm_key(F.col("llm_raw")).alias("a")).where("a <> ''").distinct()
    longer = F.greatest(F.length("a"), F.length("b"))
    near = typed.join(senders, F.abs(F.length("a") - F.length("b")) * 100 <= longer * (100 - LEAST))
    score = F.round(100.0 * (1 - F.levenshtein("a", "b") / longer), 4)
    best = near.withColumn("score", score).where(F.col("score") >= LEAST).groupBy("a").agg(F.max(F.struct("score", (-F.col("corr_id")).alias("order"))).alias("m"))
    return best.select("a", (-F.col("m.order")).alias("corr_id"), "m.score")


def refraction_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of both eyes that letters name in a sentence."""
    number = r"([+-]?[0-9]{1,2}[.,][0-9]{2})"
    docs = _t(spark, d, "documents").select("doc_id", "text").where(F.contains("text", F.lit("rechts")))
    right, left = F.regexp_extract("text", "rechts " + number, 1), F.regexp_extract("text", "links " + number, 1)
    value = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    rows = docs.select("doc_id", value(right).alias("right_eye"), value(left).alias("left_eye")).where("right_eye is not null and left_eye is not null")
    return rows.withColumn("odd", (F.abs(F.col("right_eye") * 4 - F.round(F.col("right_eye") * 4)) > 0.01) | (F.col("right_eye") * F.col("left_eye") < 0))


def reference_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Relations of senders whose reference number stands in a letter of that sender."""
    rel = _t(spark, d, "correspondents").select(F.col("name").alias("korrespondent"), F.posexplode("beziehungen").alias("pos", "b")).where("length(trim(b.referenznummer)) >= 4").select("korrespondent", "pos", X.reference_key(F.col("b.referenznummer")).alias("ref"))
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "korrespondent", X.reference_key(F.col("text")).alias("t"))
    hits = docs.join(F.broadcast(rel), "korrespondent").where(F.contains("t", "ref")).groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("pos").alias("pos"))
    return hits.where("hits = 1").select("doc_id", "pos")


def note_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """How many identifiers of each kind the senders' notes hold."""
    n = F.coalesce("notiz", F.lit(""))
    c = _t(spark, d, "correspondents")
    return c.select(F.sum(F.size(X.emails(n))).alias("emails"), F.sum(F.size(X.phones(n))).alias("phones"), F.sum(F.size(X.uids(n))).alias("uids"), F.count_if(X.ahv_key(n).isNotNull()).alias("numbers"))


QUERIES = {f.__name__: f for f in (fuzzy_match, refraction_values, reference_numbers, note_identifiers)}


def _sql() -> dict[str, str]:
    from letterloom.plans.texts import _firm_sql, _phone_sql

    ref = r"regexp_replace(lower({c}), '[ \t\n\r_.-]', '', 'g')"
    phone = r"(?:\+41|0041)[ ]?(?:\(0\))?[ -]?[0-9]{2}(?:[ .-]?[0-9]){7}|\(?0[0-9]{2}\)?[ /-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}"
    return {
        "fuzzy_match": f"WITH s AS (SELECT corr_id, {_firm_sql('name')} b FROM correspondents), t AS (SELECT DISTINCT {_firm_sql('llm_raw')} a FROM pending_correspondents WHERE aktion = 'neu'), x AS (SELECT a, corr_id, round(100.0 * (1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))), 4) score FROM t JOIN s ON abs(length(a) - length(b)) * 100 <= greatest(length(a), length(b)) * {100 - LEAST} WHERE a <> '' AND b <> '') SELECT a, corr_id, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, corr_id) r FROM x WHERE score >= {LEAST}) WHERE r = 1",
        "refraction_values": r"SELECT doc_id, r AS right_eye, l AS left_eye, abs(r * 4 - round(r * 4)) > 0.01 OR r * l < 0 AS odd FROM (SELECT doc_id, TRY_CAST(replace(regexp_extract(text, 'rechts ([+-]?[0-9]{1,2}[.,][0-9]{2})', 1), ',', '.') AS DOUBLE) r, TRY_CAST(replace(regexp_extract(text, 'links ([+-]?[0-9]{1,2}[.,][0-9]{2})', 1), ',', '.') AS DOUBLE) l FROM documents) WHERE r IS NOT NULL AND l IS NOT NULL",
        "reference_numbers": f"WITH r AS (SELECT name, pos, {ref.format(c='b.referenznummer')} ref FROM (SELECT name, unnest(beziehungen) b, (generate_subscripts(beziehungen, 1) - 1)::INTEGER pos FROM correspondents) WHERE length(trim(b.referenznummer)) >= 4) SELECT doc_id, min(pos) pos FROM documents d JOIN r ON d.korrespondent = r.name AND contains({ref.format(c='d.text')}, r.ref) GROUP BY 1 HAVING count(*) = 1",
        "note_identifiers": r"SELECT sum(len(list_distinct(list_transform(regexp_extract_all(coalesce(notiz, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)))))::BIGINT emails, sum(len(list_distinct(list_transform(regexp_extract_all(coalesce(notiz, ''), '" + phone + r"'), lambda t: " + _phone_sql("t") + r"))))::BIGINT phones, sum(len(list_distinct(regexp_extract_all(coalesce(notiz, ''), 'CHE[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}'))))::BIGINT uids, count(*) FILTER (length(regexp_replace(notiz, '[^0-9]', '', 'g')) = 13 AND starts_with(regexp_replace(notiz, '[^0-9]', '', 'g'), '756')) numbers FROM correspondents",
    }


SQL = _sql()
