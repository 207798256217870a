"""Normalisation and extraction queries over senders, the queue and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import text as X
from letterloom.functions.void import is_void

STOP = ("und", "der", "die", "das", "in", "im", "von", "für", "ag", "gmbh", "co", "sa", "sàrl")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(c):  # noqa: ANN001, ANN202
    return F.array_join(F.sort_array(c), "|")


_MARKED = f"'{X.MARKED}', '{X.UNMARKED}'"


def _firm_sql(c: str) -> str:
    t = f"replace(replace(replace(replace(translate(lower(trim({c})), {_MARKED}), 'ue', 'u'), 'ae', 'a'), 'oe', 'o'), '-', ' ')"
    for e in X.FIRM_ENDINGS:
        t = f"regexp_replace({t}, ' +{e.replace('.', chr(92) + '.')}$', '')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def _phone_sql(c: str) -> str:
    d = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\(0\\)', '', 'g'), '[^0-9+]', '', 'g'), '^\\+', ''), '^00', '')"
    return f"CASE WHEN starts_with({d}, '0') THEN '41' || substr({d}, 2) ELSE {d} END"


QUERIES = {
    "norm_names": lambda s, d: _t(s, d, "correspondents").select("corr_id", X.name_key(F.col("name")).alias("key")),
    "norm_firms": lambda s, d: _t(s, d, "correspondents").select("corr_id", X.firm_key(F.col("name")).alias("key")),
    "norm_uids": lambda s, d: _t(s, d, "correspondents").select("corr_id", F.explode("identifikatoren.uid").alias("uid")).select("corr_id", X.uid_key(F.col("uid")).alias("key")),
    "norm_phones": lambda s, d: _t(s, d, "correspondents").select("corr_id", F.explode("identifikatoren.telefon").alias("t")).select("corr_id", X.phone_key(F.col("t")).alias("key")),
    "norm_references": lambda s, d: _t(s, d, "correspondents").select("corr_id", F.explode("beziehungen").alias("b")).where("b is not null").select("corr_id", X.reference_key(F.col("b.referenznummer")).alias("key")),
    "null_values": lambda s, d: _t(s, d, "schulbericht_vision").select("document_id", "erfasst", F.when(~is_void(F.col("quality_note")), F.trim("quality_note")).alias("note")),
    "slugs": lambda s, d: _t(s, d, "document_review_queue").select("queue_id", X.slug(F.col("title")).alias("slug")),
    "file_titles": lambda s, d: _t(s, d, "document_review_queue").select("queue_id", X.title(F.col("title"), F.date_format("eingang", "yyyy-MM"), F.upper(F.left("dienst", F.lit(4)))).alias("name")),
    "amounts": lambda s, d: _t(s, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?:CHF|Fr\.) ?([0-9'’.,]*[0-9])"), F.lit(1))).alias("pos", "t")).select("doc_id", "pos", X.amount(F.col("t")).alias("amount")),
    "email_extract": lambda s, d: _t(s, d, "correspondents").select("corr_id", _joined(X.emails(F.col("notiz"))).alias("emails")).where("emails <> ''"),
    "phone_extract": lambda s, d: _t(s, d, "correspondents").select("corr_id", _joined(X.phones(F.col("notiz"))).alias("phones")).where("phones <> ''"),
    "uid_extract": lambda s, d: _t(s, d, "correspondents").select("corr_id", _joined(X.uids(F.concat_ws(" / ", "notiz", F.array_join(F.coalesce("identifikatoren.uid", F.array().cast("array<string>")), " / ")))).alias("uids")).where("uids <> ''"),
    "token_overlap": lambda s, d: _t(s, d, "correspondents").select("corr_id", F.round(X.token_overlap(F.col("name"), F.array_join(F.coalesce("match", F.array().cast("array<string>")), " "), STOP), 6).alias("overlap")),
    "text_window": lambda s, d: _t(s, d, "documents").select("doc_id", F.instr("text", "Nummer").alias("at"), "text").where("at > 0").select("doc_id", F.md5(F.substring("text", F.greatest(F.lit(1), F.col("at") - 40), F.lit(120))).alias("window")),
    "excluded_types": lambda s, d: _t(s, d, "documents").join(F.broadcast(_t(s, d, "document_types").select(F.col("name").alias("dokumenttyp"), "ausschliessen")), "dokumenttyp").where(F.exists("ausschliessen", lambda k: (F.length(F.trim(k)) > 0) & F.contains(F.lower("text"), F.lower(F.trim(k))))).select("doc_id", "dokumenttyp"),
    "path_markers": lambda s, d: _t(s, d, "document_review_queue").groupBy(F.lower(F.col("pfad")).rlike("familie|haus").alias("home"), F.substring_index("pfad", "/", -1).alias("leaf")).agg(F.count("*").alias("n")),
}

SQL = {
    "norm_names": r"SELECT corr_id, trim(regexp_replace(lower(trim(name)), '[ \t\n\r]+', ' ', 'g')) AS key FROM correspondents",
    "norm_firms": f"SELECT corr_id, {_firm_sql('name')} AS key FROM correspondents",
    "norm_uids": "SELECT corr_id, CASE WHEN starts_with(u, 'CHE') AND length(u) >= 12 THEN u[:12] ELSE u END AS key FROM (SELECT corr_id, regexp_replace(upper(unnest(identifikatoren.uid)), '[^A-Z0-9]', '', 'g') u FROM correspondents)",
    "norm_phones": f"SELECT corr_id, {_phone_sql('t')} AS key FROM (SELECT corr_id, unnest(identifikatoren.telefon) t FROM correspondents)",
    "norm_references": r"SELECT corr_id, regexp_replace(lower(b.referenznummer), '[ \t\n\r_.-]', '', 'g') AS key FROM (SELECT corr_id, unnest(beziehungen) b FROM correspondents) WHERE b IS NOT NULL",
    "null_values": "SELECT document_id, erfasst, CASE WHEN lower(trim(quality_note)) NOT IN ('', 'null', 'none', 'n/a', '-', '–', '—') THEN trim(quality_note) END AS note FROM schulbericht_vision",
    "slugs": f"SELECT queue_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(translate(title, {_MARKED})), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '^-+|-+$', '', 'g')[:60], '-+$', '') AS slug FROM document_review_queue",
    "file_titles": r"SELECT queue_id, concat_ws('_', regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '[ /\\:]+', '_', 'g'), '[^A-Za-z0-9äöüÄÖÜ_.-]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), strftime(eingang, '%Y-%m'), upper(dienst[:4]))[:128] AS name FROM document_review_queue",
    "amounts": r"SELECT doc_id, pos, CASE WHEN v <= 500000 THEN v END AS amount FROM (SELECT doc_id, pos, CASE WHEN regexp_full_match(t, '[0-9]+(\.[0-9]+)?') THEN t::DOUBLE END v FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER pos, regexp_replace(replace(regexp_replace(unnest(l), '[''’ ]', '', 'g'), ',', '.'), '[^0-9.]', '', 'g') t FROM (SELECT doc_id, regexp_extract_all(text, '(?:CHF|Fr\.) ?([0-9''’.,]*[0-9])', 1) l FROM documents)))",
    "email_extract": r"SELECT corr_id, emails FROM (SELECT corr_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(notiz, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)))), '|') emails FROM correspondents) WHERE emails <> ''",
    "phone_extract": r"SELECT corr_id, string_agg(DISTINCT key, '|' ORDER BY key) phones FROM (SELECT corr_id, " + _phone_sql("t") + r" AS key FROM (SELECT corr_id, unnest(regexp_extract_all(notiz, '(?:\+41|0041)[ ]?(?:\(0\))?[ -]?[0-9]{2}(?:[ .-]?[0-9]){7}|\(?0[0-9]{2}\)?[ /-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}')) t FROM correspondents)) GROUP BY 1",
    "uid_extract": r"SELECT corr_id, string_agg(DISTINCT u[:12], '|' ORDER BY u[:12]) uids FROM (SELECT corr_id, regexp_replace(upper(unnest(regexp_extract_all(concat_ws(' / ', notiz, array_to_string(identifikatoren.uid, ' / ')), 'CHE[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}'))), '[^A-Z0-9]', '', 'g') u FROM correspondents) GROUP BY 1",
    "token_overlap": r"""WITH w AS (SELECT corr_id, list_filter(list_distinct(regexp_split_to_array(lower(name), '[^a-zäöüàéè]+')), lambda x: length(x) > 1 AND x NOT IN (""" + ", ".join(f"'{x}'" for x in STOP) + r""")) a, list_filter(list_distinct(regexp_split_to_array(lower(coalesce(array_to_string(match, ' '), '')), '[^a-zäöüàéè]+')), lambda x: length(x) > 1 AND x NOT IN (""" + ", ".join(f"'{x}'" for x in STOP) + r""")) b FROM correspondents)
SELECT corr_id, CASE WHEN greatest(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)), 6) ELSE 0.0 END AS overlap FROM w""",
    "text_window": "SELECT doc_id, md5(substr(text, greatest(1, instr(text, 'Nummer') - 40), 120)) AS \"window\" FROM documents WHERE instr(text, 'Nummer') > 0",
    "excluded_types": "SELECT DISTINCT doc_id, dokumenttyp FROM (SELECT doc_id, dokumenttyp, text, unnest(t.ausschliessen) k FROM documents d JOIN document_types t ON d.dokumenttyp = t.name) WHERE length(trim(k)) > 0 AND contains(lower(text), lower(trim(k)))",
    "path_markers": "SELECT regexp_matches(lower(pfad), 'familie|haus') home, split_part(pfad, '/', -1) leaf, count(*) n FROM document_review_queue GROUP BY 1, 2",
}
