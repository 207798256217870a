"""Matching and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import dates as D
from letterloom.functions import text as X
from letterloom.functions.void import is_void
from letterloom.operators import matching as M

KINDS = ["uid", "email", "telefon"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "correspondents")
    parts = [c.select("name", F.lit(k).alias("kind"), F.explode(f"identifikatoren.{k}").alias("raw")) for k in KINDS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    key = F.when(F.col("kind") == "uid", X.uid_key(F.col("raw"))).when(F.col("kind") == "telefon", X.phone_key(F.col("raw"))).otherwise(F.lower(F.trim("raw")))
    return rows.select("name", "kind", key.alias("key")).where("key <> ''").distinct()


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers in letters: each document's sender's own, as the text of a letter head would have them."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("korrespondent").alias("name"))
    return docs.join(_identifiers(spark, d), "name").select("doc", "kind", "key")


def ident_match(spark: SparkSession, d: str) -> DataFrame:
    return M.by_identifier(_letters(spark, d), _identifiers(spark, d), KINDS)


def ident_fall_through(spark: SparkSession, d: str) -> DataFrame:
    return M.fall_through(_letters(spark, d), _identifiers(spark, d), KINDS)


def name_match(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "correspondents")
    entries = c.select(F.col("name"), F.col("corr_id").alias("pos"), F.explode(F.concat(F.array("name"), F.coalesce("match", F.array()))).alias("k")).select("name", "pos", X.name_key(F.col("k")).alias("key")).where("key <> ''").distinct()
    typed = _t(spark, d, "pending_correspondents").where("aktion <> 'neu'").select(F.col("pending_id").alias("id"), X.name_key(F.col("llm_raw")).alias("key")).where("key <> ''").distinct()
    return M.by_name(typed, entries)


def person_lookup(spark: SparkSession, d: str) -> DataFrame:
    persons = _t(spark, d, "brillenpaesse").select(F.lower(F.trim("person_id")).alias("person"), "anzeigename").groupBy("person").agg(F.max("anzeigename").alias("anzeigename"), F.count("*").alias("n"))
    wanted = _t(spark, d, "correspondents").select(F.explode("beziehungen").alias("b")).where(~is_void(F.col("b.person"))).select(F.lower(F.trim("b.person")).alias("person")).groupBy("person").agg(F.count("*").alias("relations"))
    return wanted.join(persons, "person", "left").select("person", "relations", F.coalesce("anzeigename", "person").alias("shown"))


def type_resolution(spark: SparkSession, d: str) -> DataFrame:
    types = _t(spark, d, "document_types")
    keys = types.select("name", F.lit(1).alias("tier"), F.lower(F.trim("name")).alias("key")).unionByName(types.select("name", F.lit(2).alias("tier"), F.explode("synonyme").alias("k")).select("name", "tier", F.lower(F.trim("k")).alias("key")))
    best = keys.groupBy("key").agg(F.min(F.struct("tier", "name")).alias("m")).select("key", "m.tier", "m.name")
    typed = _t(spark, d, "pending_correspondents").select("pending_id", F.lower(F.trim("vorgeschlagener_eintrag.default_dokumenttyp")).alias("key")).distinct()
    return typed.join(F.broadcast(best), "key", "left").select("pending_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("tier", F.lit(0)).alias("tier"))


def referential_check(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "documents").select("doc_id")
    queue = _t(spark, d, "document_review_queue").groupBy("document_id").agg(F.count("*").alias("rows"))
    pending = _t(spark, d, "pending_correspondents").select(F.explode("source_document_ids").alias("document_id")).groupBy("document_id").agg(F.count("*").alias("rows"))
    both = queue.withColumn("source", F.lit("queue")).unionByName(pending.withColumn("source", F.lit("pending")))
    return both.join(known, both["document_id"] == known["doc_id"], "left_anti").where("document_id is not null").groupBy("source").agg(F.count("*").alias("ids"), F.sum("rows").alias("rows"))


def merge_forbidden(spark: SparkSession, d: str) -> DataFrame:
    """Proposed merges (equal firm keys) without those that either sender forbids."""
    c = _t(spark, d, "correspondents").select("corr_id", "name", X.firm_key(F.col("name")).alias("key"), F.coalesce("nicht_verwechseln_mit", F.array()).alias("bad"))
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.corr_id") < F.col("b.corr_id")))
    ok = ~(F.array_contains("a.bad", F.col("b.name")) | F.array_contains("b.bad", F.col("a.name")))
    return pairs.where(F.coalesce(ok, F.lit(True))).select(F.col("a.corr_id").alias("id_a"), F.col("b.corr_id").alias("id_b"))


def folder_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 20."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.nearest(v.where("id % 20 = 0"), v, 5)


def folder_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the folder in question and of all others with its top level; how often each."""
    q = _t(spark, d, "document_review_queue").where("tags is not null and pfad is not null").select("pfad", F.substring_index("pfad", "/", 1).alias("top"), F.explode("tags").alias("tag"))
    own = q.groupBy("top", "pfad", "tag").agg(F.count("*").alias("n"))
    return own.groupBy("top", "tag").agg(F.sum("n").alias("n"), F.count("*").alias("folders"), F.max_by("pfad", F.struct("n", "pfad")).alias("most"))


def period_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one customer at most 21 days apart."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return M.within_days(o, ["o_custkey"], "day", "o_orderkey", 21)


def date_spellings(spark: SparkSession, d: str) -> DataFrame:
    """In how many spellings each order day could stand; and one of them in full."""
    days = _t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso")).distinct()
    s = D.spellings(F.col("iso"))
    return days.select("iso", F.size(s).alias("n"), F.array_join(s, " ").alias("all"))


def audit_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of each document in the queue, joined to the document."""
    last = _t(spark, d, "document_review_queue").groupBy("document_id").agg(F.max(F.struct("eingang", "queue_id", "status", "pfad")).alias("m"))
    docs = _t(spark, d, "documents").select("doc_id", "dokumenttyp")
    return docs.join(last, docs["doc_id"] == last["document_id"], "left").select("doc_id", "dokumenttyp", F.coalesce("m.queue_id", F.lit(0)).alias("queue_id"), "m.status", "m.pfad")


def enrich_types(spark: SparkSession, d: str) -> DataFrame:
    """Document counts by type with the type's attributes, defaults where the list has none."""
    n = _t(spark, d, "documents").groupBy(F.lower("dokumenttyp").alias("key")).agg(F.count("*").alias("n"))
    types = _t(spark, d, "document_types").select(F.lower("name").alias("key"), "name", F.size(F.coalesce("synonyme", F.array())).alias("synonyms"))
    return n.join(F.broadcast(types), "key", "left").select("key", "n", F.coalesce("name", F.lit("?")).alias("name"), F.coalesce("synonyms", F.lit(0)).alias("synonyms"))


QUERIES = {f.__name__: f for f in (ident_match, ident_fall_through, name_match, person_lookup, type_resolution, referential_check, merge_forbidden, folder_topk, folder_constraints, period_duplicates, date_spellings, audit_latest, enrich_types)}

_PHONE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\(0\)', '', 'g'), '[^0-9+]', '', 'g'), '^\+', ''), '^00', '')"
_IDS = f"""ids AS (SELECT DISTINCT name, kind, key FROM (SELECT name, kind, CASE kind WHEN 'uid' THEN regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g')[:12] WHEN 'telefon' THEN CASE WHEN starts_with({_PHONE}, '0') THEN '41' || substr({_PHONE}, 2) ELSE {_PHONE} END ELSE lower(trim(raw)) END AS key FROM (
  SELECT name, 'uid' kind, unnest(identifikatoren.uid) raw FROM correspondents UNION ALL SELECT name, 'email', unnest(identifikatoren.email) FROM correspondents UNION ALL SELECT name, 'telefon', unnest(identifikatoren.telefon) FROM correspondents)) WHERE key <> ''),
letters AS (SELECT d.doc_id AS doc, i.kind, i.key FROM documents d JOIN ids i ON d.korrespondent = i.name),
hits AS (SELECT l.doc, l.kind, list_position(['uid', 'email', 'telefon'], l.kind) r, min(i.name) AS name, count(DISTINCT i.name) n FROM letters l JOIN ids i ON l.kind = i.kind AND l.key = i.key GROUP BY 1, 2)"""


def _firm(c: str) -> str:
    from letterloom.plans.texts import _firm_sql

    return _firm_sql(c)


SQL = {
    "ident_match": f"WITH {_IDS} SELECT doc, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY r) k FROM hits) WHERE k = 1 AND n = 1",
    "ident_fall_through": f"WITH {_IDS} SELECT doc, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY r) k FROM hits WHERE n = 1) WHERE k = 1",
    "name_match": r"""WITH e AS (SELECT DISTINCT name, corr_id pos, trim(regexp_replace(lower(trim(k)), '[ \t\n\r]+', ' ', 'g')) AS key FROM (SELECT name, corr_id, unnest(list_concat([name], coalesce(match, []))) k FROM correspondents) WHERE trim(k) <> ''),
t AS (SELECT DISTINCT pending_id id, trim(regexp_replace(lower(trim(llm_raw)), '[ \t\n\r]+', ' ', 'g')) AS key FROM pending_correspondents WHERE aktion <> 'neu' AND trim(llm_raw) <> ''),
a AS (SELECT t.id, arg_min(e.name, e.pos) AS name, 1 tier FROM t JOIN e USING (key) GROUP BY 1),
b AS (SELECT t.id, e.name, row_number() OVER (PARTITION BY t.id ORDER BY least(length(t.key), length(e.key)) DESC, e.pos) r FROM t JOIN e ON contains(t.key, e.key) OR contains(e.key, t.key) WHERE length(t.key) >= 3 AND length(e.key) >= 3 AND t.id NOT IN (SELECT id FROM a))
SELECT id, name, tier FROM a UNION ALL SELECT id, name, 2 FROM b WHERE r = 1""",
    "person_lookup": "WITH p AS (SELECT lower(trim(person_id)) person, max(anzeigename) anzeigename FROM brillenpaesse GROUP BY 1), w AS (SELECT lower(trim(b.person)) person, count(*) relations FROM (SELECT unnest(beziehungen) b FROM correspondents) WHERE lower(trim(b.person)) NOT IN ('', 'null', 'none', 'n/a', '-', '–', '—') GROUP BY 1) SELECT w.person, relations, coalesce(anzeigename, w.person) shown FROM w LEFT JOIN p USING (person)",
    "type_resolution": "WITH k AS (SELECT lower(trim(name)) AS key, 1 tier, name FROM document_types UNION ALL SELECT lower(trim(s)), 2, name FROM (SELECT name, unnest(synonyme) s FROM document_types)), b AS (SELECT key, tier, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, name) r FROM k) WHERE r = 1), t AS (SELECT DISTINCT pending_id, lower(trim(vorgeschlagener_eintrag.default_dokumenttyp)) AS key FROM pending_correspondents) SELECT pending_id, coalesce(name, '') AS name, coalesce(tier, 0) tier FROM t LEFT JOIN b USING (key)",
    "referential_check": "WITH r AS (SELECT 'queue' source, document_id FROM document_review_queue UNION ALL SELECT 'pending', unnest(source_document_ids) FROM pending_correspondents) SELECT source, count(DISTINCT document_id) ids, count(*)::BIGINT AS rows FROM r WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT doc_id FROM documents) GROUP BY 1",
    "merge_forbidden": f"WITH c AS (SELECT corr_id, name, {_firm('name')} AS key, coalesce(nicht_verwechseln_mit, []) bad FROM correspondents) SELECT a.corr_id id_a, b.corr_id id_b FROM c a JOIN c b ON a.key = b.key AND a.corr_id < b.corr_id WHERE NOT coalesce(list_contains(a.bad, b.name) OR list_contains(b.bad, a.name), false)",
    "folder_topk": "WITH q AS (SELECT a.vec_id AS query, b.vec_id AS target, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM q) WHERE rank <= 5",
    "folder_constraints": "WITH q AS (SELECT pfad, split_part(pfad, '/', 1) top, unnest(tags) tag FROM document_review_queue WHERE tags IS NOT NULL AND pfad IS NOT NULL), o AS (SELECT top, pfad, tag, count(*) n FROM q GROUP BY ALL) SELECT top, tag, sum(n)::BIGINT n, count(*) folders, arg_max(pfad, (n, pfad)) most FROM o GROUP BY 1, 2",
    "period_duplicates": "WITH o AS (SELECT o_custkey, o_orderkey k, o_orderdate::DATE d FROM orders) SELECT a.o_custkey, a.k id_a, b.k id_b FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.k < b.k AND abs(date_diff('day', a.d, b.d)) <= 21",
    "date_spellings": "WITH d AS (SELECT DISTINCT o_orderdate::DATE t FROM orders), x AS (SELECT strftime(t, '%Y-%m-%d') iso, [strftime(t, '%Y-%m-%d'), strftime(t, '%d.%m.%Y'), strftime(t, '%-d.%-m.%Y'), strftime(t, '%d.%m.%y'), strftime(t, '%d/%m/%Y'), strftime(t, '%d-%m-%Y'), strftime(t, '%Y%m%d')] s FROM d) SELECT iso, len(list_distinct(s))::INTEGER n, array_to_string(list_filter(s, lambda v, i: list_position(s, v) = i), ' ') AS \"all\" FROM x",
    "audit_latest": "WITH l AS (SELECT document_id, arg_max((queue_id, status, pfad), (eingang, queue_id)) m FROM document_review_queue GROUP BY 1) SELECT doc_id, dokumenttyp, coalesce(m[1], 0) queue_id, m[2] status, m[3] pfad FROM documents LEFT JOIN l ON doc_id = document_id",
    "enrich_types": "WITH n AS (SELECT lower(dokumenttyp) AS key, count(*) n FROM documents GROUP BY 1) SELECT n.key, n, coalesce(name, '?') AS name, coalesce(len(synonyme), 0)::INTEGER synonyms FROM n LEFT JOIN document_types t ON n.key = lower(t.name)",
}
