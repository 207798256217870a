"""Queries p1, p3 and p6 over the household's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.void import is_void, trimmed
from letterloom.operators import history as H
from letterloom.operators import nested as N
from letterloom.operators.timestamps import normalised
from letterloom.plans import date_sql
from letterloom.runtime import written

SECTIONS, EYES = ("messung", "fern", "naehe"), ("rechts", "links")
EYE_FIELDS = ("sph", "cyl", "achse", "prisma", "basis", "add")
HOME = "Europe/Zurich"
#: Paths of versions in raw lines, whatever holds them.
VERSION = r"(^|\.)versionen(\[[0-9]+\]|\.[^.\[\]]+)$"


def _filled(rows: DataFrame, quelle: str) -> DataFrame:
    return rows.where("filled").select(F.lit(quelle).alias("quelle"), F.col("root").alias("satz_id"), "pfad")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Child objects with at least one value that is not void, of stores, raw store lines and senders."""
    eyes = [(s, e) for s in SECTIONS for e in EYES]
    stores = N.flatten(spark.read.parquet(f"{d}/brillenpaesse.parquet"), "satz_id", ["versionen"])
    senders = N.flatten(spark.read.parquet(f"{d}/correspondents.parquet"), "corr_id", ["extraktion_muster", "beziehungen"])
    raw = N.flatten_json(spark.read.parquet(f"{d}/brillenpass_roh.parquet").select("record_id", "zeile"), "record_id", "zeile", free_keys=("versionen",))
    parts = [_filled(N.struct_rows(stores["versionen[]"], eyes), "brillenpaesse")]
    parts += [_filled(senders[t].df, "correspondents") for t in ("extraktion_muster{}", "beziehungen[]")]
    # By path in the record and not by table: which table holds a version depends on the merged schema.
    for t in raw.values():
        versions = replace(t, df=t.df.where(F.col("pfad").rlike(VERSION)))
        parts.append(_filled(N.struct_rows(versions, eyes), "brillenpass_roh"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("satz_id").isNotNull()).distinct()


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows, filled rows and rows without a parent of each flat table of stores and senders."""
    parts = []
    for name, key, columns in (("brillenpaesse", "satz_id", ["versionen"]), ("correspondents", "corr_id", ["extraktion_muster", "beziehungen", "identifikatoren"])):
        df = spark.read.parquet(f"{d}/{name}.parquet")
        parts.append(_counted(N.flatten(df, key, columns), df.select(F.col(key).alias("root")), name))
    return parts[0].unionByName(parts[1])


def p1_raw_tables(spark: SparkSession, d: str) -> DataFrame:
    """The same of the tables that the merged schema of the raw lines gives."""
    df = spark.read.parquet(f"{d}/brillenpass_roh.parquet").select("record_id", "zeile")
    return _counted(N.flatten_json(df, "record_id", "zeile", free_keys=("versionen",)), df.select(F.col("record_id").alias("root")), "brillenpass_roh")


def _counted(tables: dict[str, N.Child], roots: DataFrame, quelle: str) -> DataFrame:
    """(quelle, tabelle, zeilen, gefuellt, ohne_eltern) of each table: a parent is a row of the parent's table or a record."""
    name = lambda t: F.lit(t).alias("tabelle")
    rows = keys = None
    for path, t in tables.items():
        own = t.df.select(name(path), name(t.parent).alias("eltern"), "sk", "parent_sk", "filled")
        rows = own if rows is None else rows.unionByName(own)
        up = tables[t.parent].df.select(name(t.parent).alias("eltern"), F.col("sk").alias("parent_sk")) if t.parent else roots.select(F.lit("").alias("eltern"), F.xxhash64("root").alias("parent_sk"))
        keys = up if keys is None else keys.unionByName(up)
    known = keys.distinct().withColumn("da", F.lit(True))
    joined = rows.join(known, ["eltern", "parent_sk"], "left")
    return joined.groupBy(F.lit(quelle).alias("quelle"), "tabelle").agg(F.count("*").alias("zeilen"), F.count_if("filled").alias("gefuellt"), F.count_if(F.col("da").isNull()).alias("ohne_eltern"))


def _number(c: Column) -> Column:
    """A measured value as canonical text: numbers by value, void as '', other words trimmed and lower."""
    plain = F.regexp_replace(F.translate(F.lower(trimmed(c)), "−–,", "--."), r"\s|dpt\.?|°", "")
    number = plain.try_cast("double")
    return F.when(is_void(c), F.lit("")).when(number.isNotNull(), (number + F.lit(0.0)).cast("string")).otherwise(plain)


def prescriptions(spark: SparkSession, d: str) -> DataFrame:
    """person_id, tag, the canonical eye values (in the order of VALUES), with stand, satz_id and ordinal of the version."""
    rows = spark.read.parquet(f"{d}/brillenpaesse.parquet").select(F.lower(trimmed(F.col("person_id"))).alias("person_id"), "stand", "satz_id", F.posexplode("versionen").alias("ordinal", "v"))
    # One array and one lambda: written out for each value the code would be too large to compile.
    values = F.transform(F.array(*(F.col(f"v.{s}.{e}.{f}") for s, e, f in VALUES)), _number)
    rows = rows.where(F.col("person_id").isNotNull()).select("person_id", "stand", "satz_id", "ordinal", F.col("v.gueltig_ab").alias("text"), values.alias("werte"))
    return rows.withColumn("tag", normalised(F.col("text"), F.lit(HOME))["day"]).where(F.col("tag").isNotNull()).drop("text")


VALUES = [(s, e, f) for s in ("fern", "naehe") for e in EYES for f in EYE_FIELDS]
RANK = ["stand", "ordinal", "satz_id"]


def person_history(spark: SparkSession, d: str) -> DataFrame:
    dated = H.latest_per_date(prescriptions(spark, d), ["person_id"], "tag", ["werte"], [*map(F.col, RANK)])
    return H.history(dated, ["person_id"], "tag", ["werte"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The periods of each person's prescription."""
    return person_history(spark, d).select("person_id", "von", F.coalesce("bis", F.lit("")).alias("bis"))


def p3_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same history, built by merging the newer half of the snapshots into that of the older half."""
    rows = prescriptions(spark, d)
    rank = [*map(F.col, RANK)]
    middle = F.lit("2020-01-01").cast("timestamp_ntz")
    keys = ["person_id"]
    dated = written(H.latest_per_date(rows.where(F.col("stand") < middle), keys, "tag", ["werte", *RANK], rank), "dated-prescriptions")
    old = H.history(dated, keys, "tag", ["werte"])
    new = H.latest_per_date(rows.where(~(F.col("stand") < middle) | F.col("stand").isNull()), keys, "tag", ["werte", *RANK], rank)
    return H.merge(old, dated, new, keys, "tag", ["werte"], RANK).select("person_id", "von", F.coalesce("bis", F.lit("")).alias("bis"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every date and instant in one form."""
    queue = spark.read.parquet(f"{d}/document_review_queue.parquet")
    zone = F.when(F.col("dienst") == "paper_manager", F.lit("UTC")).otherwise(F.lit(HOME))
    fields = F.array(F.struct(F.lit("datum").alias("feld"), F.col("datum").alias("text"), F.lit(HOME).alias("zone")), F.struct(F.lit("ts").alias("feld"), F.col("ts").alias("text"), zone.alias("zone")))
    queue = queue.select(F.col("queue_id").alias("satz_id"), F.explode(fields).alias("x")).select(F.lit("document_review_queue").alias("quelle"), "satz_id", "x.*")
    stores = spark.read.parquet(f"{d}/brillenpaesse.parquet").select("satz_id", F.posexplode("versionen.gueltig_ab").alias("i", "text"))
    stores = stores.select(F.lit("brillenpaesse").alias("quelle"), "satz_id", F.concat(F.lit("versionen["), F.col("i").cast("string"), F.lit("].gueltig_ab")).alias("feld"), "text", F.lit(HOME).alias("zone"))
    rows = queue.unionByName(stores).where(F.col("text").isNotNull() & F.col("satz_id").isNotNull())
    rows = rows.withColumn("n", normalised(F.col("text"), F.col("zone")))
    return rows.select("quelle", "satz_id", "feld", F.when(F.col("feld") == "ts", F.col("n.utc")).otherwise(F.col("n.day")).alias("normal")).where(F.col("normal").isNotNull()).distinct()


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p1_raw_tables": p1_raw_tables, "p3_found": p3_found, "p3_merge": p3_merge, "p6_found": p6_found}

_VOID = "('', 'null', 'none', 'n/a', '-', '–', '—')"
_EYE = " OR ".join(f"lower(trim(coalesce(e.{f}, ''))) NOT IN {_VOID}" for f in EYE_FIELDS)


def _any(column: str) -> str:
    return f"len(list_filter(coalesce({column}, []), lambda x: lower(trim(coalesce(x, ''))) NOT IN {_VOID})) > 0"


def _filled_sql(column: str) -> str:
    return f"lower(trim(coalesce({column}, ''))) NOT IN {_VOID}"


_MUSTER = " OR ".join([_filled_sql("m.value.regex"), _any("m.value.label_hints"), _filled_sql("m.value.beispiel"), "m.value.custom_field_id IS NOT NULL"])
_BEZIEHUNG = " OR ".join([*(_filled_sql(f"b.{f}") for f in ("person", "bezeichnung", "referenznummer", "ordner")), *(_any(f"b.{f}") for f in ("erlaubte_doctypen", "stichworte", "fix_tags"))])
_VERSION = " OR ".join([*(_filled_sql(f"v.{f}") for f in ("id", "gueltig_ab", "korrespondent", "auftrag", "pd", "bemerkung", "glas.beschreibung", "glas.index", "extraktion.quelle", "extraktion.confidence")), "v.document_id IS NOT NULL", "len(list_filter(v.document_ids, lambda x: x IS NOT NULL)) > 0", _any("v.glas.beschichtungen"), *(_filled_sql(f"v.{s}.{e}.{f}") for s in SECTIONS for e in EYES for f in EYE_FIELDS)])
SQL = {
    "p1_tables": f"""SELECT 'brillenpaesse' quelle, 'versionen[]' tabelle, count(*) zeilen, count(*) FILTER ({_VERSION}) gefuellt, 0::BIGINT ohne_eltern FROM (SELECT unnest(versionen) v FROM brillenpaesse)
UNION ALL SELECT 'correspondents', 'extraktion_muster{{}}', count(*), count(*) FILTER ({_MUSTER}), 0 FROM (SELECT unnest(map_entries(extraktion_muster)) m FROM correspondents)
UNION ALL SELECT 'correspondents', 'beziehungen[]', count(*), count(*) FILTER ({_BEZIEHUNG}), 0 FROM (SELECT unnest(beziehungen) b FROM correspondents)""",
    "p1_found": f"""WITH v AS (SELECT satz_id, unnest(versionen) v, generate_subscripts(versionen, 1) - 1 i FROM brillenpaesse),
eyes AS ({" UNION ALL ".join(f"SELECT satz_id, 'versionen[' || i || '].{a}.{b}' pfad, v.{a}.{b} e FROM v" for a in SECTIONS for b in EYES)}),
raw AS (SELECT DISTINCT record_id, zeile FROM brillenpass_roh WHERE json_valid(zeile)),
tree AS (SELECT record_id, replace(substr(t.fullkey, 3), '"', '') k, t.type, t.atom FROM raw, json_tree(raw.zeile) t),
holders AS (SELECT record_id, k FROM tree WHERE type = 'OBJECT' AND regexp_matches(k, '(^|\\.)versionen(\\[[0-9]+\\]|\\.[^.]+)\\.(messung|fern|naehe)\\.(rechts|links)$')),
leaves AS (SELECT record_id, k FROM tree WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND lower(trim(json_extract_string(atom, '$'))) NOT IN {_VOID})
SELECT DISTINCT 'brillenpaesse' quelle, satz_id, pfad FROM eyes WHERE {_EYE}
UNION SELECT 'correspondents', corr_id, 'extraktion_muster.' || m.key FROM (SELECT corr_id, unnest(map_entries(extraktion_muster)) m FROM correspondents) WHERE {_MUSTER}
UNION SELECT 'correspondents', corr_id, 'beziehungen[' || i || ']' FROM (SELECT corr_id, unnest(beziehungen) b, generate_subscripts(beziehungen, 1) - 1 i FROM correspondents) WHERE {_BEZIEHUNG}
UNION SELECT 'brillenpass_roh', h.record_id, h.k FROM holders h JOIN leaves l ON h.record_id = l.record_id AND starts_with(l.k, h.k || '.')""",
    "p3_found": date_sql.P3,
    "p3_merge": date_sql.P3,
    "p6_found": date_sql.P6,
}
