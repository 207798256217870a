"""Extraction queries over letters made from orders: every value in a letter comes from the order's own columns, so the
SQL gives what must come out and not how it is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import dates as D
from letterloom.functions import identifiers as I
from letterloom.operators import documents as O
from letterloom.operators import matching as M

MONTHS = "Januar Februar März Apr Mai Juni Jul August September Oktober November Dezember"
_BASE = "(SELECT o_orderkey doc, o_custkey c, year(o_orderdate) y, month(o_orderdate) m, day(o_orderdate) d, o_orderkey % 7 k FROM {orders})"
_ACCOUNT = "concat(lpad(cast(98 - (((762000000000000 + c) % 97 * 27 + 121700) % 97) + CASE WHEN doc % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(3)), 2, '0'), '00762', lpad(cast(c AS VARCHAR(12)), 12, '0'))"
_GROUPED = "concat('CH', substr(a, 1, 2), ' ', substr(a, 3, 4), ' ', substr(a, 7, 4), ' ', substr(a, 11, 4), ' ', substr(a, 15, 4), ' ', substr(a, 19, 1))"
_TWO = "lpad(cast({0} AS VARCHAR(2)), 2, '0')"
_PHONE = "concat('44 ', lpad(cast(100 + c % 900 AS VARCHAR(3)), 3, '0'), ' ', lpad(cast(c % 90 + 10 AS VARCHAR(2)), 2, '0'), ' ', lpad(cast(doc % 90 + 10 AS VARCHAR(2)), 2, '0'))"
_DATE = f"""CASE k WHEN 0 THEN concat('Ort und Datum: Bern, ', d, '.', m, '.', y) WHEN 1 THEN concat('Erstellt am ', {_TWO.format('d')}, '.', {_TWO.format('m')}, '.', {_TWO.format('y % 100')})
WHEN 2 THEN concat('Basel, den ', d, '. ', split_part('{MONTHS}', ' ', cast(m AS INT)), ' ', y) WHEN 3 THEN concat('Datum Aarau ', d, '/', m, '/', y) WHEN 4 THEN concat('Aarau, den ', d, '.', m, '.', y)
WHEN 5 THEN concat('geboren am 3.4.1980', chr(10), 'Unterschrift ', d, '-', m, '-', y) ELSE 'ohne Angabe' END"""
_TEXT = f"""concat('Firma ', c, chr(10), 'Von: info', c % 50, '@firma', c % 50, '.example', chr(10), 'An: haus', c % 3, '@familie.example', chr(10), {_DATE}, chr(10),
CASE WHEN doc % 3 = 0 THEN concat('IBAN ', {_GROUPED}) WHEN doc % 3 = 1 THEN concat('Konto CH', a) ELSE 'Konto folgt' END, chr(10), 'Telefon: ', CASE WHEN doc % 2 = 0 THEN '+41 (0)' ELSE '0' END, {_PHONE}, chr(10),
CASE WHEN doc % 4 = 0 THEN 'BIC: abcdch22' WHEN doc % 4 = 1 THEN 'Bank ABCDCH2A80X Filiale' ELSE 'bar' END, chr(10), 'noreply@firma.example', chr(10), 'Kontrolle ZH ', c, CASE WHEN doc % 6 = 0 THEN concat(chr(10), 'bez. ', d, '.', m, '.', {_TWO.format('y % 100')}) ELSE '' END)"""
LETTERS = f"SELECT *, {_TEXT} AS text FROM (SELECT *, {_ACCOUNT} AS a FROM {_BASE})"
_ISO = f"concat(y, '-', {_TWO.format('m')}, '-', {_TWO.format('d')})"
_SLIP = f"""SELECT doc, concat('SPC', chr(10), '0200', chr(10), '1', chr(10), 'CH', a, chr(10), 'S', chr(10), 'Firma ', c, repeat(chr(10), 13), cast(c AS VARCHAR(12)), '.50', chr(10), 'CHF', chr(10), 'S', chr(10), 'Haus', repeat(chr(10), 6),
CASE WHEN doc % 2 = 0 THEN 'QRR' WHEN doc % 3 = 0 THEN 'SCOR' ELSE 'NON' END, chr(10), CASE WHEN doc % 2 = 0 THEN lpad(cast(doc AS VARCHAR(27)), 27, '0') ELSE concat('RF', doc) END, chr(10), 'Rechnung ', doc, chr(10), 'EPD', chr(10), 'AV1:UV;', {_ISO}) AS text FROM (SELECT *, {_ACCOUNT} AS a FROM {_BASE})"""


def _letters(spark: SparkSession, d: str, sql: str = LETTERS) -> DataFrame:
    return spark.sql(sql.format(orders=f"parquet.`{d}/orders.parquet`"))


def _sql(sql: str) -> str:
    return sql.format(orders="orders")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _none() -> Column:
    return F.array().cast("array<string>")


def issue_dates(spark: SparkSession, d: str) -> DataFrame:
    """Day of issue of each letter with the signal it was found by; birth dates don't count."""
    x = D.issue_date(F.col("text"), F.array(F.lit("1980-04-03")))
    return _letters(spark, d).select("doc", x.alias("x")).select("doc", "x.iso", "x.signal")


def document_dates(spark: SparkSession, d: str) -> DataFrame:
    """The same of the documents, over their whole texts, checked against the year of arrival."""
    docs = _t(spark, d, "documents").select("doc_id", D.issue_date(F.col("text"), _none()).alias("x"), F.year("added").alias("scan"))
    return docs.select("doc_id", "x.signal", D.valid_issue_date(F.col("x.iso"), F.col("scan"), _none()).alias("v")).select("doc_id", "signal", "v.iso", "v.suspicious")


def date_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _letters(spark, d).select("doc", F.when(F.col("k") < 3, F.concat_ws(".", "d", "m", F.when(F.col("k") == 0, F.col("y") - 15).otherwise(F.col("y")))).when(F.col("k") == 3, F.concat_ws("-", "y", F.lpad(F.col("m").cast("string"), 2, "0"), F.lpad(F.col("d").cast("string"), 2, "0"))).when(F.col("k") == 4, F.lit("31.2.2020")).otherwise(F.lit("null")).alias("raw"))
    v = D.valid_issue_date(F.col("raw"), F.lit(1998), F.array(F.lit("1995-01-01")))
    return rows.select("doc", v.alias("v")).select("doc", "v.iso", "v.suspicious")


def source_dates(spark: SparkSession, d: str) -> DataFrame:
    """First valid day of three sources: the text, what was seen, what was guessed."""
    ok = lambda c: D.valid_issue_date(c, F.lit(2026), _none())["iso"]
    rows = _letters(spark, d).select("doc", "k", "text", F.concat_ws(".", "d", "m", "y").alias("seen"))
    return rows.select("doc", F.coalesce(ok(D.issue_date(F.col("text"), F.array(F.lit("1980-04-03")))["iso"]), ok(F.when(F.col("k") == 6, F.col("seen"))), F.lit("2000-01-01")).alias("iso"))


def paid_notes(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).select("doc", D.paid_date(F.col("text")).alias("iso")).where("iso is not null")


def birth_dates(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    raw = F.when(F.col("k") < 2, F.concat_ws(".", two("d"), two("m"), F.col("y").cast("string"))).when(F.col("k") < 4, F.concat_ws("-", "y", two("m"), two("d"))).when(F.col("k") < 6, F.concat_ws(".", "d", "m", F.lpad((F.col("y") % 100).cast("string"), 2, "0"))).otherwise(F.lit(" unbekannt "))
    return _letters(spark, d).select("doc", D.birth_date(raw).alias("born"))


def due_dates(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    raw = F.when(F.col("k") < 2, F.concat_ws("-", "y", two("m"), two("d"))).when(F.col("k") < 4, F.concat_ws(".", two("d"), two("m"), "y")).when(F.col("k") < 6, F.concat(F.col("y").cast("string"), two("m"), two("d"))).otherwise(F.lit("bald"))
    return _letters(spark, d).select("doc", D.due_date(raw).alias("due"))


def tax_years(spark: SparkSession, d: str) -> DataFrame:
    """Tax year of made-up documents: a yearly statement, two years in a balance, an invoice, a statement of the first months."""
    rows = _letters(spark, d).select("doc", F.col("k"), F.col("y"), F.concat_ws("-", "y", F.lpad(F.col("m").cast("string"), 2, "0"), F.lpad(F.col("d").cast("string"), 2, "0")).alias("issued"), (F.lit(2010) + F.col("doc") % 9).cast("int").alias("t"))
    title = F.when(F.col("k") == 0, F.concat(F.lit("Lohnausweis "), "t")).otherwise(F.lit(""))
    text = F.when(F.col("k") == 1, F.concat(F.lit("Saldo per 31.12."), "t", F.lit(" und Saldo per 31.12."), F.col("t") + 1)).when(F.col("k") == 2, F.lit("Ware geliefert")).otherwise(F.lit("Bestätigung"))
    kind = F.when(F.col("k").isin(0, 1, 3), F.lit("Kontoauszug")).when(F.col("k") == 2, F.lit("Rechnung")).otherwise(F.lit("Brief"))
    return rows.select("doc", D.tax_year(text, title, kind, F.when(F.col("k") < 6, F.col("issued"))).alias("year"))


def iban_extract(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).select("doc", F.array_join(I.ibans(F.col("text")), "|").alias("ibans"))


def swift_extract(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).select("doc", F.array_join(I.swifts(F.col("text")), "|").alias("codes"))


def phone_find(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).select("doc", F.array_join(I.phones(F.col("text")), "|").alias("phones"))


def email_senders(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).select("doc", F.array_join(I.senders(F.col("text"), F.array(F.lit("info7@firma7.example"))), "|").alias("emails"))


def text_idents(spark: SparkSession, d: str) -> DataFrame:
    """Senders found by what stands in the text of a letter: account, else bank, else e-mail, else phone; a kind that meets
    several leaves the letter without one."""
    rows = _letters(spark, d).select("doc", "text")
    found = rows.select("doc", F.explode(F.array(F.struct(F.lit("iban").alias("kind"), F.transform(I.ibans(F.col("text")), I.iban_key).alias("keys")), F.struct(F.lit("swift").alias("kind"), I.swifts(F.col("text")).alias("keys")), F.struct(F.lit("email").alias("kind"), I.senders(F.col("text"), _none()).alias("keys")), F.struct(F.lit("telefon").alias("kind"), I.phones(F.col("text")).alias("keys")))).alias("x")).select("doc", "x.kind", F.explode("x.keys").alias("key"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("c"))
    name = F.concat(F.lit("Firma "), F.col("c").cast("string")).alias("name")
    check = F.lpad((98 - (((F.lit(762000000000000) + F.col("c")) % 97 * 27 + 121700) % 97)).cast("string"), 2, "0")
    accounts = c.where("c % 2 = 0").select(name, F.lit("iban").alias("kind"), F.concat(F.lit("CH"), check, F.lit("00762"), F.lpad(F.col("c").cast("string"), 12, "0")).alias("key"))
    mails = c.where("c between 1 and 50").select(name, F.lit("email").alias("kind"), F.concat(F.lit("info"), F.col("c") % 50, F.lit("@firma"), F.col("c") % 50, F.lit(".example")).alias("key"))
    return M.by_identifier(found, accounts.unionByName(mails), ["uid", "iban", "swift", "email", "telefon"])


def plate_match(spark: SparkSession, d: str) -> DataFrame:
    """Vehicles whose plate stands in a letter: plates are cut from the text by their form, so the join is on equality."""
    rows = _letters(spark, d).select("doc", F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2} ?[0-9]{1,6})\b"), F.lit(1)), I.plate_key)).alias("plate")).distinct()
    cars = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("car"), I.plate_key(F.concat(F.lit("zh-"), F.col("c_custkey").cast("string"))).alias("plate"))
    return rows.join(cars, "plate").groupBy("doc").agg(F.min("car").alias("car"))


def payment_slips(spark: SparkSession, d: str) -> DataFrame:
    rows = _letters(spark, d, _SLIP).select("doc", O.payment_slip(F.col("text")).alias("s")).where("s is not null")
    return rows.select("doc", "s.iban", "s.amount", "s.kind", "s.reference", "s.creditor", "s.debtor", "s.note", "s.due")


def slip_codes(spark: SparkSession, d: str) -> DataFrame:
    six = F.lpad(F.col("doc").cast("string"), 6, "0")
    text = F.when(F.col("k") == 0, F.concat(six, F.lit("_Police"))).when(F.col("k") == 1, F.concat(six, F.lit("_A\nzweite"))).when(F.col("k") == 2, F.concat(F.lit("x "), six, F.lit("_B y"))).when(F.col("k") == 3, F.concat(F.lit("oben\nQR "), six, F.lit(" Haus 3 "))).otherwise(F.lit("leer"))
    code = F.coalesce(I.slip_code(text, r"[0-9]{6}_[^\s]+$"), I.slip_code(text, "[0-9]{6} .+$"))
    return _letters(spark, d).where("doc < 1000000").select("doc", code.alias("code"))


def file_stems(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("in/"), F.when(F.col("k") < 3, F.lit("Scan_")).otherwise(F.lit("")), F.col("doc").cast("string"), F.when(F.col("k") % 2 == 0, F.lit(".PDF")).otherwise(F.lit(".tif")))
    return _letters(spark, d).select("doc", I.file_stem(path).alias("stem"))


def marker_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of the original and the archived file of a document the one with more real markers, the original on ties."""
    n = lambda k: F.transform(F.sequence(F.lit(0), F.col("doc") % k), lambda i: F.when(i == 0, "Kein_Barcode").otherwise(F.concat(F.lit("B"), i.cast("string"))))
    rows = _letters(spark, d).select("doc", O.marker_score(n(3)).alias("a"), O.marker_score(n(4)).alias("b"))
    return rows.select("doc", F.when(F.col("b") > F.col("a"), "archive").otherwise("original").alias("best"), F.greatest("a", "b").alias("score"))


def answer_objects(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects read from answers with thoughts, fences, talk around them and braces in strings."""
    body = F.concat(F.lit('{"ordner": "a}{b", "n": {"m": '), F.col("c").cast("string"), F.lit("}}"))
    text = F.when(F.col("k") == 0, body).when(F.col("k") == 1, F.concat(F.lit("<think>{x}</think>"), body)).when(F.col("k") == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("k") == 3, F.concat(F.lit("Hier: "), body, F.lit(" und {mehr"))).otherwise(F.lit("nichts {"))
    v = F.try_parse_json(O.answer_json(text))
    return _letters(spark, d).select("doc", F.try_variant_get(v, "$.n.m", "bigint").alias("m"), F.try_variant_get(v, "$.ordner", "string").alias("ordner"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    pages = F.array(F.concat(F.lit(" erste "), F.col("c").cast("string")), F.when(F.col("k") % 2 == 0, F.lit("n/a")).otherwise(F.lit("zweite")), F.lit("dritte"))
    return _letters(spark, d).select("doc", O.page_transcript(pages).alias("text"))


def appended_texts(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("k") == 0, F.lit("alt\n\n[HTR]\nfrüher")).when(F.col("k") == 1, F.lit("alt")).when(F.col("k") == 2, F.lit(None).cast("string")).otherwise(F.lit("bleibt"))
    new = F.when(F.col("k") == 4, F.lit("-")).otherwise(F.concat(F.lit("neu "), F.col("c").cast("string")))
    return _letters(spark, d).select("doc", O.appended(old, new, "[HTR]", F.col("k") == 3).alias("text"))


def reading_confidences(spark: SparkSession, d: str) -> DataFrame:
    quality = F.when(F.col("k") == 0, "gut").when(F.col("k") == 1, "mittel").when(F.col("k") == 2, "schlecht")
    return _letters(spark, d).select("doc", O.reading_confidence(quality, F.col("c") % 6, F.col("doc") % 3, F.col("doc") % 2).alias("confidence"))


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """One field upserted into each document's map; what changed is counted."""
    rows = _letters(spark, d).select("doc", F.when(F.col("k") == 0, F.create_map(F.lit("dok_id"), F.col("doc").cast("string"))).when(F.col("k") == 1, F.create_map(F.lit("dok_id"), F.lit("0"))).when(F.col("k") == 2, F.create_map(F.lit("x"), F.lit("y"))).alias("fields"))
    return O.backfill(rows, "doc", "fields", "dok_id", F.col("doc").cast("string")).groupBy("change").agg(F.count("*").alias("n"), F.sum(F.size("fields")).alias("entries"))


def bulk_updates(spark: SparkSession, d: str) -> DataFrame:
    docs = _letters(spark, d).select("doc", F.concat(F.lit("s"), (F.col("c") % 3).cast("string")).alias("sender"), F.when(F.col("k") < 3, F.lit("Rechnung")).alias("kind"), F.array(F.lit("pending"), F.concat(F.lit("t"), F.col("k").cast("string"))).alias("tags"))
    changes = _letters(spark, d).where("doc % 2 = 0").select("doc", F.when(F.col("c") % 2 == 0, F.lit("neu")).alias("new_sender"), F.lit("Brief").alias("new_kind"), F.array(F.lit("fertig")).alias("add"), F.array(F.lit("pending")).alias("remove"))
    return O.bulk_update(docs, changes, "doc").select("doc", "sender", "kind", F.array_join("tags", "|").alias("tags"))


def person_match(spark: SparkSession, d: str) -> DataFrame:
    """Persons of letters by insurance number, birth date or name; a key that several share decides nothing."""
    docs = _letters(spark, d).select("doc", F.explode(F.array(F.struct(F.lit("ahv").alias("kind"), F.when(F.col("k") == 0, F.concat(F.lit("756"), F.lpad((F.col("c") % 40).cast("string"), 10, "0"))).alias("key")), F.struct(F.lit("geburt").alias("kind"), F.when(F.col("k") < 3, D.birth_date(F.concat(F.col("c") % 20 + 1, F.lit(".05.1970")))).alias("key")), F.struct(F.lit("name").alias("kind"), F.concat(F.lit("person "), F.col("c") % 60).alias("key")))).alias("x")).select("doc", "x.*").where("key is not null")
    p = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("person"), F.explode(F.array(F.struct(F.lit("ahv").alias("kind"), F.concat(F.lit("756"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("key")), F.struct(F.lit("geburt").alias("kind"), F.concat(F.col("id") % 25 + 1, F.lit(".5.1970")).alias("key")), F.struct(F.lit("name").alias("kind"), F.concat(F.lit("person "), F.col("id")).alias("key")))).alias("x")).select("person", "x.*")
    return O.person_of(docs, p)


def relation_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    """The relation of each document's sender that its text or its kind decides."""
    c = _t(spark, d, "correspondents").select(F.col("name").alias("korrespondent"), F.filter("beziehungen", lambda b: b.isNotNull()).alias("b")).where("size(b) > 0").dropDuplicates(["korrespondent"])
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "korrespondent", "dokumenttyp", F.lower("text").alias("t"))
    return docs.join(c, "korrespondent").select("doc_id", O.tiebreak(F.col("b"), F.col("t"), F.col("dokumenttyp")).alias("r")).where("r is not null").select("doc_id", "r.bezeichnung", "r.ordner")


def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Required fields of each type that a document with two of its fields would lack."""
    t = _t(spark, d, "document_types").where("feldprofil is not null")
    return t.select("name", F.array_join(O.required_missing(F.col("feldprofil"), F.array(F.lit("betrag"), F.lit("datum"))), "|").alias("missing"))


def projected_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that each type's profile lets through, the first source with a value counting."""
    t = _t(spark, d, "document_types").where("feldprofil is not null")
    keys = F.map_keys("feldprofil")
    first = F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.length(k) % 2 == 0, F.concat(F.lit("a-"), k)).otherwise(F.lit("n/a"))))
    second = F.map_from_arrays(keys, F.transform(keys, lambda k: F.concat(F.lit("b-"), k)))
    return t.select("name", F.array_join(F.map_values(O.projected(F.col("feldprofil"), first, second)), "|").alias("fields"))


def identifier_unions(spark: SparkSession, d: str) -> DataFrame:
    """Phones of each sender that differ as keys, as first written."""
    from letterloom.functions.text import phone_key

    both = F.concat(F.coalesce("identifikatoren.telefon", _none()), F.transform(F.coalesce("identifikatoren.telefon", _none()), lambda x: F.replace(x, F.lit(" "), F.lit(""))))
    return _t(spark, d, "correspondents").where("size(identifikatoren.telefon) > 0").select("corr_id", F.array_join(O.identifier_union(both, phone_key), "|").alias("phones"))


def pattern_extract(spark: SparkSession, d: str) -> DataFrame:
    """What the senders' own patterns find in the texts of their documents; patterns that are not safe to run are left out."""
    m = _t(spark, d, "correspondents").select(F.col("name").alias("korrespondent"), "corr_id", F.explode("extraktion_muster").alias("feld", "m")).where(I.safe_pattern(F.col("m.regex")))
    m = m.select("korrespondent", "corr_id", "feld", F.regexp_replace("m.regex", r"\(\?P<", "(?<").alias("muster"))
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "korrespondent", "text").join(m, "korrespondent")
    return docs.select("doc_id", "corr_id", "feld", F.expr("regexp_extract(text, muster, 0)").alias("hit")).where("hit <> ''")


def pattern_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which patterns may run: those of the senders, and a few that may not."""
    own = _t(spark, d, "correspondents").select(F.explode("extraktion_muster").alias("feld", "m")).select(F.col("m.regex").alias("pattern")).where("pattern is not null")
    made = spark.range(1).select(F.explode(F.array(F.lit("(a+)+"), F.lit("(x*)*y"), F.lit("a**"), F.repeat(F.lit("a"), F.lit(201)), F.lit(" "), F.lit(r"^[0-9]{6}_[^\s]+$"))).alias("pattern"))
    return own.unionByName(made).groupBy("pattern").agg(F.count("*").alias("n")).select("pattern", "n", I.safe_pattern(F.col("pattern")).alias("safe"))


QUERIES = {f.__name__: f for f in (issue_dates, document_dates, date_validation, source_dates, paid_notes, birth_dates, due_dates, tax_years, iban_extract, swift_extract, phone_find, email_senders, text_idents, plate_match, payment_slips, slip_codes, file_stems, marker_scores, answer_objects, transcripts, appended_texts, reading_confidences, backfilled, bulk_updates, person_match, relation_tiebreak, required_fields, projected_fields, identifier_unions, pattern_extract, pattern_gate)}

_L = _sql(f"(SELECT *, {_ACCOUNT} AS a FROM {_BASE})")
_IBAN = f"CASE WHEN doc % 5 <> 0 AND doc % 3 < 2 THEN {_GROUPED} ELSE '' END"
_VOID = "('', 'null', 'none', 'n/a', '-', '–', '—')"
SQL = {
    "issue_dates": f"SELECT doc, CASE WHEN k = 6 AND doc % 6 <> 0 THEN NULL ELSE {_ISO} END iso, CASE WHEN k = 6 AND doc % 6 = 0 THEN 'fusszeile' ELSE CASE k WHEN 0 THEN 'ort_und_datum' WHEN 1 THEN 'erstellt' WHEN 2 THEN 'ort_komma_monat' WHEN 3 THEN 'datum' WHEN 4 THEN 'ort_komma_datum' WHEN 5 THEN 'fusszeile' END END signal FROM {_L}",
    "date_validation": f"SELECT doc, CASE WHEN v BETWEEN 1990 AND 1999 AND NOT (k <> 0 AND y = 1995 AND m = 1 AND d = 1) THEN concat(v, '-', {_TWO.format('m')}, '-', {_TWO.format('d')}) END iso, coalesce(v BETWEEN 1990 AND 1999 AND 1998 - v > 2 AND NOT (k <> 0 AND y = 1995 AND m = 1 AND d = 1), false) suspicious FROM (SELECT *, CASE WHEN k = 0 THEN y - 15 WHEN k < 4 THEN y END v FROM {_L})",
    "source_dates": f"SELECT doc, CASE WHEN y BETWEEN 1990 AND 2027 THEN {_ISO} ELSE '2000-01-01' END iso FROM {_L}",
    "paid_notes": f"SELECT doc, concat(2000 + y % 100, '-', {_TWO.format('m')}, '-', {_TWO.format('d')}) iso FROM {_L} WHERE doc % 6 = 0 AND NOT (m = 2 AND d = 29 AND y % 4 <> 0)",
    "birth_dates": f"SELECT doc, CASE WHEN k = 6 THEN 'unbekannt' WHEN k IN (4, 5) THEN concat(d, '.', m, '.', CASE WHEN y % 100 < 30 THEN 2000 ELSE 1900 END + y % 100) ELSE concat(d, '.', m, '.', y) END born FROM {_L}",
    "due_dates": f"SELECT doc, CASE WHEN k < 6 THEN {_ISO} END due FROM {_L}",
    "tax_years": f"SELECT doc, (CASE k WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN y WHEN 3 THEN y - 1 WHEN 6 THEN NULL ELSE y END)::INTEGER AS year FROM (SELECT *, 2010 + doc % 9 t FROM {_L})",
    "iban_extract": f"SELECT doc, {_IBAN} ibans FROM {_L}",
    "swift_extract": f"SELECT doc, CASE doc % 4 WHEN 0 THEN concat_ws('|', 'ABCDCH22', w) WHEN 1 THEN concat_ws('|', w, 'ABCDCH2A80X') ELSE coalesce(w, '') END codes FROM (SELECT *, CASE WHEN k = 1 THEN 'ERSTELLT' WHEN k = 2 AND m = 11 THEN 'NOVEMBER' WHEN k = 2 AND m = 12 THEN 'DEZEMBER' END w FROM {_L})",
    "phone_find": f"SELECT doc, concat('41', replace({_PHONE}, ' ', '')) phones FROM {_L}",
    "email_senders": f"SELECT doc, CASE WHEN c % 50 = 7 THEN '' ELSE concat('info', c % 50, '@firma', c % 50, '.example') END emails FROM {_L}",
    "text_idents": f"SELECT doc, concat('Firma ', CASE WHEN i THEN c WHEN c % 50 = 0 THEN 50 ELSE c % 50 END) AS name, CASE WHEN i THEN 'iban' ELSE 'email' END kind FROM (SELECT *, {_IBAN} <> '' AND c % 2 = 0 AND c IN (SELECT c_custkey FROM customer) i FROM {_L}) WHERE i OR CASE WHEN c % 50 = 0 THEN 50 ELSE c % 50 END IN (SELECT c_custkey FROM customer)",
    "plate_match": f"SELECT doc, c car FROM {_L} WHERE c % 3 = 0 AND c IN (SELECT c_custkey FROM customer)",
    "payment_slips": f"SELECT doc, concat('CH', a) iban, c + 0.5::DOUBLE amount, CASE WHEN doc % 2 = 0 THEN 'QRR' WHEN doc % 3 = 0 THEN 'SCOR' ELSE 'NON' END kind, CASE WHEN doc % 2 = 0 THEN lpad(cast(doc AS VARCHAR), 27, '0') WHEN doc % 3 = 0 THEN concat('RF', doc) END reference, concat('Firma ', c) creditor, 'Haus' debtor, concat('Rechnung ', doc) note, {_ISO} due FROM {_L}",
    "slip_codes": f"SELECT doc, CASE k WHEN 0 THEN s || '_Police' WHEN 1 THEN s || '_A' WHEN 2 THEN s || '_B' WHEN 3 THEN s || ' Haus 3' END code FROM (SELECT *, lpad(cast(doc AS VARCHAR), 6, '0') s FROM {_L} WHERE doc < 1000000)",
    "file_stems": f"SELECT doc, concat(doc, CASE WHEN k % 2 = 0 THEN '' ELSE '.tif' END) stem FROM {_L}",
    "marker_scores": f"SELECT doc, CASE WHEN doc % 4 > doc % 3 THEN 'archive' ELSE 'original' END best, greatest(doc % 3, doc % 4)::INTEGER score FROM {_L}",
    "answer_objects": f"SELECT doc, CASE WHEN k < 4 THEN c END m, CASE WHEN k < 4 THEN 'a}}{{b' END ordner FROM {_L}",
    "transcripts": f"SELECT doc, concat('--- Seite 1 ---', chr(10), 'erste ', c, chr(10), chr(10), CASE WHEN k % 2 = 0 THEN '' ELSE concat('--- Seite 2 ---', chr(10), 'zweite', chr(10), chr(10)) END, '--- Seite 3 ---', chr(10), 'dritte') AS text FROM {_L}",
    "appended_texts": f"SELECT doc, CASE WHEN k = 4 THEN 'bleibt' ELSE concat(CASE WHEN k IN (2, 3) THEN '' WHEN k < 2 THEN concat('alt', chr(10), chr(10)) ELSE concat('bleibt', chr(10), chr(10)) END, '[HTR]', chr(10), 'neu ', c) END AS text FROM {_L}",
    "reading_confidences": f"SELECT doc, (round_even(greatest(5, least(85, CASE k WHEN 0 THEN 80 WHEN 1 THEN 55 WHEN 2 THEN 30 ELSE 45 END - doc % 3 * 10 - doc % 2 * 5 - CASE WHEN c % 6 < 3 THEN 15 ELSE 0 END)), 0) / 100)::DOUBLE confidence FROM {_L}",
    "backfilled": f"SELECT change, count(*) n, sum(e)::BIGINT entries FROM (SELECT CASE WHEN k = 0 THEN CASE WHEN true THEN 'kept' END WHEN k = 1 THEN CASE WHEN doc = 0 THEN 'kept' ELSE 'updated' END ELSE 'inserted' END change, CASE WHEN k = 2 THEN 2 ELSE 1 END e FROM {_L}) GROUP BY 1",
    "bulk_updates": f"SELECT doc, CASE WHEN doc % 2 = 0 AND c % 2 = 0 THEN 'neu' ELSE concat('s', c % 3) END sender, CASE WHEN k < 3 THEN 'Rechnung' WHEN doc % 2 = 0 THEN 'Brief' END kind, CASE WHEN doc % 2 = 0 THEN concat('t', k, '|fertig') ELSE concat('pending|t', k) END tags FROM {_L}",
    "person_match": f"SELECT doc, concat('p', CASE kind WHEN 'ahv' THEN c % 40 WHEN 'geburt' THEN c % 20 ELSE c % 60 END) person, kind FROM (SELECT *, CASE WHEN k = 0 THEN 'ahv' WHEN k < 3 AND c % 20 >= 15 THEN 'geburt' WHEN c % 60 < 40 THEN 'name' END kind FROM {_L}) WHERE kind IS NOT NULL",
    "relation_tiebreak": """WITH s AS (SELECT name, list_filter(min(beziehungen), lambda b: b IS NOT NULL) b FROM correspondents WHERE len(list_filter(beziehungen, lambda b: b IS NOT NULL)) > 0 GROUP BY name),
j AS (SELECT doc_id, b, list_filter(b, lambda r: len(list_filter(coalesce(r.stichworte, []), lambda w: trim(w) <> '' AND contains(lower(text), lower(trim(w))))) > 0) w, list_filter(b, lambda r: len(list_filter(coalesce(r.erlaubte_doctypen, []), lambda t: lower(trim(t)) = lower(trim(dokumenttyp)))) > 0) k FROM documents JOIN s ON korrespondent = name WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN len(b) = 1 THEN b[1] WHEN len(w) = 1 THEN w[1] WHEN len(k) = 1 THEN k[1] END r FROM j) SELECT doc_id, r.bezeichnung, r.ordner FROM c WHERE r IS NOT NULL""",
    "required_fields": "SELECT name, array_to_string(list_sort(list_filter(map_keys(feldprofil), lambda k: coalesce(feldprofil[k].pflicht, false) AND k NOT IN ('betrag', 'datum'))), '|') missing FROM document_types WHERE feldprofil IS NOT NULL",
    "projected_fields": "SELECT name, array_to_string(list_transform(list_sort(list_filter(map_keys(feldprofil), lambda k: coalesce(feldprofil[k].extrahieren, false))), lambda k: CASE WHEN length(k) % 2 = 0 THEN 'a-' || k ELSE 'b-' || k END), '|') fields FROM document_types WHERE feldprofil IS NOT NULL",
    "pattern_extract": r"SELECT doc_id, corr_id, feld, regexp_extract(text, muster) hit FROM (SELECT doc_id, corr_id, m.key feld, text, m.value.regex muster FROM documents d JOIN (SELECT name, corr_id, unnest(map_entries(extraktion_muster)) m FROM correspondents) c ON d.korrespondent = c.name WHERE text IS NOT NULL AND trim(m.value.regex) <> '' AND length(trim(m.value.regex)) <= 200 AND NOT regexp_matches(m.value.regex, '\([^()]*[+*][^()]*\)\s*[+*{]|[+*]\s*[+*]')) WHERE regexp_extract(text, muster) <> ''",
    "pattern_gate": r"SELECT pattern, count(*) n, trim(pattern) <> '' AND length(trim(pattern)) <= 200 AND NOT regexp_matches(pattern, '\([^()]*[+*][^()]*\)\s*[+*{]|[+*]\s*[+*]') safe FROM (SELECT m.value.regex pattern FROM (SELECT unnest(map_entries(extraktion_muster)) m FROM correspondents) WHERE m.value.regex IS NOT NULL UNION ALL SELECT unnest(['(a+)+', '(x*)*y', 'a**', repeat('a', 201), ' ', '^[0-9]{6}_[^\s]+$'])) GROUP BY 1",
}
