"""Operators over single documents: payment slips, transcripts of pages, answers of models, keyed writes, persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import dates as D
from letterloom.functions.void import is_void

# The places of lines in a payment slip's record.
SLIP = {"header": 0, "version": 1, "iban": 3, "creditor": 5, "amount": 18, "currency": 19, "debtor": 21, "kind": 27, "reference": 28, "note": 29, "end": 30}


def payment_slip(text: Column, place: dict[str, int] = SLIP) -> Column:
    """struct of a payment record of lines, null where the text is none: header SPC, version 0200 or 0100, 28 lines or more.
    A reference stands for kinds QRR (26 or 27 digits) and SCOR only; the due date is the last one in lines AV."""
    lines = F.split(F.trim(text), "\n")
    at = lambda k: F.trim(F.coalesce(F.get(lines, F.lit(place[k])), F.lit("")))
    ok = (F.size(lines) >= 28) & (at("header") == "SPC") & at("version").isin("0200", "0100")
    digits = F.replace(at("reference"), F.lit(" "), F.lit(""))
    reference = F.when((at("kind") == "QRR") & digits.rlike("^[0-9]{26,27}$"), digits).when(at("kind") == "SCOR", at("reference"))
    amount = F.replace(F.replace(at("amount"), F.lit("'"), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    due = F.filter(F.transform(F.filter(F.slice(lines, place["end"] + 1, F.greatest(F.size(lines) - place["end"], F.lit(0))), lambda x: x.startswith("AV")), lambda x: D.due_date(F.regexp_extract(x, r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{8})", 1))), lambda x: x.isNotNull())
    out = F.struct(F.replace(at("iban"), F.lit(" "), F.lit("")).alias("iban"), amount.alias("amount"), at("currency").alias("currency"), at("kind").alias("kind"), reference.alias("reference"), at("creditor").alias("creditor"), at("debtor").alias("debtor"), F.nullif(at("note"), F.lit("")).alias("note"), F.get(F.reverse(due), F.lit(0)).alias("due"))
    return F.when(ok, out)


def marker_score(names: Column, placeholder: str = "Kein_Barcode") -> Column:
    """How many markers of a split are real ones."""
    return F.size(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != placeholder))


def answer_json(text: Column) -> Column:
    """The JSON text in an answer of a model: without thoughts and code fences, the whole, else the first object whose
    braces balance (braces in strings don't count), else from the first brace to the last; null where none parses."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    start = F.instr(plain, "{")
    rest = F.when(start > 0, F.substring(plain, start, F.length(plain)))
    tokens = F.regexp_extract_all(rest, F.lit(r'[^"{}]|"(?:[^"\\]|\\.)*"|[{}]|"'), F.lit(0))
    step = lambda acc, x: F.when(acc["done"], acc).otherwise(_closed(acc, x))
    start_ = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("out"))
    scan = F.aggregate(F.coalesce(tokens, F.array().cast("array<string>")), start_, step)
    balanced = F.when(scan["done"], scan["out"])
    last = F.when((start > 0) & (F.instr(F.reverse(plain), "}") > 0), F.substring(plain, start, F.length(plain) - F.instr(F.reverse(plain), "}") + 2 - start))
    parses = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), c)
    return F.coalesce(parses(plain), parses(balanced), parses(last))


def _closed(acc: Column, x: Column) -> Column:
    depth = acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
    return F.struct(depth.alias("depth"), ((x == "}") & (depth == 0)).alias("done"), F.concat(acc["out"], x).alias("out"))


def page_transcript(pages: Column, most: int = 12_000) -> Column:
    """Pages put together, each under its mark; void pages keep their number and fall away."""
    marked = F.transform(pages, lambda t, i: F.when(~is_void(t), F.concat(F.lit("--- Seite "), (i + 1).cast("string"), F.lit(" ---\n"), F.left(F.trim(t), F.lit(most)))))
    return F.array_join(F.array_compact(marked), "\n\n")


def appended(existing: Column, added: Column, mark: str, drop_old: Column) -> Column:
    """A text with a part after a mark: replaced where the mark is there already, alone where the old text is dropped."""
    base = F.regexp_replace(F.substring_index(F.coalesce(existing, F.lit("")), mark, 1), r"^\s+|\s+$", "")
    part = F.concat(F.lit(mark + "\n"), F.trim(added))
    return F.when(is_void(added), existing).when(drop_old | (base == ""), part).otherwise(F.concat(base, F.lit("\n\n"), part))


def reading_confidence(quality: Column, lines: Column, failed: Column, salvaged: Column) -> Column:
    """Confidence of a reading by its quality, less for pages that failed or were salvaged and for few lines; from 0.05 to
    0.85, rounded half to even."""
    base = F.when(quality == "gut", 0.8).when(quality == "mittel", 0.55).when(quality == "schlecht", 0.3).otherwise(0.45)
    less = F.coalesce(failed, F.lit(0)) * 0.1 + F.coalesce(salvaged, F.lit(0)) * 0.05 + F.when(F.coalesce(lines, F.lit(0)) < 3, 0.15).otherwise(0.0)
    return F.bround(F.greatest(F.lit(0.05), F.least(F.lit(0.85), base - less)), 2)


def backfill(docs: DataFrame, key: str, fields: str, name: str, value: Column) -> DataFrame:
    """Upsert of one entry into each document's map of fields, with what it did: inserted, updated or kept."""
    old = F.try_element_at(F.col(fields), F.lit(name))
    change = F.when(old.isNull(), "inserted").when(old == value, "kept").otherwise("updated")
    merged = F.map_concat(F.map_filter(F.coalesce(F.col(fields), F.create_map().cast("map<string,string>")), lambda k, v: k != name), F.create_map(F.lit(name), value))
    return docs.select(key, merged.alias(fields), change.alias("change"))


def bulk_update(docs: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Documents with sender, type (only where there is none) and tags changed by rows (key, sender, kind, add, remove)."""
    both = docs.join(changes, key, "left")
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(F.filter(F.coalesce("tags", none), lambda t: ~F.array_contains(F.coalesce("remove", none), t)), F.coalesce("add", none)))
    return both.select(key, F.coalesce("new_sender", "sender").alias("sender"), F.coalesce("kind", "new_kind").alias("kind"), tags.alias("tags"))


def required_missing(profile: Column, present: Column) -> Column:
    """Names of the fields that a profile (map of struct with ``pflicht``) requires and that are not present, in order."""
    wanted = F.map_keys(F.map_filter(profile, lambda k, v: F.coalesce(v["pflicht"], F.lit(False))))
    return F.array_sort(F.array_except(wanted, present))


def projected(profile: Column, *sources: Column) -> Column:
    """The fields that a profile lets through (``extrahieren``), each from the first source (map) that has a value."""
    allowed = F.map_keys(F.map_filter(profile, lambda k, v: F.coalesce(v["extrahieren"], F.lit(False))))
    pick = lambda k: F.coalesce(*(F.when(~is_void(F.try_element_at(s, k)), F.try_element_at(s, k)) for s in sources))
    pairs = F.filter(F.transform(F.array_sort(allowed), lambda k: F.struct(k.alias("key"), pick(k).alias("value"))), lambda p: p["value"].isNotNull())
    return F.map_from_entries(pairs)


def identifier_union(values: Column, key) -> Column:  # noqa: ANN001
    """Values whose keys differ, in order, each as it was first written; values without a key fall away."""
    rows = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.trim(x).alias("v"), key(x).alias("k")))
    rows = F.filter(rows, lambda r: r["k"].isNotNull() & (r["k"] != ""))
    keys = F.transform(rows, lambda r: r["k"])
    return F.transform(F.filter(F.transform(rows, lambda r, i: F.struct(r.alias("r"), (F.array_position(keys, r["k"]) == i + 1).alias("first"))), lambda x: x["first"]), lambda x: x["r"]["v"])


def person_of(docs: DataFrame, persons: DataFrame) -> DataFrame:
    """(doc, person, kind): by insurance number, else birth date, else name. docs: (doc, kind, key) found in the texts;
    persons: (person, kind, key). A kind that meets several persons is passed over for the next."""
    from letterloom.operators import matching

    return matching.fall_through(docs, persons.withColumnRenamed("person", "name"), ["ahv", "geburt", "name"]).withColumnRenamed("name", "person")


def tiebreak(relations: Column, corpus: Column, kind: Column) -> Column:
    """Of several relations the one whose keywords alone stand in the text, else the one whose kinds of documents alone
    hold ``kind``; null while more than one or none remain."""
    words = F.filter(relations, lambda r: F.exists(F.coalesce(r["stichworte"], F.array().cast("array<string>")), lambda w: (F.trim(w) != "") & F.contains(corpus, F.lower(F.trim(w)))))
    kinds = F.filter(relations, lambda r: F.exists(F.coalesce(r["erlaubte_doctypen"], F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)) == F.lower(F.trim(kind))))
    return F.when(F.size(relations) == 1, relations[0]).when(F.size(words) == 1, words[0]).when(F.size(kinds) == 1, kinds[0])
