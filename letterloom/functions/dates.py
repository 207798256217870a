"""Dates in letters as column expressions. Days that don't exist are null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.operators.timestamps import MONTH_OF

_NAMES = "|".join(sorted((w for w in MONTH_OF if w.isalpha()), key=lambda w: (-len(w), w)))
_NUMERIC = r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{2,4})"
_NAMED = rf"([0-9]{{1,2}})[.\s]+({_NAMES})\s+([0-9]{{4}})"
_PLACE = r"[A-ZÀ-Ü][A-Za-zÀ-ÿ.-]+,\s*(?:den\s+)?"
# The signals of an issue date, first to last, each with the characters after it in which the date may stand.
SIGNALS = (
    ("ort_und_datum", r"ort\s+und\s+datum", 150),
    ("ort_und_datum", r"lieu\s+et\s+date", 150),
    ("ort_und_datum", r"luogo\s+e\s+data", 150),
    ("erstellt", r"erstellt\s+am", 80),
    ("erstellt", r"ausgestellt\s+am", 80),
    ("erstellt", r"ausgefertigt\s+am", 80),
    ("erstellt", r"datum\s*:", 80),
    ("erstellt", r"fait\s+[àa]", 80),
    ("erstellt", r"emesso\s+il", 80),
    ("datum", r"\bdatum\b", 100),
)
#: Characters at the end of a text in which a date may stand without a signal.
TAIL = 2000


def day(y: Column, m: Column, d: Column) -> Column:
    """ISO day of three texts; years of two digits below 70 are 20xx."""
    year = F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") < 70, F.lit("20")).otherwise(F.lit("19")), y)).otherwise(y)
    return F.date_format(F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    numbers = F.create_map(*(F.lit(x) for w, m in sorted(MONTH_OF.items()) if w.isalpha() for x in (w, f"{m:02d}")))
    return F.try_element_at(numbers, F.lower(name))


def _parts(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.nullif(F.regexp_extract(text, "(?iu)" + pattern, k), F.lit("")) for k in (1, 2, 3))


def first_day(text: Column) -> Column:
    """The first numeric date of a text if it is a day, else the first one with the name of a month."""
    d, m, y = _parts(text, _NUMERIC)
    e, n, z = _parts(text, _NAMED)
    return F.coalesce(day(y, m, d), day(z, _month(n), e))


def _first(days: Column, excluded: Column) -> Column:
    return F.get(F.filter(days, lambda x: x.isNotNull() & ~F.coalesce(F.array_contains(excluded, x), F.lit(False))), F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` in the expression once, however often ``use`` names it: a candidate that is itself a
    long expression would else be copied at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def issue_date(text: Column, excluded: Column) -> Column:
    """struct(iso, signal): the day on which a letter was issued, by the first signal that a day follows that is not among
    the ``excluded`` ones (birth dates): labels, a place with a comma, and last the last date near the end. Null texts and
    texts without a date give nulls."""
    found = []
    for name, label, width in SIGNALS:
        after = F.regexp_extract_all(text, F.lit(rf"(?iu){label}(?=([\s\S]{{0,{width}}}))"), F.lit(1))
        found.append((name, _first(F.transform(after, first_day), excluded)))
    for name, pattern in (("ort_komma_datum", _PLACE + _NUMERIC), ("ort_komma_monat", "(?iu)" + _PLACE + _NAMED)):
        found.append((name, _first(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), first_day), excluded)))
    tail = F.substring(text, F.greatest(F.length(text) - TAIL, F.lit(0)) + 1, F.lit(TAIL))
    last = F.reverse(F.regexp_extract_all(tail, F.lit(f"(?iu){_NUMERIC}|{_NAMED}"), F.lit(0)))
    found.append(("fusszeile", _first(F.transform(last, first_day), excluded)))
    return F.coalesce(*(F.when(iso.isNotNull(), F.struct(iso.alias("iso"), F.lit(name).alias("signal"))) for name, iso in found), F.struct(F.lit(None).cast("string").alias("iso"), F.lit(None).cast("string").alias("signal")))


def valid_issue_date(candidate: Column, scan_year: Column, excluded: Column) -> Column:
    """struct(iso, suspicious): a candidate, ISO or d.m.y, whose year lies from 1990 to the year after the scan and that is
    not excluded; suspicious where it is more than two years older than the scan."""

    def of(raw: Column) -> Column:
        return F.when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw).otherwise(F.when(raw.rlike("^" + _NUMERIC), first_day(raw)))

    def checked(iso: Column) -> Column:
        year = F.left(iso, F.lit(4)).cast("int")
        ok = year.between(F.lit(1990), scan_year + 1) & ~F.coalesce(F.array_contains(excluded, iso), F.lit(False))
        return F.struct(F.when(ok, iso).alias("iso"), F.coalesce(ok & (scan_year - year > 2), F.lit(False)).alias("suspicious"))

    return _once(_once(F.left(F.trim(candidate), F.lit(10)), of), checked)


def paid_date(note: Column) -> Column:
    """The day after ``bez.``, ``bz.`` or ``bezahlt`` in a handwritten note; years of two digits are 20xx."""
    d, m, y = _parts(note, r"\b(?:bez|bz|bezahlt)\b\.?\s*(?:am\s+)?([0-9]{1,2})\.\s*([0-9]{1,2})\.\s*([0-9]{4}|[0-9]{2})\b")
    return day(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), m, d)


def birth_date(text: Column) -> Column:
    """d.m.yyyy without leading zeros, from d.m.yyyy, d.m.yy (below 30: 20xx) or ISO; else the trimmed text."""
    t = F.trim(text)
    d, m, y = _parts(t, r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})$")
    z, n, e = _parts(t, "^([0-9]{4})-([0-9]{2})-([0-9]{2})$")
    year = F.when(F.length(y) == 2, F.when(y.cast("int") < 30, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))).otherwise(y)
    a, b, c = F.coalesce(d, e).cast("int"), F.coalesce(m, n).cast("int"), F.coalesce(year, z).cast("int")
    return F.when(a.between(1, 31) & b.between(1, 12), F.concat_ws(".", a.cast("string"), b.cast("string"), c.cast("string"))).otherwise(t)


def due_date(raw: Column) -> Column:
    """ISO day of yyyy-mm-dd, dd.mm.yyyy or yyyymmdd."""
    each = (F.when(raw.rlike(shape), F.try_to_date(raw, form)) for shape, form in (("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", "dd.MM.yyyy"), ("^[0-9]{8}$", "yyyyMMdd")))
    return F.date_format(F.coalesce(*each), "yyyy-MM-dd")


# Words that make a year in their surroundings the one a document is about, and kinds of documents.
YEAR_WORDS = "steuer lohn saldo beschein periode abrechnung 3a säule hypothek zins spende prämie versicherung konto depot wert beitrag".split()
YEARLY = "lohnausweis|lohnabrechnung|steuerwertbescheinigung|steuerbescheinigung|steuerdokument|kontoauszug|saldo|jahresabschluss|jahresrechnung|praemienbescheinigung|spendenbescheinigung|zinsbescheinigung|hypothekarzins|saeule 3a|3a"
EXPENSE = "rechnung|faktura|quittung"
YEARLY_TEXT = "3a|saule|lohnausweis|steuerwert|hypothek|zinsbeschein|spendenbeschein|jahresabschluss|saldo per"
_YEAR_LABELS = (
    r"(?:saldo|stand|per|stichtag|bescheinigt|gültig)\s*(?:per|am|vom)?\s*(?:31\.?\s*12\.?\s*|den\s+)?(20[12][0-9])",
    r"(?:steuerperiode|abrechnungsjahr|beitragsjahr|versicherungsjahr|jahr)\s*[:\s]?\s*(20[12][0-9])",
    r"(?:lohnausweis|jahreslohnausweis|lohn\s*abrechnung)\s*[:\s]?\s*(20[12][0-9])",
)


def tax_year(text: Column, title: Column, kind: Column, issued: Column) -> Column:
    """The tax year a document is about: the only year that a label or its surroundings name; of several the least for
    yearly documents, else that of issue if it is among them; without any the year of issue, for yearly documents the one
    before."""
    whole = F.concat_ws("\n", F.nullif(title, F.lit("")), text)
    labelled = [F.regexp_extract_all(whole, F.lit("(?iu)" + p), F.lit(1)) for p in _YEAR_LABELS]
    around = F.regexp_extract_all(whole, F.lit(rf"(?isu)(?<=(?:{'|'.join(YEAR_WORDS)})[\s\S]{{0,75}})\b(20[12][0-9])\b|\b(20[12][0-9])\b(?=[\s\S]{{0,14}}(?:{'|'.join(YEAR_WORDS)}))"), F.lit(0))
    years = F.array_distinct(F.concat(*labelled, around))
    folded = F.replace(F.replace(F.replace(F.lower(kind), F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue"))
    expense = F.coalesce(folded.rlike(EXPENSE), F.lit(False))
    yearly = ~expense & (F.coalesce(folded.rlike(YEARLY), F.lit(False)) | F.translate(F.lower(whole), "äöü", "aou").rlike(YEARLY_TEXT))
    year = F.left(issued, F.lit(4))
    fallback = F.when(year.isNull(), None).when(yearly, (year.cast("int") - 1)).otherwise(year.cast("int"))
    return F.when(F.size(years) == 1, years[0].cast("int")).when(F.size(years) > 1, F.when(yearly, F.array_min(years).cast("int")).when(F.array_contains(years, year), year.cast("int"))).otherwise(fallback)


def spellings(iso: Column) -> Column:
    """The ways in which a day may be written in a letter."""
    y, m, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    short = lambda c: F.regexp_replace(c, "^0", "")
    y2 = F.substring(y, 3, 2)
    return F.array_distinct(F.array(iso, F.concat_ws(".", d, m, y), F.concat_ws(".", short(d), short(m), y), F.concat_ws(".", d, m, y2), F.concat_ws("/", d, m, y), F.concat_ws("-", d, m, y), F.concat(y, m, d)))
