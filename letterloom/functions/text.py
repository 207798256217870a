"""Text normalisation and extraction as column expressions; all run inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and departments that end a firm's name, in the order in which they are cut off.
FIRM_ENDINGS = ("genossenschaft", "versicherungen", "versicherung", "gmbh", "sarl", "ag", "sa", "& co.", "& co", "gruppe", "schweiz")
# Places of letters with marks, and what they become.
MARKED, UNMARKED = "äöüàâéèêëîïôûùçÄÖÜÉÈÀ", "aouaaeeeeiiouucAOUEEA"


def name_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[ \t\n\r]+", " "))


def firm_key(c: Column) -> Column:
    """Firm names for comparison: marks and written-out umlauts to base letters, hyphens to blanks, endings cut off."""
    t = F.translate(F.lower(F.trim(c)), MARKED, UNMARKED)
    for a, b in (("ue", "u"), ("ae", "a"), ("oe", "o"), ("-", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for e in FIRM_ENDINGS:
        t = F.regexp_replace(t, r" +" + e.replace(".", r"\.").replace("&", "&") + "$", "")
    return F.trim(F.regexp_replace(t, " +", " "))


def uid_key(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(t.startswith("CHE") & (F.length(t) >= 12), F.substring(t, 1, 12)).otherwise(t)


def reference_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[ \t\n\r_.-]", "")


def phone_key(c: Column) -> Column:
    """Digits with the country code; a trunk zero in brackets falls away."""
    d = F.regexp_replace(F.regexp_replace(c, r"\(0\)", ""), "[^0-9+]", "")
    d = F.regexp_replace(F.regexp_replace(d, r"^\+", ""), "^00", "")
    return F.when(d.startswith("0"), F.concat(F.lit("41"), F.substring(d, F.lit(2), F.length(d)))).otherwise(d)


def ahv_key(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when((F.length(d) == 13) & d.startswith("756"), d)


def slug(c: Column, most: int = 60) -> Column:
    t = F.lower(F.translate(c, MARKED, UNMARKED))
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 _-]", ""), r"[ _-]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(t, "^-+|-+$", ""), F.lit(most)), "-+$", "")


def title(c: Column, month: Column, short: Column, most: int = 128) -> Column:
    """A title as a file name with its month and the sender's short form."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"[ /\\:]+", "_"), r"[^A-Za-z0-9äöüÄÖÜ_.-]", ""), "_+", "_")
    return F.left(F.concat_ws("_", F.regexp_replace(t, "^_+|_+$", ""), month, short), F.lit(most))


def amount(c: Column, most: float = 500_000) -> Column:
    """A written amount as a number: apostrophes divide thousands, a comma is a decimal point; null if unreadable or too high."""
    t = F.regexp_replace(F.replace(F.regexp_replace(c, "['’ ]", ""), F.lit(","), F.lit(".")), "[^0-9.]", "")
    v = F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.cast("double"))
    return F.when(v <= most, v)


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), F.lit(0)), F.lower))


def phones(c: Column) -> Column:
    pattern = r"(?:\+41|0041)[ ]?(?:\(0\))?[ -]?[0-9]{2}(?:[ .-]?[0-9]){7}|\(?0[0-9]{2}\)?[ /-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}"
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), phone_key))


def uids(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"CHE[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}"), F.lit(0)), uid_key))


def iban_valid(c: Column) -> Column:
    """Length 15-34 and remainder 1 modulo 97, by a fold over the characters."""
    t = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    turned = F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))
    digit = lambda x: F.when(x.between("0", "9"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.split(turned, "(?!$)"), F.lit(0), lambda a, x: F.when(digit(x) > 9, a * 100 + digit(x)).otherwise(a * 10 + digit(x)) % 97)
    return F.coalesce(t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def token_overlap(a: Column, b: Column, stop: tuple[str, ...]) -> Column:
    """Shared words over the larger number of words, stop words aside; 0 where either has none."""
    words = lambda c: F.array_except(F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-zäöüàéè]+"), lambda w: F.length(w) > 1)), F.array(*map(F.lit, stop)))
    x, y = words(a), words(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(F.lit(0.0))
