"""Identifiers in running text as column expressions: account numbers, bank codes, phones, e-mails, plates, codes on slips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions.text import phone_key

# Length of an account number by country (ISO 13616).
IBAN_LENGTHS = dict(
    x.split(":")
    for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split()
)
# Addresses that send but don't read.
SENDS_ONLY = "noreply|no-reply|donotreply|mailer-daemon"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_LABELLED_PHONE = r"(?i)(?:Telefon|Tel\.?|Phone|Mobile|Mobil|Handy|Direkt|Zentrale|Fax|Telefax)\s*[:\s]*([+()0-9][0-9\s()./-]{6,32})"
_PHONES = (r"(?:\+41|0041)\s*-?\s*(?:\(\s*0\s*\)\s*)?[0-9]{2,3}[\s.-]?[0-9]{3}[\s.-]?[0-9]{2}[\s.-]?[0-9]{2}\b", r"\b0[1-9][0-9][\s./-]?[0-9]{3}[\s./-]?[0-9]{2}[\s./-]?[0-9]{2}\b")


def iban_key(c: Column) -> Column:
    """Capitals without blanks and hyphens; the letter O after CH is a misread zero."""
    t = F.regexp_replace(F.upper(c), r"[\s-]", "")
    return F.when(t.startswith("CHO"), F.concat(F.lit("CH0"), F.substring(t, F.lit(4), F.length(t)))).otherwise(t)


def iban_valid(key: Column) -> Column:
    """Whether a key has the length of its country and leaves 1 modulo 97."""
    sizes = F.create_map(*(F.lit(x) for k, v in IBAN_LENGTHS.items() for x in (k, int(v))))
    turned = F.concat(F.substring(key, F.lit(5), F.length(key)), F.substring(key, 1, 4))
    digit = lambda x: F.when(x.between("0", "9"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.split(turned, "(?!$)"), F.lit(0), lambda a, x: F.when(digit(x) > 9, a * 100 + digit(x)).otherwise(a * 10 + digit(x)) % 97)
    return F.coalesce(key.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.length(key) == F.try_element_at(sizes, F.left(key, F.lit(2)))) & (rest == 1), F.lit(False))


def ibans(text: Column, most: int = 3) -> Column:
    """The first valid account numbers of a text in groups of four: those written in groups, then any that stand in the
    text without its blanks."""
    spaced = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b[A-Z]{2}[0-9O]{2}(?:[\s-]?[0-9A-Z]{4}){1,7}[\s-]?[0-9A-Z]{0,4}\b"), F.lit(0)), iban_key)
    compact = F.upper(F.regexp_replace(text, r"\s+", ""))
    sizes = F.create_map(*(F.lit(x) for k, v in IBAN_LENGTHS.items() for x in (k, int(v))))
    cut = lambda x: F.left(x, F.coalesce(F.try_element_at(sizes, F.left(x, F.lit(2))), F.lit(0)))
    anchored = F.transform(F.regexp_extract_all(compact, F.lit(r"(?=([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}))[A-Z]{2}[0-9]{2}"), F.lit(1)), cut)
    valid = F.slice(F.filter(F.array_distinct(F.concat(spaced, anchored)), iban_valid), 1, most)
    return F.transform(valid, lambda x: F.trim(F.regexp_replace(x, "(.{4})", "$1 ")))


def swift_key(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(F.length(t).isin(8, 11) & F.left(t, F.lit(4)).rlike("^[A-Z]{4}$"), t)


def swifts(text: Column, most: int = 2) -> Column:
    """Bank codes of a text: those after a label first, then any word of their form."""
    code = "[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"
    labelled = F.regexp_extract_all(text, F.lit(rf"(?i)(?:SWIFT|BIC)\s*(?:Code)?\s*[:\s]*({code})"), F.lit(1))
    alone = F.regexp_extract_all(F.upper(text), F.lit(rf"\b({code})\b"), F.lit(1))
    return F.slice(F.array_distinct(F.array_compact(F.transform(F.concat(labelled, alone), swift_key))), 1, most)


def phones(text: Column, most: int = 3) -> Column:
    """Keys of the phone numbers of a text: those after a label first, then by their form; a key has nine digits or more."""
    plain = F.regexp_replace(text, r"(?i)(\+41|0041)\s*\(\s*0\s*\)\s*", "$1 ")
    found = F.concat(F.regexp_extract_all(plain, F.lit(_LABELLED_PHONE), F.lit(1)), *(F.regexp_extract_all(plain, F.lit(p), F.lit(0)) for p in _PHONES))
    return F.slice(F.array_distinct(F.filter(F.transform(found, phone_key), lambda k: F.length(k) >= 9)), 1, most)


def email_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def senders(text: Column, household: Column) -> Column:
    """E-mail addresses of a letter, the one on its From line first, without recipients, the household's own and those that
    only send."""
    on = lambda label: F.transform(F.regexp_extract_all(text, F.lit(rf"(?im)^\s*(?:{label})\s*:[^\n]*?({EMAIL})"), F.lit(1)), email_key)
    every = F.array_distinct(F.concat(on("Von|From|De|Da"), F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), email_key)))
    bad = F.concat(on("An|To|À|A"), household)
    return F.filter(every, lambda e: ~F.array_contains(bad, e) & ~e.rlike(SENDS_ONLY))


def plate_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def slip_code(text: Column, pattern: str) -> Column:
    """The text of a code on a separating sheet that fits ``pattern``: the whole, else its first line, else six digits with
    what follows after an underscore, else the part of a line from six digits and a blank on."""
    t = F.trim(text)
    fits = lambda c: F.when(c.rlike("^(?:" + pattern + ")"), c)
    line = F.trim(F.get(F.split(t, "\n"), F.lit(0)))
    under = F.nullif(F.regexp_extract(t, r"([0-9]{6}_[^\s]+)", 1), F.lit(""))
    blank = F.transform(F.split(t, "\n"), lambda x: F.trim(F.nullif(F.regexp_extract(x, "([0-9]{6} .+)", 1), F.lit(""))))
    return F.coalesce(fits(t), fits(line), fits(under), F.get(F.filter(F.transform(blank, fits), lambda x: x.isNotNull()), F.lit(0)))


def file_stem(path: Column) -> Column:
    """Name of a scanned file without folder, leading ``scan_`` and ``.pdf``."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, "(?i)^scan_", ""), r"(?i)\.pdf$", "")


def safe_pattern(pattern: Column, most: int = 200) -> Column:
    """Whether a user's pattern may run: not empty, not too long, and without a repeated group that repeats within."""
    t = F.trim(pattern)
    return F.coalesce((t != "") & (F.length(t) <= most) & ~t.rlike(r"\([^()]*[+*][^()]*\)\s*[+*{]|[+*]\s*[+*]"), F.lit(False))
