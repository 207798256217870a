"""SQL that reads the same date texts, for the check against the operator: one regular expression for each form."""

from __future__ import annotations

from letterloom.operators.timestamps import MONTH_OF

_MONTHS = "MAP {" + ", ".join(f"'{w}': '{m:02d}'" for w, m in sorted(MONTH_OF.items()) if w.isalpha()) + "}"


def parsed(source: str) -> str:
    """CTEs that add to the rows of ``source`` (with ``text``): d (a mere day), w (wall time), o (offset in minutes)."""
    return rf"""
z1 AS (SELECT *, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ?\. ?', '.', 'g') z FROM {source}),
z2 AS (SELECT *, lower(z) lz,
  regexp_extract(z, '^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d\d)(?:,? (\d\d)[:.](\d\d)(?: Uhr)?)?$', ['d', 'm', 'y', 'h', 'n']) a,
  regexp_extract(z, '^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})$', ['y', 'm', 'd']) b,
  regexp_extract(z, '^(\d{{4}})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d))?$', ['y', 'm', 'd', 'h', 'n', 's']) c,
  regexp_extract(lower(z), '^(\d{{1,2}})[. ]*([^0-9 .]+) (\d{{4}})$', ['d', 'm', 'y']) e,
  regexp_extract(lower(z), '^([^0-9 .]+) (\d{{1,2}}), (\d{{4}})$', ['m', 'd', 'y']) f,
  regexp_extract(z, '^(\d{{4}}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d+)? ?(Z|CEST|CET|[+-]\d\d:?\d\d)?$', ['d', 't', 'r', 'o']) i,
  regexp_extract(lower(z), '^[a-z]+, (\d\d) ([a-z]+) (\d{{4}}) (\d\d:\d\d:\d\d) ([+-]\d{{4}})$', ['d', 'm', 'y', 't', 'o']) r FROM z1),
z3 AS (SELECT * EXCLUDE (a, b, c, e, f, i, r), coalesce(
    TRY_CAST(CASE WHEN a.d <> '' AND a.h = '' THEN (CASE WHEN length(a.y) = 4 THEN a.y WHEN a.y < '70' THEN '20' || a.y ELSE '19' || a.y END) || '-' || a.m || '-' || a.d END AS DATE),
    TRY_CAST(CASE WHEN b.y <> '' THEN b.y || '-' || b.m || '-' || b.d END AS DATE), TRY_CAST(CASE WHEN c.y <> '' AND c.h = '' THEN c.y || '-' || c.m || '-' || c.d END AS DATE),
    TRY_CAST(CASE WHEN e.y <> '' THEN e.y || '-' || {_MONTHS}[e.m] || '-' || e.d END AS DATE), TRY_CAST(CASE WHEN f.y <> '' THEN f.y || '-' || {_MONTHS}[f.m] || '-' || f.d END AS DATE)) d,
  coalesce(
    TRY_CAST(CASE WHEN a.h <> '' THEN (CASE WHEN length(a.y) = 4 THEN a.y WHEN a.y < '70' THEN '20' || a.y ELSE '19' || a.y END) || '-' || a.m || '-' || a.d || ' ' || a.h || ':' || a.n || ':00' END AS TIMESTAMP),
    TRY_CAST(CASE WHEN c.h <> '' THEN c.y || '-' || c.m || '-' || c.d || ' ' || c.h || ':' || c.n || ':' || c.s END AS TIMESTAMP),
    TRY_CAST(CASE WHEN i.d <> '' THEN i.d || ' ' || i.t || i.r[:7] END AS TIMESTAMP), TRY_CAST(CASE WHEN r.d <> '' THEN r.y || '-' || {_MONTHS}[r.m] || '-' || r.d || ' ' || r.t END AS TIMESTAMP),
    CASE WHEN regexp_full_match(z, '\d{{10}}') THEN make_timestamp(z::BIGINT * 1000000) WHEN regexp_full_match(z, '\d{{13}}') THEN make_timestamp(z::BIGINT * 1000) END) w,
  CASE WHEN regexp_full_match(z, '\d{{10}}|\d{{13}}') THEN 0 WHEN i.o = 'Z' THEN 0 WHEN i.o = 'CET' THEN 60 WHEN i.o = 'CEST' THEN 120
    WHEN coalesce(nullif(i.o, ''), nullif(r.o, '')) IS NOT NULL THEN (CASE WHEN starts_with(coalesce(nullif(i.o, ''), r.o), '-') THEN -1 ELSE 1 END) * (substr(coalesce(nullif(i.o, ''), r.o), 2, 2)::INT * 60 + right(coalesce(nullif(i.o, ''), r.o), 2)::INT) END o FROM z2)"""


def _last_sunday(t: str, month: str) -> str:
    end = f"make_date(year({t}), {month}, 31)"
    return f"({end} - dayofweek({end})::INT)"


def home_of_utc(u: str) -> str:
    """Wall time in Zurich of an instant, by the rule in force since 1996."""
    summer = f"{u} >= {_last_sunday(u, '3')} + INTERVAL 1 HOUR AND {u} < {_last_sunday(u, '10')} + INTERVAL 1 HOUR"
    return f"({u} + to_hours(CASE WHEN {summer} THEN 2 ELSE 1 END))"


def utc_of_home(w: str) -> str:
    """Instant of a wall time in Zurich: the first of two, a skipped one moves on."""
    summer = f"{w} >= {_last_sunday(w, '3')} + INTERVAL 3 HOUR AND {w} < {_last_sunday(w, '10')} + INTERVAL 3 HOUR"
    return f"({w} - to_hours(CASE WHEN {summer} THEN 2 ELSE 1 END))"


_UTC = "(w - to_minutes(o))"
#: The day that a text denotes, in Zurich where it is an instant.
DAY = f"coalesce(d, CASE WHEN o IS NULL THEN w::DATE ELSE {home_of_utc(_UTC)}::DATE END)"
#: The instant that a text denotes; ``home`` says whether wall times are those of Zurich.
INSTANT = f"CASE WHEN w IS NOT NULL AND o IS NOT NULL THEN {_UTC} WHEN home THEN {utc_of_home('coalesce(w, d::TIMESTAMP)')} ELSE coalesce(w, d::TIMESTAMP) END"

P6 = rf"""WITH src AS (SELECT 'document_review_queue' quelle, queue_id satz_id, 'datum' feld, datum AS text, true home FROM document_review_queue
UNION ALL SELECT 'document_review_queue', queue_id, 'ts', ts, dienst IS DISTINCT FROM 'paper_manager' FROM document_review_queue
UNION ALL SELECT 'brillenpaesse', satz_id, 'versionen[' || (generate_subscripts(versionen, 1) - 1) || '].gueltig_ab', unnest(versionen).gueltig_ab, true FROM brillenpaesse), {parsed('src')}
SELECT DISTINCT quelle, satz_id, feld, CASE WHEN feld = 'ts' THEN strftime({INSTANT}, '%Y-%m-%dT%H:%M:%S.%fZ') ELSE strftime({DAY}, '%Y-%m-%d') END normal FROM z3 WHERE coalesce(d::TIMESTAMP, w) IS NOT NULL"""


def _value(column: str) -> str:
    plain = f"regexp_replace(translate(lower(trim({column})), '−–,', '--.'), '\\s|dpt\\.?|°', '', 'g')"
    return f"CASE WHEN lower(trim(coalesce({column}, ''))) IN ('', 'null', 'none', 'n/a', '-', '–', '—') THEN '' ELSE coalesce((TRY_CAST({plain} AS DOUBLE) + 0.0)::VARCHAR, {plain}) END"


_VALUES = " || '|' || ".join(_value(f"v.{s}.{e}.{f}") for s in ("fern", "naehe") for e in ("rechts", "links") for f in ("sph", "cyl", "achse", "prisma", "basis", "add"))
P3 = rf"""WITH src AS (SELECT lower(trim(person_id)) person_id, stand, satz_id, ord, v.gueltig_ab AS text, {_VALUES} AS val FROM (SELECT person_id, stand, satz_id, unnest(versionen) v, generate_subscripts(versionen, 1) ord FROM brillenpaesse WHERE person_id IS NOT NULL)), {parsed('src')},
days AS (SELECT person_id, {DAY} tag, arg_max(val, (stand, ord, satz_id)) val FROM z3 WHERE {DAY} IS NOT NULL GROUP BY 1, 2),
starts AS (SELECT *, lag(val) OVER (PARTITION BY person_id ORDER BY tag) b FROM days)
SELECT person_id, strftime(tag, '%Y-%m-%d') von, coalesce(strftime(lead(tag) OVER (PARTITION BY person_id ORDER BY tag), '%Y-%m-%d'), '') bis FROM starts WHERE b IS NULL OR b <> val"""
