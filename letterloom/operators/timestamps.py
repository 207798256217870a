"""Mixed timestamp texts to unambiguous days and instants.

Every text is reduced to a mask of character classes of the same length (``2024-02-05`` becomes
``dddd-dd-dd``). A mask is compiled once into a plan of fixed slices; all texts of one mask are then
converted together as integer matrices. Zone rules are tables of transitions with the version of the
time-zone data they were made from.

Defined results: null, blank, unreadable and impossible values give a null ``kind``; a value that repeats
gives the same result each time; texts longer than any known form are no dates.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their usual short forms in de, fr, it, en, each list from January on.
MONTHS = (
    "januar februar märz april mai juni juli august september oktober november dezember",
    "jänner feber maerz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "jan feb mär apr mai jun jul aug sept okt nov dez",
    "janv févr mars avr mai juin juil août sept oct nov déc",
    "gen feb mar apr mag giu lug ago set ott nov dic",
)
MONTH_OF = {name: i + 1 for row in MONTHS for i, name in enumerate(row.split())}
# Zone words and their offset from UTC in minutes.
ZONE_WORDS = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180}
# Words that may follow a clock time, and week days that may lead a date.
CLOCK_WORDS = ("uhr", "h")
WEEKDAYS = set(
    "mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday "
    "mo di mi do fr sa so montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lunedì martedì mercoledì giovedì venerdì sabato domenica".split()
)
LONGEST = 64
MICROS = 1_000_000
DAY_US = 86_400 * MICROS


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone: ``utc[i]`` is the instant (s) from which ``offset[i + 1]`` (s) holds."""

    name: str
    version: str
    utc: np.ndarray
    wall: np.ndarray
    offset: np.ndarray

    def to_utc(self, wall_us: np.ndarray) -> np.ndarray:
        """Wall times to instants: one that occurs twice is the first, a skipped one moves on by the gap."""
        at = np.searchsorted(self.wall, wall_us // MICROS, side="right")
        return wall_us - self.offset[at] * MICROS

    def to_wall(self, utc_us: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.utc, utc_us // MICROS, side="right")
        return utc_us + self.offset[at] * MICROS


def zone_data_version() -> str:
    try:
        import importlib.resources

        return "tzdata " + importlib.resources.files("tzdata").joinpath("zones").parent.joinpath("__init__.py").read_text().split("IANA_VERSION")[1].split('"')[1]
    except Exception:  # noqa: BLE001 - the system's files carry the version in another place
        pass
    try:
        with open("/usr/share/zoneinfo/tzdata.zi", encoding="utf-8") as f:
            return "tzdata " + f.readline().split()[-1]
    except OSError:
        return "tzdata of the system"


@lru_cache(maxsize=64)
def zone_table(name: str, first_year: int = 1900, last_year: int = 2100) -> ZoneTable:
    """Transitions of a zone between two years, found by bisection over its offsets."""
    if name == "UTC":
        none = np.empty(0, dtype=np.int64)
        return ZoneTable(name, "fixed", none, none, np.zeros(1, dtype=np.int64))
    from zoneinfo import ZoneInfo

    zone = ZoneInfo(name)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(s: int) -> int:
        return int((epoch + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())

    low = int((datetime(first_year, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    end = int((datetime(last_year, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    instants, offsets, step = [], [offset(low)], 7 * 86_400
    while low < end:
        high = low + step
        if offset(high) != offsets[-1]:
            a, b = low, high
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if offset(m) == offsets[-1] else (a, m)
            instants.append(b)
            offsets.append(offset(b))
        low = high
    utc, off = np.array(instants, dtype=np.int64), np.array(offsets, dtype=np.int64)
    return ZoneTable(name, zone_data_version(), utc, utc + np.maximum(off[:-1], off[1:]), off)


@dataclass
class Plan:
    """Where each field of a mask stands. Slices are [from, to); words are looked up by distinct value."""

    kind: str
    slices: dict[str, tuple[int, int]] = field(default_factory=dict)


_SEP = r"(?P<sep>[-/.])"
_TIME = r"(?P<hour>d{1,2})(?P<c>[:.])(?P<minute>dd)(?:(?P=c)(?P<second>dd)(?:[.,](?P<frac>d+))?)?"
_ZONE = r" ?(?:(?P<sign>[+-])(?P<zh>dd)(?::?(?P<zm>dd))?|(?P<zword>a+))"
_FORMS = tuple(
    re.compile(p)
    for p in (
        rf"(?P<year>dddd){_SEP}(?P<month>d{{1,2}})(?P=sep)(?P<day>d{{1,2}})(?:(?:(?P<t>a)|,? ){_TIME}(?:{_ZONE})?)?",
        rf"(?P<year>dddd)(?P<month>dd)(?P<day>dd)(?:(?:(?P<t>a)| )?(?P<hour>dd)(?P<minute>dd)(?:(?P<second>dd)(?:[.,](?P<frac>d+))?)?(?:{_ZONE})?)?",
        rf"(?P<day>d{{1,2}}) ?{_SEP} ?(?P<month>d{{1,2}}) ?(?P=sep) ?(?P<year>dddd|dd)(?:(?:(?P<t>a)|,? ){_TIME}(?:{_ZONE})?)?",
        rf"(?:(?P<weekday>a+)[.,]*,? )?(?P<day>d{{1,2}})\.? (?P<mword>a+)\.? (?P<year>dddd)(?:,? {_TIME}(?:{_ZONE})?)?",
        rf"(?:(?P<weekday>a+)[.,]*,? )?(?P<mword>a+)\.? (?P<day>d{{1,2}}),? (?P<year>dddd)(?:,? {_TIME}(?:{_ZONE})?)?",
    )
)
_EPOCHS = {10: MICROS, 13: 1000, 16: 1}


@lru_cache(maxsize=65_536)
def compile_mask(mask: str) -> Plan | None:
    """The plan of one mask; null for masks that are no form of a date. Called once per distinct mask."""
    if mask == "d" * len(mask) and len(mask) in _EPOCHS:
        return Plan("epoch", {"n": (0, len(mask))})
    for form in _FORMS:
        if m := form.fullmatch(mask):
            return Plan("parts", {k: m.span(k) for k in m.groupdict() if k not in ("c", "sep") and m.group(k) is not None})
    return None


def _number(codes: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    part = codes[:, at[0] : at[1]].astype(np.int64) - 48
    return part @ (10 ** np.arange(part.shape[1] - 1, -1, -1, dtype=np.int64))


def _words(texts: np.ndarray, at: tuple[int, int], table: dict[str, int]) -> np.ndarray:
    """Look each distinct word up once; -1_000_000 where it is unknown."""
    cut = np.array([t[at[0] : at[1]].lower() for t in texts])
    words, back = np.unique(cut, return_inverse=True)
    return np.array([table.get(w, -MICROS) for w in words], dtype=np.int64)[back]


def _parts(plan: Plan, codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Wall microseconds, offset minutes (or the least int for none), validity, whether a clock time is given."""
    s, n = plan.slices, len(texts)
    year = _number(codes, s["year"])
    if s["year"][1] - s["year"][0] == 2:
        year = year + np.where(year < 70, 2000, 1900)
    month = _words(texts, s["mword"], MONTH_OF) if "mword" in s else _number(codes, s["month"])
    day = _number(codes, s["day"])
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    if "weekday" in s:
        ok &= _words(texts, s["weekday"], dict.fromkeys(WEEKDAYS, 1)) == 1
    if "t" in s:
        ok &= _words(texts, s["t"], {"t": 1}) == 1
    y, m = np.where(ok, year, 1970), np.where(ok, month, 1)
    first = ((y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1).astype("timedelta64[M]"))
    days = first.astype("datetime64[D]").astype(np.int64)
    length = (first + np.timedelta64(1, "M")).astype("datetime64[D]").astype(np.int64) - days
    ok &= day <= length
    wall = (days + day - 1) * DAY_US
    shift = np.full(n, np.iinfo(np.int64).min)
    clock = "hour" in s
    if clock:
        hour, minute = _number(codes, s["hour"]), _number(codes, s["minute"])
        second = _number(codes, s["second"]) if "second" in s else np.zeros(n, dtype=np.int64)
        ok &= (hour < 24) & (minute < 60) & (second < 60)
        wall = wall + ((hour * 60 + minute) * 60 + second) * MICROS
        if "frac" in s:
            a, b = s["frac"]
            digits = min(b - a, 6)
            wall = wall + _number(codes, (a, a + digits)) * 10 ** (6 - digits)
        if "sign" in s:
            zh, zm = _number(codes, s["zh"]), _number(codes, s["zm"]) if "zm" in s else 0
            ok &= (zh <= 18) & (zm < 60)
            shift = np.where(codes[:, s["sign"][0]] == ord("-"), -1, 1) * (zh * 60 + zm)
        elif "zword" in s:
            found = _words(texts, s["zword"], ZONE_WORDS | dict.fromkeys(CLOCK_WORDS, 1 << 40))
            ok &= found != -MICROS
            shift = np.where(found == 1 << 40, np.iinfo(np.int64).min, found)
    return wall, shift, ok, clock


def _classes() -> np.ndarray:
    """Mask symbol by code point below 0x250: d digit, a letter, blank for white space, else the character."""
    table = np.arange(0x250, dtype=np.uint32)
    for i in range(0x250):
        c = chr(i)
        table[i] = ord("d") if "0" <= c <= "9" else ord("a") if c.isalpha() else ord(" ") if c.isspace() else i
    return table


_CLASS = _classes()
_NONE = np.iinfo(np.int64).min


def parse_batch(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, wall µs, utc µs) of each text. kind: 0 none, 1 day, 2 wall time without zone, 3 instant."""
    n = len(texts)
    kind, wall, utc = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    values = texts.to_numpy(dtype=object)
    by_length: dict[int, list[tuple[int, str]]] = {}
    for i, v in enumerate(values):
        if v is None or v != v:
            continue
        v = " ".join(v.split())
        if not v.isascii():
            v = unicodedata.normalize("NFC", v)
        if 6 <= len(v) <= LONGEST:
            by_length.setdefault(len(v), []).append((i, v))
    for size, group in by_length.items():
        rows = np.array([i for i, _ in group])
        same = np.array([v for _, v in group], dtype=f"<U{size}")
        codes = same.view(np.uint32).reshape(len(group), size)
        masks = np.where(codes < 0x250, _CLASS[np.minimum(codes, 0x24F)], ord("?")).astype(np.uint32)
        masks, back = np.unique(np.ascontiguousarray(masks).view(f"<U{size}").ravel(), return_inverse=True)
        for k, mask in enumerate(masks):
            if (plan := compile_mask(str(mask))) is None:
                continue
            at = np.flatnonzero(back == k)
            to = rows[at]
            if plan.kind == "epoch":
                utc[to], kind[to] = _number(codes[at], plan.slices["n"]) * _EPOCHS[size], 3
                continue
            w, shift, ok, clock = _parts(plan, codes[at], same[at])
            zoned = shift != _NONE
            kind[to] = np.where(ok, np.where(zoned, 3, 2 if clock else 1), 0)
            wall[to] = np.where(ok, w, 0)
            utc[to] = np.where(ok & zoned, w - np.where(zoned, shift, 0) * 60 * MICROS, 0)
    return kind, wall, utc


def normalised(text: Column, zone: Column, home: str = "Europe/Zurich", zones: tuple[str, ...] = ("Europe/Zurich", "UTC")) -> Column:
    """struct<kind, day, utc> of a text.

    ``zone`` names, row by row, the zone of wall times without one (one of ``zones``; unknown or null: ``home``).
    ``day`` is YYYY-MM-DD, of an instant in ``home``; ``utc`` is YYYY-MM-DDTHH:MM:SS.ffffffZ, of a mere day its
    midnight in ``zone``. All are null where the text denotes no real date.
    """
    tables = {z: zone_table(z) for z in {home, *zones}}

    @F.pandas_udf("kind string, day string, utc string")
    def convert(texts: pd.Series, zone_of: pd.Series) -> pd.DataFrame:
        kind, wall, utc = parse_batch(texts)
        local = kind == 3
        wall[local] = tables[home].to_wall(utc[local])
        named = zone_of.to_numpy(dtype=object)
        open_ = (kind == 1) | (kind == 2)
        for z, table in tables.items():
            mine = open_ & ((named == z) if z != home else ~np.isin(named.astype(str), [x for x in tables if x != home]))
            utc[mine] = table.to_utc(wall[mine])
        none = kind == 0
        day = np.datetime_as_string(wall.astype("datetime64[us]").astype("datetime64[D]")).astype(object)
        iso = np.char.add(np.datetime_as_string(utc.astype("datetime64[us]")), "Z").astype(object)
        word = np.array([None, "day", "wall", "instant"], dtype=object)[kind]
        day[none], iso[none] = None, None
        return pd.DataFrame({"kind": word, "day": day, "utc": iso})

    # Not deterministic for the planner only: else a filter on a field makes Spark run the function twice.
    return convert.asNondeterministic()(text, zone)
