"""Free-entered values to the entries of a reference list.

A symmetric-delete dictionary of the list's spellings is broadcast; each value looks up its own deletes, so that every
spelling within the bounded edit distance is met without comparing all. Hits are ranked by weighted
Damerau-Levenshtein distance, then by how often the list itself uses the spelling. Values without a hit are misses.

The dictionary holds at most ``BLOCK`` entries at a time: longer lists go through in blocks, each broadcast on its
own, and the best hit over all blocks counts. So what is broadcast has a fixed bound.

Defined results: null, void and wordless values are misses (target ''); ties go to the spelling that the list uses
more often, then to the first entry; repeated rows give the same result; an empty list makes every value a miss.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.llm import names

#: Entries of the reference list in one broadcast dictionary.
BLOCK = 20_000


def deletes(word: str, most: int) -> set[str]:
    """The word and all that remain of it when up to ``most`` characters are left out."""
    out = {word}
    for n in range(1, min(most, len(word) - 1) + 1):
        out.update("".join(word[i] for i in range(len(word)) if i not in gone) for gone in map(set, combinations(range(len(word)), n)))
    return out


# Letters that sound alike, folded before deletes are made.
_SOUNDS = (("sch", "s"), ("ck", "k"), ("th", "t"), ("ph", "f"), ("y", "i"), ("v", "f"), ("c", "k"), ("z", "s"), ("j", "i"))


def sound(word: str) -> str:
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


class SymmetricDelete:
    """Words that lie near a word."""

    def __init__(self, words: set[str], bound: Callable[[int], int]):
        self.bound = bound
        self.index: dict[str, list[str]] = defaultdict(list)
        self.longest = max(map(len, words), default=0)
        for w in sorted(words):
            for d in deletes(w, bound(len(w))) | deletes(sound(w), bound(len(w))):
                self.index[d].append(w)

    def near(self, word: str) -> list[tuple[float, str]]:
        most = self.bound(len(word))
        if len(word) > self.longest + most:  # too long for any word within the bound
            return []
        met = {w for d in deletes(word, most) | deletes(sound(word), most) for w in self.index.get(d, ())}
        if not most:
            met &= {word}
        found = ((names.distance(word, w, max(most, self.bound(len(w)))), w) for w in met)
        return sorted((d, w) for d, w in found if d <= max(most, self.bound(len(w))))


def _light(text: str) -> str:
    return " ".join(text.casefold().split())


@dataclass(frozen=True)
class Entry:
    """An entry of a reference list: its place, name, short form and other spellings."""

    pos: int
    name: str
    short: str | None
    forms: tuple[str, ...]


class NameMatcher:
    """Finds the entry of a list of senders that a typed name means.

    ``weights`` are those of the words of the whole list (``names.weight``), ``rare`` the weight of a word it doesn't have.
    The dictionary holds the words that tell entries apart; what it meets is compared as a whole (``names.compare``).
    """

    #: Least part of the weight of both names that has to agree.
    AGREE = 0.5

    def __init__(self, entries: list[Entry], weights: dict[str, float], rare: float):
        self.weights, self.rare = weights, rare
        self.entries = {e.name: e for e in reversed(entries)}
        self.exact: dict[str, str] = {}
        self.posting: dict[str, set[tuple[str, tuple[names.Word, ...]]]] = defaultdict(set)
        self.used: Counter[str] = Counter()
        self.spelt: dict[str, set[str]] = defaultdict(set)
        self.shorts: dict[str, set[str]] = defaultdict(set)
        for e in entries:
            self.exact.setdefault(e.name, e.name)
            for s in {_light(x) for x in [e.name, *e.forms]}:
                self.used[s] += 1
                self.spelt[e.name].add(s)
            forms = {names.weigh(names.words(x), weights, rare) for x in [e.name, *e.forms]}
            if own := names.weigh(names.words(e.name), weights, rare):
                if short := names.bare(e.short or "").strip():
                    forms.add((names.Word(short, own[0].weight), *own[1:]))
            for f in forms - {()}:
                for w in f:
                    if w is f[0] or w.weight >= names.SECOND * f[0].weight:
                        self.posting[w.text].add((e.name, f))
        for w in self.posting:
            for k in names.short_keys(w) if len(w) >= 5 else ():
                self.shorts[k].add(w)
        self.words = SymmetricDelete(set(self.posting), names.bound)

    def _met(self, typed: tuple[names.Word, ...]) -> set[str]:
        met = {w for t in typed for _, w in self.words.near(t.text)}
        for t in typed:
            if names.is_short(t.text):
                met |= {w for w in self.shorts.get(t.text[:3], ()) if names.short_cost(t.text, w) is not None}
            if len(t.text) >= 8:
                # Words written as one: what stands before or after a word of the list, else all beginnings.
                cuts = range(4, len(t.text) - 1)
                parts = [p for c in cuts for p, q in ((t.text[:c], t.text[c:]), (t.text[c:], t.text[:c])) if q in self.weights]
                found = {w for p in parts for _, w in self.words.near(p)}
                met |= found or ({w for c in cuts for _, w in self.words.near(t.text[:c])} if not met else set())
        return met

    def __call__(self, raw: str) -> tuple[float, str]:
        """(score, name); a score of 9 and '' for a miss."""
        if (name := self.exact.get(" ".join(raw.split()))) is not None:
            return 0.0, name
        typed = names.weigh(names.words(raw), self.weights, self.rare)
        best: dict[str, float] = {}
        for name, form in {x for w in self._met(typed) for x in self.posting[w]}:
            if (hit := names.compare(typed, form)) and hit[1] >= self.AGREE:
                best[name] = min(best.get(name, 9.0), hit[0])
        if not best:
            return 9.0, ""
        least = min(best.values())
        return least, min((x for x, s in best.items() if s <= least + 0.05), key=lambda x: self.rank(raw, x))

    def rank(self, raw: str, name: str) -> tuple:
        """Of names that fit alike: the one with the typed spelling, the one the list uses more, the first."""
        light = _light(raw)
        return (light not in self.spelt[name], -self.used[_light(name)], self.entries[name].pos)


# Words and signs around a type of document that don't belong to it.
_AROUND = re.compile(r"\([^)]*\)|\bnr\.? ?\d*|\bvom \d+\.? ?\w*|\b(?:neue?[rs]?|orig|original|div|diverse|definitiv|provisorisch|kopie|entwurf)\b\.?|\d+/\d+|\b\d+\b\.?")


def type_words(text: str) -> str:
    text = _AROUND.sub(" ", names.fold(text))
    words = [w.translate(names._DIGITS) if any(c.isdigit() for c in w) else w for w in re.findall(r"[^\W_]+", text)]
    return " ".join(w for w in words if not w.isdigit())


class TermMatcher:
    """Finds the entry of a list of terms that a typed term means."""

    def __init__(self, entries: list[Entry], weights: dict[str, float] | None = None, rare: float = 0.0):
        self.entry: dict[str, str] = {}
        self.pos = {e.name: e.pos for e in reversed(entries)}
        self.used: Counter[str] = Counter()
        for e in entries:
            for term in {type_words(x) for x in [e.name, *e.forms]} - {""}:
                self.entry.setdefault(term, e.name)
                self.used[term] += 1
        self.words = SymmetricDelete(set(self.entry), lambda n: 0 if n < 5 else 1 if n < 7 else 2 if n < 10 else 3)

    def __call__(self, raw: str) -> tuple[float, str]:
        if not (text := type_words(raw)):
            return 9.0, ""
        if text in self.entry:
            return 0.0, self.entry[text]
        found = self.words.near(text)
        if not found:
            return 9.0, ""
        d, word = min(found, key=lambda x: (x[0], -self.used[x[1]], x[1]))
        return d, self.entry[word]

    def rank(self, raw: str, name: str) -> tuple:
        return (0, -self.used[type_words(raw)], self.pos[name])


def match_values(values: DataFrame, reference: DataFrame, matcher: type, block: int = BLOCK) -> DataFrame:
    """``values`` (with a string column ``wert``) and the entry ``ziel`` that each means, '' for a miss.

    ``reference``: name, kurz, formen (array of spellings), and pos for their order. Distinct values are matched, each
    with every block of the list, and the best hit over all blocks counts by the same rank as within one. The weights of
    words are those of the whole list, whatever the blocks.
    """
    reference = reference.where("name is not null").select("pos", "name", "kurz", F.coalesce("formen", F.array().cast("array<string>")).alias("formen"))
    n = reference.count()
    blocks = max(1, -(-n // block))
    weights = _weights(reference, n)
    distinct = values.select("wert").distinct() if blocks > 1 else values
    parts = [_matched(distinct, reference.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b) if blocks > 1 else reference, weights, names.rarest(n), matcher) for b in range(blocks)]
    if blocks == 1:
        return parts[0].drop("_score", "_rank")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    least = every.groupBy(F.col("wert").alias("_w")).agg(F.min("_score").alias("_least"))
    close = every.join(least, F.col("wert").eqNullSafe(F.col("_w"))).where(F.col("_score") <= F.col("_least") + 0.05)
    best = close.groupBy("wert").agg(F.min_by("ziel", F.struct("_rank", "ziel")).alias("ziel")).withColumnRenamed("wert", "_w")
    return values.join(best, F.col("wert").eqNullSafe(F.col("_w")), "left").drop("_w")


def _weights(reference: DataFrame, n: int) -> DataFrame:
    """(word, weight) of the words of the list."""
    spelt = reference.select(F.col("name").alias("entry"), F.explode(F.concat(F.array("name"), "formen")).alias("form")).distinct()
    return names.weight(names.word_counts(names.split_words(spelt, "form")), n)


def _matched(values: DataFrame, rows: DataFrame, weights: DataFrame, rare: float, matcher: type) -> DataFrame:
    entries = [Entry(i, r["name"], r["kurz"], tuple(x for x in r["formen"] if x)) for i, r in enumerate(rows.orderBy("pos", "name").collect())]
    own = names.split_words(rows.select(F.explode(F.concat(F.array("name"), "formen")).alias("form")), "form").select(F.explode("words").alias("word")).distinct()
    known = {r["word"]: r["weight"] for r in weights.join(own, "word", "left_semi").collect()}
    schema = T.StructType([*values.schema.fields, T.StructField("ziel", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_rank", T.ArrayType(T.LongType()))])
    shared = values.sparkSession.sparkContext.broadcast((entries, known, rare))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, met = None, {}
        for batch in batches:
            find = find or matcher(*shared.value)
            hits = []
            for raw in batch["wert"].tolist():
                if raw not in met:
                    if len(met) > 500_000:
                        met.clear()
                    score, ziel = find(raw) if isinstance(raw, str) else (9.0, "")
                    met[raw] = score, ziel, [int(x) for x in find.rank(raw, ziel)] if ziel else []
                hits.append(met[raw])
            yield batch.assign(ziel=[h[1] for h in hits], _score=[h[0] for h in hits], _rank=[h[2] for h in hits])

    return values.mapInPandas(run, schema)
