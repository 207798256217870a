"""Names of organisations and persons as people type them, and how they are compared.

``words`` gives the words of a name in one spelling: no legal form, forms of address, remarks in brackets or signs, digits
among letters read as the letters they stand for. What a word counts for is learned from the names themselves
(``word_counts``): a rare word tells names apart, a frequent one less, and one that is missing from other spellings of the
same entry (departments, places, remarks) does not count at all. ``compare`` lines up two names by these weights.

Null, blank and wordless texts have no words and are like nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word that other spellings of the same entry hold less often than this counts for nothing, if it is met in at least so
#: many entries and other spellings.
CONSTANT, SEEN = 0.5, 3
#: Words of less than this part of the largest weight are of the second rank: line of business, first name.
SECOND = 0.72

# Forms of address, and small words that stand in names.
TITLES = set("dr prof med dipl ing fam familie frau herr herrn madame monsieur mme signor signora mr mrs".split())
SMALL = set("der die das und von fur de la le les des du della et e".split())
# Legal forms in several languages.
_LEGAL = (
    re.compile(r"(?<!\w)(?:g\.? ?m\.? ?b\.? ?h\b\.?|s\.? ?[àa] ?\.? ?r\.? ?l\b\.?|s\.? ?r\.? ?l\b\.?)", re.I),
    re.compile(r"(?<!\w)(?:genossenschaft|genoss\b\.?|gen\b\.?|aktiengesellschaft|e\. ?v\.|ltd\b\.?|inc\b\.?|plc\b|s\.?p\.?a\b\.?)", re.I),
    re.compile(r"(?<!\w)(?:a\.? ?g\b\.?|s\.? ?a\b\.?|k\.? ?g\b\.?)(?!\w)", re.I),
    re.compile(r"(?:&|\+|(?<!\w)und(?!\w)) ?co\b\.*", re.I),
)
# Pet forms of given names that no rule of spelling gives.
PET_FORMS = {
    "alois": "wisi", "anna": "anneli nanni", "bartholomaus": "bartli", "elisabeth": "elsi bethli lilo", "franz": "franky",
    "franziska": "fanny", "georg": "schorsch jurg jorg", "giovanni": "gianni nino", "giuseppe": "beppe peppino", "heinrich": "heiri heinz",
    "jakob": "joggi", "johann": "hans hannes schang", "josef": "sepp beppi", "karl": "kari charly", "ludwig": "lutz", "luigi": "gigi",
    "magdalena": "leni madlen", "margaretha": "grit gritli margrit", "matthias": "hias", "nikolaus": "niggi claus", "richard": "dick",
    "robert": "bob", "rudolf": "ruedi", "theresia": "resi", "walter": "wadi walti", "wilhelm": "helmi", "william": "bill",
}
_PETS = {frozenset((f, p)) for f, every in PET_FORMS.items() for p in every.split()}
_DIGITS = str.maketrans("0158", "olsb")
_VOWELS = set("aeiouy")


def bare(text: str) -> str:
    """Lower case without marks."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def fold(text: str) -> str:
    """``bare``, and written-out umlauts become base letters too. For known words; in names these may be two vowels."""
    return bare(text).replace("ae", "a").replace("oe", "o").replace("ue", "u")


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance; glyphs and letters that are easily taken for each other cost half.

    Returns a value above ``most`` as soon as no path can stay within it.
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    before: list[float] = []
    row = [float(j) for j in range(m + 1)]
    band = int(most / 0.7) + 1  # farther from the diagonal no path can stay within ``most``
    for i in range(1, n + 1):
        now = [float(i)] + [most + 1] * m
        x = a[i - 1]
        for j in range(max(1, i - band), min(m, i + band) + 1):
            y = b[j - 1]
            cost = row[j - 1] + (0.0 if x == y else 0.5 if (x, y) in _ALIKE or (y, x) in _ALIKE else 1.0)
            cost = min(cost, row[j] + (0.7 if i > 1 and x == a[i - 2] else 1.0), now[j - 1] + (0.7 if j > 1 and y == b[j - 2] else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, before[j - 2] + 0.8)
            now[j] = cost
        if min(now) > most and (not row or min(row) > most):
            return most + 1
        before, row = row, now
    return row[m]


# Pairs that are often taken for each other, in reading, by ear or on the keyboard's wrong key.
_ALIKE = {tuple(p) for p in "il lt vf kc kg td bp sz iy ij ea ce rn mn uv oq gq hb eo ao nu zs xc rt dt ui".split()}


@lru_cache(maxsize=200_000)
def words(raw: str | None) -> tuple[str, ...]:
    """The words of a name, in their order, each once; single letters are initials."""
    if not raw:
        return ()
    text = unicodedata.normalize("NFKC", raw).replace("_", " ")
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"[\"“”„«»*'`´]", " ", text)
    for pattern in _LEGAL:
        text = pattern.sub(" ", text)
    # Parts of one word: short forms with a hyphen, and single letters before one.
    text = re.sub(r"\.-", "", bare(text))
    text = re.sub(r"\b(\w)-(?=\w{3})", r"\1", re.sub(r"\s+", " ", text))
    text = re.sub(r"(?<=\w) in \w+", " ", text)
    out = []
    for w in re.findall(r"[^\W_]+", text):
        if w.isdigit() or w in TITLES or w in SMALL:
            continue
        out.append(w.translate(_DIGITS) if any(c.isdigit() for c in w) else w)
    return tuple(dict.fromkeys(out))


def bound(n: int) -> int:
    """Greatest distance of two spellings of a word of n letters."""
    return 0 if n < 4 else 1 if n < 7 else 2


def _within(short: str, long: str) -> bool:
    """All letters of the one stand in the other, in their order."""
    rest = iter(long)
    return all(c in rest for c in short)


@lru_cache(maxsize=500_000)
def related(a: str, b: str) -> bool:
    """Whether two words of the second rank may stand for each other: equal but for slips, an initial, a short form (its
    letters stand in the word, the first one first), a part, a pet form of a given name."""
    if a == b or fold(a) == fold(b):
        return True
    a, b = sorted((fold(a), fold(b)), key=len)
    if len(a) == 1:
        return a == b[0]
    if a[0] == b[0] and _within(a, b):
        return True
    if frozenset((a, b)) in _PETS:
        return True
    most = min(bound(len(a)), bound(len(b)))
    if most and distance(a, b, most) <= most:
        return True
    if len(a) >= 4 and len(b) - len(a) >= 3 and (b.startswith(a) or b.endswith(a)):
        return True
    stem = re.sub(r"(.)\1+", r"\1", re.sub(r"(?:li|el|ie|[iyesu])$", "", a))
    if len(stem) < 2:
        return False
    if stem[0] == b[0] and _within(stem, b):
        return True
    if len(stem) >= 3 and (stem in b or len(stem) >= 4 and _within(stem, b)):
        return True
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return same >= 3 and len(a) - same <= 2


def is_short(word: str) -> bool:
    """A short form of a name: four to six letters that begin with three consonants."""
    return 4 <= len(word) <= 6 and not _VOWELS & set(word[:3])


def short_cost(short: str, word: str) -> float | None:
    """How far a short form is from the usual way to shorten the word (leading consonants, then the end); None where it
    can't stand for it. A consonant that is passed over costs 1, another last letter 1."""
    if len(word) < len(short) + 2 or short[0] != word[0]:
        return None
    cost, at = 0.0, 0
    for k, c in enumerate(short):
        near = word.find(c, at)
        if near < 0:
            return None
        # The last letters may be those of the word's end.
        if k >= len(short) - 2 and word.endswith(short[k:]) and len(word) - (len(short) - k) >= at:
            return cost
        cost += sum(x not in _VOWELS for x in word[at:near])
        at = near + 1
    return cost + 1


def short_keys(word: str) -> set[str]:
    """Beginnings of three letters that short forms of a word may have."""
    out = set()
    for i in range(1, len(word)):
        out.update(word[0] + word[i] + c for c in set(word[i + 1 :]))
    return out


@dataclass(frozen=True)
class Word:
    text: str
    weight: float


def weigh(found: Iterable[str], weight_of: dict[str, float], rare: float) -> tuple[Word, ...]:
    """Words with their weights, heaviest first; those without weight fall away, unknown ones are rare."""
    out = [Word(w, weight_of.get(w, rare) if len(w) > 1 else 0.1) for w in found]
    return tuple(sorted((w for w in out if w.weight > 0), key=lambda w: (-w.weight, w.text)))


def compare(a: tuple[Word, ...], b: tuple[Word, ...]) -> tuple[float, float] | None:
    """(cost, part of the weight that agrees) of two names; None where they contradict each other: a word of either is
    left over that nothing in the other explains. The cost adds up the distances of the words that are the same."""
    if not a or not b:
        return None
    left, right = list(a), list(b)
    cost = met = 0.0
    heaviest = max(a[0].weight, b[0].weight)
    total = sum(w.weight for w in a) + sum(w.weight for w in b)
    first, pairs = False, 0

    def take(x: Word, y: Word, d: float) -> None:
        nonlocal cost, met, first, pairs
        pairs += 1
        left.remove(x)
        right.remove(y)
        cost += d
        met += x.weight + y.weight
        first = first or max(x.weight, y.weight) >= SECOND * heaviest and len(x.text) > 1 and len(y.text) > 1

    for x in a:
        for y in [y for y in right if y.text == x.text][:1]:
            take(x, y, 0.0)
    # Words written as one.
    for one, other in ((left, right), (right, left)):
        for x in [w for w in one if len(w.text) >= 8]:
            if hit := _glued(x.text, [w for w in other]):
                d, y, z = hit
                one.remove(x)
                other.remove(y)
                if z is not None:
                    other.remove(z)
                cost += d
                pairs += 2
                met += x.weight + y.weight + (z.weight if z else 0)
                first = first or y.weight >= SECOND * heaviest
    # Nearest spellings first.
    near = []
    for x in left:
        for y in right:
            most = max(bound(len(x.text)), bound(len(y.text)))
            if min(len(x.text), len(y.text)) > 3 and (d := distance(x.text, y.text, most)) <= most:
                near.append((d, x, y))
    for d, x, y in sorted(near, key=lambda n: (n[0], n[1].text, n[2].text)):
        if x in left and y in right:
            take(x, y, d)
    # Short forms and other spellings of words of the second rank; initials wait for what is left.
    for x in [w for w in left if len(w.text) > 1]:
        for y in [w for w in right if len(w.text) > 1]:
            light = min(x.weight, y.weight) < SECOND * heaviest
            if related(x.text, y.text) and (light or first):
                take(x, y, 0.1)
                break
            short, long = sorted((x.text, y.text), key=len)
            if is_short(short) and (c := short_cost(short, long)) is not None and c <= 1:
                take(x, y, 0.4 + c * 0.3)
                break
    rest_left, rest_right = ([w for w in side if len(w.text) > 1] for side in (left, right))
    initials = [{w.text for w in side if len(w.text) == 1} for side in (left, right)]
    # An initial stands for a word that is left over on the other side, or else for the same initial.
    for rest, letters in ((rest_left, initials[1]), (rest_right, initials[0])):
        for w in [w for w in rest if letters]:
            if hit := next((c for c in sorted(letters) if related(c, w.text)), None):
                letters.discard(hit)
                rest.remove(w)
                cost, pairs, met = cost + 0.1, pairs + 1, met + w.weight
                total -= 0.1
            elif pairs == 1:
                return None
    if pairs == 1 and all(initials) and not initials[0] & initials[1]:
        return None
    if rest_left and rest_right or not first:
        return None
    # Where one name says more and nothing beside the one word agrees, that word has to be nearly equal.
    if (rest_left or rest_right) and pairs == 1 and cost > 0.75:
        return None
    return cost + 0.2 * (len(rest_left) + len(rest_right)), met / total


def _glued(x: str, others: list[Word]) -> tuple[float, Word, Word | None] | None:
    """The word, or two words, that x is when written as one."""
    best, firsts = None, {z.text[0] for z in others}
    for y in others:
        if len(y.text) < 5:
            continue
        for cut in range(len(y.text) - 1, len(y.text) + 2):
            for head, tail in ((x[:cut], x[cut:]), (x[-cut:], x[:-cut])):
                if len(tail) < 2 or tail[0] not in firsts:
                    continue
                most = bound(len(y.text))
                if (d := distance(head, y.text, most)) > most:
                    continue
                for z in others:
                    if z != y and z.text[0] == tail[0] and z.weight <= y.weight and related(tail, z.text) and (best is None or d < best[0]):
                        best = (d, y, z)
    return best


def word_counts(forms: DataFrame) -> DataFrame:
    """(word, df, seen, constant) from rows (entry, form, words array<string>): ``df`` entries hold the word; of ``seen``
    other spellings of these entries the part ``constant`` has the word or one that begins or ends alike (the first letter,
    or the last three) and so may be another form of it.

    Counts only, so an entry with very many spellings is never gathered; a word of an entry meets its other spellings
    through the number of those with such a word.
    """
    every = forms.select("entry", "form", F.explode("words").alias("word")).distinct()
    spelt = forms.select("entry", "form").distinct().groupBy("entry").agg(F.count("*").alias("spelt"))
    ends = F.array(F.concat(F.lit("^"), F.substring("word", 1, 1)), F.concat(F.lit("$"), F.right("word", F.lit(3))))
    parts = every.select("entry", "form", "word", F.explode(ends).alias("part"))
    alike = parts.select("entry", "form", "part").distinct().groupBy("entry", "part").agg(F.count("*").alias("alike"))
    own = parts.groupBy("entry", "part", "word").agg(F.count("*").alias("own"))
    joined = own.join(spelt, "entry").join(alike, ["entry", "part"])
    side = F.substring("part", 1, 1)
    sums = joined.groupBy("word", side.alias("side")).agg(F.countDistinct("entry").alias("df"), F.sum(F.col("own") * (F.col("spelt") - 1)).alias("seen"), F.sum(F.col("own") * (F.col("alike") - 1)).alias("kept"))
    kept = F.when(F.col("seen") > 0, F.col("kept") / F.col("seen")).otherwise(F.lit(1.0))
    return sums.groupBy("word").agg(F.max("df").alias("df"), F.max("seen").alias("seen"), F.max(kept).alias("constant"))


def weight(counts: DataFrame, entries: int) -> DataFrame:
    """(word, weight) of ``word_counts``: 0 for words that other spellings leave out, else the rarer the higher."""
    aside = (F.least("seen", "df") >= SEEN) & (F.col("constant") < CONSTANT)
    return counts.select("word", F.when(aside, F.lit(0.0)).otherwise(F.log1p(F.lit(float(entries)) / F.col("df"))).alias("weight"))


def rarest(entries: int) -> float:
    return math.log1p(float(max(entries, 1)))


def split_words(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a column ``words`` of the words of a column of names."""

    @F.pandas_udf("array<string>")
    def cut(names: pd.Series) -> pd.Series:
        return pd.Series([list(words(x if isinstance(x, str) else None)) for x in names.tolist()])

    return rows.withColumn("words", cut(text))
