"""Repair of text from scanned pages.

Corpus statistics come from all rows: word counts, neighbours, and how often a word stands in lines next to a page
boundary. Skip-gram vectors are learnt by negative sampling from all neighbours of all words, in rounds of batches over
the cluster; words share a table of fixed size by two digests each, so every word has a vector and none is cut off. Rare
words are linked to frequent ones that undoing a plausible glyph error yields; of several, the nearness of the vectors,
the context and the frequency decide. With running heads and page numbers found, words broken over lines are joined, and
the rest is reflowed into paragraphs.

Defined results: null and void texts give nothing; null elements of line arrays are skipped; repeated rows count once
in the result; a word that no frequent word explains stays as it is.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.names import distance
from letterloom.runtime import written

#: Rows and width of the table of vectors, which fixes its size; rounds of training, negative words to a pair, first step.
BUCKETS, DIMENSIONS, ROUNDS, NEGATIVE, STEP = 1 << 15, 24, 3, 4, 0.25
#: The most frequent words without a correction, which the workers need not report; how many changes no result.
COMMON = 3000
#: Words of running heads that are compared with others at a time; all are, block by block.
HEAD_BLOCK = 20_000
#: A frequent word is at least so frequent, and so many times as frequent as the misread one.
LEAST, RATIO = 4, 6

# What a scanner reads, and what may have stood there.
GLYPHS = {
    "c": ("e",), "f": ("t",), "l": ("i",), "v": ("u",), "q": ("g",), "1": ("l", "i"), "0": ("o", "O"), "5": ("S", "s"), "8": ("B",), "6": ("G",), "9": ("g",),
    "rn": ("m",), "m": ("rn",), "li": ("h",), "cl": ("d",), "ii": ("ü",), "vv": ("w",), "nn": ("m",), "a": ("ä",), "o": ("ö",), "u": ("ü",), "I": ("l",), "h": ("b",), "b": ("h",), "n": ("u",), "i": ("l",), "t": ("f",), "e": ("c",),
}
# Signs that may stand for a hyphen at the end of a line.
HYPHENS = "-­‐‑‒–¬~_="
# Words that follow the first part of a coordinated compound.
COORDINATE = {"und", "oder", "sowie", "bzw", "bis", "als", "wie", "noch"}

_MARK = re.compile(r"\s*-{2,}\s*Seite\s+\d+\s*-{2,}\s*$")
_NUMBER = re.compile(r"\s*(?:[-–—\[(|]\s*)?(?:(?P<w>[^\W\d_]{1,6}\.?)\s*)?\d{1,4}(?:\s*(?:/|von|of|de|sur|di)\s*\d{1,4})?(?:\s*[-–—\])|])?\s*$", re.I)
_NUMBER_WORDS = {"seite", "s.", "blatt", "page", "p.", "pag.", "pagina"}
_EDGE = " \t.,;:!?()[]{}\"“”„«»…*"
_VOID = {"", "null", "none", "n/a", "-", "–", "—"}


def is_number(line: str) -> bool:
    """A line that bears only a page number."""
    if not (m := _NUMBER.match(line)) or _MARK.match(line):
        return False
    w = (m["w"] or "").lower()
    return not w or w in _NUMBER_WORDS or len(w) >= 4 and any(len(k) >= 5 and distance(w, k, 1) <= 1 for k in _NUMBER_WORDS)


def words(line: str) -> list[str]:
    return [w for w in (t.strip(_EDGE) for t in line.split()) if w]


@lru_cache(maxsize=500_000)
def plain(word: str) -> bool:
    """A word of letters, with digits among them at most where a glyph may be one."""
    letters = sum(c.isalpha() for c in word)
    return len(word) >= 3 and letters >= 2 and letters * 2 >= len(word) and all(c.isalnum() or c in "-'’" for c in word) and not (word[0].isdigit() and letters < 4) and not word[-1:].isdigit()


def boundaries(lines: list[str]) -> set[int]:
    """Lines that stand next to the end of a page: the two beside marks and page numbers, and at either end."""
    solid = [i for i, x in enumerate(lines) if x.strip()]
    ends = [-1] + [k for k, i in enumerate(solid) if _MARK.match(lines[i]) or is_number(lines[i])] + [len(solid)]
    near = {solid[k + s] for k in ends for s in (-2, -1, 1, 2) if 0 <= k + s < len(solid)}
    return {i for i in near if not _MARK.match(lines[i]) and not is_number(lines[i])}


def head_form(line: str) -> list[str]:
    """The words of a line that has the form of a running head; none for other lines."""
    text = line.strip()
    if not text or len(text) > 90 or text[-1] in ".!?;:" or text[0].islower() or re.search(r"[^\W\d_]{2}\.\s", text):
        return []
    found = [w for w in words(text) if any(c.isalpha() for c in w) and len(w) > 2]
    return found if len(found) <= 8 else []


def misread_heads(known: list[tuple[str, int, bool]], heads: list[tuple[str, int]]) -> list[str]:
    """Those of ``known`` (word, count, whether it is a word of the body) that one of ``heads`` (word, count) misread may be."""
    by_size: dict[int, list[tuple[str, int]]] = {}
    for x, n in heads:
        by_size.setdefault(len(x), []).append((x, n))
    out = []
    for w, n, body in known:
        if len(w) < 6:
            continue
        # A word of the body is a misread one only where a single glyph differs from a far more frequent word of heads.
        most, least = (0.5, 5 * n) if body else (1 if len(w) < 8 else 2, 0)
        plain_w = w.replace("'", "~")
        if any(k >= least and distance(plain_w, x, most) <= most for m in range(len(w) - 2, len(w) + 3) for x, k in by_size.get(m, ())):
            out.append(w)
    return out


def layout(lines: list[str], heads: set[str]) -> list[str]:
    """mark, number, head, blank or text for each line."""
    return ["mark" if _MARK.match(x) else "blank" if x.strip().lower() in _VOID and x.strip() in ("", *"-–—") else "number" if is_number(x) else "head" if x.strip() in heads else "text" for x in lines]


def broken(first_line: str, second_line: str) -> tuple[str, str, str] | None:
    """(first part, second part, sign) of a word that a sign at the end of the line breaks; the sign may be followed by
    blanks or a speck, or be preceded by a blank."""
    end = first_line.rstrip()
    if end.endswith(".") and len(end) > 1 and end[-2] in HYPHENS:
        end = end[:-1]
    if not end or end[-1] not in HYPHENS:
        return None
    sign, head = end[-1], end[:-1]
    spaced = head.endswith((" ", "\t"))
    head = head.rstrip()
    if spaced and sign in "–—" or not head or not head[-1].isalnum():
        return None
    first = head.split()[-1].lstrip(_EDGE + "-–")
    rest = second_line.split()
    if not rest:
        return None
    second = rest[0].strip(_EDGE)
    if not first or not second or not second[0].isalpha() or second.lower().rstrip(".") in COORDINATE or "@" in first:
        return None
    return first, second, sign


def joined(first: str, second: str) -> str:
    """The whole word: a capital after small letters keeps the word's own hyphen."""
    own = second[0].isupper() and not (first.isupper() and second.isupper())
    return f"{first}-{second}" if own else first + second


def text_pairs(lines: list[str], kinds: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring lines of text, across furniture; a blank line between ends a paragraph unless the page ends there."""
    last, page = None, False
    for i, k in enumerate(kinds):
        if k == "text":
            if last is not None:
                yield last, i
            last, page = i, False
        elif k in ("mark", "number", "head"):
            page = True
        elif k == "blank" and not page and last is not None and not any(x in ("mark", "number", "head") for x in kinds[i + 1 : i + 4]):
            if lines[last].rstrip()[-1:] not in HYPHENS:
                last = None


def undone(word: str, most: int = 2) -> set[str]:
    """What may have stood there: up to ``most`` glyph errors undone."""
    sites = [(i, len(g), r) for g, reads in GLYPHS.items() for i in range(len(word) - len(g) + 1) if word[i : i + len(g)] == g for r in reads]
    out = set()
    for i, n, r in sites:
        out.add(word[:i] + r + word[i + n :])
    if most > 1 and len(word) >= 6:
        strong = [s for s in sites if word[s[0] : s[0] + s[1]] not in ("a", "o", "u", "h", "b", "n", "m", "i", "t", "e")]
        for a, b in itertools.combinations(sorted(strong), 2):
            if a[0] + a[1] <= b[0]:
                out.add(word[: a[0]] + a[2] + word[a[0] + a[1] : b[0]] + b[2] + word[b[0] + b[1] :])
    out.discard(word)
    return out


def pages(df: DataFrame, key: str, texts: list[str], arrays: list[str]) -> DataFrame:
    """(doc, feld, lines): one row for each text or array of lines that is not void."""
    parts = [F.struct(F.lit(c).alias("feld"), F.split(F.col(c), r"\r\n|[\n\r \x0b\x0c]", -1).alias("lines")) for c in texts]
    parts += [F.struct(F.lit(c).alias("feld"), F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.split(x, "\n", -1))).alias("lines")) for c in arrays]
    return df.select(F.col(key).alias("doc"), F.explode(F.array(*parts)).alias("x")).select("doc", "x.feld", "x.lines").where(F.col("lines").isNotNull() & (F.size("lines") > 0) & F.col("doc").isNotNull())


def statistics(rows: DataFrame) -> DataFrame:
    """(kind, a, b, n) over all rows: word counts (w), words near page boundaries (p), first words of lines in the form of
    running heads (f) and neighbours within two words (c).

    Each task adds up first; neighbours are counted for words that are frequent in the task's own rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, beside, firsts, pairs = Counter(), Counter(), Counter(), Counter()

        def flush() -> pd.DataFrame:
            out = [("w", w, "", n) for w, n in every.items()] + [("p", w, "", n) for w, n in beside.items()] + [("f", w, "", n) for w, n in firsts.items()]
            out += [("c", a, b, n) for (a, b), n in pairs.items() if a and b]
            for c in (every, beside, firsts, pairs):
                c.clear()
            return pd.DataFrame(out, columns=["kind", "a", "b", "n"])

        for batch in batches:
            for lines in batch["lines"]:
                lines = [x or "" for x in lines]
                near = boundaries(lines)
                open_ = False
                for i, line in enumerate(lines):
                    if not line.strip() or _MARK.match(line) or is_number(line):
                        continue
                    firsts.update(head_form(line)[:1])
                    found = words(line)
                    cut = line.rstrip().rstrip(".")[-1:] in HYPHENS
                    inner = [w if plain(w) else "" for w in found[int(open_ and i not in near) : -1 if cut else None]]
                    open_ = cut
                    known = [w for w in inner if w]
                    every.update(known)
                    if i in near:
                        beside.update(known)
                    pairs.update(zip(inner, inner[1:]))
                    pairs.update(zip(inner, inner[2:]))
            if len(every) + len(firsts) + len(pairs) > 400_000:
                yield flush()
        yield flush()

    return rows.mapInPandas(run, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=300_000)
def places(word: str) -> tuple[int, int]:
    """Two rows of the table of vectors; a word's vector is their sum."""
    d = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return d % BUCKETS, (d >> 32) % BUCKETS


def _trained(a: np.ndarray, b: np.ndarray, n: np.ndarray, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """What one pass over pairs (places of word and neighbour, count) adds to the table (words, neighbours): ascent on the
    likelihood of the pairs against words drawn by their smoothed frequency, with a step of its own for each row."""
    new, grown = table.copy(), np.full(table.shape[:2], 1e-3, dtype=np.float32)
    weight = np.power(n, 0.75)
    noise = np.cumsum(weight) / weight.sum()
    weight = (weight / weight.mean()).astype(np.float32)
    order = rng.permutation(len(a))
    for lo in range(0, len(order), 8192):
        at = order[lo : lo + 8192]
        left = new[0][a[at]].sum(axis=1)
        others = b[np.searchsorted(noise, rng.random((len(at), NEGATIVE)))]
        right = np.concatenate([b[at][:, None], others], axis=1)
        vectors = new[1][right].sum(axis=2)
        score = np.einsum("id,ikd->ik", left, vectors)
        g = -1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g[:, 0] += 1
        g *= np.minimum(weight[at], 20)[:, None]
        sides = ((0, a[at].ravel(), np.repeat(np.einsum("ik,ikd->id", g, vectors), 2, axis=0)), (1, right.ravel(), np.repeat((g[:, :, None] * left[:, None, :]).reshape(-1, left.shape[1]), 2, axis=0)))
        for side, rows, slope in sides:
            own, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(own), slope.shape[1]), dtype=np.float32)
            np.add.at(total, where, slope)
            grown[side, own] += (total * total).mean(axis=1)
            new[side, own] += STEP * total / np.sqrt(grown[side, own])[:, None]
    return new - table


def skip_grams(pairs: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The table of vectors [words or neighbours, row, width] from all neighbours (a, b, n) of all texts.

    Each task passes over its pairs from the table so far; what the tasks add is averaged row by row in the cluster, and
    only the table itself, of a fixed size, goes to the driver and back.
    """
    table = np.zeros((2, BUCKETS, DIMENSIONS), dtype=np.float32)
    table[0] = np.random.default_rng(7).normal(scale=0.1, size=table[0].shape)
    context = pairs.sparkSession.sparkContext
    for k in range(rounds):
        shared = context.broadcast(table)

        def run(batches: Iterator[pd.DataFrame], shared=shared, k=k) -> Iterator[pd.DataFrame]:
            for x in batches:
                a, b = np.array([places(w) for w in x["a"]], dtype=np.int64).reshape(-1, 2), np.array([places(w) for w in x["b"]], dtype=np.int64).reshape(-1, 2)
                n = np.tile(x["n"].to_numpy(dtype=np.float64), 2)
                if not len(n):
                    continue
                # The seed comes from the rows, so a task that runs again adds the same.
                rng = np.random.default_rng([k, len(n), int(n.sum())])
                more = _trained(np.concatenate([a, b]), np.concatenate([b, a]), n, shared.value, rng)
                for side in (0, 1):
                    rows = np.flatnonzero(np.abs(more[side]).max(axis=1) > 0)
                    for part in range(16):
                        own = rows[rows % 16 == part]
                        yield pd.DataFrame({"side": [side], "part": [part], "rows": [own.astype(np.int32).tobytes()], "more": [more[side, own].tobytes()]})

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            total, met = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32), np.zeros(BUCKETS, dtype=np.float32)
            for rows, more in zip(pdf["rows"], pdf["more"], strict=True):
                own = np.frombuffer(rows, dtype=np.int32)
                total[own] += np.frombuffer(more, dtype=np.float32).reshape(-1, DIMENSIONS)
                met[own] += 1
            own = np.flatnonzero(met)
            return pd.DataFrame({"side": [pdf["side"].iloc[0]], "rows": [own.astype(np.int32).tobytes()], "more": [(total[own] / met[own, None]).tobytes()]})

        added = pairs.mapInPandas(run, "side int, part int, rows binary, more binary").groupBy("side", "part").applyInPandas(mean, "side int, rows binary, more binary")
        table = table.copy()
        for r in added.collect():
            table[r["side"], np.frombuffer(r["rows"], dtype=np.int32)] += np.frombuffer(r["more"], dtype=np.float32).reshape(-1, DIMENSIONS)
        shared.destroy()
    return table


class Reader:
    """What the workers need to know: the common words and the table of vectors, both of a fixed size."""

    def __init__(self, common: set[str], table: np.ndarray):
        self.common = common
        self.table = table
        self.known: dict[tuple[int, str], np.ndarray] = {}

    def vector(self, word: str, side: int = 0) -> np.ndarray:
        v = self.known.get((side, word))
        if v is None:
            if len(self.known) > 200_000:
                self.known.clear()
            v = self.known[side, word] = self.table[side, places(word)].sum(axis=0) if side else _unit(self.table[0, places(word)].sum(axis=0))
        return v

    def context(self, found: list[str], i: int) -> list[str]:
        return [w for w in found[max(0, i - 2) : i] + found[i + 1 : i + 3] if plain(w)]

    def fit(self, word: str, right: str, n: int, context: list[str]) -> float:
        """How well a frequent word stands for a rare one: by its frequency, the nearness of their vectors, and how likely
        it is in the context."""
        near = float(self.vector(word) @ self.vector(right))
        likely = float(np.mean([np.tanh(self.table[0, places(right)].sum(axis=0) @ self.vector(c, 1)) for c in context])) if context else 0.0
        return math.log(n) + 2 * near + 2 * likely


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-9)


def head_words(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, head, body) of the distinct words ``wanted``. Words of running heads stand next to page boundaries and hardly
    anywhere else, or are one of those misread; every word is told by its own counts, joined to it."""
    head = (F.col("near") >= 3) & (F.col("near") >= 1.5 * (F.col("n") - F.col("near")))
    body = (F.col("n") - F.col("near") >= 5) & (F.col("n") - F.col("near") > F.col("near"))
    known = wanted.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(head, F.lit(False)).alias("head"), F.coalesce(body, F.lit(False)).alias("body"))
    known = written(known, "scan-known")
    heads = counts.where(head & (F.length("word") >= 6)).select("word", "n")
    blocks = max(1, -(-heads.count() // HEAD_BLOCK))
    found = known.where("head").select("word")
    for b in range(blocks):
        block = [(r["word"], r["n"]) for r in heads.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).collect()]
        shared = wanted.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield pd.DataFrame({"word": misread_heads(list(zip(x["word"].tolist(), x["n"].tolist(), x["body"].tolist(), strict=True)), shared.value)}, dtype=object)

        rest = known.where("not head and length(word) >= 6").select("word", "n", "body")
        # Few words make one small file, but each is compared with a whole block.
        rest = rest.repartition(wanted.sparkSession.sparkContext.defaultParallelism, "word")
        found = found.unionByName(written(rest.mapInPandas(run, "word string"), "scan-misread-heads"))
        shared.destroy()
    return known.join(found.distinct().withColumn("_found", F.lit(True)), "word", "left").select("word", F.col("_found").isNotNull().alias("head"), "body")


def head_lines(rows: DataFrame, stats: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, feld, heads): the running heads of each text that has any, trimmed: lines that begin with a word of heads, and
    that words of heads outweigh words of the body in."""
    first = written(head_words(stats.where("kind = 'f'").select(F.col("a").alias("word")), counts).where("head").select(F.col("word").alias("first")), "scan-first-words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, feld, lines in zip(batch["doc"], batch["feld"], batch["lines"], strict=True):
                for line in {x.strip() for x in lines if x}:
                    if found := head_form(line):
                        out.append((doc, feld, line, found[0], found))
            yield pd.DataFrame(out, columns=["doc", "feld", "line", "first", "found"])

    lines = written(rows.mapInPandas(run, "doc long, feld string, line string, first string, found array<string>").join(first, "first", "left_semi"), "scan-head-forms")
    parts = lines.select("line", "found").dropDuplicates(["line"]).select("line", F.explode("found").alias("word"))
    kinds = head_words(parts.select("word").distinct(), counts)
    small = F.col("body") & (F.lower(F.substring("word", 1, 1)) == F.substring("word", 1, 1)) & (F.upper(F.substring("word", 1, 1)) != F.substring("word", 1, 1))
    sums = parts.join(kinds, "word").groupBy("line").agg(F.count("*").alias("n"), F.count_if("head").alias("heads"), F.count_if(small).alias("small"))
    sure = sums.where("heads > small and heads * 2 >= n").select("line")
    return lines.select("doc", "feld", "line").join(sure, "line", "left_semi").groupBy("doc", "feld").agg(F.collect_set("line").alias("heads"))


def learn(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Reader]:
    """(word counts, corrections of rare words, running heads of each text, reader) from all rows."""
    stats = written(statistics(rows), "scan-statistics")
    counts = stats.where("kind = 'w'").select(F.col("a").alias("word"), "n")
    near = stats.where("kind = 'p'").select(F.col("a").alias("word"), F.col("n").alias("near"))
    ranked = written(counts.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("near")), "scan-words")
    fixes = written(corrections(counts), "scan-corrections")
    common = {r["word"] for r in counts.where(F.col("n") >= LEAST).join(fixes.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON).collect()}
    table = skip_grams(stats.where("kind = 'c'").select("a", "b", "n"))
    return counts, fixes, head_lines(rows, stats, ranked), Reader(common, table)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, right, n_right) of rare words and the frequent words that undoing glyph errors yields. One join on the
    undone spellings; nothing is broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, int(n), v) for w, n in zip(b["word"], b["n"], strict=True) for v in undone(w)], columns=["word", "n_word", "right"])

    tried = counts.mapInPandas(run, "word string, n_word long, right string")
    frequent = counts.where(F.col("n") >= LEAST).select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    return tried.join(frequent, "right").where(F.col("n_right") >= RATIO * F.col("n_word")).select("word", "right", "n_right")


def findings(rows: DataFrame, heads: DataFrame, reader: Reader) -> DataFrame:
    """(doc, feld, art, wert, word, first, second, line, context) of each text, before rare words are looked up.

    art: kopf, seitenzahl; trennung (wert is the joined word); wort (a word that is not among the most frequent ones,
    with its context); offen (a line that ends with a word of which the next line may hold the rest).
    """
    shared = rows.sparkSession.sparkContext.broadcast(reader)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for batch in batches:
            out = []
            for doc, feld, lines, own in zip(batch["doc"], batch["feld"], batch["lines"], batch["heads"], strict=True):
                lines = [x or "" for x in lines]
                kinds = layout(lines, set(own) if own is not None else set())
                taken: set[tuple[int, int]] = set()  # (line, word from the front or, negative, from the end) that is part of a broken word
                for i, (x, k) in enumerate(zip(lines, kinds, strict=True)):
                    if k in ("head", "number"):
                        out.append((doc, feld, "kopf" if k == "head" else "seitenzahl", " ".join(x.split()) if k == "head" else x.strip(), "", []))
                for i, j in text_pairs(lines, kinds):
                    if b := broken(lines[i], lines[j]):
                        whole = joined(b[0], b[1])
                        out.append((doc, feld, "trennung", whole, whole, []))
                        taken |= {(i, -1), (j, 0)}
                    else:
                        x, y = words(lines[i]), words(lines[j])
                        if x and y and lines[i].rstrip()[-1:].isalpha() and y[0][0].islower() and plain(x[-1] + y[0]) and len(x[-1] + y[0]) >= 6:
                            out.append((doc, feld, "offen", x[-1] + y[0], x[-1] + " " + y[0], [x[-1], y[0]]))
                for i, (x, k) in enumerate(zip(lines, kinds, strict=True)):
                    if k != "text":
                        continue
                    found = words(x)
                    for p, w in enumerate(found):
                        if w in r.common or not plain(w) or p == 0 and (i, 0) in taken or p == len(found) - 1 and (i, -1) in taken:
                            continue
                        out.append((doc, feld, "wort", w, w, r.context(found, p)))
            yield pd.DataFrame(out, columns=["doc", "feld", "art", "wert", "word", "context"]).drop_duplicates(subset=["doc", "feld", "art", "wert", "word"])

    return rows.join(heads, ["doc", "feld"], "left").mapInPandas(run, "doc long, feld string, art string, wert string, word string, context array<string>")


def repairs(rows: DataFrame) -> DataFrame:
    """(doc, feld, art, wert, word): the cases found, with the spelling in the text (``word``) where it differs."""
    rows = rows.repartition("doc", "feld").dropDuplicates(["doc", "feld", "lines"])
    counts, fixes, heads, reader = learn(rows)
    found = written(findings(rows, heads, reader), "scan-findings")
    shared = rows.sparkSession.sparkContext.broadcast(reader)

    @F.pandas_udf("double")
    def fit(word: pd.Series, right: pd.Series, n: pd.Series, context: pd.Series) -> pd.Series:
        r = shared.value
        return pd.Series([r.fit(w, x, k, list(c) if c is not None else []) for w, x, k, c in zip(word, right, n, context, strict=True)], dtype="float64")

    # Words: of several frequent words the context and the frequency decide.
    hits = found.where("art in ('wort', 'trennung')").join(fixes, "word").withColumn("fit", fit("word", "right", "n_right", "context"))
    best = hits.groupBy("doc", "feld", "art", "word").agg(F.max(F.struct("fit", "right"))["right"].alias("right"))
    misread = best.where("art = 'wort'").select("doc", "feld", F.lit("zeichen").alias("art"), F.col("right").alias("wert"), "word")
    cut = found.where("art = 'trennung'").join(best.where("art = 'trennung'").select("doc", "feld", "word", "right"), ["doc", "feld", "word"], "left")
    cut = cut.select("doc", "feld", "art", F.coalesce("right", "wert").alias("wert"), "word")
    # Words broken without a sign: the whole is a word, its first part is none, or the two hardly ever stand side by side.
    bare = found.where("art = 'offen'").select("doc", "feld", "wert", "word", F.element_at("context", 1).alias("first"), F.element_at("context", 2).alias("second"))
    bare = bare.join(counts.select(F.col("word").alias("wert"), F.col("n").alias("n_whole")), "wert").join(counts.select(F.col("word").alias("first"), F.col("n").alias("n_first")), "first", "left").join(counts.select(F.col("word").alias("second"), F.col("n").alias("n_second")), "second", "left")
    n1, n2 = F.coalesce("n_first", F.lit(0)), F.coalesce("n_second", F.lit(0))
    bare = bare.where((F.col("n_whole") >= 2) & (F.least(n1, n2) * 3 <= F.col("n_whole"))).select("doc", "feld", F.lit("trennung").alias("art"), "wert", "word")
    rest = found.where("art in ('kopf', 'seitenzahl')").select("doc", "feld", "art", "wert", F.lit("").alias("word"))
    return misread.unionByName(cut).unionByName(bare).unionByName(rest).distinct()


def reflow(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, feld, text): furniture removed, broken words joined, misread words corrected, lines put together into
    paragraphs (a blank line within a page ends one)."""
    rows = rows.dropDuplicates(["doc", "feld", "lines"])
    cases = found.groupBy("doc", "feld").agg(F.collect_list(F.struct("art", "wert", "word")).alias("cases"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, feld, lines, cases in zip(batch["doc"], batch["feld"], batch["lines"], batch["cases"], strict=True):
                cases = list(cases) if cases is not None else []
                gone = {c["wert"] for c in cases if c["art"] in ("kopf", "seitenzahl")}
                right = {c["word"]: c["wert"] for c in cases if c["art"] == "zeichen"}
                whole = {c["word"]: c["wert"] for c in cases if c["art"] == "trennung"}
                lines = [x or "" for x in lines]
                furniture = lambda x: bool(_MARK.match(x)) or " ".join(x.split()) in gone or x.strip() in gone  # noqa: B023, E731
                kinds = ["mark" if furniture(x) else "text" if x.strip() else "blank" for x in lines]
                linked = dict(text_pairs(lines, kinds))
                text, skip = "", False
                for i, k in enumerate(kinds):
                    if k != "text":
                        continue
                    parts = lines[i].split()
                    if skip:
                        parts = parts[1:]
                    nxt, skip, glue = linked.get(i), False, " "
                    parts = [p if (w := p.strip(_EDGE)) not in right else p.replace(w, right[w]) for p in parts]
                    if nxt is None:
                        glue = "\n\n"
                    else:
                        b = broken(lines[i], lines[nxt])
                        x, y = words(lines[i]), words(lines[nxt])
                        key = joined(b[0], b[1]) if b else f"{x[-1]} {y[0]}" if x and y else ""
                        if key in whole and parts:
                            tail = lines[nxt].split()[0]
                            end = " ".join(parts).rstrip()
                            at = end.rfind(b[0] if b else x[-1])
                            parts = [(end[: max(at, 0)] + whole[key] + tail[len(tail.rstrip(_EDGE)) :]).strip()]
                            skip = True
                    text += " ".join(parts) + glue
                out.append((doc, feld, text.strip()))
            yield pd.DataFrame(out, columns=["doc", "feld", "text"])

    return rows.join(cases, ["doc", "feld"], "left").select("doc", "feld", "lines", "cases").mapInPandas(run, "doc long, feld string, text string")


