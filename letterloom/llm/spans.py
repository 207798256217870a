"""Long exact spans shared between texts.

Three operators:

``shared_spans`` finds every pair of texts with a common verbatim span of at least ``least`` characters. Hashing whole
lines or paragraphs would miss spans that begin and end inside lines, so the units are cut by content: within any
``WINDOW`` consecutive k-grams the one of least hash is an anchor (equal spans have equal anchors), and the unit of an
anchor reaches to the first anchor at least ``reach`` characters on. With ``reach + 2 (WINDOW - 1) + GRAM <= least`` a
shared span holds at least one whole unit, so grouping unit digests loses no pair. Each pair comes from the first unit
of a run of shared units only, and is then measured on the texts. Exact copies stand for each other through one
representative and are expanded at the end. Units that stand in very many places are told apart by the digests of all
exact windows of ``least`` characters around them before any pair is made.

``spans_elsewhere`` gives the spans of each text that stand in other texts, with offsets: every exact window of
``least`` characters that holds a shared unit is grouped by its digest, at each of its places.

``removed_lines`` hashes lines: digests are grouped over all texts, the earliest occurrence stays, others are removed.

Defined results: null texts and texts shorter than ``least`` share nothing; case and white space count; a text that
repeats within itself makes no pair; repeated rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.runtime import written

GRAM, WINDOW = 16, 112
#: Shared units with more places than this are split by exact windows first (same result, other way).
MANY = 64
_BASE = 0xD6E8FEB86659FD93
_SECOND = 0xA0761D6478BD642F
_U = np.uint64


class _Hasher:
    """Digests of slices of one long array of code points by prefix sums."""

    def __init__(self, codes: np.ndarray, base: int = _BASE):
        n = len(codes)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(n, base, dtype=_U)]), dtype=_U)
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(n, pow(base, -1, 1 << 64), dtype=_U)]), dtype=_U)
            self.sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum((codes.astype(_U) + _U(1)) * self.up[:n], dtype=_U)])

    def digest(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[stop] - self.sums[begin]) * self.down[begin]
            h ^= h >> _U(31)
            h *= _U(0x94D049BB133111EB)
            h ^= h >> _U(29)
            h *= _U(0xBF58476D1CE4E5B9)
            return h ^ (h >> _U(32))


def anchors(codes: np.ndarray, hasher: _Hasher) -> np.ndarray:
    """Positions of k-grams that are the least (the rightmost of equals) in some window."""
    m = len(codes) - GRAM + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    at = np.arange(m)
    grams = hasher.digest(at, at + GRAM)
    if m < WINDOW:
        return np.empty(0, dtype=np.int64)
    # Sliding minimum by doubling; position breaks ties to the right.
    low = grams.copy()
    where = at.copy()

    def combine(shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = low[:size], low[shift : shift + size]
        take = b <= a
        return np.where(take, b, a), np.where(take, where[shift : shift + size], where[:size])

    width = 1
    while width * 2 <= WINDOW:
        low, where = combine(width, len(low) - width)
        width *= 2
    if width < WINDOW:
        low, where = combine(WINDOW - width, len(low) - (WINDOW - width))
    return np.unique(where)


def units(text: str, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, digest) of the units of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    hasher = _Hasher(codes)
    a = anchors(codes, hasher)
    to = np.searchsorted(a, a + reach)
    ok = to < len(a)
    begin, end = a[ok], a[to[ok]] + GRAM
    return begin, end, hasher.digest(begin, end)


def spans_elsewhere(df: DataFrame, doc: str, text: str, least: int = 400) -> DataFrame:
    """(doc, von, bis, dort, dort_von): the longest spans of at least ``least`` characters of each text that stand in
    another text ``dort`` at ``dort_von``, offsets in code points. Each window of a text is given where its least (text,
    place) elsewhere is, so the spans cover all that stands elsewhere and may overlap.

    Windows are taken around shared units only, a few rows a character of what is shared; texts move once.
    """
    reach = least - 2 * (WINDOW - 1) - GRAM
    if reach < 1:
        raise ValueError("spans shorter than the windows need a smaller WINDOW")
    texts = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where(F.char_length("text") >= least).dropDuplicates(["doc"])

    def every_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for one, t in zip(batch["doc"].tolist(), batch["text"].tolist(), strict=True):
                begin, end, h = units(t, reach)
                parts.append((np.full(len(h), one, dtype=np.int64), h.view(np.int64), begin.astype(np.int32), (end - begin).astype(np.int32)))
            if parts:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("doc", "unit", "pos", "size"), zip(*parts, strict=True), strict=True)})

    def every_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, t, starts, sizes in zip(batch["doc"].tolist(), batch["text"].tolist(), batch["starts"].tolist(), batch["sizes"].tolist(), strict=True):
                codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
                # A mark per start of a window: starts of neighbouring units overlap.
                mark = np.zeros(len(codes) - least + 2, dtype=np.int32)
                begin = np.clip(starts + sizes - least, 0, len(codes) - least + 1)
                np.add.at(mark, begin, 1)
                np.add.at(mark, np.maximum(begin, np.minimum(starts, len(codes) - least) + 1), -1)
                at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                yield pd.DataFrame({"doc": np.full(len(at), one, dtype=np.int64), "h": _Hasher(codes).digest(at, at + least).view(np.int64), "pos": at.astype(np.int32)})

    found = written(texts.mapInPandas(every_unit, "doc long, unit long, pos int, size int"), "span-places")
    shared = found.groupBy("unit").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("unit")
    spots = found.join(shared, "unit").groupBy("doc").agg(F.collect_list(F.struct("pos", "size")).alias("s")).select("doc", F.col("s.pos").alias("starts"), F.col("s.size").alias("sizes"))
    windows = written(texts.join(spots, "doc").select("doc", "text", "starts", "sizes").mapInPandas(every_window, "doc long, h long, pos int"), "span-windows")
    # The first place of a window, and the first one in any other text.
    first = windows.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("one"), F.max("doc").alias("hi")).where("one.doc <> hi").select("h", "one")
    places = windows.join(first, "h").withColumn("own", F.col("doc") == F.col("one.doc"))
    second = places.where("not own").groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("two"))
    there = places.join(second, "h").select("doc", "pos", F.when(F.col("own"), F.col("two")).otherwise(F.col("one")).alias("x")).select("doc", "pos", F.col("x.doc").alias("dort"), (F.col("x.pos") - F.col("pos")).alias("shift"))
    # Neighbouring windows with neighbouring places in one text are one span; a text has at most as many as characters.
    by = Window.partitionBy("doc", "dort", "shift").orderBy("pos")
    runs = there.withColumn("run", F.col("pos") - F.row_number().over(by)).groupBy("doc", "dort", "shift", "run").agg(F.min("pos").alias("von"), F.max("pos").alias("last"))
    return runs.select("doc", "von", (F.col("last") + least).alias("bis"), "dort", (F.col("von") + F.col("shift")).alias("dort_von"))


def covered(spans: DataFrame) -> DataFrame:
    """(doc, n): characters of each text that lie in any of its spans (doc, von, bis)."""
    before = F.max("bis").over(Window.partitionBy("doc").orderBy("von", "bis").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("bis") - F.greatest(F.col("von"), F.coalesce("before", F.lit(0))), F.lit(0))
    return spans.select("doc", "von", "bis").distinct().withColumn("before", before).groupBy("doc").agg(F.sum(fresh).alias("n"))


def _unit_rows(docs: DataFrame, reach: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc, text in zip(batch["doc"].tolist(), batch["text"].tolist(), strict=True):
                begin, end, h = units(text, reach)
                # Every occurrence in a text: the first one may stand where less around it is shared.
                h = h.view(np.int64)
                # The unit before counts only where it overlaps this one, and with its distance: else it lies in another span.
                gap = np.diff(begin, prepend=0)
                joined = np.concatenate([[False], gap[1:] <= (end - begin)[:-1]]) if len(h) else np.empty(0, dtype=bool)
                before = np.where(joined, np.concatenate([[0], h[:-1]]) * 1_000_003 + gap, 0) if len(h) else h
                parts.append((np.full(len(h), doc, dtype=np.int64), h, before, begin, end - begin))
            if parts:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("doc", "unit", "before", "pos", "size"), zip(*parts, strict=True), strict=True)}).astype({"pos": "int32", "size": "int32"})

    return docs.mapInPandas(run, "doc long, unit long, before long, pos int, size int")


def _meeting(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Pairs of rows of one unit that don't also share the unit before. A hot unit's rows are divided by the skew join."""
    a = left.select("unit", *more, F.col("doc").alias("a"), F.col("before").alias("xa"), F.col("pos").alias("pa"))
    b = right.select("unit", *more, F.col("doc").alias("b"), F.col("before").alias("xb"), F.col("pos").alias("pb"))
    return a.join(b, ["unit", *more]).where("a < b and (xa <> xb or xa = 0)").select("a", "b", "pa", "pb")


def _common(a: str, b: str, pa: int, pb: int) -> int:
    """Length of the common span of a and b through the positions pa and pb."""

    def run(x: str, y: str) -> int:
        n, size = 0, 64
        while n < min(len(x), len(y)):
            if x[n : n + size] == y[n : n + size] and n + size <= min(len(x), len(y)):
                n, size = n + size, size * 2
            elif size > 1:
                size //= 2
                if size == 1 and x[n] != y[n]:
                    break
            elif x[n] == y[n]:
                n += 1
            else:
                break
        return n

    return run(a[pa:], b[pb:]) + run(a[:pa][::-1], b[:pb][::-1])


def _measured(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Pairs whose common span through the two positions has at least ``least`` characters. Only slices around the
    positions travel, and each side's texts move once."""
    margin = least
    near = lambda text, pos: F.substring(text, F.greatest(pos - margin, F.lit(0)) + 1, F.lit(2 * margin))
    a = pairs.join(docs.select(F.col("doc").alias("a"), "text"), "a").select("a", "b", "pb", near(F.col("text"), F.col("pa")).alias("ta"), F.least(F.col("pa"), F.lit(margin)).alias("qa"))
    both = a.join(docs.select(F.col("doc").alias("b"), "text"), "b").select("a", "b", "ta", "qa", near(F.col("text"), F.col("pb")).alias("tb"), F.least(F.col("pb"), F.lit(margin)).alias("qb"))

    @F.pandas_udf("boolean")
    def long_enough(ta: pd.Series, qa: pd.Series, tb: pd.Series, qb: pd.Series) -> pd.Series:
        return pd.Series([_common(w, x, y, z) >= least for w, y, x, z in zip(ta.tolist(), qa.tolist(), tb.tolist(), qb.tolist(), strict=True)])

    return both.where(long_enough("ta", "qa", "tb", "qb")).select("a", "b")


def _windows(rows: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Exact windows of ``least`` characters that hold a row's unit, as rows of the same form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc, text, starts, sizes in zip(batch["doc"].tolist(), batch["text"].tolist(), batch["starts"].tolist(), batch["sizes"].tolist(), strict=True):
                codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                at = np.unique(np.concatenate([np.arange(max(0, p + s - least), min(p, len(codes) - least) + 1) for p, s in zip(starts, sizes, strict=True)]))
                if not len(at):
                    continue
                h, first = np.unique(_Hasher(codes).digest(at, at + least).view(np.int64), return_index=True)
                order = np.argsort(first, kind="stable")
                h, pos = h[order], at[first[order]]
                # A second digest, on another base: what is equal in both is taken for equal.
                check = _Hasher(codes, _SECOND).digest(pos, pos + least).view(np.int64)
                joined = np.concatenate([[False], np.diff(pos) == 1])
                parts.append((np.full(len(h), doc, dtype=np.int64), h, check, np.where(joined, np.concatenate([[0], h[:-1]]), 0), pos))
            if parts:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("doc", "unit", "check", "before", "pos"), zip(*parts, strict=True), strict=True)}).astype({"pos": "int32"})

    spots = rows.groupBy("doc").agg(F.collect_list("pos").alias("starts"), F.collect_list("size").alias("sizes"))
    return docs.join(spots, "doc").select("doc", "text", "starts", "sizes").mapInPandas(run, "doc long, unit long, check long, before long, pos int")


def shared_spans(df: DataFrame, doc: str, text: str, least: int = 400) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts that share a verbatim span of at least ``least`` characters."""
    reach = least - 2 * (WINDOW - 1) - GRAM
    if reach < 1:
        raise ValueError("spans shorter than the windows need a smaller WINDOW")
    texts = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where(F.char_length("text") >= least)
    same = texts.select("doc", F.sha2("text", 256).alias("h"))
    classes = same.groupBy("h").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    members = written(same.join(classes.where("n > 1"), "h").select("rep", "doc").distinct(), "span-classes")
    # Texts that another row stands for are few or many; either way they drop out before units are made.
    reps = texts.join(members.where("doc <> rep").select("doc").distinct(), "doc", "left_anti").dropDuplicates(["doc"])
    rows = written(_unit_rows(texts.join(members.where("doc <> rep").select("doc").distinct(), "doc", "left_anti"), reach), "span-units")
    shared = written(rows.groupBy("unit").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("unit", "n"), "span-shared")
    rows = rows.join(shared, "unit")
    few, many = rows.where(F.col("n") <= MANY), rows.where(F.col("n") > MANY)
    found = _measured(_meeting(few, few).distinct(), reps, least)
    if shared.where(F.col("n") > MANY).limit(1).count():
        exact = _windows(many, reps, least)
        again = exact.groupBy("unit", "check").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("unit", "check")
        exact = exact.join(again, ["unit", "check"])
        found = found.unionByName(_meeting(exact, exact, "check").select("a", "b"))
    found = found.distinct()
    # Expand representatives to their copies.
    copies = members.select(F.col("rep"), F.col("doc").alias("copy"))
    wide = found.join(copies.withColumnRenamed("rep", "a"), "a", "left").select("b", F.coalesce("copy", "a").alias("x")).join(copies.withColumnRenamed("rep", "b"), "b", "left").select("x", F.coalesce("copy", "b").alias("y"))
    within = members.alias("l").join(members.alias("r"), "rep").where("l.doc < r.doc").select(F.col("l.doc").alias("x"), F.col("r.doc").alias("y"))
    return wide.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, von, bis, digest) of each line that is not blank, with offsets in code points of the original text.

    The digest is that of the line with runs of white space as one blank, trimmed, in lower case.
    """
    parts = df.select(F.col(doc).alias("doc"), F.split(F.col(text), "\n", -1).alias("parts")).where(F.col("parts").isNotNull())
    ends = F.aggregate("parts", F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1) + 1, F.lit(0)) + F.char_length(x))))
    rows = parts.select("doc", F.posexplode(F.arrays_zip("parts", ends.alias("ends"))).alias("pos", "x"))
    line = F.trim(F.regexp_replace(F.lower(F.col("x.parts")), r"(?U)\s+", " "))
    rows = rows.select("doc", "pos", (F.col("x.ends") - F.char_length("x.parts")).alias("von"), F.col("x.ends").alias("bis"), line.alias("line"))
    return rows.where("line <> ''").select("doc", "pos", "von", "bis", F.md5("line").alias("digest"))


def removed_lines(df: DataFrame, doc: str, text: str, least: int = 0) -> DataFrame:
    """Lines (of at least ``least`` characters) that stand earlier, in a lower id or further up; with their original offsets.

    Digests are counted before they are shuffled. Lines then meet their first place on the digest; one that a third of all
    texts hold is divided by the skew join of adaptive execution.
    """
    all_ = lines(df, doc, text).where(F.col("bis") - F.col("von") >= least)
    first = all_.groupBy("digest").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return all_.join(first, "digest").where("doc <> first.doc or pos <> first.pos").select("doc", "von", "bis", F.col("first.doc").alias("zuerst"))
