"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

The histogram of sizes (at most one bin per size step, so bounded by the capacity) goes to the driver. Patterns of few
items that fill a container are enumerated, their repeat counts fitted to the histogram by NNLS and rounded down; what
is left is packed by counts, longest first into the best fitting space. The plan is a short list of patterns; the
items themselves are ranked within their bin, without gathering a bin in one task, and look their container up.

Defined results: an item longer than the capacity is cut into full containers and a rest; no other item is split;
items of size zero or null size take no space and are put in container 0; repeated ids are items of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the histogram, and rows that one task ranks at most (on average).
BINS, RANKED = 256, 200_000


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000, eps: float = 1e-9) -> np.ndarray:
    """min |a x - b| with x >= 0: active sets after Lawson and Hanson. At most as many positive values as rows."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[inside] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= eps * max(1.0, float(np.abs(b).max())):
            break
        inside[j] = True
        while True:
            cols = np.flatnonzero(inside)
            part = a[:, cols]
            gram = part.T @ part
            gram[np.diag_indices_from(gram)] += 1e-10
            z = np.linalg.solve(gram, part.T @ b)
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            bad = z <= 0
            old = x[cols]
            alpha = float(np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300)))
            x[cols] = old + alpha * (z - old)
            drop = cols[(x[cols] <= 1e-12) & bad]
            if not len(drop):
                drop = cols[bad][:1]
            x[drop] = 0
            inside[drop] = False
            if not inside.any():
                break
    return x


def patterns(bins: int, present: np.ndarray) -> np.ndarray:
    """Counts by bin (row) of each pattern (column) of one to four items whose bins fill a container.

    Bin b stands for items of up to b + 1 steps. Patterns of four use every fourth bin only, to keep their number low;
    patterns that leave space unused are none, so that what fits no pattern stays for ``longest_first``.
    """
    have = set(np.flatnonzero(present).tolist())
    size = lambda b: b + 1
    found: list[tuple[int, ...]] = [(bins - 1,)] if bins - 1 in have else []
    for a in sorted(have):
        rest = bins - size(a)
        if rest >= size(a) and rest - 1 in have:
            found.append((a, rest - 1))
        for b in range(a, rest // 2):
            if b in have and (c := rest - size(b) - 1) >= b and c in have:
                found.append((a, b, c))
    even = [b for b in sorted(have) if size(b) % 4 == 0]
    for a, b, c in combinations_with_replacement(even, 3):
        d = bins - size(a) - size(b) - size(c) - 1
        if d < c:
            continue
        if d in have:
            found.append((a, b, c, d))
    out = np.zeros((bins, len(found)), dtype=np.float64)
    for k, p in enumerate(found):
        for b in p:
            out[b, k] += 1
    return out


def longest_first(left: np.ndarray, bins: int) -> list[tuple[dict[int, int], int]]:
    """Pack counts by bin: longest first, each into the open space that it fills best; equal steps are taken at once."""
    spaces: dict[int, list[tuple[dict[int, int], int]]] = {}
    for b in range(len(left) - 1, -1, -1):
        size, todo = b + 1, int(left[b])
        for room in range(size, bins + 1):
            while todo and spaces.get(room):
                content, n = spaces[room].pop()
                fit = room // size
                full, one = (fit, min(n, todo // fit)) if todo >= fit else (todo, 1)
                if n > one:
                    spaces[room].append((content, n - one))
                spaces.setdefault(room - full * size, []).append((content | {b: content.get(b, 0) + full}, one))
                todo -= full * one
        fit = bins // size
        if todo >= fit:
            spaces.setdefault(bins - fit * size, []).append(({b: fit}, todo // fit))
            todo %= fit
        if todo:
            spaces.setdefault(bins - todo * size, []).append(({b: todo}, 1))
    return [x for group in spaces.values() for x in group]


@dataclass
class Plan:
    """Slots by bin: ranks from ``first`` on go to container ``base + (rank - first) // each``."""

    bin: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    containers: int


def plan(histogram: np.ndarray) -> Plan:
    bins = len(histogram)
    chosen: list[tuple[dict[int, int], int]] = []
    left = histogram.astype(np.int64).copy()
    if left.sum():
        a = patterns(bins, left > 0)
        scale = float(left.max())
        x = nnls(a, left / scale) * scale if a.shape[1] else np.zeros(0)
        for k in np.argsort(-x):
            if x[k] < 1:
                break
            p = {int(b): int(a[b, k]) for b in np.flatnonzero(a[:, k])}
            n = min(int(x[k] + 1e-6), *(int(left[b] // m) for b, m in p.items()))
            if n:
                chosen.append((p, n))
                for b, m in p.items():
                    left[b] -= m * n
        chosen += longest_first(left, bins)
    rows, used, base = [], np.zeros(bins, dtype=np.int64), 0
    for p, n in chosen:
        for b, m in p.items():
            rows.append((b, used[b], m, base))
            used[b] += m * n
        base += n
    assert (used == histogram).all()
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], base)


def pack(items: DataFrame, item: str, size: str, capacity: int, bins: int = BINS) -> DataFrame:
    """(item, teil, von, laenge, behaelter) of each piece; ``items`` is read twice, so keep or write it if it is dear."""
    bins = min(bins, capacity)
    step = -(-capacity // bins)
    bins = capacity // step  # a last part that is no full step stays unused, but by items that need it
    n = F.coalesce(F.col(size), F.lit(0))
    pieces = items.select(F.col(item).alias("item"), n.cast("long").alias("size"))
    pieces = pieces.withColumn("teil", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.select("item", "teil", (F.col("teil").cast("long") * capacity).alias("von"), F.least(F.col("size") - F.col("teil").cast("long") * capacity, F.lit(capacity)).alias("laenge"))
    # A bin holds the sizes up to (bin + 1) steps; full pieces are the last bin, empty ones have none.
    pieces = pieces.withColumn("bin", F.when(F.col("laenge") > 0, F.least(F.ceil(F.col("laenge") / step) - 1, F.lit(bins - 1)).cast("int")))
    counts = {r["bin"]: r["count"] for r in pieces.where("bin is not null").groupBy("bin").count().collect()}
    histogram = np.array([counts.get(b, 0) for b in range(bins)], dtype=np.int64)
    p = plan(histogram)
    salts = int(histogram.sum() // (RANKED * 8)) + 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("item", "teil"), F.lit(salts)).cast("int"))
    sizes = salted.where("bin is not null").groupBy("bin", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("bin", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    own = Window.partitionBy("bin", "salt").orderBy("item", "teil")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["bin", "salt"], "left").withColumn("rank", F.col("rank") + F.col("before"))
    key = (p.bin << 44) + p.first

    @F.pandas_udf("long")
    def container(bin_: pd.Series, rank: pd.Series) -> pd.Series:
        b = bin_.fillna(-1).to_numpy(dtype=np.int64)
        r = rank.fillna(0).to_numpy(dtype=np.int64)
        if not len(key):
            return pd.Series(np.zeros(len(b), dtype=np.int64))
        at = np.searchsorted(key, (np.maximum(b, 0) << 44) + r, side="right") - 1
        return pd.Series(np.where(b < 0, 0, p.base[at] + (r - p.first[at]) // p.each[at]))

    return ranked.select(F.col("item").alias(item), "teil", "von", "laenge", container("bin", "rank").alias("behaelter"))
