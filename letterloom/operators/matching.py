"""Matching joins: identifiers, names, similarity, retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_identifier(docs: DataFrame, entries: DataFrame, kinds: list[str]) -> DataFrame:
    """doc, name, kind. Both sides are rows (doc or name, kind, key). The first kind with any hit decides; if it hits more
    than one entry the document stays without a match."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    hits = docs.join(entries, ["kind", "key"]).groupBy("doc", "kind").agg(F.min("name").alias("name"), F.countDistinct("name").alias("n"))
    first = hits.groupBy("doc").agg(F.min_by(F.struct("kind", "name", "n"), rank).alias("m"))
    return first.where("m.n = 1").select("doc", "m.name", "m.kind")


def fall_through(docs: DataFrame, entries: DataFrame, kinds: list[str]) -> DataFrame:
    """As ``by_identifier``, but a kind that hits several entries is passed over for the next."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    hits = docs.join(entries, ["kind", "key"]).groupBy("doc", "kind").agg(F.min("name").alias("name"), F.countDistinct("name").alias("n")).where("n = 1")
    return hits.groupBy("doc").agg(F.min_by(F.struct("kind", "name"), rank).alias("m")).select("doc", "m.name", "m.kind")


def by_name(typed: DataFrame, entries: DataFrame) -> DataFrame:
    """id, name, tier. typed: (id, key); entries: (name, pos, key). Equal keys first, then the entry whose key and the
    typed one contain each other (longest, at least three characters), the earlier entry on ties.

    Containment can't be joined on equality; it runs over the typed values left over only, against the list, which is
    broadcast when it is small.
    """
    equal = typed.join(entries, "key").groupBy("id").agg(F.min_by("name", "pos").alias("name")).withColumn("tier", F.lit(1))
    rest = typed.join(equal.select("id"), "id", "left_anti")
    e = entries.where(F.length("key") >= 3).select("name", "pos", F.col("key").alias("k"))
    near = rest.where(F.length("key") >= 3).join(e, F.contains("key", "k") | F.contains("k", "key"))
    near = near.groupBy("id").agg(F.max_by("name", F.struct(F.least(F.length("key"), F.length("k")), -F.col("pos"))).alias("name")).withColumn("tier", F.lit(2))
    return equal.unionByName(near)


def _matrix(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows cut or filled with zeros to one width, lengths of the whole vectors); null values and vectors are zeros."""
    out, norms = np.zeros((len(vectors), width)), np.zeros(len(vectors))
    for i, v in enumerate(vectors):
        if v is not None:
            x = np.nan_to_num(np.asarray(v, dtype="float64"))
            out[i, : len(x)] = x[:width]
            norms[i] = np.sqrt(x @ x)
    return out, norms


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of one query; ties go to the lower id."""
    if len(score) > k:
        kept = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))][:k]


def nearest(queries: DataFrame, targets: DataFrame, k: int, limit: int = 10_000) -> DataFrame:
    """(query, target, score, rank): the k targets (id, vector) of highest cosine for each query (id, vector); a target of
    the query's own id doesn't count, ties go to the lower id, a vector that is null or of length 0 scores 0.

    A stated list of queries against all targets: the queries go in blocks of at most ``limit``, each broadcast, so the
    targets are read once a block and never shuffled. Scores are products of matrices over Arrow batches; each task keeps
    its own k best of each query, and only these are shuffled.
    """
    blocks = max(1, -(-queries.count() // limit))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        one = _nearest(part.select("id", "vector"), targets.select("id", "vector"), k)
        out = one if out is None else out.unionByName(one)
    return out


def _nearest(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    rows = queries.where("id is not null").collect()
    width = max((len(r["vector"]) for r in rows if r["vector"] is not None), default=0)
    ids = np.array([r["id"] for r in rows], dtype="int64")
    shared = queries.sparkSession.sparkContext.broadcast((ids, *_matrix([r["vector"] for r in rows], width)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q, nq = shared.value
        found = [(np.empty(0, dtype="int64"), np.empty(0)) for _ in own]
        for batch in batches:
            batch = batch[batch["id"].notna()]
            there = batch["id"].to_numpy(dtype="int64")
            t, nt = _matrix(batch["vector"].tolist(), width)
            norms = nq[:, None] * nt[None, :]
            score = np.where(norms > 0, np.round(q @ t.T / np.where(norms > 0, norms, 1), 6), 0.0) + 0.0
            score[own[:, None] == there[None, :]] = -np.inf
            for i in range(len(own)):
                kept = np.concatenate([found[i][0], there]), np.concatenate([found[i][1], score[i]])
                top = _best(kept[1], kept[0], k)
                found[i] = kept[0][top], kept[1][top]
        n = [len(x) for x, _ in found]
        if sum(n):
            out = pd.DataFrame({"query": np.repeat(own, n), "target": np.concatenate([x for x, _ in found]), "score": np.concatenate([s for _, s in found])})
            yield out[out["score"] > -np.inf]

    local = targets.mapInPandas(run, "query long, target long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "target")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def within_days(rows: DataFrame, keys: list[str], date: str, id_: str, days: int) -> DataFrame:
    """Pairs of rows of one key whose dates lie at most ``days`` apart, by buckets of that width: each row meets the rows
    of its own and the next bucket only."""
    bucket = F.floor(F.datediff(F.col(date), F.lit("1970-01-01")) / (days + 1))
    left = rows.select(*keys, F.col(id_).alias("id_a"), F.col(date).alias("_a"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    right = rows.select(*keys, F.col(id_).alias("id_b"), F.col(date).alias("_z"), bucket.alias("_b"))
    close = F.abs(F.datediff("_a", "_z")) <= days
    pairs = left.join(right, [*keys, "_b"]).where(close & (F.col("id_a") != F.col("id_b")))
    return pairs.select(*keys, F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
