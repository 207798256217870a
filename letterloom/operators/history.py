"""History of changing attributes: type-two dimensions from snapshots or updates.

Defined results: rows whose key or effective date is null don't enter; of several rows for one key and date the one
with the highest rank counts, so repeated rows change nothing; neighbouring dates with equal attributes are one
version; attributes are compared null-safe; an empty input gives an empty history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute_hash(columns: list[str]) -> Column:
    """One digest of all attributes; null differs from every text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def latest_per_date(df: DataFrame, keys: list[str], effective: str, attributes: list[str], rank: list[Column]) -> DataFrame:
    """The attributes that count at each date. Partial aggregation before the shuffle, so a hot key shrinks first."""
    return (
        df.where(F.col(effective).isNotNull())
        .groupBy(*keys, effective)
        .agg(F.max(F.struct(F.struct(*rank).alias("rank"), F.struct(*attributes).alias("attrs"))).alias("_best"))
        .select(*keys, effective, "_best.attrs.*")
    )


def history(df: DataFrame, keys: list[str], effective: str, attributes: list[str], start: str = "von", end: str = "bis") -> DataFrame:
    """Versions with [start, end) from one row per key and date; ``end`` of the open version is null.

    ``effective`` is a date, so a key has at most one row per calendar day here and its window stays small
    whatever share of the input rows it holds.
    """
    by = Window.partitionBy(*keys).orderBy(effective)
    hashed = df.withColumn("_hash", attribute_hash(attributes)).withColumn("_before", F.lag("_hash").over(by))
    changes = hashed.where(F.col("_before").isNull() | (F.col("_before") != F.col("_hash")))
    return changes.select(*keys, F.col(effective).alias(start), F.lead(effective).over(by).alias(end), *attributes, F.col("_hash").alias("attr_hash"))


def merge(current: DataFrame, dated: DataFrame, updates: DataFrame, keys: list[str], effective: str, attributes: list[str], rank: list[str], start: str = "von", end: str = "bis") -> DataFrame:
    """Type-two merge of updates into a kept history: equal hashes leave it as it is, changed rows are closed with the
    update's date, new versions are opened. Updates that arrive late, before the open version began, are put in place.

    ``dated``: the row of each key and date that ``current`` was built from, with its ``rank`` columns (as
    ``latest_per_date`` gives it with them among the attributes). Dates with the attributes of the date before are no
    starts in ``current``, but each becomes one where an update comes between the two. Of an update and a kept row of one
    date the higher rank counts, so an update that is older than what is kept changes nothing; of equals the update.

    Only keys that occur in the updates are rebuilt; the others pass through unchanged (semi and anti join on the keys).
    """
    touched = updates.where(F.col(effective).isNotNull()).select(*keys).distinct()
    kept = current.join(touched, keys, "left_anti").select(*keys, start, end, *attributes, "attr_hash")
    columns = list(dict.fromkeys([*keys, effective, *attributes, *rank]))
    old = dated.join(touched, keys, "left_semi").select(*columns, F.lit(0).alias("_new"))
    new = updates.select(*columns, F.lit(1).alias("_new"))
    rebuilt = latest_per_date(old.unionByName(new), keys, effective, attributes, [*map(F.col, rank), F.col("_new")])
    return kept.unionByName(history(rebuilt, keys, effective, attributes, start, end))
