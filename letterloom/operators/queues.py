"""Keyed queues, ordered unions and version lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(queue: DataFrame, key: str, pos: str, reasons: str, first: list[str], latest: str) -> DataFrame:
    """One row per key: the union of the reasons in order of first occurrence, the first value of ``first`` that is not
    empty, the latest time.

    The reasons are aggregated to their first position before they are collected, so what is gathered for a key is its
    distinct reasons, whatever share of the rows it has.
    """
    whole = queue.groupBy(key).agg(*(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(pos))).alias(c) for c in first), F.max(latest).alias(latest), F.count("*").alias("rows"))
    each = queue.select(key, pos, F.posexplode(reasons).alias("_i", "_r")).groupBy(key, "_r").agg(F.min(F.struct(pos, "_i")).alias("_at"))
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_r"))), lambda x: x["_r"]).alias(reasons))
    return whole.join(lists, key, "left")


def upsert(current: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """New entries into a queue of one row per key: open ones are updated, closed ones opened again, others inserted."""
    a, b = current.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    state = F.when(F.col(f"b.{key}").isNull(), F.lit("kept")).when(F.col(f"a.{key}").isNull(), F.lit("inserted")).when(F.col(f"a.{status}") == "pending", F.lit("updated")).otherwise(F.lit("reopened"))
    other = [c for c in current.columns if c not in (key, status)]
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.when(F.col(f"b.{key}").isNotNull(), F.lit("pending")).otherwise(F.col(f"a.{status}")).alias(status), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in other), state.alias("change"))


def ordered_union(*arrays: Column) -> Column:
    """Union of arrays in order of first occurrence, nulls aside."""
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))))


def without(tags: Column, bad: Column) -> Column:
    """The tags that are not in ``bad``; order and repeats stay."""
    return F.filter(tags, lambda t: ~F.coalesce(F.array_contains(bad, t), F.lit(False)))


def union_ignoring_case(values: Column) -> Column:
    """Distinct values but for letter case and blanks around; the first spelling stays."""
    low = F.transform(values, lambda x: F.lower(F.trim(x)))
    return F.transform(F.filter(F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i"), F.array_position(low, F.lower(F.trim(x))).alias("p"))), lambda s: (s["p"] == s["i"] + 1) & (F.trim(s["v"]) != "")), lambda s: F.trim(s["v"]))


def conflicts(entries: DataFrame) -> DataFrame:
    """Keys (kind, key) that more than one entry claims; entries: (name, kind, key)."""
    return entries.where("key <> ''").groupBy("kind", "key").agg(F.countDistinct("name").alias("entries"), F.max("name").alias("owner")).where("entries > 1")


def unique_titles(rows: DataFrame, folder: str, title: str, order: str) -> DataFrame:
    """Titles made unique in their folder by _2, _3 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(folder, F.lower(title)).orderBy(order))
    return rows.withColumn("unique_title", F.when(n == 1, F.col(title)).otherwise(F.concat_ws("_", title, n.cast("string"))))


def grouped_rows(words: DataFrame, doc: str, top: str, left: str, tolerance: int) -> DataFrame:
    """Number of the text row of each word: a word belongs to the row of the first word of that row while its top lies
    within the tolerance. A fold over the words of one page, since the anchor is not the word before."""
    word = F.struct(F.col(top).alias("top"), F.col(left).alias("left"))
    pages = words.groupBy(doc).agg(F.array_sort(F.collect_list(word)).alias("_w"))
    start = F.struct(F.lit(None).cast("int").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<struct<top:int,left:int,row:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        fresh = acc["anchor"].isNull() | (w["top"] - acc["anchor"] > tolerance)
        row = F.when(fresh, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.when(fresh, w["top"]).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.concat(acc["out"], F.array(F.struct(w["top"].alias("top"), w["left"].alias("left"), row.alias("row")))).alias("out"))

    return pages.select(doc, F.explode(F.aggregate("_w", start, step)["out"]).alias("w")).select(doc, "w.top", "w.left", "w.row")
