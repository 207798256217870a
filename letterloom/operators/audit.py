"""Import reconciliation: inventories of files against a store, by content hash and by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_folder(path: Column) -> Column:
    """First part of a relative path, ``(root)`` for a file that lies in none."""
    return F.when(F.instr(path, "/") == 0, F.lit("(root)")).otherwise(F.substring_index(path, "/", 1))


def summary(inventory: DataFrame) -> DataFrame:
    """Files, distinct contents, files with a copy, groups of copies, surplus copies. Copies are counted before they are
    added up, so that one content that very many files have is a single row."""
    groups = inventory.groupBy("hash").agg(F.count("*").alias("n"))
    more = F.col("n") > 1
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.count("*").alias("contents"),
        F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).alias("in_groups"),
        F.count_if(more).alias("groups"),
        F.coalesce(F.sum(F.when(more, F.col("n") - 1)), F.lit(0)).alias("surplus"),
    )


def duplicates(inventory: DataFrame, least: int = 2) -> DataFrame:
    """Every file whose content at least ``least`` files have, with the number of copies. A join on the counts and not a
    window, so that no task holds a whole group."""
    counts = inventory.groupBy("hash").agg(F.count("*").alias("copies")).where(F.col("copies") >= least)
    return inventory.join(counts, "hash").select("hash", "copies", "relpath")


def missing(inventory: DataFrame, store: DataFrame) -> DataFrame:
    """First path of each content that the store holds neither by content nor by name of the file."""
    first = inventory.groupBy("hash").agg(F.min("relpath").alias("relpath"), F.count("*").alias("copies"))
    first = first.join(store.select("hash").distinct(), "hash", "left_anti")
    name = F.lower(F.substring_index("relpath", "/", -1))
    return first.withColumn("name", name).join(store.select(F.lower("name").alias("name")).distinct(), "name", "left_anti").select("relpath", "hash", "copies")


def orphans(disk: DataFrame, store: DataFrame) -> DataFrame:
    """dead: files whose content the store does not hold; safe: further copies of one that it holds."""
    known = store.select("hash").distinct()
    dead = disk.join(known, "hash", "left_anti").select("relpath", F.lit("dead").alias("kind"))
    kept = disk.join(known, "hash", "left_semi")
    first = kept.groupBy("hash").agg(F.min("relpath").alias("first"))
    safe = kept.join(first, "hash").where("relpath <> first").select("relpath", F.lit("safe").alias("kind"))
    return dead.unionByName(safe)


def keep_lowest(docs: DataFrame, key: str, id_: str) -> DataFrame:
    """Documents to delete: all of a key but the one with the lowest id."""
    low = docs.groupBy(key).agg(F.min(id_).alias("kept"))
    return docs.join(low, key).where(F.col(id_) != F.col("kept")).select(key, id_, "kept")


def agreement(docs: DataFrame, key: str, hash_: str) -> DataFrame:
    """Groups of a key with more than one row: whether their known hashes agree (no known hash: different)."""
    groups = docs.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(hash_).alias("hashes")).where("n > 1")
    return groups.select(key, "n", F.when(F.col("hashes") == 1, F.lit("same")).otherwise(F.lit("different")).alias("kind"))


def reused_hashes(listing: DataFrame, old: DataFrame) -> DataFrame:
    """Files of a new listing with the hash of the old inventory where path, size and time are unchanged; null: to hash."""
    return listing.join(old.select("relpath", "size", "mtime", "hash"), ["relpath", "size", "mtime"], "left").select("relpath", "size", "mtime", "hash")


def pop(queue: DataFrame, present: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entries by position that are not present at the destination."""
    return queue.join(present.select("relpath").distinct(), "relpath", "left_anti").orderBy("pos").limit(n)


def page_ranges(markers: DataFrame, total: str) -> DataFrame:
    """[first, last] page of each part from the pages where a marker begins; pages before the first are a part without."""
    by = Window.partitionBy("doc").orderBy("page")
    parts = markers.select("doc", "name", F.col("page").alias("first"), F.coalesce(F.lead("page").over(by) - 1, F.col(total)).alias("last"), F.lag("page").over(by).alias("_before"))
    lead = parts.where("_before is null and first > 1").select("doc", F.lit("(none)").alias("name"), F.lit(1).alias("first"), (F.col("first") - 1).alias("last"))
    return parts.drop("_before").unionByName(lead)
