"""Readers and writers of configuration documents, append-only logs, inventories and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_list(spark: SparkSession, path: str, field: str, schema: T.StructType) -> DataFrame:
    """Entries of a JSON document, either a list or an object that holds the list under ``field``; with their position.

    The schema is given, never inferred. An entry that is no object gives nulls; an empty or missing list gives no rows.
    """
    text = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    rows = text.select(F.posexplode(items).alias("pos", "item"))
    return rows.select("pos", F.from_json(F.to_json("item"), schema).alias("e")).select("pos", "e.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines log; blank lines, comments (#) and malformed lines are left out without an error."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.where(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")).select(F.from_json("value", schema).alias("e")).select("e.*")


INVENTORY = T.StructType([T.StructField("relpath", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("hash", T.StringType())])


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated inventory with a head line; rows with a missing or unreadable field are left out."""
    return spark.read.csv(path, sep="\t", header=True, schema=INVENTORY, mode="DROPMALFORMED").na.drop()


def write_inventory(df: DataFrame, path: str) -> None:
    df.select(*INVENTORY.fieldNames()).write.mode("overwrite").csv(path, sep="\t", header=True)


def file_tree(spark: SparkSession, root: str, pattern: str = "*", old: DataFrame | None = None) -> DataFrame:
    """Inventory of a directory tree. Contents are read only of files whose path, size and time the old inventory lacks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    prefix = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    listed = files.select(F.substring(path, F.length(prefix) + 1, F.length(path)).alias("relpath"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    if old is None:
        return listed.select("relpath", "size", "mtime", F.sha2("content", 256).alias("hash"))
    known = listed.drop("content").join(old, ["relpath", "size", "mtime"]).select("relpath", "size", "mtime", "hash")
    fresh = listed.join(known.select("relpath"), "relpath", "left_anti").select("relpath", "size", "mtime", F.sha2("content", 256).alias("hash"))
    return known.unionByName(fresh)


def text_words(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """Words with their boxes from the tab-separated output of a text recogniser; those of low confidence are left out."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="").where((F.col("conf") > least) & (F.trim("text") != "")).select("page_num", "left", "top", "width", "height", "conf", "text")
