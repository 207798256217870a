"""Deeply nested records to related flat tables.

Typed columns are taken apart along their schema; JSON texts along a merged schema that is inferred first.
Every array or map level becomes a child table, every struct below it a table of its own, and each row carries
its surrogate key, its parent's key, the ordinal in the array (or the map key) and its path in the record.

Defined results: a null or empty container has no child rows; a null element keeps its ordinal and is a row whose
``filled`` is false; repeated records give the same keys again (use ``distinct``); JSON texts that are null or no
valid JSON give nothing; columns of the input besides the named ones never enter and so can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.functions.void import has_value, is_void

#: An object with more distinct keys than this, over all records, is kept as a map and not as a struct, so that the
#: merged schema stays small. It changes which table holds an object, never its path: choose rows by ``pfad``.
MAP_KEYS = 40


@dataclass
class Child:
    """One table: ``df`` has root, sk, parent_sk, ordinal, key, pfad, filled and obj; ``path`` is the place in the schema
    (``[]`` array level, ``{}`` map level, ``.name`` field)."""

    path: str
    parent: str
    df: DataFrame
    kind: object


def _sk(root: Column, pfad: Column) -> Column:
    return F.xxhash64(root, pfad)


def _join(pfad: Column, name: str) -> Column:
    return F.when(pfad == "", F.lit(name)).otherwise(F.concat(pfad, F.lit("." + name)))


def _step(name: str) -> str | None:
    """A key as a step of a VARIANT path; None for one with both kinds of quotes, which no path can hold."""
    return f"['{name}']" if "'" not in name else f'["{name}"]' if '"' not in name else None


def flatten(df: DataFrame, root: str, columns: list[str]) -> dict[str, Child]:
    """Tables of the nested ``columns`` of a typed DataFrame, by schema path. All steps are narrow: no shuffle.

    Each array or map of objects becomes a table, at any depth; structs stay in the row of their object
    (``struct_rows`` gives them rows of their own, ``flat_columns`` columns).
    """
    tables: dict[str, Child] = {}

    def visit(frame: DataFrame, kind: T.DataType, path: str, parent: str) -> None:
        # frame: root, parent_sk, pfad, obj
        if isinstance(kind, (T.ArrayType, T.MapType)):
            array = isinstance(kind, T.ArrayType)
            inner = kind.elementType if array else kind.valueType
            if not isinstance(inner, (T.StructType, T.ArrayType, T.MapType)):
                return
            names, key, mark = (("ordinal", "obj"), F.lit(None).cast("string"), "[]") if array else (("ordinal", "key", "obj"), F.col("key").cast("string"), "{}")
            rows = frame.select("root", F.col("pfad").alias("_p"), "parent_sk", F.posexplode("obj").alias(*names))
            place = F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("]")) if array else F.concat(F.lit("."), F.col("key").cast("string"))
            rows = rows.select("root", "parent_sk", "ordinal", key.alias("key"), F.concat("_p", place).alias("pfad"), "obj")
            own = rows.select("root", _sk(F.col("root"), F.col("pfad")).alias("sk"), "parent_sk", "ordinal", "key", "pfad", has_value(F.col("obj"), inner).alias("filled"), "obj")
            tables[path + mark] = Child(path + mark, parent, own, inner)
            below(own, inner, path + mark, path + mark)
        elif isinstance(kind, T.StructType):
            below(frame.withColumn("sk", F.col("parent_sk")), kind, path, parent)

    def below(own: DataFrame, kind: T.DataType, path: str, parent: str) -> None:
        if not isinstance(kind, T.StructType):
            return visit(own.select("root", F.col("sk").alias("parent_sk"), "pfad", "obj"), kind, path, parent)
        for f in kind.fields:
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                visit(own.select("root", F.col("sk").alias("parent_sk"), _join(F.col("pfad"), f.name).alias("pfad"), F.col("obj")[f.name].alias("obj")), f.dataType, f"{path}.{f.name}", parent)

    for c in columns:
        base = df.select(F.col(root).alias("root"), F.xxhash64(F.col(root)).alias("parent_sk"), F.lit(c).alias("pfad"), F.col(c).alias("obj"))
        visit(base, df.schema[c].dataType, c, "")
    return tables


def struct_rows(child: Child, places: list[tuple[str, ...]]) -> DataFrame:
    """Rows of the structs at ``places`` (field names from the object down), all of one type, in one pass over the table."""
    typed = isinstance(child.kind, T.StructType)

    def at(place: tuple[str, ...]) -> Column:
        o = F.col("obj")
        if not typed:
            return F.try_variant_get(o, "$" + "".join(map(_step, place)), "variant")
        for n in place:
            o = o[n]
        return o

    if typed:
        kind = child.kind
        for n in places[0]:
            kind = kind[n].dataType
        filled = has_value(F.col("obj"), kind)
    else:
        filled = F.schema_of_variant("obj").startswith("OBJECT") & variant_filled(F.col("obj"))
    found = F.array(*(F.struct(F.lit("." + ".".join(p)).alias("tail"), F.lit(p[-1]).alias("key"), at(p).alias("obj")) for p in places))
    rows = child.df.select("root", F.col("sk").alias("parent_sk"), F.col("pfad").alias("_p"), F.explode(found).alias("x")).where(F.col("x.obj").isNotNull())
    rows = rows.select("root", "parent_sk", F.lit(None).cast("int").alias("ordinal"), "x.key", F.concat("_p", "x.tail").alias("pfad"), "x.obj")
    return rows.withColumns({"sk": _sk(F.col("root"), F.col("pfad")), "filled": filled})


def _leaves(c: Column, kind: T.DataType, name: str) -> list[Column]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(c[f.name], f.dataType, f"{name}_{f.name}" if name else f.name)]
    if isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return []
    return [c.alias(f"v_{name}")]


def flat_columns(child: Child) -> DataFrame:
    """The table with all scalars and arrays of scalars of its object and inner structs as columns ``v_...``."""
    return child.df.select("root", "sk", "parent_sk", "ordinal", "key", "pfad", *_leaves(F.col("obj"), child.kind, ""))


# --- JSON texts: merged schema -------------------------------------------------------------------------------------


def _shape(value: object, limit: int, free: frozenset[str], name: str = "") -> dict:
    """Schema of one value: s (scalar), a (array), o (object), m (map), the last three with the merged schema below."""
    if isinstance(value, dict):
        return _limit({"o": {k: _shape(v, limit, free, k) for k, v in value.items()}}, limit, name in free)
    if isinstance(value, list):
        below: dict = {}
        for x in value:
            below = merge_shapes(below, _shape(x, limit, free), limit)
        return {"a": below}
    return {"s": 1} if value is not None else {}


def _limit(shape: dict, limit: int, always: bool = False) -> dict:
    """Turn an object with too many keys, or one that stands where others have arrays, into a map of one merged value."""
    fields = shape.get("o")
    if fields is not None and (always or len(fields) > limit or shape.get("a")):
        value = shape.get("m", {})
        for x in fields.values():
            value = merge_shapes(value, x, limit)
        shape = {k: v for k, v in shape.items() if k != "o"} | {"m": value}
    return shape


def merge_shapes(a: dict, b: dict, limit: int = MAP_KEYS) -> dict:
    out: dict = {}
    if "s" in a or "s" in b:
        out["s"] = 1
    if "a" in a or "a" in b:
        out["a"] = merge_shapes(a.get("a", {}), b.get("a", {}), limit)
    if "m" in a or "m" in b:
        value = merge_shapes(a.get("m", {}), b.get("m", {}), limit)
        for x in [*a.get("o", {}).values(), *b.get("o", {}).values()]:
            value = merge_shapes(value, x, limit)
        out["m"] = value
    elif "o" in a or "o" in b:
        x, y = a.get("o", {}), b.get("o", {})
        out["o"] = {k: merge_shapes(x.get(k, {}), y.get(k, {}), limit) for k in [*x, *(k for k in y if k not in x)]}
        out = _limit(out, limit)
    return out


def infer_shape(df: DataFrame, text: str, map_keys: int = MAP_KEYS, free_keys: tuple[str, ...] = ()) -> dict:
    """Merged schema of all JSON texts in a column.

    Objects under a field of ``free_keys``, objects with more than ``map_keys`` distinct keys and objects where other
    rows have arrays of objects are maps. Each partition sends one schema; as maps keep one merged value, its size depends on the
    number of fields and not on the rows.
    """
    free = frozenset(free_keys)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merged: dict = {}
        for batch in batches:
            for line in batch["j"]:
                if line is None:
                    continue
                try:
                    merged = merge_shapes(merged, _shape(json.loads(line), map_keys, free), map_keys)
                except (ValueError, RecursionError):
                    continue
        yield pd.DataFrame({"shape": [json.dumps(merged)]})

    merged: dict = {}
    for row in df.select(F.col(text).alias("j")).mapInPandas(parts, "shape string").collect():
        merged = merge_shapes(merged, json.loads(row["shape"]), map_keys)
    return merged


def variant_filled(v: Column) -> Column:
    """has_value of a VARIANT: some scalar in its JSON text, keys aside, is not void."""
    tokens = F.regexp_extract_all(F.to_json(v), F.lit(r'"(?:[^"\\]|\\.)*":?|[^\s{}\[\],:"]+'), F.lit(0))
    plain = lambda t: F.regexp_replace(F.when(t.startswith('"'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t), r"\\[tnrfb]", " ")
    return F.coalesce(F.exists(tokens, lambda t: ~t.endswith('":') & ~is_void(plain(t))), F.lit(False))


def flatten_json(df: DataFrame, root: str, text: str, shape: dict | None = None, free_keys: tuple[str, ...] = ()) -> dict[str, Child]:
    """Tables of a column of JSON texts whose shape varies from row to row.

    The merged schema (``infer_shape``) fixes the tables. A place that holds arrays in some rows and objects with free
    keys in others is one table (path mark ``*``), with the ordinal or the key filled. ``obj`` is a VARIANT.
    """
    shape = infer_shape(df, text, free_keys=free_keys) if shape is None else shape
    spark = df.sparkSession
    tables: dict[str, Child] = {}

    def visit(frame: DataFrame, shape: dict, path: str, parent: str) -> None:
        # frame: root, parent_sk, pfad, obj
        for name, below in shape.get("o", {}).items():
            if below.keys() & {"o", "a", "m"}:
                if step := _step(name):
                    inner = frame.withColumn("_value", F.try_variant_get("obj", "$" + step, "variant"))
                else:
                    objects = frame.where(F.schema_of_variant("obj").startswith("OBJECT"))
                    inner = objects.lateralJoin(spark.tvf.variant_explode(F.col("obj")).toDF("_pos", "_key", "_value")).where(F.col("_key") == name)
                inner = inner.select("root", "parent_sk", _join(F.col("pfad"), name).alias("pfad"), F.col("_value").alias("obj")).where(F.col("obj").isNotNull())
                visit(inner, below, f"{path}.{name}" if path else name, parent)
        element = merge_shapes(shape.get("a", {}), shape.get("m", {}))
        if element.keys() & {"o", "a", "m"}:
            free = F.lit("m" in shape)
            kind = F.schema_of_variant("obj")
            rows = frame.where(kind.startswith("ARRAY") | kind.startswith("OBJECT") & free).lateralJoin(spark.tvf.variant_explode(F.col("obj").outer()).toDF("_pos", "_key", "_value"))
            place = F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).when(F.col("pfad") == "", F.col("_key")).otherwise(F.concat(F.lit("."), F.col("_key")))
            rows = rows.select("root", "parent_sk", F.when(F.col("_key").isNull(), F.col("_pos")).alias("ordinal"), F.col("_key").alias("key"), F.concat("pfad", place).alias("pfad"), F.col("_value").alias("obj"))
            own = rows.select("root", _sk(F.col("root"), F.col("pfad")).alias("sk"), "parent_sk", "ordinal", "key", "pfad", variant_filled(F.col("obj")).alias("filled"), "obj")
            tables[path + "*"] = Child(path + "*", parent, own, element)
            visit(own.select("root", F.col("sk").alias("parent_sk"), "pfad", "obj"), element, path + "*", path + "*")

    base = df.select(F.col(root).alias("root"), F.xxhash64(F.col(root)).alias("parent_sk"), F.lit("").alias("pfad"), F.try_parse_json(text).alias("obj")).where(F.col("obj").isNotNull())
    visit(base, shape, "", "")
    return tables
