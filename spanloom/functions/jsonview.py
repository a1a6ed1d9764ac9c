"""Tolerant views of JSON text: what doesn't parse gives nothing, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import stored

DEPTH = 8


def _json_text(text: Column) -> Column:
    """The text, or the single {...} inside prose, where that is JSON; or null."""
    inner = F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull(), inner)


def tolerant(text: Column) -> Column:
    """The text as VARIANT, or the single {...} inside prose, or null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))))


def children(level: DataFrame) -> DataFrame:
    """The columns of ``level`` with _pos, _key (null in an array) and _value of each part of its VARIANT ``v``."""
    return level.sparkSession.sql("select l.*, e.pos as _pos, e.key as _key, e.value as _value from {level} l, lateral variant_explode(l.v) e", level=level)


def json_leaves(rows: DataFrame, key: list[str], text: str, depth: int = DEPTH, ordered: bool = False) -> DataFrame:
    """key…, parent_path, key_name, value, type, depth and place (positions from the root on) of every scalar of the JSON in ``text``, down to
    ``depth`` levels. Fields of an object stand in the order of their names, as VARIANT keeps them; with ``ordered`` their places are
    those in the text, which a map of the raw texts keeps.

    Each level is one generator step over the values that are still objects or arrays, is stored, and ends the search where nothing goes
    deeper: a text is parsed once. There is no recursion and no UDF. Joins of the leaves shuffle both sides: Spark takes a VARIANT for 2 KB, so it
    estimates columns beside one at a small part of the stored files, and would broadcast leaves of any number.
    """
    keys = [F.col(k) for k in key]
    raw = _json_text(F.col(text)) if ordered else F.lit(None).cast("string")
    level = rows.select(*keys, F.lit("$").alias("path"), tolerant(F.col(text)).alias("v"), raw.alias("raw")).where("v is not null")
    level = level.select(*keys, F.lit("").alias("parent_path"), F.lit("$").alias("key_name"), "path", F.array().cast("array<int>").alias("place"), "v", "raw")
    out = None
    for d in range(depth + 1):
        level = stored(level)
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.where(~nested).select(*keys, "parent_path", "key_name", F.try_variant_get("v", "$", "string").alias("value"), F.schema_of_variant("v").alias("type"), F.lit(d).alias("depth"), "place")
        out = leaves if out is None else out.unionByName(leaves)
        if d == depth or level.where(nested).isEmpty():
            break
        if ordered:
            level = level.where(nested).withColumn("_map", F.when(kind.startswith("OBJECT"), F.from_json("raw", "map<string,string>"))).withColumn("_list", F.when(kind.startswith("ARRAY"), F.from_json("raw", "array<string>")))
        each = children(level)
        name = F.coalesce(F.col("_key"), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        place, inner = F.col("_pos"), F.col("raw")
        if ordered:
            place = F.coalesce(F.when(F.col("_key").isNotNull(), F.array_position(F.map_keys("_map"), F.col("_key")) - 1), F.col("_pos")).cast("int")
            inner = F.when(F.col("_key").isNotNull(), F.try_element_at("_map", F.col("_key"))).otherwise(F.get("_list", F.col("_pos")))
        level = each.select(*keys, F.col("path").alias("parent_path"), name.alias("key_name"), F.concat("path", F.lit("."), name).alias("path"), F.array_append("place", place).alias("place"), F.col("_value").alias("v"), inner.alias("raw"))
    return out.hint("merge")
