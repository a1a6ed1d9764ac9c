"""JSON Schemas as rows, joined to the parts of JSON values by path.

A path is a list: ".key" for a field, "[]" for any item of an array. A schema gives one row for each place that it says something of, a
value one row for each part that lies at such a place. Parts that break the rule of their place are what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsonview import DEPTH, children
from .lineage import cut

# The types of JSON Schema as VARIANT names them.
JSON_TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "integer": "^(BIGINT|INT|TINYINT|SMALLINT|DECIMAL\\(\\d+,0\\))", "number": "^(BIGINT|INT|TINYINT|SMALLINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "null": "^VOID"}


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def schema_rules(schemas: DataFrame, key: str, text: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, level, types, listed, required, further): what the schema in ``text`` asks at each place down to ``depth`` levels below the
    top. types: names, or null; listed: allowed values as JSON, or null; required: keys; further: whether it says something deeper still.
    Words of JSON Schema other than type, enum, required, properties and items are ignored; so is a text that is no JSON."""
    level = cut(schemas.select(key, F.array().cast("array<string>").alias("path"), F.try_parse_json(text).alias("s")).where("s is not null"))
    out = None
    for d in range(depth + 1):
        fields = F.coalesce(F.map_entries(_get("s", "$.properties", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
        item = _get("s", "$.items", "variant")
        one = _get("s", "$.type", "string")
        types = F.when(_get("s", "$.type", "variant").isNotNull(), F.coalesce(_get("s", "$.type", "array<string>"), F.array(one)))
        here = level.withColumn("fields", fields).withColumn("item", item)
        rules = here.select(key, "path", F.lit(d).alias("level"), types.alias("types"), F.transform(_get("s", "$.enum", "array<variant>"), lambda x: F.to_json(x)).alias("listed"),
                            F.coalesce(_get("s", "$.required", "array<string>"), F.array().cast("array<string>")).alias("required"), ((F.size("fields") > 0) | F.col("item").isNotNull()).alias("further"))
        out = rules if out is None else out.unionByName(rules)
        if d < depth:
            named = here.select(key, "path", F.explode("fields").alias("e")).select(key, F.array_append("path", F.concat(F.lit("."), "e.key")).alias("path"), F.col("e.value").alias("s"))
            each = here.where("item is not null").select(key, F.array_append("path", F.lit("[]")).alias("path"), F.col("item").alias("s"))
            level = cut(named.unionByName(each))
            if level.isEmpty():
                break
    return cut(out)


def breaches(values: DataFrame, id_: list[str], rules: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """(id…, path, reason): parts of ``values`` (id…, key, v) that break a rule of their schema (key): type, enum or required; and reason
    deeper where a value goes on below the last level while its schema does, too.

    Each level is one equi-join of parts and rules by schema and path, and only parts with rules below them are opened further, until none
    is left."""
    keys = [*(F.col(c) for c in id_), F.col(key)]
    level = values.select(*keys, F.array().cast("array<string>").alias("path"), "v").where("v is not null")
    out = None
    for d in range(depth + 1):
        met = level.join(F.broadcast(rules.where(F.col("level") == d).drop("level")), [key, "path"])  # written by people, and few: joined by key, all values of a schema would go to one task
        shape = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
        patterns = F.create_map(*(y for k, p in JSON_TYPES.items() for y in (F.lit(k), F.lit(p))))
        typed = F.exists("types", lambda t: F.coalesce(F.regexp_like(shape, F.element_at(patterns, t)), F.lit(False)))
        names = F.coalesce(F.map_keys(_get("v", "$", "map<string,variant>")), F.array().cast("array<string>"))
        compound = shape.startswith("OBJECT") | shape.startswith("ARRAY")
        reason = (F.when(F.col("types").isNotNull() & ~F.coalesce(typed, F.lit(False)), "type").when(F.col("listed").isNotNull() & ~F.array_contains("listed", F.to_json("v")), "enum")
                  .when(shape.startswith("OBJECT") & (F.size(F.array_except("required", names)) > 0), "required"))
        if d == depth:
            reason = F.coalesce(reason, F.when(F.col("further") & compound, "deeper"))
        met = cut(met.withColumn("reason", reason))
        bad = met.where("reason is not null").select(*id_, "path", "reason")
        out = bad if out is None else out.unionByName(bad)
        below = met.where(F.col("further") & compound)
        if d == depth or below.isEmpty():
            break
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), "_key")).otherwise("[]")
        level = children(below.select(*keys, "path", "v")).select(*keys, F.array_append("path", step).alias("path"), F.col("_value").alias("v"))
    return out
