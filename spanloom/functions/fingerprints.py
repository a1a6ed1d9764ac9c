"""Order-independent fingerprints of rule sets and tool schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rules_fingerprint(rules: DataFrame, settings: str = "{}") -> DataFrame:
    """One row: 12 hex digits of sha256 over the sorted rules (without their row ids) and the settings."""
    row = F.to_json(F.struct(*sorted(c for c in rules.columns if c != "id")))
    return rules.agg(F.left(F.sha2(F.concat_ws("\n", F.array_join(F.sort_array(F.collect_list(row)), "\n"), F.lit(settings)), 256), F.lit(12)).alias("fingerprint"))


def tool_schema_hash(schemas: DataFrame) -> DataFrame:
    """(agent_name, tool, schema) → (agent_name, hash), whatever the order of the tools."""
    row = F.concat_ws("=", "tool", "schema")
    return schemas.groupBy("agent_name").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("hash"))
