"""Content hashes of nested JSON that do not depend on key order, spacing or ids.

A payload is parsed once into a VARIANT and taken apart level by level in the
JVM: every step explodes the containers that the step before has found, until
none is left. Fields that name rows (`id`, `*_id`, `*_ids`) go with everything
below them. What remains are leaves, a path and a value; the hash covers the
sorted leaves, so equal content has one hash however it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import checkpointed


def names_a_row(key: Column) -> Column:
    """Whether a field holds the id of a row: true of `id`, `x_id` and `x_ids`."""
    return (key == "id") | F.endswith(key, F.lit("_id")) | F.endswith(key, F.lit("_ids"))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def leaves(payloads: DataFrame, keys: list[str], column: str = "payload", drop: bool = True) -> DataFrame:
    """`keys`, path, value: the leaves of each payload, one row each.

    Paths are `/key` and `/[place]`, a `/` or `~` in a key written `~1` and `~0`.
    Values are marked by kind: `s:` a text, `n:` a number (as a double), `b:` a
    truth value, `null`, and `{}` or `[]` for empty containers. With `drop`,
    fields that name rows are left out. Payloads that are null or no JSON have
    the one leaf `invalid`.
    """
    rows = payloads.select(*keys, F.lit("").alias("path"), F.try_parse_json(column).alias("v"))
    bad = rows.filter("v IS NULL").select(*keys, "path", F.lit("invalid").alias("value"))
    open_, found = rows.filter("v IS NOT NULL"), [bad]
    while True:
        held = checkpointed(open_.withColumn("kind", _kind(F.col("v"))))
        found.append(held.filter(~F.col("kind").isin("OBJECT", "ARRAY")).select(*keys, "path", _value().alias("value")))
        containers = held.filter(F.col("kind").isin("OBJECT", "ARRAY"))
        if containers.isEmpty():
            break
        containers.createOrReplaceTempView("_containers")
        listed = ", ".join(f"c.`{k}`" for k in keys)
        inner = containers.sparkSession.sql(f"SELECT {listed}, c.path, c.kind, e.pos, e.key, e.value AS v FROM _containers AS c LEFT JOIN LATERAL variant_explode_outer(c.v) AS e")
        containers.sparkSession.catalog.dropTempView("_containers")
        inner = checkpointed(inner)
        found.append(inner.filter("pos IS NULL").select(*keys, "path", F.when(F.col("kind") == "OBJECT", "{}").otherwise("[]").alias("value")))
        escaped = F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        step = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("/"), escaped)).otherwise(F.concat(F.lit("/["), F.col("pos").cast("string"), F.lit("]")))
        kept = inner.filter("pos IS NOT NULL")
        if drop:
            kept = kept.filter((F.col("kind") == "ARRAY") | ~names_a_row(F.col("key")))
        open_ = kept.select(*keys, F.concat("path", step).alias("path"), "v")
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    return union


def _value() -> Column:
    text = F.col("v").cast("string")
    return (
        F.when(F.col("kind") == "VOID", F.lit("null"))
        .when(F.col("kind") == "STRING", F.concat(F.lit("s:"), text))
        .when(F.col("kind") == "BOOLEAN", F.concat(F.lit("b:"), text))
        .otherwise(F.concat(F.lit("n:"), text.cast("double").cast("string")))
    )


def content_hashes(payloads: DataFrame, keys: list[str], column: str = "payload") -> DataFrame:
    """`keys`, content_hash: SHA-256 of the sorted leaves of each payload, ids left out.

    One payload is one value of one row, so its leaves fit one row again. A
    payload whose fields all name rows has no leaves and the hash of nothing.
    """
    line = F.concat("path", F.lit("="), "value")
    made = leaves(payloads, keys, column).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_lines"))
    known = payloads.select(*keys).distinct().join(made, keys, "left")
    return known.select(*keys, F.sha2(F.coalesce("_lines", F.lit("")), 256).alias("content_hash"))
