"""Rows for publication from nested results: JSON of any shape as long paths, then intervals by path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.experiment import verdict


def leaves(results: DataFrame, key: str, text: str, depth: int = 12) -> DataFrame:
    """``key, path, value, number``: every leaf of JSON texts, its path as names and places from 0 with
    dots between (a dot in a name is ``~1``, a tilde ``~0``), its value as text and, if it is one, as a
    number; true and false are 1 and 0.

    Texts that aren't JSON, null ones, and empty objects and arrays have no leaves; a JSON null is a leaf
    without a value. What lies deeper than ``depth`` is one leaf, its value the JSON."""
    spark = results.sparkSession
    rows = results.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(text).alias("node")).where("node is not null")
    out = None
    for level in range(depth + 1):
        kind = F.schema_of_variant("node")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        done = rows if level == depth else rows.where(~inner)
        out = done if out is None else out.unionByName(done)
        if level == depth:
            break
        each = rows.where(inner).lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        name = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("c_key"), F.col("c_pos").cast("string")), "~", "~0"), "\\.", "~1")
        each = each.toDF("key", "path", "node", "c_pos", "c_key", "c_value")
        rows = each.select("key", F.concat_ws(".", F.nullif("path", F.lit("")), name).alias("path"), F.col("c_value").alias("node"))
    value = F.when(F.schema_of_variant("node").isin("VOID"), F.lit(None).cast("string")).otherwise(F.expr("try_variant_get(node, '$', 'string')"))
    value = F.coalesce(value, F.when(F.schema_of_variant("node") != "VOID", F.to_json("node")))
    number = F.when(value == "true", 1.0).when(value == "false", 0.0).otherwise(F.expr("try_variant_get(node, '$', 'double')"))
    return out.select(F.col("key").alias(key), "path", value.alias("value"), number.alias("number"))


@dataclass(frozen=True)
class Entry:
    """A row of a table or plot. ``path``: of an interval's parent, whose leaves ``mean``, ``ci_low`` and
    ``ci_high`` it takes; with ``single`` the path is a leaf's own. ``turned``: less is better, so that the
    sign and the ends are turned."""

    name: str
    key: str
    path: str
    turned: bool = False
    single: bool = False


def oriented(low: Column, high: Column, turned: Column) -> tuple[Column, Column]:
    """The ends of an interval, or, if it is turned, of its negative."""
    return F.when(turned, -high).otherwise(low), F.when(turned, -low).otherwise(high)


def entries(found: DataFrame, key: str, wanted: list[Entry]) -> DataFrame:
    """``place, name, estimate, low, high, crosses_zero, verdict, source``: one row per entry, in its order,
    whether its leaves are there or not (nulls, verdict ``missing``); the source names key and path."""
    spark = found.sparkSession
    kind = "place int, name string, w_key string, w_path string, turned boolean, part string"
    rows = [(n, e.name, e.key, e.path if e.single else f"{e.path}.{p}", e.turned, p) for n, e in enumerate(wanted) for p in (("mean",) if e.single else ("mean", "ci_low", "ci_high"))]
    asked = F.broadcast(spark.createDataFrame(rows, kind))  # the entries of a publication
    met = found.join(asked, (F.col(key).cast("string") == F.col("w_key")) & (F.col("path") == F.col("w_path")))
    part = lambda p: F.max(F.when(F.col("part") == p, F.col("number"))).alias(p)
    got = met.groupBy(F.col("place").alias("p_")).agg(part("mean"), part("ci_low"), part("ci_high"))
    every = spark.createDataFrame([(n, e.name, e.turned, f"{e.key}:{e.path}") for n, e in enumerate(wanted)], "place int, name string, turned boolean, source string")
    out = every.join(got, F.col("place") == F.col("p_"), "left")
    low, high = oriented(F.col("ci_low"), F.col("ci_high"), F.col("turned"))
    out = out.select("place", "name", F.when(F.col("turned"), -F.col("mean")).otherwise(F.col("mean")).alias("estimate"), low.alias("low"), high.alias("high"), "source")
    said = F.when(F.col("estimate").isNull(), "missing").when(F.col("low").isNull() | F.col("high").isNull(), "value").otherwise(verdict(F.col("low"), F.col("high")))
    return out.select("place", "name", "estimate", "low", "high", ((F.col("low") <= 0) & (F.col("high") >= 0)).alias("crosses_zero"), said.alias("verdict"), "source")
