"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the running sum finds the bucket that crosses the
source's budget; only that bucket is looked at with the next bits of the hash; at the end each
source has one hash threshold, and documents are taken by comparing with it. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, LEVELS = 10, 4


def doc_hash(column: str):
    """Forty bits of the key's MD5; equal keys share them."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("null"))), 1, 10), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per source: ``source_size``, ``target``. Weights repeat over sources by code point,
    null last. Targets split ``share`` of all sizes by weight, none above ``limit`` of its source;
    the water level is found from sources in the order in which they fill."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    fill = Window.orderBy(F.col("limit_") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    return (
        totals.withColumn("weight", weight)
        .withColumn("limit_", F.lit(limit) * F.col("source_size"))
        .withColumn("all_", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("all_") - F.coalesce(F.sum("limit_").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("open_", F.col("level") * F.col("weight") < F.col("limit_"))
        .withColumn("level", F.max(F.when(F.col("open_"), F.col("level"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("limit_")).otherwise(F.least("limit_", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, key: str = "doc_id", weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row.

    Each document is taken ``floor(target / source_size)`` times, and once more if its hash lies
    under the source's threshold. A null text has size 0 and a null source is a source; rows that
    repeat a key are taken or left together; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        doc_hash(key).alias("hash"),
    )
    rows = cut(rows, "mix-sizes")
    targets = cut(source_targets(rows, weights, share, limit), "mix-targets")
    # budget: what is left of the target after whole copies
    state = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")
    )
    state = state.withColumn("low", F.lit(0).cast("long"))
    for level in range(LEVELS):
        width = 1 << (LEVEL_BITS * (LEVELS - 1 - level))
        here = (
            rows.join(state.select(F.col("source").alias("s_"), "low"), F.col("source").eqNullSafe(F.col("s_")))
            .where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width * (1 << LEVEL_BITS)))
            .groupBy("source", F.expr(f"(hash - low) div {width}").alias("bucket"))
            .agg(F.sum("size").alias("size"))
        )
        running = Window.partitionBy("source").orderBy("bucket")
        crossed = (
            here.withColumn("upto", F.sum("size").over(running))
            .join(state.select(F.col("source").alias("s_"), "budget"), F.col("source").eqNullSafe(F.col("s_")))
            .groupBy(F.col("source").alias("t_"))
            .agg(
                F.min(F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("bucket"),
                F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("under"),
            )
        )
        state = state.join(crossed, F.col("source").eqNullSafe(F.col("t_")), "left").select(
            "source", "source_size", "target", "whole",
            (F.col("budget") - F.coalesce("under", F.lit(0))).alias("budget"),
            (F.col("low") + F.coalesce("bucket", F.lit(1 << LEVEL_BITS)) * width).alias("low"),
        )
        state = cut(state, "mix-state")
    # documents of size 0 lie under any threshold; they keep the limit, too
    picked = F.least(F.col("whole") + F.when(F.col("hash") < F.col("low"), 1).otherwise(0), F.lit(int(limit)).cast("long"))
    return rows.join(state.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).select(
        "doc_id", "source", "size", "source_size", "target", picked.alias("copies"), (picked * F.col("size")).alias("taken")
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``. Nulls,
    repeated rows and empty tables are as in :func:`mix`; columns may have any names."""
    plan = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias("mix_copies_")).withColumnRenamed("doc_id", "mix_id_")
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("mix_id_")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = joined.where("mix_copies_ > 0")
    return kept.select(*names, F.explode(F.expr("array_repeat(0, int(mix_copies_))")).alias("mix_turn_")).drop("mix_turn_")
