"""Joins by order and by place: as-of and bracketing joins of long tables, and points in boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut
from .geometry import TurnedCrop
from .metrics import match, small


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """``left`` with ``before`` and ``after``: structs of ``on`` and the ``values`` of the last row of ``right``
    with the same ``by`` that is not beyond it in ``on``, and of the first that is beyond; null where
    there is none.

    Both sides are one table, dealt over ranges of keys and order and written once; within a range a
    window carries what was last and is next known, and the ends of ranges are carried over the
    ranges of a key. Neither a key nor one value of ``on`` has to fit a task: rows of ``left`` that
    agree in both are told apart by a hash. Nulls in ``by`` meet each other; a row of ``left`` whose
    ``on`` is null has neither neighbour; such rows of ``right`` are left out, and of several with one
    ``on`` the one of the greatest values counts. Columns of ``left`` may have any names but these two.
    """
    own = [c for c in left.columns if c not in by]
    known = F.struct(F.col(on), *[F.col(v) for v in values])
    row = F.struct(*[F.col(f"`{c}`") for c in own])
    keys = [f"k{n}_" for n in range(len(by))]
    named = [F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)]
    kind = right.select(known.alias("s")).schema["s"].dataType
    rows = right.where(F.col(on).isNotNull()).select(*named, F.col(on).cast("double").alias("on_"), F.lit(0).alias("side_"), F.lit(0).cast("long").alias("tie_"), known.alias("known_"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("row_"))
    asks = left.select(*named, F.col(f"`{on}`").cast("double").alias("on_"), F.lit(1).alias("side_"), F.xxhash64(row).alias("tie_"), F.lit(None).cast(kind).alias("known_"), row.alias("row_"))
    order = [F.col("on_"), F.col("side_"), F.col("known_"), F.col("tie_")]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.unionByName(asks).repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("part_", F.spark_partition_id()), "as-of")
    inside = Window.partitionBy("part_", *keys).orderBy(*order)
    ends = dealt.groupBy(*keys, "part_").agg(F.max_by("known_", F.when(F.col("known_").isNotNull(), F.struct("on_", "known_"))).alias("last_"), F.min("on_").alias("from_"), F.min_by("known_", F.when(F.col("known_").isNotNull(), F.struct("on_", "known_"))).alias("first_"))
    over = Window.partitionBy(*keys).orderBy("part_")
    ends = ends.select(*keys, "part_", F.last("last_", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("last_"), F.first("first_", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("first_"))
    out = match(dealt, ends, [*keys, "part_"])
    before = F.coalesce(F.last("known_", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("last_"))
    after = F.coalesce(F.first("known_", True).over(inside.rowsBetween(1, Window.unboundedFollowing)), F.col("first_"))
    out = out.select(*keys, "side_", "on_", "row_", before.alias("before"), after.alias("after")).where("side_ = 1")
    there = lambda c: F.when(F.col("on_").isNotNull(), F.col(c)).alias(c)
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *[F.col(f"row_.`{c}`").alias(c) for c in own], there("before"), there("after"))


def bracketed(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """``left`` with ``value`` between the two rows of ``right`` around it, in proportion to their distance in
    ``on``; beyond the ends of ``right`` the value of the end. Null where ``right`` has no row of the keys."""
    both = as_of(left, right, by, on, [value])
    x, x0, x1 = F.col(on), F.col("before")[on], F.col("after")[on]
    y0, y1 = F.col("before")[value], F.col("after")[value]
    return both.withColumn(value, F.when(x0.isNull(), y1).when(x1.isNull(), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))).drop("before", "after")


def in_boxes(points: DataFrame, boxes: DataFrame, key: str = "roi", crop: TurnedCrop | None = None) -> DataFrame:
    """``points`` (y, x and others) with the ``key`` of every half-open box (y0, x0, y1, x1) that holds them.

    Boxes lie on square grids whose tiles are powers of two: each on the one whose tiles are at least
    as long as its longer side, so it touches four tiles at most. Points ask on every grid that has
    boxes, by an equi-join on the tile, and are then held against the box itself; no pair is made
    whose tiles differ. Boxes of a ``crop`` are in its turned places, and so are then the points that
    are asked for. Up to 10,000 boxes are sent to all tasks. A box with a null or an end that isn't
    beyond its start holds nothing, nor does any box hold a point with a null or NaN place; points
    keep all their columns but for ``key``."""
    spot = (F.col("y").cast("double"), F.col("x").cast("double"))
    v, u = crop.from_scene(*spot) if crop else spot
    held = boxes.select(F.col(key).alias("b_key"), *[F.col(c).cast("double").alias(f"b_{c}") for c in ("y0", "x0", "y1", "x1")]).where("b_y1 > b_y0 and b_x1 > b_x0")
    side = F.greatest(F.col("b_y1") - F.col("b_y0"), F.col("b_x1") - F.col("b_x0"), F.lit(1.0))
    tiled = held.withColumn("b_grid", F.ceil(F.log2(side)).cast("int"))

    def span(a: str, b: str) -> Column:
        tile = F.pow(F.lit(2.0), F.col("b_grid"))
        return F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile)))

    tiled = cut(tiled.withColumn("b_ty", span("b_y0", "b_y1")).withColumn("b_tx", span("b_x0", "b_x1")), "boxes")
    grids = [r[0] for r in tiled.select("b_grid").distinct().orderBy("b_grid").collect()]  # a few dozen: sides are doubles
    if not grids:
        return points.withColumn(key, F.lit(None).cast(boxes.schema[key].dataType)).where("false")
    asks = points.withColumns({"p_v": v, "p_u": u}).where(~F.isnan("p_v") & ~F.isnan("p_u"))
    asks = asks.withColumn("p_grid", F.explode(F.array(*[F.lit(g) for g in grids])))
    tile = F.pow(F.lit(2.0), F.col("p_grid"))
    asks = asks.withColumns({"p_ty": F.floor(F.col("p_v") / tile), "p_tx": F.floor(F.col("p_u") / tile)})
    on = (F.col("p_grid") == F.col("b_grid")) & (F.col("p_ty") == F.col("b_ty")) & (F.col("p_tx") == F.col("b_tx"))
    inside = (F.col("p_v") >= F.col("b_y0")) & (F.col("p_v") < F.col("b_y1")) & (F.col("p_u") >= F.col("b_x0")) & (F.col("p_u") < F.col("b_x1"))
    found = asks.join(small(tiled, 40_000), on & inside)
    return found.select(*[F.col(f"`{c}`") for c in points.columns if c != key], F.col("b_key").alias(key))
