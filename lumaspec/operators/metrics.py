"""Ranking, probability and interval metrics. Scores are counted before they are ordered, and
running sums go over ranges of scores, so no task holds a whole scene's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spectral import clip
from ..store import cut


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are equal, null being equal to null.
    Without keys the one row of ``right`` goes with every row."""
    named = right.select(*[F.col(f"`{k}`").alias(f"k__{n}") for n, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = F.lit(True)
    for n, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"k__{n}"))
    return left.join(named if keys else F.broadcast(named), on, how).drop(*[f"k__{n}" for n in range(len(keys))])


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, sent to all tasks of a join if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def running(df: DataFrame, keys: list[str], order: list[Column], sums: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``before_<sum>`` for each of ``sums``: its total over earlier rows of the same keys.

    Rows are dealt over ranges of keys and order and written once with the number of their range:
    ranges are cut by a sample, so two evaluations need not cut alike. A null in a sum counts 0."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("part_", F.spark_partition_id()), "running")
    totals = dealt.groupBy(*keys, "part_").agg(*[F.sum(s).alias(f"t_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "part_", *[F.coalesce(F.sum(f"t_{s}").over(earlier), F.lit(0)).alias(f"s_{s}") for s in sums])
    inside = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = match(dealt, starts, [*keys, "part_"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"s_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sums])


def quantiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """``keys, q0, q1, ...``: exact quantiles between the two nearest ranks, nulls left out. Values
    are counted and ranked by running sums over ranges, so no task holds a group."""
    by = keys or ["k_"]
    rows = (df if keys else df.withColumn("k_", F.lit(0))).where(F.col(value).isNotNull())
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("cnt_"))
    ranked = running(counts, by, [F.col("v_")], ["cnt_"])
    ranked = match(ranked, ranked.groupBy(*by).agg(F.sum("cnt_").alias("n_")), by)

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("before_cnt_") <= rank) & (rank < F.col("before_cnt_") + F.col("cnt_")), F.col("v_")))

    def point(p: float) -> Column:
        place = (F.max("n_") - 1) * F.lit(p)
        each = (F.col("n_") - 1) * F.lit(p)
        low, high = at(F.floor(each)), at(F.ceil(each))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return ranked.groupBy(*by).agg(*[point(p).alias(f"q{i}") for i, p in enumerate(points)]).select(*keys, *[f"q{i}" for i in range(len(points))])


def score_counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """``keys, score, pos, neg`` for each distinct score."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))


def roc_auc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys, auc, positives, negatives``: ranks of ties are shared; 0.5 if a class is missing."""
    counted = running(score_counts(df, keys, score, label), keys, [F.col("score")], ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    both = F.sum("pos") * F.sum("neg")
    return counted.groupBy(*keys).agg(F.when(both > 0, wins / both).otherwise(0.5).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def roc_curve(df: DataFrame, keys: list[str], tie: str, score: str = "score", label: str = "label") -> DataFrame:
    """``keys, tie, fpr, tpr`` after each row in falling order of score; ties by the ``tie`` column."""
    rows = df.select(*keys, tie, score, F.col(label).cast("long").alias("p"), (~F.col(label)).cast("long").alias("q"))
    counted = running(rows, keys, [F.isnan(score), F.col(score).desc(), F.col(tie)], ["p", "q"])
    whole = counted.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    return match(counted, whole, keys).select(*keys, tie, ((F.col("before_q") + F.col("q")) / F.greatest("all_q", F.lit(1))).alias("fpr"), ((F.col("before_p") + F.col("p")) / F.greatest("all_p", F.lit(1))).alias("tpr"))


def far_thresholds(df: DataFrame, keys: list[str], far: float, score: str = "score") -> DataFrame:
    """``keys, threshold``: the score that at most ``far`` of the rows exceed (the (k+1)-th largest, k = floor(far n))."""
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("cnt_"))
    above = running(counts, keys, [F.col("score").desc()], ["cnt_"])
    above = match(above, above.groupBy(*keys).agg(F.sum("cnt_").alias("n")), keys)
    k = F.floor(F.col("n") * F.lit(far))
    return above.where((F.col("before_cnt_") <= k) & (F.col("before_cnt_") + F.col("cnt_") > k)).select(*keys, F.col("score").alias("threshold"))


def rates_at(df: DataFrame, keys: list[str], threshold: Column, score: str = "score", label: str = "label") -> DataFrame:
    """``keys, pd, far``: shares of each class strictly above a threshold."""
    over = (F.col(score) > threshold).cast("double")
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(label), over)).alias("pd"), F.avg(F.when(~F.col(label), over)).alias("far"))


def pd_at_far(df: DataFrame, keys: list[str], far: float, score: str = "score", label: str = "label") -> DataFrame:
    """``keys, threshold, pd``; keys with a class missing are left out."""
    limit = far_thresholds(df.where(~F.col(label)), keys, far, score)
    return match(df.where(F.col(label)), limit, keys).groupBy(*keys, "threshold").agg(F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("pd"))


def nll(p: str, y: str, eps: float = 1e-12) -> Column:
    q = clip(F.col(p), eps, 1 - eps)
    return F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.log1p(-q)))


def brier(p: str, y: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def bin_index(p: Column, bins: int) -> Column:
    """Bin of a probability over edges i/n, right-open but for the last. What lies below 0 is in the
    first and what lies above 1 in the last; null and NaN are in none (null)."""
    edges = F.array(*[F.lit(k * (1.0 / bins)) for k in range(bins)])
    return F.when(~F.isnan(p), F.greatest(F.size(F.filter(edges, lambda e: e <= p)) - 1, F.lit(0)))


def scaled_index(p: Column, bins: int) -> Column:
    """Bin of a probability by the whole part of its product with ``bins``, the last one also taking what
    lies above. It differs from :func:`bin_index` at edges that no double states, as 0.6 of 5."""
    return F.when(~F.isnan(p), F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1)))


def reliability(df: DataFrame, p: str, y: str, bins: int = 15, keys: list[str] | None = None, index=bin_index) -> DataFrame:
    """``keys, bin, lo, hi, count, mean_probability, event_rate``; empty bins have null means. Rows
    whose probability is null or NaN, or whose outcome is null, count nowhere. ``index`` deals rows to bins."""
    keys = keys or []
    df = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    found = df.groupBy(*keys, index(F.col(p), bins).alias("bin")).agg(F.count("*").alias("count"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("event_rate"))
    whole = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return match(every, found, [*keys, "bin"], "left").select(*keys, "bin", (F.col("bin") * F.lit(1.0 / bins)).alias("lo"), ((F.col("bin") + 1) * F.lit(1.0 / bins)).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"), "mean_probability", "event_rate")


def calibration_error(curve: DataFrame) -> DataFrame:
    w = F.col("count") / F.sum("count").over(Window.partitionBy())
    return curve.select((w * F.abs(F.col("mean_probability") - F.col("event_rate"))).alias("e")).agg(F.sum("e").alias("ece"))


def pearson(a: str, b: str) -> Column:
    return F.when((F.stddev_pop(a) < 1e-9) | (F.stddev_pop(b) < 1e-9), 0.0).otherwise(F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def errors(predicted: str, truth: str) -> dict[str, Column]:
    d = F.col(predicted) - F.col(truth)
    return {"mae": F.avg(F.abs(d)), "bias": F.avg(d), "pearson_r": pearson(predicted, truth)}


def coverage(lower: str, upper: str, truth: str) -> Column:
    return F.avg(((F.col(truth) >= F.col(lower)) & (F.col(truth) <= F.col(upper))).cast("double"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank", few: int = 200_000) -> DataFrame:
    """Adds ranks from 1 in which ties share their mean. Up to ``few`` different values are sent to
    all tasks, which spares rows of a common value their meeting in one task; beyond that it's a join."""
    counts = df.groupBy(*keys, F.col(value).alias("v_")).agg(F.count("*").alias("cnt_"))
    ranked = running(counts, keys, [F.col("v_")], ["cnt_"]).select(*keys, "v_", (F.col("before_cnt_") + (F.col("cnt_") + 1) / 2.0).alias(name))
    ranked = small(cut(ranked, "ranks"), few)
    return match(df.withColumn("v_", F.col(value)), ranked, [*keys, "v_"]).select(*[F.col(f"`{c}`") for c in df.columns], name)
