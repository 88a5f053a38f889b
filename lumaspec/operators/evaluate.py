"""Evaluation of calibrated detectors over cases: splits, resampling by level, summaries, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut
from .calibrate import detection_limit
from .experiment import hash_index
from .metrics import match, running

SPLITS = ("fit", "calibrate", "evaluate")


def split_of(case: Column, names: tuple[str, ...] = SPLITS) -> Column:
    """The split of a numbered case; a case, with all its rows, is in one."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(case, F.lit(len(names))) + 1).cast("int"))


def in_several(rows: DataFrame, case: str, split: str = "split") -> DataFrame:
    """Cases with rows in more than one split, with how many splits; none if splits are apart."""
    return rows.groupBy(case).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def _numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds the row's number from 0 within keys, in rising order of a column that tells rows apart."""
    return running(rows.withColumn("one__", F.lit(1)), keys, [F.col(order)], ["one__"]).withColumnRenamed("before_one__", name).drop("one__")


def hierarchical_bootstrap(cases: DataFrame, scene: str, stratum: str, value: str, order: str, replicates: int, seed: int = 17) -> DataFrame:
    """``replicate, mean``: scenes are drawn with replacement, as many as there are, and in every
    stratum of each drawn scene as many of its cases as there are. Draws are joined to numbered
    scenes and cases, so the work spreads over draws."""
    rows = cases.select(F.lit(0).alias("all_"), F.col(scene).alias("scene_"), F.col(stratum).alias("stratum_"), F.col(value).alias("value_"), F.col(order).alias("order_"))
    numbered = _numbered(rows.drop("all_"), ["scene_", "stratum_"], "order_", "k_")
    strata = rows.groupBy("all_", "scene_", "stratum_").agg(F.count("*").alias("n_"))
    place = F.row_number().over(Window.partitionBy("scene_").orderBy("stratum_")) - 1
    strata = strata.withColumn("st_", place.cast("long"))
    scenes = _numbered(rows.select("all_", "scene_").distinct(), ["all_"], "scene_", "s_").drop("all_")
    count = scenes.count()
    slots = cases.sparkSession.range(replicates * count).select(F.expr(f"id div {max(count, 1)}").alias("replicate"), (F.col("id") % max(count, 1)).alias("slot_"))
    slots = slots.withColumn("s_", hash_index(F.col("replicate"), F.col("slot_"), F.lit(count), seed)).join(scenes, "s_")
    each = match(slots, strata.drop("all_"), ["scene_"])
    draws = each.select("replicate", "slot_", "scene_", "stratum_", "st_", "n_", F.explode(F.expr("sequence(0L, n_ - 1)")).alias("draw_"))
    turn = F.col("slot_") * 1009 + F.col("st_") * 131 + F.col("draw_")
    drawn = draws.withColumn("k_", hash_index(F.col("replicate"), turn, F.col("n_"), seed + 1))
    return match(drawn, numbered, ["scene_", "stratum_", "k_"]).groupBy("replicate").agg(F.avg("value_").alias("mean"))


def limit_summary(curve: DataFrame, realized: DataFrame, keys: list[str], level: str, far: str, target: float = 0.9) -> DataFrame:
    """``keys, budget_valid, nominal_limit, conservative_limit`` and both crossings without the gate.

    ``curve`` has ``pd`` and its lower bound ``pd_low`` by keys (the budget ``far`` among them) and
    level; ``realized`` has ``realized_far`` of runs by keys. A limit counts only where the mean
    realized rate keeps the budget."""
    nominal = detection_limit(curve, keys, level, "pd", target).withColumnRenamed("limit", "nominal_crossing")
    low = detection_limit(curve, keys, level, "pd_low", target).withColumnRenamed("limit", "conservative_crossing")
    kept = realized.groupBy(*keys).agg((F.avg("realized_far") <= F.col(far)).alias("budget_valid"))
    both = match(match(nominal, low, keys), kept, keys)
    gate = lambda c: F.when(F.col("budget_valid"), F.col(c))
    return both.select(*keys, "budget_valid", "nominal_crossing", "conservative_crossing", gate("nominal_crossing").alias("nominal_limit"), gate("conservative_crossing").alias("conservative_limit"))


def abundance_verdict(error_high: Column, width_high: Column, coverages: list[Column], wanted: float = 0.9) -> Column:
    """Which claims hold: lower error, narrower intervals (only if all coverages are as wanted)."""
    point = F.coalesce(error_high < 0, F.lit(False))
    narrow = F.coalesce(width_high < 0, F.lit(False))
    for c in coverages:
        narrow = narrow & F.coalesce(c >= wanted, F.lit(False))
    return F.when(point & narrow, "point_and_interval").when(point, "point_only").when(narrow, "interval_only").otherwise("no_advantage")


def smallest_sufficient(means: DataFrame, keys: list[str], size: str, value: str, margin: float = 0.005) -> DataFrame:
    """``keys, smallest``: the least size whose value lies within the margin of the largest size's."""
    full = means.groupBy(*keys).agg(F.max_by(value, size).alias("full_"))
    return match(means, full, keys).groupBy(*keys).agg(F.min(F.when(F.col(value) >= F.col("full_") - margin, F.col(size))).alias("smallest"))


def noise_for_ratio(clean: DataFrame, signal: DataFrame, keys: list[str], pixel: str, decibels: float, spectrum: str = "spectrum") -> DataFrame:
    """``keys, noise_std``: the noise at which the added signal, the root mean square difference of
    equal pixels of both cubes over all bands, stands at a ratio in decibels."""
    other = signal.select(*keys, pixel, F.col(spectrum).alias("with_"))
    both = match(clean.select(*keys, pixel, spectrum), other, [*keys, pixel])
    squares = F.aggregate(F.zip_with("with_", spectrum, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    rms = F.sqrt(F.sum(squares) / F.sum(F.size(spectrum)))
    return both.groupBy(*keys).agg((rms / F.lit(10.0 ** (decibels / 20.0))).alias("noise_std"))


def reproduced(mae: Column, pearson: Column, most: float = 0.01, least: float = 0.99) -> Column:
    """Whether published numbers are met; an unknown one is not."""
    return F.coalesce((mae <= most) & (pearson >= least), F.lit(False))


def case_seed(base: int, *parts: Column) -> Column:
    """The seed of a case: ``base`` and its parts, each weighted so that no two cases meet."""
    total = F.lit(base)
    for part in parts:
        total = total + part
    return total.cast("long")


def hash_sample(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows without replacement, those of the least MD5 of key and seed; a sampling
    operator, alike on every run."""
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.withColumn("mark__", mark).orderBy("mark__", key).limit(most).drop("mark__")


def fit_platt_groups(rows: DataFrame, keys: list[str], score: str, label: str, rounds: int = 12, slopes: tuple[float, float] | None = None, few: int = 10_000) -> DataFrame:
    """``keys, slope, bias``: one logistic fit per group, all groups in each pass over the rows.

    Newton steps on the score standardized within its group, each held to 4. With ``slopes`` a slope
    outside them is held at the nearer one and the bias fitted to that (a temperature, on log-odds).
    Up to ``few`` groups' numbers are sent to all tasks between passes; beyond that they are a table
    that is joined and written in each pass."""
    y, s = F.col(label).cast("double"), F.col(score)
    state = rows.groupBy(*keys).agg(F.avg(s).alias("m_"), F.stddev_pop(s).alias("d_"))
    state = cut(state.select(*keys, "m_", F.when(F.col("d_") > 1e-12, F.col("d_")).otherwise(1.0).alias("d_"), F.lit(0.0).alias("a_"), F.lit(0.0).alias("b_"), F.lit(False).alias("held_")), "groups")
    schema, all_few = state.schema, state.limit(few + 1).count() <= few

    def kept(df: DataFrame) -> DataFrame:
        return F.broadcast(df.sparkSession.createDataFrame(df.collect(), schema)) if all_few else cut(df, "groups")

    def steps(state: DataFrame) -> DataFrame:
        for _ in range(rounds):
            z = (s - F.col("m_")) / F.col("d_")
            p = 1 / (1 + F.exp(-(z * F.col("a_") + F.col("b_"))))
            g, h = p - y, p * (1 - p)
            sums = match(rows, state, keys).groupBy(*keys, "m_", "d_", "a_", "b_", "held_").agg(
                F.avg(g * z).alias("ga"), F.avg(g).alias("gb"), (F.avg(h * z * z) + 1e-9).alias("haa"), F.avg(h * z).alias("hab"), (F.avg(h) + 1e-9).alias("hbb")
            )
            det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
            da = F.when(F.col("held_"), 0.0).otherwise((F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / det)
            db = F.when(F.col("held_"), F.col("gb") / F.col("hbb")).otherwise((F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / det)
            scale = F.least(F.lit(1.0), F.lit(4.0) / F.greatest(F.abs(da), F.abs(db), F.lit(1e-12)))
            state = kept(sums.select(*keys, "m_", "d_", (F.col("a_") - scale * da).alias("a_"), (F.col("b_") - scale * db).alias("b_"), "held_"))
        return state

    done = steps(kept(state))
    if slopes:
        slope = F.col("a_") / F.col("d_")
        near = F.greatest(F.lit(slopes[0]), F.least(F.lit(slopes[1]), slope))
        bounded = kept(done.select(*keys, "m_", "d_", (near * F.col("d_")).alias("a_"), F.when(near == slope, F.col("b_")).otherwise(0.0).alias("b_"), (near != slope).alias("held_")))
        done = bounded if bounded.where("held_").isEmpty() else steps(bounded)
    return done.select(*keys, (F.col("a_") / F.col("d_")).alias("slope"), (F.col("b_") - F.col("a_") * F.col("m_") / F.col("d_")).alias("bias"))


def fit_temperature_groups(rows: DataFrame, keys: list[str], logit: str, label: str, rounds: int = 12) -> DataFrame:
    """``keys, slope, bias``: as :func:`fit_platt_groups`, with slopes (one over the temperature) from exp(-10)
    to exp(10)."""
    return fit_platt_groups(rows, keys, logit, label, rounds, (math.exp(-10), math.exp(10)))


def apply_logistic(score: Column, slope: Column, bias: Column) -> Column:
    """The probability by a logistic model whose numbers are columns."""
    return 1 / (1 + F.exp(-(score * slope + bias)))

