"""Experiment tables: runs of methods over cases, their summaries and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import running

LCG = (1103515245, 12345, 1 << 31)


def grid(*dims: DataFrame, few: int = 10_000) -> DataFrame:
    """All combinations of tables of settings. A table of at most ``few`` rows is sent to all tasks; a
    longer one is dealt into blocks of about that many, and every combined row meets every block."""
    out = dims[0]
    for d in dims[1:]:
        n = d.count()
        if n <= few:
            out = out.crossJoin(F.broadcast(d))
            continue
        blocks = -(-n // few)
        dealt = d.withColumn("block_", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in d.columns]), F.lit(blocks)))
        out = out.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "block_").drop("block_")
    return out


def leaderboard(runs: DataFrame, method: str = "method", metric: str = "auc", level: str = "snr", at: float = 0.0) -> DataFrame:
    """``method, mean, at_level, place`` in falling order of the mean."""
    means = runs.groupBy(method).agg(F.avg(metric).alias("mean"), F.avg(F.when(F.col(level) == at, F.col(metric))).alias("at_level"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), method)))


def drop_from(runs: DataFrame, keys: list[str], level: str, base, metric: str) -> DataFrame:
    """Adds ``drop``: the metric at the base level of the same keys, less the row's own."""
    best = F.max(F.when(F.col(level) == base, F.col(metric))).over(Window.partitionBy(*keys))
    return runs.withColumn("drop", best - F.col(metric))


def winner(runs: DataFrame, keys: list[str], method: str, metric: str, margin: float = 0.005) -> DataFrame:
    """``keys, best, lead, verdict``: the best method, or a tie if the second lies within the margin."""
    order = Window.partitionBy(*keys).orderBy(F.desc(metric), method)
    top = runs.withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    two = top.groupBy(*keys).agg(F.max(F.when(F.col("nth") == 1, F.col(method))).alias("best"), (F.max(F.when(F.col("nth") == 1, F.col(metric))) - F.max(F.when(F.col("nth") == 2, F.col(metric)))).alias("lead"))
    return two.withColumn("verdict", F.when(F.col("lead") > margin, F.col("best")).otherwise("tie"))


def hash_index(replicate: Column, draw: Column, n: Column, seed: int = 17) -> Column:
    """A pseudo-random index from 0 to n - 1 by two steps of a linear congruence, alike in any engine."""
    a, c, m = LCG
    first = F.pmod((replicate * 7919 + draw * 104729 + F.lit(seed)) * F.lit(a) + F.lit(c), F.lit(m))
    second = F.pmod(first * F.lit(a) + F.lit(c), F.lit(m))
    return F.pmod(F.floor(second / 65536).cast("long"), n)


def bootstrap(cases: DataFrame, value: str, order: str, replicates: int, seed: int = 17) -> DataFrame:
    """``replicate, mean`` over cases drawn with replacement; every replicate draws as many as there are.

    Cases are numbered by running sums over ranges of ``order``, which must tell them apart, and
    draws join them by number, so that the work spreads over draws.
    """
    ones = cases.select(F.lit(0).alias("k_"), F.col(value).alias("value_"), F.col(order).alias("order_"), F.lit(1).alias("one_"))
    numbered = running(ones, ["k_"], [F.col("order_")], ["one_"]).select("value_", F.col("before_one_").alias("k_"))
    n = numbered.count()
    draws = cases.sparkSession.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("replicate"), (F.col("id") % max(n, 1)).alias("draw"))
    drawn = draws.withColumn("k_", hash_index(F.col("replicate"), F.col("draw"), F.lit(n), seed))
    return drawn.join(numbered, "k_").groupBy("replicate").agg(F.avg("value_").alias("mean"))


def interval(replicates: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """``keys, ci_low, ci_high``: the central 95 %, by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def significant(low: list[Column], high: list[Column]) -> Column:
    """Whether all intervals lie above 0, or all below."""
    above, below = F.lit(True), F.lit(True)
    for lo, hi in zip(low, high, strict=True):
        above, below = above & (lo > 0), below & (hi < 0)
    return above | below


def oriented(low: Column, high: Column, larger_is_better: bool) -> tuple[Column, Column]:
    return (low, high) if larger_is_better else (-high, -low)


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "advantage").when(high < 0, "disadvantage").otherwise("inconclusive")


def interval_text(mean: Column, low: Column, high: Column, digits: int = 3, comma: bool = False) -> Column:
    text = F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", mean, low, high)
    return F.translate(text, ".", ",") if comma else text


def markdown(df: DataFrame, order: str) -> DataFrame:
    """One row ``report``: the table as Markdown. For summaries of a few rows."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    rows = df.select(F.col(order).alias("o"), line.alias("line")).agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("all"))
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("all", lambda s: s["line"]), "\n")).alias("report"))
