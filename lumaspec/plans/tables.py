"""Queries on scores, probabilities and experiment runs drawn from the driver's tables.

Roles: text length of labelled documents is a score of quality; events are score streams by type;
discount and tax of order lines are prediction and truth, with suppliers as cases; orders by
priority and status are runs of methods in scenes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibrate, experiment, learn, metrics
from ..sources import files


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scored(spark, d) -> DataFrame:
    both = _t(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score")).join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return both.select("doc_id", "source", "score", (F.col("quality") == 1).alias("label"), F.col("quality").cast("double").alias("y"), (F.col("score") / (F.col("score") + 1000.0)).alias("p"))


def auc_by_source(spark, d):
    return _r(metrics.roc_auc(_scored(spark, d), ["source"]))


def roc_curve_points(spark, d):
    return _r(metrics.roc_curve(_scored(spark, d).withColumn("scene", F.lit(0)), ["scene"], "doc_id").drop("scene"))


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "event_type", F.col("value").alias("score"), (F.col("user_id") % 4 == 0).alias("label"))


def pd_at_far_by_group(spark, d):
    return _r(metrics.pd_at_far(_events(spark, d), ["event_type"], 0.01))


def threshold_at_far(spark, d):
    return _r(metrics.far_thresholds(_events(spark, d), ["event_type"], 0.001))


def detection_rate_external_threshold(spark, d):
    return _r(metrics.rates_at(_events(spark, d), ["event_type"], F.lit(250.0)))


def pooled_max_threshold_rates(spark, d):
    """Rates at the largest of the types' own thresholds."""
    top = metrics.far_thresholds(_events(spark, d), ["event_type"], 0.01).agg(F.max("threshold").alias("t"))
    return _r(metrics.rates_at(_events(spark, d).crossJoin(F.broadcast(top)), ["event_type", "t"], F.col("t")))  # one row


def nll_brier(spark, d):
    return _r(_scored(spark, d).agg(metrics.nll("p", "y").alias("nll"), metrics.brier("p", "y").alias("brier")))


def reliability_bins(spark, d):
    return _r(metrics.reliability(_scored(spark, d), "p", "y", 15))


def expected_calibration_error(spark, d):
    return _r(metrics.calibration_error(metrics.reliability(_scored(spark, d), "p", "y", 15)))


def platt_scaling_metrics(spark, d):
    rows = _scored(spark, d)
    model = calibrate.fit_platt(rows, "score", "label")
    return _r(rows.withColumn("q", model.apply(F.col("score"))).agg(metrics.nll("q", "y").alias("nll"), metrics.brier("q", "y").alias("brier")))


def temperature_scaling_metrics(spark, d):
    rows = _scored(spark, d).withColumn("z", F.ln(F.col("p") / (1 - F.col("p")))).where("p > 0")
    model = calibrate.fit_temperature(rows, "z", "label")
    return _r(rows.withColumn("q", model.apply(F.col("z"))).agg(metrics.nll("q", "y").alias("nll"), metrics.brier("q", "y").alias("brier")))


def _lines(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), "l_returnflag", F.col("l_discount").alias("predicted"), F.col("l_tax").alias("truth"))


def abundance_errors(spark, d):
    return _r(_lines(spark, d).groupBy("l_returnflag").agg(*[c.alias(n) for n, c in metrics.errors("predicted", "truth").items()]))


def interval_coverage_width(spark, d):
    rows = _lines(spark, d).withColumn("lo", F.col("predicted") - 0.025).withColumn("hi", F.col("predicted") + 0.025)
    return _r(rows.groupBy("l_returnflag").agg(metrics.coverage("lo", "hi", "truth").alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width")))


def affine_calibration(spark, d):
    return _r(calibrate.affine_sums(_lines(spark, d), "case_id", "predicted", "truth"))


def conformal_radius(spark, d):
    rows = _lines(spark, d).withColumn("residual", F.round(F.abs(F.col("predicted") - F.col("truth")), 9))
    return _r(calibrate.conformal_radius(rows, "case_id", "residual", 0.1))


def calibrated_intervals(spark, d):
    rows = _lines(spark, d)
    model = calibrate.fit_affine(rows, "case_id", "predicted", "truth")
    fixed = rows.withColumn("q", F.round(model.apply(F.col("predicted")), 9)).withColumn("residual", F.round(F.abs(F.col("q") - F.col("truth")), 9))
    both = fixed.crossJoin(F.broadcast(calibrate.conformal_radius(fixed, "case_id", "residual", 0.1)))  # one row
    return _r(both.groupBy("l_returnflag").agg(F.avg((F.col("residual") <= F.col("radius")).cast("double")).alias("coverage"), F.count("*").alias("n")))


def robust_standardise_by_type(spark, d):
    rows = _t(spark, d, "events").select("event_id", "event_type", "value")
    return _r(calibrate.robust_standardise(rows, ["event_type"], "value").select("event_id", "z"))


def spearman_by_group(spark, d):
    rows = _t(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    ranked = metrics.average_ranks(metrics.average_ranks(rows, ["l_returnflag"], "l_quantity", "a"), ["l_returnflag"], "l_extendedprice", "b")
    return _r(ranked.groupBy("l_returnflag").agg(metrics.pearson("a", "b").alias("rho")))


def contrast(spark, d):
    c = F.avg(F.when(F.col("label"), F.col("score"))) - F.avg(F.when(~F.col("label"), F.col("score")))
    return _r(_events(spark, d).groupBy("event_type").agg(c.alias("contrast")))


def grid_detection_limit(spark, d):
    rows = _t(spark, d, "events").select("event_type", (F.col("user_id") % 8).alias("level"), F.col("value"))
    curve = rows.groupBy("event_type", "level").agg(F.avg((F.col("value") > 30.0).cast("double")).alias("pd"))
    return calibrate.detection_limit(curve, ["event_type"], "level", "pd", 0.6)


def empirical_quantiles(spark, d):
    rows = _t(spark, d, "events").select("event_id", "event_type", "value")
    return _r(learn.empirical_quantile(rows, ["event_type"], "value", "q").select("event_id", "q"))


def _runs(spark, d) -> DataFrame:
    """Mean price share per (scene, method, level) as a run's metric."""
    o = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("scene"), F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 4 * 5).cast("double").alias("snr"), (F.col("o_custkey") % 6).alias("seed"), F.col("o_totalprice"))
    return o.groupBy("scene", "method", "snr", "seed").agg(F.round(F.avg("o_totalprice") / 500000.0, 9).alias("auc"))


def method_leaderboard(spark, d):
    return _r(experiment.leaderboard(_runs(spark, d)))


def per_scene_pivot(spark, d):
    return _r(_runs(spark, d).groupBy("method").pivot("scene", ["F", "O", "P"]).agg(F.avg("auc")))


def mismatch_drop(spark, d):
    means = _runs(spark, d).groupBy("scene", "method", "snr").agg(F.avg("auc").alias("auc"))
    return _r(experiment.drop_from(means, ["scene", "method"], "snr", 0.0, "auc"))


def winner_margin(spark, d):
    means = _runs(spark, d).groupBy("scene", "snr", "method").agg(F.round(F.avg("auc"), 9).alias("auc"))
    return _r(experiment.winner(means, ["scene", "snr"], "method", "auc"))


def grouping_sets_summary(spark, d):
    out = _runs(spark, d).groupingSets([["method"], ["method", "snr"], ["method", "scene"]], "method", "snr", "scene").agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.count("*").alias("n"))
    return _r(out)


def _paired(spark, d) -> DataFrame:
    p = _runs(spark, d).where(F.col("method").isin("1-URGENT", "5-LOW")).groupBy("scene", "snr", "seed").pivot("method", ["1-URGENT", "5-LOW"]).agg(F.max("auc"))
    return p.where("`1-URGENT` is not null and `5-LOW` is not null").select("scene", "snr", "seed", F.concat_ws("|", "scene", F.col("snr").cast("int"), "seed").alias("case_id"), (F.col("1-URGENT") - F.col("5-LOW")).alias("difference"))


def paired_difference(spark, d):
    return _r(_paired(spark, d).select("case_id", "difference"))


def bootstrap_ci(spark, d):
    reps = experiment.bootstrap(_paired(spark, d), "difference", "case_id", 400).withColumn("mean", F.round("mean", 9))
    out = experiment.interval(reps, [])
    return _r(out).withColumn("verdict", experiment.verdict(F.col("ci_low"), F.col("ci_high"))).withColumn("significant", experiment.significant([F.col("ci_low")], [F.col("ci_high")]))


def distance_to_best(spark, d):
    means = _runs(spark, d).groupBy("scene", "method").agg(F.avg("auc").alias("auc"))
    return _r(means.withColumn("distance", F.max("auc").over(Window.partitionBy("scene")) - F.col("auc")))


def checksum_manifest(spark, d):
    return files.checksums(_t(spark, d, "benchmark"), "item_id", "text")


def verify_manifest(spark, d):
    """Pages against a manifest in which every tenth size and every seventh digest is wrong and one file in eleven is missing."""
    have = files.checksums(_t(spark, d, "pages"), "page_id", "html")
    want = have.select("name", F.when(F.col("name") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("name") % 7 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return files.verify(have.where("name % 11 <> 0"), want)


def duplicate_texts(spark, d):
    return files.duplicates(_t(spark, d, "documents").select(F.md5("text").alias("digest")), "digest")


def interval_report(spark, d):
    out = _runs(spark, d).groupBy("method").agg(F.round(F.avg("auc"), 6).alias("m"), F.round(F.min("auc"), 6).alias("lo"), F.round(F.max("auc"), 6).alias("hi"))
    return out.select("method", experiment.interval_text(F.col("m"), F.col("lo"), F.col("hi")).alias("text"))


_S = "s as (select doc_id, source, n_chars::double as score, quality = 1 as label, quality::double as y, n_chars::double / (n_chars::double + 1000) as p from documents join labels using (doc_id))"
_E = "e as (select event_id, event_type, value as score, user_id % 4 = 0 as label from events)"
_L = "l as (select l_suppkey as case_id, l_returnflag, l_discount as predicted, l_tax as truth from lineitem)"
_R = "runs as (select o_orderstatus as scene, o_orderpriority as method, (o_custkey % 4 * 5)::double as snr, o_custkey % 6 as seed, round(avg(o_totalprice) / 500000, 9) as auc from orders group by all)"
_BINS = "edges as (select b::int as bin, b * (1.0::double / 15) as lo, (b + 1) * (1.0::double / 15) as hi from (select unnest(range(15)) as b)), bins as (select bin, lo, hi, count(p)::bigint as count, avg(p) as mean_probability, avg(y) as event_rate from edges left join s on p >= lo and (p < hi or bin = 14) group by bin, lo, hi)"
_AFF = "c as (select avg(predicted) as x, avg(truth) as y, avg(predicted * predicted) as xx, avg(predicted * truth) as xy from l group by case_id), a as (select avg(x) as x, avg(y) as y, avg(xx) as xx, avg(xy) as xy from c), f as (select (xy - x * y) / (xx - x * x) as line, x, y from a), fit as (select greatest(line, 0) as slope, case when line < 0 then y else y - line * x end as intercept from f)"


def _conformal(source: str) -> str:
    return f"q1 as (select case_id, residual from (select case_id, residual, row_number() over (partition by case_id order by residual) as r, count(*) over (partition by case_id) as n from {source}) where r = greatest(1, least(n, ceil((n + 1) * 0.9::double)))), q2 as (select residual as radius from (select residual, row_number() over (order by residual) as r, count(*) over () as n from q1) where r = greatest(1, least(n, ceil((n + 1) * 0.9::double))))"


def _thr(far: float, where: str = "true") -> str:
    return f"t as (select event_type, score as threshold from (select event_type, score, row_number() over (partition by event_type order by score desc) as r, count(*) over (partition by event_type) as n from e where {where}) where r = floor({far}::double * n) + 1)"


SQL = {
    "auc_by_source": f"with {_S}, r as (select source, label, rank() over (partition by source order by score) + (count(*) over (partition by source, score) - 1) / 2.0::double as rk from s) select source, round(case when count_if(label) * count_if(not label) > 0 then (sum(case when label then rk end) - count_if(label) * (count_if(label) + 1) / 2.0::double) / (count_if(label)::double * count_if(not label)) else 0.5::double end, 6) as auc, count_if(label)::bigint as positives, count_if(not label)::bigint as negatives from r group by source",
    "roc_curve_points": f"with {_S} select doc_id, round(sum((not label)::int) over w / sum((not label)::int) over ()::double, 6) as fpr, round(sum(label::int) over w / sum(label::int) over ()::double, 6) as tpr from s window w as (order by score desc, doc_id rows unbounded preceding)",
    "pd_at_far_by_group": f"with {_E}, {_thr(0.01, 'not label')} select event_type, round(threshold, 6) as threshold, round(avg((score > threshold)::int::double), 6) as pd from e join t using (event_type) where label group by event_type, threshold",
    "threshold_at_far": f"with {_E}, {_thr(0.001)} select event_type, round(threshold, 6) as threshold from t",
    "detection_rate_external_threshold": f"with {_E} select event_type, round(avg(case when label then (score > 250)::int::double end), 6) as pd, round(avg(case when not label then (score > 250)::int::double end), 6) as far from e group by event_type",
    "pooled_max_threshold_rates": f"with {_E}, {_thr(0.01)}, m as (select max(threshold) as t from t) select event_type, round(m.t, 6) as t, round(avg(case when label then (score > m.t)::int::double end), 6) as pd, round(avg(case when not label then (score > m.t)::int::double end), 6) as far from e, m group by event_type, m.t",
    "nll_brier": f"with {_S} select round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as nll, round(avg((p - y) ** 2), 6) as brier from (select *, greatest(1e-12::double, least(1 - 1e-12::double, p)) as q from s)",
    "reliability_bins": f"with {_S}, {_BINS} select bin, round(lo, 6) as lo, round(hi, 6) as hi, count, round(mean_probability, 6) as mean_probability, round(event_rate, 6) as event_rate from bins",
    "expected_calibration_error": f"with {_S}, {_BINS} select round(sum(count * abs(mean_probability - event_rate)) / (select count(*) from s), 6) as ece from bins",
    "abundance_errors": f"with {_L} select l_returnflag, round(avg(abs(predicted - truth)), 6) as mae, round(avg(predicted - truth), 6) as bias, round(covar_pop(predicted, truth) / (stddev_pop(predicted) * stddev_pop(truth)), 6) as pearson_r from l group by 1",
    "interval_coverage_width": f"with {_L}, i as (select *, predicted - 0.025::double as lo, predicted + 0.025::double as hi from l) select l_returnflag, round(avg((truth >= lo and truth <= hi)::int::double), 6) as coverage, round(avg(hi - lo), 6) as width from i group by 1",
    "affine_calibration": f"with {_L}, {_AFF} select round(slope, 6)::double as slope, round(intercept, 6) as intercept from fit",
    "conformal_radius": f"with {_L}, k as (select case_id, round(abs(predicted - truth), 9) as residual from l), {_conformal('k')} select round(radius, 6) as radius from q2",
    "calibrated_intervals": f"with {_L}, {_AFF}, k as (select case_id, l_returnflag, round(abs(round(greatest(0, least(1, predicted * slope + intercept)), 9) - truth), 9) as residual from l, fit), {_conformal('k')} select l_returnflag, round(avg((residual <= radius)::int::double), 6) as coverage, count(*)::bigint as n from k, q2 group by 1",
    "robust_standardise_by_type": "with m as (select event_type, median(value) as m from events group by 1), d as (select event_type, m, median(abs(value - m)) as d from events join m using (event_type) group by 1, 2) select event_id, round((value - m) / greatest(1.4826::double * d, 1e-12), 6) as z from events join d using (event_type)",
    "spearman_by_group": "with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as a, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0::double as b from lineitem) select l_returnflag, round(corr(a, b), 6) as rho from r group by 1",
    "contrast": f"with {_E} select event_type, round(avg(case when label then score end) - avg(case when not label then score end), 6) as contrast from e group by 1",
    "grid_detection_limit": "with c as (select event_type, user_id % 8 as level, avg((value > 30)::int::double) as pd from events group by 1, 2), w as (select *, min(pd) over (partition by event_type order by level rows between current row and unbounded following) as worst from c) select event_type, min(case when worst >= 0.6::double then level end) as \"limit\" from w group by 1",
    "empirical_quantiles": "select event_id, round((rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0::double) / (count(*) over (partition by event_type) + 1), 6) as q from events",
    "method_leaderboard": f"with {_R}, m as (select method, avg(auc) as mean, avg(case when snr = 0 then auc end) as at_level from runs group by 1) select method, round(mean, 6) as mean, round(at_level, 6) as at_level, (row_number() over (order by mean desc, method))::int as place from m",
    "per_scene_pivot": f"with {_R} select method, round(avg(case when scene = 'F' then auc end), 6) as \"F\", round(avg(case when scene = 'O' then auc end), 6) as \"O\", round(avg(case when scene = 'P' then auc end), 6) as \"P\" from runs group by 1",
    "mismatch_drop": f"with {_R}, m as (select scene, method, snr, avg(auc) as auc from runs group by all) select scene, method, snr, round(auc, 6) as auc, round(max(case when snr = 0 then auc end) over (partition by scene, method) - auc, 6) as \"drop\" from m",
    "winner_margin": f"with {_R}, m as (select scene, snr, method, round(avg(auc), 9) as auc from runs group by all), k as (select *, row_number() over (partition by scene, snr order by auc desc, method) as n from m), w as (select scene, snr, max(case when n = 1 then method end) as best, max(case when n = 1 then auc end) - max(case when n = 2 then auc end) as lead from k where n <= 2 group by 1, 2) select scene, snr, best, round(lead, 6) as lead, case when lead > 0.005::double then best else 'tie' end as verdict from w",
    "grouping_sets_summary": f"with {_R} select method, snr, scene, round(avg(auc), 6) as mean, round(stddev_pop(auc), 6) as std, count(*)::bigint as n from runs group by grouping sets ((method), (method, snr), (method, scene))",
    "paired_difference": f"with {_R} select a.scene || '|' || a.snr::int || '|' || a.seed as case_id, round(a.auc - b.auc, 6) as difference from runs a join runs b using (scene, snr, seed) where a.method = '1-URGENT' and b.method = '5-LOW'",
    "bootstrap_ci": f"with {_R}, c as (select a.scene || '|' || a.snr::int || '|' || a.seed as case_id, a.auc - b.auc as difference from runs a join runs b using (scene, snr, seed) where a.method = '1-URGENT' and b.method = '5-LOW'), k as (select difference, row_number() over (order by case_id) - 1 as k, count(*) over () as n from c), dr as (select r, i, ((r * 7919 + i * 104729 + 17) * 1103515245 + 12345) % 2147483648 as h1, n from (select unnest(range(400)) as r), (select unnest(range((select max(n) from k))) as i), (select max(n) as n from k)), ix as (select r, ((h1 * 1103515245 + 12345) % 2147483648) // 65536 % n as k from dr), m as (select r, round(avg(difference), 9) as mean from ix join k using (k) group by r), q as (select round(quantile_cont(mean, 0.025::double), 6) as ci_low, round(quantile_cont(mean, 0.975::double), 6) as ci_high from m) select ci_low, ci_high, case when ci_low > 0 then 'advantage' when ci_high < 0 then 'disadvantage' else 'inconclusive' end as verdict, ci_low > 0 or ci_high < 0 as significant from q",
    "distance_to_best": f"with {_R}, m as (select scene, method, avg(auc) as auc from runs group by 1, 2) select scene, method, round(auc, 6) as auc, round(max(auc) over (partition by scene) - auc, 6) as distance from m",
    "checksum_manifest": "select item_id as name, strlen(text)::bigint as size, md5(text) as md5, sha256(text) as sha256 from benchmark",
    "verify_manifest": "select page_id as name, case when page_id % 11 = 0 then 'missing' when page_id % 10 = 0 then 'size' when page_id % 7 = 0 then 'checksum' else 'ok' end as state from pages",
    "duplicate_texts": "select md5(text) as digest, count(*)::bigint as n from documents group by 1 having count(*) > 1",
    "interval_report": f"with {_R} select method, printf('%.3f [%.3f, %.3f]', round(avg(auc), 6), round(min(auc), 6), round(max(auc), 6)) as text from runs group by 1",
}
QUERIES = {f.__name__: f for f in (auc_by_source, roc_curve_points, pd_at_far_by_group, threshold_at_far, detection_rate_external_threshold, pooled_max_threshold_rates, nll_brier, reliability_bins, expected_calibration_error, platt_scaling_metrics, temperature_scaling_metrics, abundance_errors, interval_coverage_width, affine_calibration, conformal_radius, calibrated_intervals, robust_standardise_by_type, spearman_by_group, contrast, grid_detection_limit, empirical_quantiles, method_leaderboard, per_scene_pivot, mismatch_drop, winner_margin, grouping_sets_summary, paired_difference, bootstrap_ci, distance_to_best, checksum_manifest, verify_manifest, duplicate_texts, interval_report)}
