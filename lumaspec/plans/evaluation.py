"""Queries on splits, resampling, summaries and verdicts, on places and colours, and on manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import store
from ..functions import spectral as S
from ..model import nodata
from ..operators import calibrate, detect, evaluate, experiment, geometry, metrics, spatial, stats
from ..sources import files, protocol
from .cubes import _ACES, _MF_BASE, _RXS, _SAM, _T, _blur, _cte, _target, cube
from .tables import _AFF, _L, _R, _S, _conformal, _lines, _paired, _r, _runs, _scored, _t


def _split_lines(spark, d):
    return _lines(spark, d).withColumn("split", evaluate.split_of(F.col("case_id")))


def case_splits(spark, d):
    rows = _split_lines(spark, d)
    shared = evaluate.in_several(rows, "case_id").agg(F.count("*").alias("shared"))
    sizes = rows.groupBy("split").agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("n"))
    return metrics.match(sizes, shared, [])


def split_calibrated_intervals(spark, d):
    """The scale from one split, the radius from another with scaled predictions, and how both do on a third."""
    rows = _split_lines(spark, d)
    model = calibrate.fit_affine(rows.where("split = 'fit'"), "case_id", "predicted", "truth")
    rows = rows.withColumn("q", F.round(model.apply(F.col("predicted")), 9)).withColumn("residual", F.round(F.abs(F.col("q") - F.col("truth")), 9))
    radius = calibrate.conformal_radius(rows.where("split = 'calibrate'"), "case_id", "residual", 0.1)
    held = metrics.match(rows.where("split = 'evaluate'"), radius, []).withColumn("lo", F.greatest(F.col("q") - F.col("radius"), F.lit(0.0))).withColumn("hi", F.least(F.col("q") + F.col("radius"), F.lit(1.0)))
    inside = F.avg((F.col("residual") <= F.col("radius")).cast("double"))
    return _r(held.groupBy("l_returnflag").agg(inside.alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"), F.avg(F.abs(F.col("q") - F.col("truth"))).alias("mae"), F.avg(F.col("q") - F.col("truth")).alias("bias")))


def calibration_by_source(spark, d):
    """A logistic fit per source on one split; probabilities scored on the others, ranks on the raw score."""
    rows = _scored(spark, d).withColumn("split", evaluate.split_of(F.col("doc_id")))
    models = evaluate.fit_platt_groups(rows.where("split = 'fit'"), ["source"], "score", "label")
    held = metrics.match(rows.where("split <> 'fit'"), models, ["source"]).withColumn("q", evaluate.apply_logistic(F.col("score"), F.col("slope"), F.col("bias")))
    scored = held.groupBy("source").agg(metrics.nll("q", "y").alias("nll"), metrics.brier("q", "y").alias("brier"))
    return _r(metrics.match(scored, metrics.roc_auc(held, ["source"]).select("source", "auc"), ["source"]))


def hierarchical_bootstrap_ci(spark, d):
    reps = evaluate.hierarchical_bootstrap(_paired(spark, d), "scene", "snr", "difference", "case_id", 200).withColumn("mean", F.round("mean", 9))
    return _r(experiment.interval(reps, []))


def _budgets(spark, d):
    e = _t(spark, d, "events").select("event_type", F.col("value").alias("score"), (F.col("user_id") % 4 == 0).alias("label"), (F.col("user_id") % 7).alias("level"), (F.col("user_id") % 5).alias("seed"))
    far = F.explode(F.array(F.lit(0.1), F.lit(0.4))).alias("far")
    cuts = [metrics.far_thresholds(e.where("not label"), ["event_type"], f).withColumn("far", F.lit(f)) for f in (0.1, 0.4)]
    return metrics.match(e.select("*", far), cuts[0].unionByName(cuts[1]), ["event_type", "far"]).withColumn("over", (F.col("score") > F.col("threshold")).cast("double"))


def limit_summary(spark, d):
    over, keys = _budgets(spark, d), ["event_type", "far"]
    curve = over.where("label").groupBy(*keys, "level").agg(F.round(F.avg("over"), 9).alias("pd")).withColumn("pd_low", F.round(F.col("pd") * 0.9, 9))
    real = over.where("not label").groupBy(*keys, "seed").agg(F.avg("over").alias("realized_far"))
    return evaluate.limit_summary(curve, real, keys, "level", "far", 0.09)


def abundance_verdicts(spark, d):
    g = _lines(spark, d).groupBy("l_returnflag", F.col("case_id").alias("case"))
    e = F.round(F.avg(F.abs(F.col("predicted") - F.col("truth"))) - 0.033, 9)
    w = F.round(F.avg("predicted") - 0.05, 9)
    c = F.round(F.avg((F.col("truth") <= 0.07).cast("double")), 9)
    out = g.agg(e.alias("e"), w.alias("w"), c.alias("c"))
    return out.select("l_returnflag", "case", evaluate.abundance_verdict(F.col("e"), F.col("w"), [F.col("c")], 0.88).alias("verdict"))


def smallest_sufficient(spark, d):
    means = _runs(spark, d).groupBy("scene", "method", F.col("seed").alias("k")).agg(F.round(F.avg("auc"), 9).alias("auc"))
    return evaluate.smallest_sufficient(means, ["scene", "method"], "k", "auc")


def noise_by_label(spark, d):
    px = cube(spark, d)
    mixed = px.withColumn("spectrum", S.implant(F.col("spectrum"), S.literal(_target(px)), F.lit(0.15)))
    return _r(evaluate.noise_for_ratio(px, mixed, ["label"], "pixel_id", 10.0))


def reproduction_gate(spark, d):
    found = _lines(spark, d).groupBy("case_id").agg(*[F.round(c, 9).alias(n) for n, c in metrics.errors("predicted", "truth").items()])
    return found.select("case_id", evaluate.reproduced(F.col("mae"), F.col("pearson_r"), 0.033, 0.0).alias("passed"))


def clipped_abundance_errors(spark, d):
    """Errors of predictions held in 0 to 1, over all rows and over those that hold some of the target."""
    rows = _lines(spark, d).withColumn("q", S.clip(F.col("predicted") * 12 - 0.1, 0.0, 1.0)).withColumn("some", F.col("truth") > 0.02)
    held = rows.where("some").groupBy("l_returnflag").agg(metrics.errors("q", "truth")["mae"].alias("target_mae"), metrics.pearson("q", "truth").alias("target_r"), F.count("*").alias("target_n"))
    return _r(metrics.match(held, rows.groupBy("l_returnflag").agg(metrics.errors("q", "truth")["mae"].alias("mae")), ["l_returnflag"]))


def distinct_cases(spark, d):
    return _runs(spark, d).select("scene", "snr").distinct().orderBy("scene", "snr")


def pixel_sample(spark, d):
    return evaluate.hash_sample(cube(spark, d), "pixel_id", 120, 5).select(F.col("pixel_id").alias("vec_id"))


def case_seeds(spark, d):
    scene = F.element_at(F.create_map(*[F.lit(x) for x in ("F", 0, "O", 1, "P", 2)]), F.col("scene"))
    return _runs(spark, d).select("scene", "method", "snr", "seed", evaluate.case_seed(100_000, scene * 10_000, F.col("snr") * 100, F.col("seed")).alias("case_seed"))


def other_method_pairs(spark, d):
    """Each run beside that of the method it is held against, by a mapping of methods."""
    runs = _runs(spark, d)
    against = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("2-HIGH", "1-URGENT"), ("5-LOW", "4-NOT SPECIFIED")], "method string, against string")
    held = metrics.match(runs, F.broadcast(against), ["method"])  # three rows
    other = runs.select("scene", F.col("method").alias("against"), "snr", "seed", F.col("auc").alias("other"))
    return _r(metrics.match(held, other, ["scene", "against", "snr", "seed"]).select("scene", "method", "against", "snr", "seed", (F.col("auc") - F.col("other")).alias("lead")))


def pooled_reliability(spark, d):
    rows = _scored(spark, d).withColumn("kind", F.col("doc_id") % 3)
    return _r(metrics.reliability(rows, "p", "y", 5, ["kind"], metrics.scaled_index))


def physical_family(spark, d):
    made = cube(spark, d).select(F.col("pixel_id").alias("vec_id"), F.explode(S.shifted_and_tilted(F.col("spectrum"), 64)).alias("f"))
    total = F.aggregate("f.spectrum", F.lit(0.0), lambda s, e: s + e)
    return _r(made.select("vec_id", "f.shift", "f.tilt", total.alias("total"), F.element_at("f.spectrum", 64).alias("last")))


def band_smoothing(spark, d):
    out = cube(spark, d).select(F.col("pixel_id").alias("vec_id"), F.posexplode(S.smooth_bands(F.col("spectrum"), 64, 2.5)).alias("band", "value"))
    return _r(out)


def target_scaling(spark, d):
    """Spectra with their peak at the cube's mean, by value and by absolute value."""
    px = cube(spark, d)
    size = F.transform("spectrum", lambda v: F.abs(v))
    level = px.agg(F.avg(S.mean(F.col("spectrum"))).alias("level"), F.avg(S.mean(size)).alias("size"))
    both = metrics.match(px, level, [])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + e)
    return _r(both.select(F.col("pixel_id").alias("vec_id"), total(S.scaled_to(F.col("spectrum"), F.col("level"))).alias("by_peak"), total(S.scaled_to(F.col("spectrum"), F.col("size"), True)).alias("by_size")))


def rgb_composite(spark, d):
    """Bands nearest to 650, 550 and 450 nm, stretched, with a gamma."""
    px = cube(spark, d)
    grid = spark.createDataFrame(list(enumerate(S.wavelengths(64))), "band int, wavelength double")
    wanted = {"r": 650.0, "g": 550.0, "b": 450.0}
    near = grid.agg(*[F.min_by("band", F.struct(F.abs(F.col("wavelength") - w), F.col("band"))).alias(n) for n, w in wanted.items()]).first()
    bands = near.asDict()
    return _r(geometry.composite(px, bands, F.forall(F.array(*[F.col("spectrum")[k] for k in bands.values()]), lambda v: v == 0)).select(F.col("pixel_id").alias("vec_id"), *bands))


_CROP = geometry.TurnedCrop(107, 9, 300.0, 120.0, 12.5)


def roi_corners(spark, d):
    n = _t(spark, d, "nation")
    boxes = n.select(F.col("n_nationkey").alias("roi"), (F.col("n_nationkey") * 4).alias("y0"), F.col("n_regionkey").alias("x0"), (F.col("n_nationkey") * 4 + 3).alias("y1"), (F.col("n_regionkey") + 4).alias("x1"))
    return _r(_CROP.polygon(boxes))


def scene_to_crop(spark, d):
    y, x = _CROP.from_scene(F.col("y") + 300.0, F.col("x") + 120.0)
    return _r(cube(spark, d).select(F.col("pixel_id").alias("vec_id"), y.alias("v"), x.alias("u")))


def luminance_threshold(spark, d):
    at = lambda k: F.least(F.lit(255.0), F.abs(F.element_at("spectrum", k + 1)) * 255)
    view = cube(spark, d).select(F.col("pixel_id").alias("vec_id"), geometry.luminance_view(at(44), at(28), at(12), 12.0).alias("v"))
    return _r(view.select("vec_id", "v.bright", "v.strength", "v.level"))


def evidence_check(spark, d):
    """Claims about benchmark texts as a manifest with faults of every kind, held against the texts."""
    b = _t(spark, d, "benchmark")
    i = F.col("item_id")
    good = F.sha2("text", 256)
    entries = b.select(
        F.when(i % 13 == 0, "item-0").otherwise(F.concat(F.lit("item-"), i)).alias("id"), i.alias("row"),
        F.when(i % 11 == 5, "proven").otherwise("supported").alias("status"), F.lit("it is so").alias("claim"),
        F.when(i % 7 == 3, "run.sh it").otherwise("python run.py it").alias("command"),
        F.when(i % 9 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("small"))).alias("limitations"),
        F.array(F.struct(F.when(i % 5 == 1, F.concat(F.lit("../"), i)).when(i % 6 == 2, F.concat(F.lit("gone/"), i)).otherwise(i.cast("string")).alias("path"), F.when(i % 8 == 6, F.repeat(F.lit("0"), F.lit(64))).otherwise(good).alias("sha256"))).alias("artifacts"),
    )
    found = b.select(i.cast("string").alias("path"), good.alias("sha256"))
    return protocol.check_evidence(entries, found, "row")


def detector_table(spark, d):
    """Four detectors side by side: areas, detection at a false-alarm rate, and their order."""
    px = cube(spark, d)
    bg, t = stats.background(px), _target(px)
    each = {"ace": detect.ace(bg, t), "mf": detect.matched_filter(bg, t), "rx": detect.mahalanobis(bg), "sam": detect.spectral_angle(t)}
    rows = px.select("gt", *[F.round(c, 9).alias(n) for n, c in each.items()]).unpivot(["gt"], list(each), "method", "score")
    rows = store.cut(rows, "scores")
    both = metrics.match(metrics.roc_auc(rows, ["method"], "score", "gt").select("method", "auc"), metrics.pd_at_far(rows, ["method"], 0.05, "score", "gt").select("method", "pd"), ["method"])
    return _r(both.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("auc", 9)), "method"))))


def limit_score(spark, d):
    """The score of detection limits: the filter, smoothed over the scene, over its robust spread."""
    px = cube(spark, d)
    smooth = spatial.gaussian_reflect(px.withColumn("score", detect.matched_filter(stats.background(px), _target(px))).select("scene_id", "y", "x", "score"), 1.5)
    z = calibrate.robust_standardise(store.cut(smooth, "scores"), ["scene_id"], "score")
    return _r(z.select((F.col("y").cast("long") * 25 + F.col("x")).alias("vec_id"), "z"))


def json_records(spark, d):
    """The values of the events' JSON properties as rows, with what can't be read told apart."""
    rows = files.json_rows(_t(spark, d, "events").where("event_type <> 'view'"), "event_id", "props", "k long")
    return rows.select("event_id", "readable", F.col("record.k").alias("k"))


_HASH = lambda r, i, n, seed: f"((((({r} * 7919 + {i} * 104729 + {seed}) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) // 65536 % {n}"
_SPLIT = "case case_id % 3 when 0 then 'fit' when 1 then 'calibrate' else 'evaluate' end"
_PAIRS = "c as (select a.scene, a.snr, a.scene || '|' || a.snr::int || '|' || a.seed as case_id, a.auc - b.auc as difference from runs a join runs b using (scene, snr, seed) where a.method = '1-URGENT' and b.method = '5-LOW')"
_TURN = "cos(radians(12.5::double))", "sin(radians(12.5::double))"

SQL = {
    "case_splits": f"with {_L} select {_SPLIT} as split, count(distinct case_id)::bigint as cases, count(*)::bigint as n, 0::bigint as shared from l group by 1",
    "split_calibrated_intervals": f"""with {_L.replace("l as (", "every as (", 1)}, l as (select * from every where case_id % 3 = 0), {_AFF},
k as (select case_id, l_returnflag, truth, q, round(abs(q - truth), 9) as residual from (select *, round(greatest(0, least(1, predicted * slope + intercept)), 9) as q from every, fit)),
w as (select * from k where case_id % 3 = 1), {_conformal("w")}
select l_returnflag, round(avg((residual <= radius)::int::double), 6) as coverage, round(avg(least(1, q + radius) - greatest(0, q - radius)), 6) as width, round(avg(abs(q - truth)), 6) as mae, round(avg(q - truth), 6) as bias
from k, q2 where case_id % 3 = 2 group by 1""",
    "hierarchical_bootstrap_ci": f"""with {_R}, {_PAIRS}, num as (select scene, snr, difference, row_number() over (partition by scene, snr order by case_id) - 1 as k from c),
st as (select scene, snr, n, row_number() over (partition by scene order by snr) - 1 as st from (select scene, snr, count(*) as n from c group by all)),
sc as (select scene, row_number() over (order by scene) - 1 as s, count(*) over () as m from (select distinct scene from c)),
slots as (select r, i, {_HASH("r", "i", "m", 17)} as s from (select unnest(range(200)) as r), (select unnest(range((select max(m) from sc))) as i), (select max(m) as m from sc)),
each as (select r, i, scene, snr, st, n, unnest(range(n)) as dr from slots join sc using (s) join st using (scene)),
drawn as (select r, scene, snr, {_HASH("r", "(i * 1009 + st * 131 + dr)", "n", 18)} as k from each),
m as (select r, round(avg(difference), 9) as mean from drawn join num using (scene, snr, k) group by r)
select round(quantile_cont(mean, 0.025::double), 6) as ci_low, round(quantile_cont(mean, 0.975::double), 6) as ci_high from m""",
    "limit_summary": """with e as (select event_type, value as score, user_id % 4 = 0 as label, user_id % 7 as level, user_id % 5 as seed from events), b as (select unnest([0.1::double, 0.4::double]) as far),
t as (select event_type, far, score as threshold from (select event_type, far, score, row_number() over (partition by event_type, far order by score desc) as r, count(*) over (partition by event_type, far) as n from e, b where not label) where r = floor(far * n) + 1),
o as (select e.*, far, (score > threshold)::int::double as hit from e join t using (event_type)),
c as (select event_type, far, level, round(avg(hit), 9) as pd, round(round(avg(hit), 9) * 0.9::double, 9) as pd_low from o where label group by all),
v as (select event_type, far, avg(rf) <= far as budget_valid from (select event_type, far, seed, avg(hit) as rf from o where not label group by all) group by event_type, far),
w as (select *, min(pd) over y as worst, min(pd_low) over y as worst_low from c window y as (partition by event_type, far order by level rows between current row and unbounded following)),
x as (select event_type, far, min(case when worst >= 0.09::double then level end) as nominal_crossing, min(case when worst_low >= 0.09::double then level end) as conservative_crossing from w group by all)
select event_type, far, budget_valid, nominal_crossing, conservative_crossing, case when budget_valid then nominal_crossing end as nominal_limit, case when budget_valid then conservative_crossing end as conservative_limit from x join v using (event_type, far)""",
    "abundance_verdicts": f"""with {_L}, g as (select l_returnflag, case_id, round(avg(abs(predicted - truth)) - 0.033::double, 9) < 0 as p, round(avg(predicted) - 0.05::double, 9) < 0 and round(avg((truth <= 0.07)::int::double), 9) >= 0.88 as i from l group by all)
select l_returnflag, case_id as "case", case when p and i then 'point_and_interval' when p then 'point_only' when i then 'interval_only' else 'no_advantage' end as verdict from g""",
    "smallest_sufficient": f"with {_R}, m as (select scene, method, seed as k, round(avg(auc), 9) as auc from runs group by all), f as (select *, max_by(auc, k) over (partition by scene, method) as top from m) select scene, method, min(case when auc >= top - 0.005::double then k end) as smallest from f group by all",
    "noise_by_label": _cte(_T) + "select label, round(sqrt(avg((0.15::double * (tm.t[e.b + 1] - e.v)) ** 2)) / 10 ** 0.5::double, 6) as noise_std from e, tm group by label",
    "reproduction_gate": f"with {_L}, g as (select case_id, round(avg(abs(predicted - truth)), 9) as mae, round(case when stddev_pop(predicted) < 1e-9 or stddev_pop(truth) < 1e-9 then 0 else covar_pop(predicted, truth) / (stddev_pop(predicted) * stddev_pop(truth)) end, 9) as r from l group by 1) select case_id, mae <= 0.033 and r >= 0 as passed from g",
    "clipped_abundance_errors": f"with {_L}, q as (select l_returnflag, truth, greatest(0, least(1, predicted * 12 - 0.1::double))::double as q from l) select l_returnflag, round(avg(abs(q - truth)) filter (where truth > 0.02), 6) as target_mae, round(covar_pop(q, truth) filter (where truth > 0.02) / (stddev_pop(q) filter (where truth > 0.02) * stddev_pop(truth) filter (where truth > 0.02)), 6) as target_r, count_if(truth > 0.02)::bigint as target_n, round(avg(abs(q - truth)), 6) as mae from q group by 1",
    "distinct_cases": f"with {_R} select distinct scene, snr from runs",
    "pixel_sample": "select vec_id from embeddings order by md5(vec_id || ':5'), vec_id limit 120",
    "case_seeds": f"with {_R} select scene, method, snr, seed, (100000 + case scene when 'F' then 0 when 'O' then 10000 else 20000 end + snr * 100 + seed)::bigint as case_seed from runs",
    "other_method_pairs": f"with {_R}, a as (select * from (values ('1-URGENT', '2-HIGH'), ('2-HIGH', '1-URGENT'), ('5-LOW', '4-NOT SPECIFIED')) t(method, against)) select r.scene, r.method, against, r.snr, r.seed, round(r.auc - o.auc, 6) as lead from runs r join a using (method) join runs o on o.method = against and o.scene = r.scene and o.snr = r.snr and o.seed = r.seed",
    "pooled_reliability": f"with {_S}, g as (select doc_id % 3 as kind, least(4, floor(p * 5))::int as bin, p, y from s), every as (select kind, b::int as bin from (select distinct kind from g), (select unnest(range(5)) as b)) select kind, bin, round(bin * 0.2::double, 6) as lo, round((bin + 1) * 0.2::double, 6) as hi, count(p)::bigint as count, round(avg(p), 6) as mean_probability, round(avg(y), 6) as event_rate from every left join g using (kind, bin) group by kind, bin",
    "physical_family": _cte() + "select vec_id, shift, tilt, round(list_sum(f), 6) as total, round(f[64], 6) as last from (select vec_id, shift::int as shift, tilt, list_transform(range(64), lambda i: greatest(s[least(greatest(i - shift, 0), 63) + 1] * (1 + tilt * (i * (2.0::double / 63) - 1)), 0)) as f from px, (select unnest([-1, 0, 1]) as shift), (select unnest([-0.03::double, 0.0::double, 0.03::double]) as tilt))",
    "band_smoothing": _cte() + """, k as (select list(w order by o) as w from (select o, exp(-0.5::double * (o / (2.5::double / 2.3548::double)) ** 2) / sum(exp(-0.5::double * (o / (2.5::double / 2.3548::double)) ** 2)) over () as w from (select unnest(range(-4, 5)) as o)))
select vec_id, band::int as band, round(list_sum(list_transform(range(9), lambda j: w[j + 1] * s[least(greatest(band + j - 4, 0), 63) + 1])), 6) as value from px, k, (select unnest(range(64)) as band)""",
    "target_scaling": _cte() + ", q as (select avg(v) as level, avg(abs(v)) as size from e) select vec_id, round(list_sum(s) / (case when list_max(s) = 0 then 1 else list_max(s) end) * level, 6) as by_peak, round(list_sum(s) / list_max(list_transform(s, lambda v: abs(v))) * size, 6) as by_size from px, q",
    "rgb_composite": _cte() + "".join((
        ", q as (select ", ", ".join(f"quantile_cont(s[{k}], {p}::double) filter (where not z) as {c}{i}" for c, k in (("r", 27), ("g", 17), ("b", 6)) for i, p in ((0, 0.01), (1, 0.99))),
        " from (select s, len(list_filter(s, lambda v: v <> 0)) = 0 as z from px)) select vec_id, ",
        ", ".join(f"round(case when len(list_filter(s, lambda v: v <> 0)) = 0 then 0 else greatest(0, least(1, (s[{k}] - {c}0) / greatest({c}1 - {c}0, 1e-9))) ** 0.8::double end, 6)::double as {c}" for c, k in (("r", 27), ("g", 17), ("b", 6))), " from px, q",
    )),
    "roi_corners": f"""with b as (select n_nationkey as roi, n_nationkey * 4 as y0, n_regionkey as x0, n_nationkey * 4 + 2 as y1, n_regionkey + 3 as x1 from nation),
p as (select roi, corner::int as corner, (case when corner in (0, 1) then y0 else y1 end) - 53.0::double as y, (case when corner in (0, 3) then x0 else x1 end) - 4.0::double as x from b, (select unnest(range(4)) as corner))
select roi, corner, round(y * {_TURN[0]} + x * {_TURN[1]} + 353, 6) as y, round(x * {_TURN[0]} - y * {_TURN[1]} + 124, 6) as x from p""",
    "scene_to_crop": f"select vec_id, round((y - 53) * {_TURN[0]} - (x - 4) * {_TURN[1]} + 53, 6) as v, round((x - 4) * {_TURN[0]} + (y - 53) * {_TURN[1]} + 4, 6) as u from (select vec_id, (vec_id // 25)::double as y, (vec_id % 25)::double as x from embeddings)",
    "luminance_threshold": _cte() + ", q as (select vec_id, least(255, abs(s[45]) * 255) * 0.2126::double + least(255, abs(s[29]) * 255) * 0.7152::double + least(255, abs(s[13]) * 255) * 0.0722::double as light from px) select vec_id, light >= 12 * 2.55::double as bright, case when light >= 12 * 2.55::double then round(least(1, (light - 12 * 2.55::double) / (255 - 12 * 2.55::double)), 6) end as strength, case when light < 12 * 2.55::double then floor(light * 0.42::double + 0.5::double)::int end as level from q",
    "evidence_check": """with b as (select item_id as i, text from benchmark), z as (select count(*) as n from b where i % 13 = 0 or i = 0)
select i as "row", case when i % 13 = 0 then 'item-0' else 'item-' || i end as id, case when i % 13 = 0 and n > 1 then 'id given twice' when i % 11 = 5 then 'status' when i % 7 = 3 then 'command' when i % 9 = 4 then 'limitations'
when i % 5 = 1 then 'path leaves its root' when i % 6 = 2 then 'artifact missing' when i % 8 = 6 then 'checksum' else 'ok' end as state from b, z""",
    "detector_table": _cte(*_MF_BASE, _RXS, _ACES, _SAM) + """, k as (select 'mf' as method, vec_id, round(score, 9) as score from mf union all select 'ace', vec_id, round(score, 9) from ac union all select 'rx', vec_id, round(score, 9) from rx union all select 'sam', vec_id, round(score, 9) from sam),
g as (select method, score, label = 3 as gt from k join px using (vec_id)),
r as (select method, gt, rank() over (partition by method order by score) + (count(*) over (partition by method, score) - 1) / 2.0::double as rk from g),
a as (select method, (sum(case when gt then rk end) - count_if(gt) * (count_if(gt) + 1) / 2.0::double) / (count_if(gt)::double * count_if(not gt)) as auc from r group by method),
t as (select method, score as threshold from (select method, score, row_number() over (partition by method order by score desc) as r, count(*) over (partition by method) as n from g where not gt) where r = floor(0.05::double * n) + 1),
p as (select method, avg((score > threshold)::int::double) as pd from g join t using (method) where gt group by method)
select method, round(auc, 6) as auc, round(pd, 6) as pd, (row_number() over (order by round(auc, 9) desc, method))::int as place from a join p using (method)""",
    "limit_score": _cte(*_MF_BASE, _blur("mf", "bl", 1.5)) + ", m as (select median(score) as m from bl), s as (select m, median(abs(score - m)) as s from bl, m group by m) select vec_id, round((score - m) / greatest(1.4826::double * s, 1e-12), 6) as z from bl, s",
    "json_records": "select event_id, true as readable, (props::json->>'k')::bigint as k from events where event_type <> 'view'",
}
QUERIES = {
    f.__name__: f
    for f in (
        case_splits, split_calibrated_intervals, calibration_by_source, hierarchical_bootstrap_ci, limit_summary, abundance_verdicts, smallest_sufficient, noise_by_label,
        reproduction_gate, clipped_abundance_errors, distinct_cases, pixel_sample, case_seeds, other_method_pairs, pooled_reliability, physical_family, band_smoothing, target_scaling, rgb_composite,
        roi_corners, scene_to_crop, luminance_threshold, evidence_check, json_records, detector_table, limit_score,
    )
}
