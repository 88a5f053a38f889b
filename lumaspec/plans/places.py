"""Queries that join by order and by place, and those over noise that keys determine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..operators import evaluate, geometry, metrics, noise, relate, scenes, stats
from ..sources import publication
from ..store import cut
from .cubes import cube
from .scenes import _A, _ACE, _CELLS, _HOSTS, _KERNEL, _filtered, _list, _moved, _smooth, _weights


def _r(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bracketing_join(spark, d):
    """The spectra as a long table of wavelengths, read at other wavelengths, some beyond its ends."""
    long = cube(spark, d).select(F.col("pixel_id").alias("vec_id"), F.posexplode("spectrum").alias("band", "value"))
    known = long.select("vec_id", (F.lit(400.0) + F.col("band") * (600.0 / 63)).alias("nm"), "value")
    asked = cube(spark, d).select(F.col("pixel_id").alias("vec_id"), F.explode(F.array(*[F.lit(v) for v in (390.0, 400.0, 523.7, 610.0, 760.05, 999.0, 1010.0)])).alias("nm"))
    return _r(relate.bracketed(asked, known, ["vec_id"], "nm", "value"))


def last_and_next_event(spark, d):
    """For every event of a user the last purchase up to it and the next one after it."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"), "event_type", "value")
    bought = e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("buy"))
    out = relate.as_of(e.select("event_id", "user_id", "at"), bought, ["user_id"], "at", ["buy"])
    return out.select("event_id", F.col("before.at").alias("last_at"), F.col("after.at").alias("next_at"))


def _boxes(spark, d):
    """A box around every third pixel, of a side by its label; some reach far beyond the scene."""
    side = (F.col("label") % 5 + 1) * F.when(F.col("pixel_id") % 30 == 0, 9).otherwise(1)
    return cube(spark, d).where("pixel_id % 3 = 0").select(F.col("pixel_id").alias("roi"), (F.col("y") - side).alias("y0"), (F.col("x") - side).alias("x0"), (F.col("y") + side).alias("y1"), (F.col("x") + side + 1).alias("x1"))


def means_in_boxes(spark, d):
    px = cube(spark, d).select("y", "x", S.mean(F.col("spectrum")).alias("score"))
    found = relate.in_boxes(px, _boxes(spark, d))
    return _r(found.groupBy("roi").agg(F.avg("score").alias("score"), F.count("*").alias("n")))


_TURN = geometry.TurnedCrop(16, 12, 2.0, 4.0, 30.0)


def means_in_turned_boxes(spark, d):
    """Boxes in the turned crop's own places, over the scene's pixels."""
    px = cube(spark, d).select("y", "x", S.mean(F.col("spectrum")).alias("score"))
    found = relate.in_boxes(px, _boxes(spark, d), crop=_TURN)
    return _r(found.groupBy("roi").agg(F.avg("score").alias("score"), F.count("*").alias("n")))


def turned_cube(spark, d):
    """The spectra of a turned crop; null outside the scene."""
    out = geometry.turned_crop(cube(spark, d), _TURN, "spectrum")
    return _r(out.select("y", "x", S.mean(F.col("spectrum")).alias("level"), F.element_at("spectrum", 1).alias("first"), F.element_at("spectrum", 64).alias("last")))


_SEEDS = {"calibrate": [100, 101], "evaluate": [1, 2]}
_LEVELS = [0.05, 0.15, 0.3]
_TARGETS = {"a": _HOSTS[_A], "b": _moved(_HOSTS[_A], 1)}


def _settings(spark, d):
    """``sensor, target, noise_std``: the noise at which 15 per cent of a target stand at 10 decibels."""
    px = cube(spark, d).where(F.col("pixel_id") * 37 % 11 == 0)
    known = spark.createDataFrame([(s, [float(v) for v in t]) for s, t in _TARGETS.items()], "sensor string, target array<double>")
    clean = px.crossJoin(F.broadcast(known))
    signal = clean.withColumn("spectrum", F.zip_with("spectrum", "target", lambda c, t: c + F.lit(0.15) * (t - c)))
    std = evaluate.noise_for_ratio(clean, signal, ["sensor"], "pixel_id", 10.0)
    return cut(metrics.match(known, std, ["sensor"]), "sensors")


def _variants(spark, d):
    px = cube(spark, d).withColumn("gt", F.col("pixel_id") * 37 % 11 == 0)
    settings = _settings(spark, d)
    out = noise.noisy_variants(px, settings, _SEEDS, _LEVELS)
    targets = settings.select("sensor", F.lit("sensor").alias("target"), F.lit(0).alias("member"), F.col("target").alias("spectrum"))
    names = [("scene", s, part, seed, v) for s in _TARGETS for part, seeds in _SEEDS.items() for seed in seeds for v in ([0.0] if part == "calibrate" else [0.0, *_LEVELS])]
    cells = spark.createDataFrame([("|".join(map(str, n)), n[1]) for n in names], "scene_id string, sensor string")
    return out, cells.join(targets, "sensor").drop("sensor")


def shared_noise(spark, d):
    """What noise adds to the first and last band, by sensor, seed and level: equal at all levels."""
    px = cube(spark, d).withColumn("gt", F.lit(False)).withColumn("clean", F.col("spectrum"))
    out = noise.noisy_variants(px, _settings(spark, d), {"evaluate": [1, 2]}, [0.05, 0.3])
    added = lambda k: F.element_at("spectrum", k) - F.element_at("clean", k)
    return _r(out.groupBy("sensor", "seed", F.col("pixel_id").alias("vec_id")).agg(F.max(added(1)).alias("first"), F.max(added(64)).alias("last"), F.countDistinct("level").alias("levels"), (F.max(added(1)) - F.min(added(1)) + F.max(added(64)) - F.min(added(64)) < 1e-12).alias("shared")))


def detection_limit_runs(spark, d):
    """Detection at budgets of false alarms, by sensor, level and seed, with noise shared by all levels."""
    return _r(noise.detection_runs(*_variants(spark, d), [0.05, 0.01])[0])


def detection_limits(spark, d):
    """The realized rates of false alarms, whether they keep the budget, and the first level from which
    on every mean detection is 0.5 or more."""
    runs, real = (cut(x, "limit-runs") for x in noise.detection_runs(*_variants(spark, d), [0.05, 0.01]))
    curve = runs.groupBy("sensor", "far", "level").agg(F.round(F.avg("pd"), 9).alias("pd"), F.round(F.min("pd"), 9).alias("pd_low"))
    limits = evaluate.limit_summary(curve, real, ["sensor", "far"], "level", "far", 0.5)
    mean = real.groupBy("sensor", "far").agg(F.avg("realized_far").alias("realized_far"))
    return _r(metrics.match(limits, mean, ["sensor", "far"]))


def temperature_by_source(spark, d):
    """A temperature and a bias per source on one split; probabilities scored on the others."""
    from .tables import _scored

    rows = _scored(spark, d).withColumn("logit", F.ln(F.col("p") / (1 - F.col("p")))).where("p > 0 and p < 1").withColumn("split", evaluate.split_of(F.col("doc_id")))
    models = evaluate.fit_temperature_groups(rows.where("split = 'fit'"), ["source"], "logit", "label")
    held = metrics.match(rows.where("split <> 'fit'"), models, ["source"]).withColumn("q", evaluate.apply_logistic(F.col("logit"), F.col("slope"), F.col("bias")))
    return _r(held.groupBy("source").agg(metrics.nll("q", "y").alias("nll"), metrics.brier("q", "y").alias("brier")), 5)


def _documents(spark, d):
    """``scene, report``: a nested JSON per scene, of each method's lead over the mean of all methods."""
    from .tables import _runs

    runs = _runs(spark, d)
    lead = F.col("auc") - F.avg("auc").over(Window.partitionBy("scene", "snr", "seed"))
    each = runs.withColumn("lead", F.round(lead, 9)).groupBy("scene", "method").agg(F.round(F.avg("lead"), 9).alias("mean"), F.round(F.stddev_pop("lead") / F.sqrt(F.count("*")), 9).alias("e"), F.count("*").alias("runs"))
    each = each.select("scene", "method", F.struct("mean", F.round(F.col("mean") - 2 * F.col("e"), 9).alias("ci_low"), F.round(F.col("mean") + 2 * F.col("e"), 9).alias("ci_high")).alias("auc"), "runs")
    whole = each.groupBy("scene").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", F.struct("auc", "runs"))))).alias("comparison"), F.sum("runs").alias("runs"))
    return whole.select("scene", F.to_json(F.struct("comparison", F.struct("runs", F.lit(True).alias("passed")).alias("gate"), F.array(F.lit("a.b"), F.lit(None).cast("string")).alias("notes")), {"ignoreNullFields": "false"}).alias("report"))


def result_leaves(spark, d):
    return _r(publication.leaves(_documents(spark, d), "scene", "report").drop("value"))


_METHODS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def publication_rows(spark, d):
    """A table of leads by scene and method, some turned, with single values and one that isn't there."""
    wanted = [publication.Entry(f"{scene} {m}", scene, f"comparison.{m}.auc", turned=m == "5-LOW") for scene in "FOP" for m in _METHODS]
    wanted += [publication.Entry(f"runs {scene}", scene, "gate.runs", single=True) for scene in "FOP"] + [publication.Entry("gate", "F", "gate.passed", single=True), publication.Entry("nowhere", "F", "comparison.none.auc")]
    return _r(publication.entries(publication.leaves(_documents(spark, d), "scene", "report"), "scene", wanted))


def split_predictions(spark, d):
    """What methods say of every mixed pixel that holds some of the target, beside the truth, by split."""
    px = cube(spark, d).withColumn("truth", (F.col("pixel_id") * 37 % 101) / F.lit(200.0))
    t = stats.mean_spectrum(px, F.col("label") == 3)
    mixed = px.withColumn("spectrum", S.implant(F.col("spectrum"), S.literal(t), F.col("truth"))).withColumn("split", evaluate.split_of(F.col("pixel_id")))
    methods = [scenes.Method("matched_filter", "matched_filter", "t"), scenes.Method("ace", "ace", "t"), scenes.Method("angle", "angle", "t")]
    scored = scenes.score_methods(mixed, {"t": [t]}, methods, ["pixel_id", "split", "truth"]).where("truth > 0.02")
    return _r(scored.withColumnRenamed("pixel_id", "vec_id").unpivot(["vec_id", "split", "truth"], [m.name for m in methods], "method", "raw"))


# ---- SQL -------------------------------------------------------------------------------------

_PX = "px0 as materialized (select vec_id, vec_id // 25 as y, vec_id % 25 as x, embedding::double[] as s, label from embeddings)"
_BOXES = "bx as (select vec_id as roi, y - k as y0, x - k as x0, y + k as y1, x + k + 1 as x1 from (select *, (label % 5 + 1) * case when vec_id % 30 = 0 then 9 else 1 end as k from px0 where vec_id % 3 = 0))"
_IN = "select roi, round(avg(list_sum(s) / 64), 6) as score, count(*)::bigint as n from {p} join bx on v >= y0 and v < y1 and u >= x0 and u < x1 group by roi"
_CROP = "cr as (select vec_id, s, (y - 9.5::double) * cos(radians(30)) - (x - 9.5::double) * sin(radians(30)) + 7.5::double as v, (x - 9.5::double) * cos(radians(30)) + (y - 9.5::double) * sin(radians(30)) + 5.5::double as u from px0)"
_G = lambda h: f"sqrt(-2 * ln((('0x' || substr({h}, 1, 13))::bigint + 0.5::double) / 4503599627370496::double)) * cos(2 * pi() * ((('0x' || substr({h}, 14, 13))::bigint + 0.5::double) / 4503599627370496::double))"
_SENSORS = "kn as (select * from (values " + ", ".join(f"('{s}', {_list(t)})" for s, t in _TARGETS.items()) + ") v(sensor, t)), ns as materialized (select sensor, t, sqrt(sum((0.15::double * (t[i] - s[i])) ** 2) / count(*)) / 10 ** 0.5::double as std from px0, kn, (select unnest(range(1, 65)) as i) where vec_id * 37 % 11 = 0 group by sensor, t)"
_USES = "us as (select * from (values " + ", ".join(f"('{part}', {s})" for part, some in _SEEDS.items() for s in some) + ") v(part, seed))"
_RUNS = (
    f"with recursive {_PX}, {_SENSORS}, {_USES}, "
    f"nz as materialized (select sensor, part, seed, vec_id, list(std * ({_G('h')}) order by b) as e from (select sensor, std, part, seed, vec_id, b, md5(concat_ws(':', sensor, seed, vec_id, b)) as h from px0, ns, us, (select unnest(range(64)) as b)) group by all), "
    f"px as materialized (select vec_id, y, x, sensor || '|' || part || '|' || seed || '|' || level as cell, sensor, part, seed, level, t, vec_id * 37 % 11 = 0 as gt, list_transform(range(1, 65), lambda i: s[i] + case when vec_id * 37 % 11 = 0 then level else 0.0::double end * (t[i] - s[i]) + e[i]) as s from px0 join nz using (vec_id) join ns using (sensor), (select unnest([0.0, {', '.join(map(str, _LEVELS))}]::double[]) as level) where part = 'evaluate' or level = 0),\n"
    + ",\n".join((_CELLS, "cells as materialized (select distinct cell, t from px)", _weights("w1", "t"), _filtered("mf", "w1"), _KERNEL, _smooth("mf", "mfs")))
    + """, md as materialized (select cell, median(score) as m from mfs group by cell), sd as materialized (select cell, any_value(m) as m, greatest(1.4826::double * median(abs(score - m)), 1e-12) as d from mfs join md using (cell) group by cell),
sc as materialized (select vec_id, sensor, part, seed, level, gt, round((score - m) / d, 9) as z from mfs join sd using (cell) join px using (cell, vec_id)),
ca as (select sensor, seed, z, row_number() over (partition by sensor, seed order by z desc) as nth, count(*) over (partition by sensor, seed) as n from sc where part = 'calibrate'),
th as materialized (select sensor, far, max(z) as t from ca, (select unnest([0.05, 0.01]::double[]) as far) where nth = floor(n * far) + 1 group by all),
real as materialized (select sensor, far, seed, avg((z > t)::int) as realized_far from sc join th using (sensor) where part = 'evaluate' and level = 0 group by all),
rk as (select sensor, level, seed, gt, rank() over (partition by sensor, level, seed order by z) + (count(*) over (partition by sensor, level, seed, z) - 1) / 2.0::double as rk from sc where part = 'evaluate' and level > 0),
au as (select sensor, level, seed, (sum(case when gt then rk end) - count_if(gt) * (count_if(gt) + 1) / 2.0::double) / (count_if(gt)::double * count_if(not gt)) as auc from rk group by all),
runs as materialized (select sensor, level, far, seed, avg((z > t)::int) as pd, any_value(auc) as auc, count(*)::bigint as positives from sc join th using (sensor) join au using (sensor, level, seed) where part = 'evaluate' and gt group by sensor, level, far, seed)"""
)

_LEADS = (
    "runs as (select o_orderstatus as scene, o_orderpriority as method, (o_custkey % 4 * 5)::double as snr, o_custkey % 6 as seed, round(avg(o_totalprice) / 500000, 9) as auc from orders group by all), "
    "ld as (select scene, method, round(auc - avg(auc) over (partition by scene, snr, seed), 9) as lead from runs), "
    "ag as (select scene, method, round(avg(lead), 9) as mean, round(stddev_pop(lead) / sqrt(count(*)), 9) as e, count(*) as runs from ld group by all), "
    "iv as (select scene, method, mean, round(mean - 2 * e, 9) as ci_low, round(mean + 2 * e, 9) as ci_high, runs from ag), tt as (select scene, sum(runs) as runs from iv group by scene)"
)

SQL = {
    "split_predictions": f"""with recursive {_PX}, kn as (select list(m order by b) as t from (select b, avg(v) as m from (select unnest(range(1, 65)) as b, unnest(s) as v from px0 where label = 3) group by b)),
px as materialized (select vec_id, 'one' as cell, t, (vec_id * 37 % 101) / 200.0::double as truth, list_transform(range(1, 65), lambda i: s[i] + (vec_id * 37 % 101) / 200.0::double * (t[i] - s[i])) as s from px0, kn),
""" + ",\n".join((_CELLS, "cells as (select cell, any_value(t) as t from px group by cell)", _weights("w1", "t"), _filtered("mf", "w1"), _ACE)) + """,
a as (select vec_id, 'matched_filter' as method, score as raw from mf union all select vec_id, 'ace', score from ac
  union all select vec_id, 'angle', list_dot_product(s, t) / ((sqrt(list_dot_product(s, s)) + 1e-12) * (sqrt(list_dot_product(t, t)) + 1e-12)) from px)
select vec_id, ['fit', 'calibrate', 'evaluate'][vec_id % 3 + 1] as split, truth, method, round(raw, 6) as raw from a join px using (vec_id) where truth > 0.02""",
    "result_leaves": f"""with {_LEADS}, l as (
  select scene, 'comparison.' || method || '.auc.' || part as path, v::double as number, null::varchar as t from (unpivot iv on mean, ci_low, ci_high into name part value v)
  union all select scene, 'comparison.' || method || '.runs', runs::double, runs::varchar from iv union all select scene, 'gate.runs', runs::double, runs::varchar from tt
  union all select scene, 'gate.passed', 1.0, 'true' from tt union all select scene, 'notes.0', null, 'a.b' from tt union all select scene, 'notes.1', null, null from tt)
select scene, path, round(number, 6) as number from l""",
    "publication_rows": f"""with {_LEADS}, w as (select *, (row_number() over (order by scene, method) - 1)::int as place from iv)
select place, scene || ' ' || method as name, round(case when method = '5-LOW' then -mean else mean end, 6) as estimate, round(case when method = '5-LOW' then -ci_high else ci_low end, 6) as low, round(case when method = '5-LOW' then -ci_low else ci_high end, 6) as high,
  ci_low <= 0 and ci_high >= 0 as crosses_zero, case when case when method = '5-LOW' then -ci_high else ci_low end > 0 then 'advantage' when case when method = '5-LOW' then -ci_low else ci_high end < 0 then 'disadvantage' else 'inconclusive' end as verdict, scene || ':comparison.' || method || '.auc' as source from w
union all select (14 + row_number() over (order by scene))::int, 'runs ' || scene, runs::double, null, null, null, 'value', scene || ':gate.runs' from tt
union all select 18, 'gate', 1.0, null, null, null, 'value', 'F:gate.passed' union all select 19, 'nowhere', null, null, null, null, 'missing', 'F:comparison.none.auc'""",
    "bracketing_join": f"""with {_PX}, k as (select vec_id, 400.0::double + b * (600.0::double / 63) as nm, v as value from (select vec_id, unnest(range(64)) as b, unnest(s) as v from px0)),
q as (select vec_id, unnest([390.0, 400.0, 523.7, 610.0, 760.05, 999.0, 1010.0]::double[]) as nm from px0),
b as (select q.vec_id, q.nm, k.nm as x0, k.value as y0 from q asof left join k on q.vec_id = k.vec_id and q.nm >= k.nm),
a as (select b.*, k.nm as x1, k.value as y1 from b asof left join k on b.vec_id = k.vec_id and b.nm < k.nm)
select vec_id, round(nm, 6) as nm, round(case when x0 is null then y1 when x1 is null then y0 else y0 + (y1 - y0) * (nm - x0) / (x1 - x0) end, 6) as value from a""",
    "last_and_next_event": """with e as (select event_id, user_id, epoch_us(ts::timestamp) / 1000000.0::double as tm, event_type from events), p as (select distinct user_id, tm from e where event_type = 'purchase'),
b as (select e.event_id, e.user_id, e.tm, p.tm as last_at from e asof left join p on e.user_id = p.user_id and e.tm >= p.tm)
select event_id, last_at, p.tm as next_at from b asof left join p on b.user_id = p.user_id and b.tm < p.tm""",
    "means_in_boxes": f"with {_PX}, {_BOXES}, pv as (select *, y as v, x as u from px0) " + _IN.format(p="pv"),
    "means_in_turned_boxes": f"with {_PX}, {_BOXES}, {_CROP} " + _IN.format(p="cr"),
    "turned_cube": f"""with {_PX}, p as (select v, u, 9.5::double + (v - 7.5::double) * cos(radians(30)) + (u - 5.5::double) * sin(radians(30)) as fy, 9.5::double + (u - 5.5::double) * cos(radians(30)) - (v - 7.5::double) * sin(radians(30)) as fx from (select unnest(range(16))::int as v), (select unnest(range(12))::int as u)),
k as (select v, u, floor(fy)::bigint + i as y, floor(fx)::bigint + j as x, (case i when 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * (case j when 1 then fx - floor(fx) else 1 - fx + floor(fx) end) as w from p, (select unnest(range(2)) as i), (select unnest(range(2)) as j))
select v as y, u as x, round(case when count(s) = 4 then sum(w * list_sum(s) / 64) end, 6) as level, round(case when count(s) = 4 then sum(w * s[1]) end, 6) as first, round(case when count(s) = 4 then sum(w * s[64]) end, 6) as last from k left join px0 using (y, x) group by v, u""",
    "shared_noise": f"""with {_PX}, {_SENSORS}, h as (select sensor, std, seed, vec_id, md5(concat_ws(':', sensor, seed, vec_id, 0)) as a, md5(concat_ws(':', sensor, seed, vec_id, 63)) as b from px0, ns, (select unnest([1, 2])::bigint as seed))
select sensor, seed, vec_id, round(std * ({_G("a")}), 6) as first, round(std * ({_G("b")}), 6) as last, 3::bigint as levels, true as shared from h""",
    "detection_limit_runs": _RUNS + " select sensor, level, far, seed::bigint as seed, round(pd, 6) as pd, round(auc, 6) as auc, positives from runs",
    "detection_limits": _RUNS + """, cu as (select sensor, far, level, round(avg(pd), 9) as pd, round(min(pd), 9) as pd_low from runs group by all),
wo as (select sensor, far, level, min(pd) over w as p, min(pd_low) over w as q from cu window w as (partition by sensor, far order by level rows between current row and unbounded following)),
li as (select sensor, far, min(case when p >= 0.5 then level end) as nominal_crossing, min(case when q >= 0.5 then level end) as conservative_crossing from wo group by all),
rm as (select sensor, far, avg(realized_far) as r, avg(realized_far) <= far as ok from real group by sensor, far)
select sensor, far, ok as budget_valid, nominal_crossing, conservative_crossing, case when ok then nominal_crossing end as nominal_limit, case when ok then conservative_crossing end as conservative_limit, round(r, 6) as realized_far from li join rm using (sensor, far)""",
}
QUERIES = {f.__name__: f for f in (bracketing_join, last_and_next_event, means_in_boxes, means_in_turned_boxes, turned_cube, shared_noise, detection_limit_runs, detection_limits, temperature_by_source, result_leaves, publication_rows, split_predictions)}
