"""Grids of scenes, levels and methods over the vectors read as three scenes of 25 columns, every third
row of pixels each; a known signature is mixed into about every eleventh pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectral as S
from ..operators import physics, scenes
from ..operators.scenes import Method
from .cubes import cube

_SCENES = 3
_LEVELS = [0.1, 0.2, 0.4]
_GAMMAS = [0.0, 0.5]


def _moved(target: list[float], bands: int, tilt: float = 0.0) -> list[float]:
    """A signature moved by whole bands, ends repeated, and tilted about its middle."""
    n = len(target)
    return [max(0.0, target[min(max(k - bands, 0), n - 1)] * (1 + tilt * (2.0 * k / (n - 1) - 1))) for k in range(n)]


_HOSTS = {name: physics.reporter(64, dips) for name, dips in physics.REPORTERS.items()}
_A, _B = sorted(_HOSTS)
_LAB = {"sensor": [_HOSTS[_A]], "laboratory": [_moved(_HOSTS[_A], 2, 0.03)]}


def scene_cube(spark, d):
    px = cube(spark, d)
    return px.withColumns({"scene_id": F.concat(F.lit("s"), F.col("y") % _SCENES), "y": F.expr(f"cast(y div {_SCENES} as int)"), "gt": F.col("pixel_id") * 37 % 11 == 0})


GRID = [
    Method("matched_filter", "matched_filter", "sensor"), Method("matched_filter_spatial", "matched_filter", "sensor", sigma=1.5), Method("ace", "ace", "sensor"),
    Method("angle", "angle", "sensor"), Method("rx", "rx"), Method("laboratory_spatial", "matched_filter", "laboratory", sigma=1.5),
]


def _rated(scores, methods, keys):
    rates = scenes.scene_rates(scores, methods, keys)
    return rates.select(*keys, "method", F.round("auc", 6).alias("auc"), F.round("pd", 6).alias("pd"), "positives", "negatives")


def scene_method_grid(spark, d):
    """Scenes by levels by linear or bilinear mixing by six methods."""
    px = scene_cube(spark, d).withColumn("scene", F.col("scene_id"))
    px = scenes.implanted(px, S.literal(_LAB["sensor"][0]), _LEVELS, _GAMMAS, F.col("gt"))
    keys = ["scene", "level", "gamma"]
    return _rated(scenes.score_methods(px, _LAB, GRID, ["pixel_id", "y", "x", "gt", *keys]), GRID, keys)


def scene_method_means(spark, d):
    """By level, mixing and method: mean and deviation of the AUC over scenes, and the better of the
    filter and the angle where one leads by more than 0.005."""
    rates = scene_method_grid(spark, d)
    lead = F.max(F.when(F.col("method") == "matched_filter_spatial", F.col("m"))) - F.max(F.when(F.col("method") == "angle", F.col("m")))
    means = rates.groupBy("level", "gamma", "method").agg(F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s"), F.count("*").alias("scenes"))
    winner = means.groupBy("level", "gamma").agg(F.when(lead > 0.005, "matched_filter_spatial").when(lead < -0.005, "angle").otherwise("tie").alias("winner"))
    return means.join(winner, ["level", "gamma"]).select("level", "gamma", "method", F.round("m", 6).alias("auc_mean"), F.round("s", 5).alias("auc_std"), "scenes", "winner")


BLIND = [
    Method("oracle_spatial", "matched_filter", "exact", sigma=1.5), Method("family_centroid_spatial", "matched_filter", "family", sigma=1.5),
    Method("family_subspace_spatial", "subspace", "family", rank=3, sigma=1.5), Method("rx_spatial", "rx", sigma=1.5),
]
_TRACK = {"oracle_spatial": "exact", "family_centroid_spatial": "family", "family_subspace_spatial": "family", "rx_spatial": "blind"}


def _held_out(spark, d):
    """Every scene once per host that is mixed in; its family is the other host's variants."""
    px = scene_cube(spark, d).withColumn("scene", F.col("scene_id")).withColumn("held_out", F.explode(F.array(F.lit(_A), F.lit(_B))))
    px = px.withColumn("scene_id", F.concat_ws("|", "scene_id", "held_out"))
    return scenes.implanted(px, F.when(F.col("held_out") == _A, S.literal(_HOSTS[_A])).otherwise(S.literal(_HOSTS[_B])), [0.1, 0.3], [0.0], F.col("gt"))


def _known(px, variants):
    """``scene_id, target, member, spectrum``: what each scene's methods may know."""
    rows = []
    for held, other in ((_A, _B), (_B, _A)):
        rows += [(held, "exact", 0, _HOSTS[held])] + [(held, "family", k, _moved(_HOSTS[other], shift, tilt)) for k, (shift, tilt) in enumerate(variants)]
    known = px.sparkSession.createDataFrame(rows, "held_out string, target string, member int, spectrum array<double>")
    return px.select("scene_id", "held_out").distinct().join(F.broadcast(known), "held_out").drop("held_out")


_THREE = [(-1, -0.03), (0, 0.0), (1, 0.03)]
_NINE = [(shift, tilt) for shift in (-1, 0, 1) for tilt in (-0.03, 0.0, 0.03)]


def blind_tracks(spark, d):
    """Methods that know the target, another host's family, or nothing."""
    px = _held_out(spark, d)
    keys = ["scene", "held_out", "level"]
    rates = _rated(scenes.score_methods(px, _known(px, _THREE), BLIND, ["pixel_id", "y", "x", "gt", *keys]), BLIND, keys)
    track = F.create_map(*[F.lit(v) for kv in _TRACK.items() for v in kv])
    return rates.withColumn("track", F.element_at(track, F.col("method")))


TRANSFER = [
    Method("laboratory_spatial", "matched_filter", "laboratory", sigma=1.5), Method("nominal_spatial", "matched_filter", "nominal", sigma=1.5),
    Method("family_spatial", "subspace", "family", rank=4, sigma=1.5), Method("oracle_spatial", "matched_filter", "sensor", sigma=1.5),
]


def transfer_targets() -> dict[str, list]:
    """Laboratory, nominal and nine transferred signatures: moved, tilted, under a path of air."""
    air = S.transmittance(S.wavelengths(64), 1.0)
    through = lambda t: [v * a + 0.02 * (1 - a) for v, a in zip(t, air, strict=True)]
    lab = _HOSTS[_A]
    return {"laboratory": [lab], "nominal": [through(lab)], "family": [through(_moved(lab, s, t)) for s, t in _NINE], "sensor": [through(_moved(lab, 1, 0.02))]}


def transfer_tracks(spark, d):
    """What a laboratory signature, its nominal transfer and a family of transfers at rank 4 find of the
    signature at the sensor, in bilinear mixtures."""
    targets = transfer_targets()
    px = scenes.implanted(scene_cube(spark, d).withColumn("scene", F.col("scene_id")), S.literal(targets["sensor"][0]), [0.1, 0.3], [0.5], F.col("gt"))
    keys = ["scene", "level"]
    return _rated(scenes.score_methods(px, targets, TRANSFER, ["pixel_id", "y", "x", "gt", *keys]), TRANSFER, keys)


# ---- SQL -------------------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::double[]"


_BASE = "b0 as (select vec_id, 's' || ((vec_id // 25) % 3) as scene, (vec_id // 25) // 3 as y, vec_id % 25 as x, embedding::double[] as s, vec_id * 37 % 11 = 0 as gt from embeddings)"


def _mixed(source: str, target: str, columns: str, cell: str) -> str:
    return f"px as materialized (select vec_id, {cell} as cell, {columns}, y, x, gt, case when gt then list_transform(range(1, 65), lambda i: s[i] + level * ({target}[i] - s[i]) + gamma * level * (1 - level) * s[i] * {target}[i]) else s end as s from {source})"


_CELLS = """e as materialized (select cell, vec_id, unnest(range(1, 65)) as b, unnest(s) as v from px),
mul as materialized (select cell, list(m order by b) as m from (select cell, b, avg(v) as m from e group by all) group by cell),
xc as materialized (select cell, vec_id, list_transform(range(1, 65), lambda i: s[i] - m[i]) as z from px join mul using (cell)),
z as materialized (select cell, vec_id, unnest(range(1, 65)) as b, unnest(z) as v from xc),
c0 as materialized (select cell, p.b as i, q.b as j, sum(p.v * q.v) / max(n) as c from z p join z q using (cell, vec_id) join (select cell, count(*) as n from px group by cell) using (cell) group by all),
rg as materialized (select cell, 1e-6::double * sum(c) / 64 as r from c0 where i = j group by cell),
cm as materialized (select cell, list(r order by i) as a from (select cell, i, list(c + case when i = j then r else 0 end order by j) || list_transform(range(1, 65), lambda k: case when k = i then 1.0::double else 0.0::double end) as r from c0 join rg using (cell) group by cell, i) group by cell),
gj as (select 0 as k, cell, a from cm union all
  select k + 1, cell, list_transform(range(1, 65), lambda i: case when i = k + 1 then p else list_transform(range(1, 129), lambda j: a[i][j] - a[i][k + 1] * p[j]) end)
  from (select k, cell, a, list_transform(range(1, 129), lambda j: a[k + 1][j] / a[k + 1][k + 1]) as p from gj where k < 64)),
inv as materialized (select cell, list_transform(range(1, 65), lambda i: a[i][65:128]) as c from gj where k = 64),
rx as materialized (select cell, vec_id, list_dot_product(z, list_transform(c, lambda r: list_dot_product(r, z))) as score from xc join inv using (cell))"""


def _weights(name: str, target: str) -> str:
    """Weights of a filter for a target given per cell."""
    return f"{name}t as materialized (select cell, list_transform(range(1, 65), lambda i: t[i] - m[i]) as t from mul join (select cell, {target} as t from cells) using (cell)), {name} as materialized (select cell, w, list_dot_product(t, w) as d from (select cell, t, list_transform(c, lambda r: list_dot_product(r, t)) as w from inv join {name}t using (cell)))"


def _filtered(name: str, weights: str) -> str:
    return f"{name} as materialized (select cell, vec_id, list_dot_product(z, w) / (d + 1e-12) as score from xc join {weights} using (cell))"


_KERNEL = "tp as materialized (select o, exp(-0.5::double * (o / 1.5::double) ** 2) / sum(exp(-0.5::double * (o / 1.5::double) ** 2)) over () as w from (select unnest(range(-6, 7))::bigint as o)), hh as materialized (select cell, max(y) + 1 as h from px group by cell)"


def _smooth(source: str, name: str) -> str:
    reflect = lambda a, n: f"case when {a} < 0 then -{a} - 1 when {a} >= {n} then 2 * {n} - 1 - {a} else {a} end"
    return f"""{name}_p as materialized (select cell, vec_id, y, x, score from {source} join px using (cell, vec_id)),
{name}_y as materialized (select p.cell, p.vec_id, p.y, p.x, sum(w * q.score) as score from {name}_p p join hh using (cell), tp t, {name}_p q where q.cell = p.cell and q.x = p.x and q.y = {reflect("(p.y + t.o)", "hh.h")} group by all),
{name} as materialized (select p.cell, p.vec_id, sum(w * q.score) as score from {name}_y p, tp t, {name}_y q where q.cell = p.cell and q.y = p.y and q.x = {reflect("(p.x + t.o)", "25")} group by all)"""


def _rates(methods: dict[str, str], keys: str, more: str = "") -> str:
    long = " union all ".join(f"select '{m}' as method, cell, vec_id, score from {source}" for m, source in methods.items())
    return f""", sc as materialized (select method, cell, vec_id, round(score, 9) as score, gt from ({long}) join px using (cell, vec_id)),
rk as (select *, rank() over (partition by method, cell order by score) + (count(*) over (partition by method, cell, score) - 1) / 2.0::double as rk, row_number() over (partition by method, cell, gt order by score desc) as nth, count(*) over (partition by method, cell, gt) as n from sc),
au as (select method, cell, case when count_if(gt) * count_if(not gt) > 0 then (sum(case when gt then rk end) - count_if(gt) * (count_if(gt) + 1) / 2.0::double) / (count_if(gt)::double * count_if(not gt)) else 0.5 end as auc, count_if(gt)::bigint as positives, count_if(not gt)::bigint as negatives from rk group by all),
th as (select method, cell, max(score) as t from rk where not gt and nth = floor(0.05::double * n) + 1 group by all),
dp as (select method, cell, avg((score > t)::int) as pd from rk join th using (method, cell) where gt group by all)
select {keys}, method, round(auc, 6) as auc, round(pd, 6) as pd, positives, negatives{more} from au left join dp using (method, cell) join (select distinct cell, {keys} from px) using (cell)"""


_ACE = "ac as materialized (select a.cell, a.vec_id, n * n / ((d + 1e-12) * (rx.score + 1e-12)) as score from (select cell, vec_id, list_dot_product(z, w) as n, d from xc join w1 using (cell)) a join rx using (cell, vec_id))"
_GRID_SQL = (
    f"with recursive {_BASE}, kn as (select {_list(_LAB['sensor'][0])} as t, {_list(_LAB['laboratory'][0])} as lab), "
    + _mixed(f"b0, kn, (select unnest({_list(_LEVELS)}) as level), (select unnest({_list(_GAMMAS)}) as gamma)", "t", "scene, level, gamma", "scene || '|' || level || '|' || gamma") + ",\n"
    + ",\n".join((
        _CELLS, "cells as (select cell, t, lab from mul, kn)", _weights("w1", "t"), _weights("w2", "lab"), _filtered("mf", "w1"), _filtered("lb", "w2"), _ACE,
        "sa as materialized (select cell, vec_id, list_dot_product(s, t) / ((sqrt(list_dot_product(s, s)) + 1e-12) * (sqrt(list_dot_product(t, t)) + 1e-12)) as score from px, kn)", _KERNEL, _smooth("mf", "mfs"), _smooth("lb", "lbs"),
    )) + _rates({"matched_filter": "mf", "matched_filter_spatial": "mfs", "ace": "ac", "angle": "sa", "rx": "rx", "laboratory_spatial": "lbs"}, "scene, level, gamma")
)
_PART = lambda a, b: f"list_dot_product(f{a}.t, f{b}.w)"
_BLIND_SQL = (
    f"with recursive {_BASE}, kn as (select * from (values ('{_A}', {_list(_HOSTS[_A])}), ('{_B}', {_list(_HOSTS[_B])})) v(held_out, t)), "
    + "fam as (select * from (values " + ", ".join(f"('{held}', " + ", ".join(_list(_moved(_HOSTS[other], *v)) for v in _THREE) + ")" for held, other in ((_A, _B), (_B, _A))) + ") v(held_out, a, b, c)), "
    + _mixed("b0, kn, (select unnest([0.1, 0.3]::double[]) as level), (select 0.0::double as gamma)", "t", "scene, held_out, level", "scene || '|' || held_out || '|' || level") + ",\n"
    + ",\n".join((
        _CELLS, "cells as materialized (select cell, t, a, b, fam.c as d, list_transform(range(1, 65), lambda i: (a[i] + b[i] + fam.c[i]) / 3) as mid from (select distinct cell, held_out from px) join kn using (held_out) join fam using (held_out))",
        _weights("w0", "t"), _weights("wm", "mid"), *[_weights(f"q{k}", c) for k, c in enumerate("abd")], _filtered("orc", "w0"), _filtered("mid", "wm"),
        "g as materialized (select q0.cell, [q0.w, q1.w, q2.w] as w, list_transform([q0t.t, q1t.t, q2t.t], lambda p: list_transform([q0.w, q1.w, q2.w], lambda r: list_dot_product(p, r))) as g from q0 join q1 using (cell) join q2 using (cell) join q0t using (cell) join q1t using (cell) join q2t using (cell))",
        "gd as materialized (select cell, w, g, g[1][1]*(g[2][2]*g[3][3]-g[2][3]*g[3][2]) - g[1][2]*(g[2][1]*g[3][3]-g[2][3]*g[3][1]) + g[1][3]*(g[2][1]*g[3][2]-g[2][2]*g[3][1]) as det from g)",
        "gi as materialized (select cell, w, [[(g[2][2]*g[3][3]-g[2][3]*g[3][2])/det, (g[1][3]*g[3][2]-g[1][2]*g[3][3])/det, (g[1][2]*g[2][3]-g[1][3]*g[2][2])/det], [(g[2][3]*g[3][1]-g[2][1]*g[3][3])/det, (g[1][1]*g[3][3]-g[1][3]*g[3][1])/det, (g[1][3]*g[2][1]-g[1][1]*g[2][3])/det], [(g[2][1]*g[3][2]-g[2][2]*g[3][1])/det, (g[1][2]*g[3][1]-g[1][1]*g[3][2])/det, (g[1][1]*g[2][2]-g[1][2]*g[2][1])/det]] as gi from gd)",
        "sb as materialized (select cell, vec_id, list_dot_product(u, list_transform(gi, lambda r: list_dot_product(r, u))) / (rx.score + 1e-12) as score from (select cell, vec_id, gi, list_transform(w, lambda r: list_dot_product(r, z)) as u from xc join gi using (cell)) join rx using (cell, vec_id))",
        _KERNEL, _smooth("orc", "orcs"), _smooth("mid", "mids"), _smooth("sb", "sbs"), _smooth("rx", "rxs"),
    )) + _rates({"oracle_spatial": "orcs", "family_centroid_spatial": "mids", "family_subspace_spatial": "sbs", "rx_spatial": "rxs"}, "scene, held_out, level", ", case method when 'oracle_spatial' then 'exact' when 'rx_spatial' then 'blind' else 'family' end as track")
)

SQL = {
    "scene_method_grid": _GRID_SQL,
    "scene_method_means": f"with g as ({_GRID_SQL}), m as (select level, gamma, method, avg(auc) as m, stddev_pop(auc) as s, count(*)::bigint as scenes from g group by all), l as (select level, gamma, max(case when method = 'matched_filter_spatial' then m end) - max(case when method = 'angle' then m end) as lead from m group by all) select level, gamma, method, round(m, 6) as auc_mean, round(s, 5) as auc_std, scenes, case when lead > 0.005 then 'matched_filter_spatial' when lead < -0.005 then 'angle' else 'tie' end as winner from m join l using (level, gamma)",
    "blind_tracks": _BLIND_SQL,
}
QUERIES = {f.__name__: f for f in (scene_method_grid, scene_method_means, blind_tracks, transfer_tracks)}
