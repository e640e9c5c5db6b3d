"""Queries over the volumes of the given tables, and the SQL with the same results.

The mask is the largest disc inside the square that the embeddings fill, so it grows with the table. Bin counts, labels and model parameters are those of the blueprint's examples. Results that pass through floating-point sums are rounded on both sides.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.voxel import argmax_label, denormalise, inverse_sigmoid, nearest_label, normalise, pinned_softmax, project_gaps, project_simplex, sigmoid
from ..operators import bimm, denoise, export, geometry, gmm, mask, phases, potts, stencil
from ..operators import histogram as hist
from ..operators.blocks import shared_folder
from ..sources import tiff
from ..sources.archive import Field, archive_slabs, read_archive, write_archive
from ..sources.volumes import cube_side, embedding_volume, event_volume, from_rods, linear_ids, order_volume, rods, save_aligned, square_side
from . import programs

LABELS = [-0.15, 0.0, 0.15]
LO, HI = -0.5, 0.5
MIXTURE = gmm.Mixture([0.3, 0.4, 0.3], [-0.15, 0.0, 0.15], [0.08, 0.06, 0.08])
THETA = bimm.Theta([0.3, 0.2, 0.3, 0.08, 0.05, 0.07], [0.3, 0.5, 0.7], 0.09, 0.9, 1.2, 0.3)
WINDOW = (0.05, 0.95, 0.4)
NODES = 16
LAM = 0.5
IMAGES = 64


def r6(c) -> F.Column:
    return F.round(c, 6)


def masked(spark: SparkSession, sf: str) -> DataFrame:
    side = square_side(spark, sf)
    return mask.in_cylinder(embedding_volume(spark, sf, side), (side - 1) / 2, (side - 1) / 2, side / 2)


def shared_file(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the cluster shares."""
    path = f"{shared_folder(spark)}/voxelgrove/{uuid.uuid4().hex}"
    os.makedirs(path.removeprefix("file://").removeprefix("file:"), exist_ok=True)
    return f"{path}/{name}"


def unit(spark: SparkSession, sf: str) -> DataFrame:
    """The masked volume with u from 0 to 1."""
    return masked(spark, sf).withColumn("u", normalise(F.col("u"), LO, HI))


def with_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.gradient_magnitude(unit(spark, sf))


def written_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """For queries that read it more than once."""
    return hist.once(with_gradient(spark, sf), "gradient")


# --- SQL of the same volumes ---
E_SQL = 'side AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS s FROM embeddings), e AS (SELECT CAST(n AS INT) AS n, CAST(vec_id % s AS INT) AS "row", CAST(vec_id // s AS INT) AS "col", CAST(x AS DOUBLE) AS u FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS n FROM embeddings), side)'
M_SQL = f'{E_SQL}, m AS (SELECT e.* FROM e, side WHERE ("row" - (s - 1) / 2.0) * ("row" - (s - 1) / 2.0) + ("col" - (s - 1) / 2.0) * ("col" - (s - 1) / 2.0) < s * s / 4.0)'
U_SQL = f'{M_SQL}, w AS (SELECT n, "row", "col", CASE WHEN u <= {LO} THEN 0.0 WHEN u >= {HI} THEN 1.0 ELSE CAST((u - {LO}) / {HI - LO} AS DOUBLE) END AS u FROM m)'
V_SQL = 'cube AS (SELECT greatest(1, CAST(floor(pow(count(*), 1 / 3.0) + 0.5) AS BIGINT)) AS s FROM events), e AS (SELECT CAST(event_id % s AS INT) AS n, CAST((event_id // s) % s AS INT) AS "row", CAST(event_id // (s * s) AS INT) AS "col", CAST(value AS DOUBLE) AS u FROM events, cube)'
O_SQL = 'e AS (SELECT CAST(o_orderkey % 25 AS INT) AS n, CAST((o_orderkey // 25) % 20 AS INT) AS "row", CAST(o_orderkey // 500 AS INT) AS "col", CAST(floor(o_totalprice / 10) AS INT) AS v FROM orders)'
OTHERS = {"n": '"row", "col"', "row": 'n, "col"', "col": 'n, "row"'}


def _q(a: str) -> str:
    return a if a == "n" else f'"{a}"'


def prev_sql(axis: str, value: str) -> str:
    w = f"OVER (PARTITION BY {OTHERS[axis]} ORDER BY {_q(axis)})"
    return f"CASE WHEN lag({_q(axis)}) {w} = {_q(axis)} - 1 THEN lag({value}) {w} END"


def next_sql(axis: str, value: str) -> str:
    w = f"OVER (PARTITION BY {OTHERS[axis]} ORDER BY {_q(axis)})"
    return f"CASE WHEN lead({_q(axis)}) {w} = {_q(axis)} + 1 THEN lead({value}) {w} END"


def gradient_sql(source: str) -> str:
    d = [f"({next_sql(a, 'u')}) - ({prev_sql(a, 'u')}) AS d{k}" for k, a in enumerate(OTHERS)]
    return f'SELECT n, "row", "col", u, coalesce(0.5 * sqrt(d0 * d0 + d1 * d1 + d2 * d2), -1.0) AS v FROM (SELECT *, {", ".join(d)} FROM {source})'


G_SQL = f"{U_SQL}, g AS ({gradient_sql('w')})"


def div_sql(parts: list[str]) -> str:
    out = []
    for a, p in zip(OTHERS, parts, strict=True):
        out.append(f"(CASE WHEN ({next_sql(a, '1')}) IS NOT NULL THEN {p} ELSE 0.0 END - coalesce({prev_sql(a, p)}, 0.0))")
    return " + ".join(out)


def bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    return f"greatest(0, least({bins - 1}, CAST(floor({bins} * (({x} - {lo}) / ({hi} - {lo}))) AS INT)))"


def hist_sql(source: str, bins: int, lo: str = "(SELECT min(u) FROM {s})", hi: str = "(SELECT max(u) FROM {s})", value: str = "u") -> str:
    """Common tables ``ends`` and ``h`` (bin, count, density, lo, hi)."""
    lo, hi = lo.format(s=source), hi.format(s=source)
    return (
        f"ends AS (SELECT {lo} AS lo, {hi} AS hi, (SELECT count(*) FROM {source}) AS total), "
        f"c AS (SELECT {bin_sql(value, 'lo', 'hi', bins)} AS bin, count(*) AS count FROM {source}, ends WHERE lo <= {value} AND {value} <= hi GROUP BY 1), "
        f"h AS (SELECT CAST(b.range AS INT) AS bin, coalesce(c.count, 0) AS count, coalesce(c.count, 0) / (total * ((hi - lo) / {bins})) AS density, lo, hi FROM range({bins}) b LEFT JOIN c ON c.bin = b.range, ends)"
    )


def noise_sql(seed: int) -> str:
    """The number of a voxel that dithering moves it by: see ``hist.noise``."""
    return f"((CAST('0x' || substr(md5('{seed}:' || n || ':' || \"row\" || ':' || \"col\"), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


CUM_SQL = "k AS (SELECT *, sum({what}) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, sum({what}) OVER () AS total FROM h)"


def labels_sql(u: str, labels: list[float] = LABELS) -> str:
    pairs = ", ".join(f"{{'d': abs({c} - {u}), 'k': {k}}}" for k, c in enumerate(labels))
    return f"list_min([{pairs}]).k"


def nodes_sql(i: int, j: int) -> str:
    return ", ".join(f"({a!r}, {g!r}, {w!r})" for a, g, w in bimm.nodes(THETA, i, j, NODES))


def pure_sql(i: int) -> str:
    s2 = THETA.sigma_n**2
    c = 2 * 2**0.5 / 3.141592653589793 / (s2 * s2 * (1 - THETA.rho) ** 1.5)
    return f"{c!r} * v * v * exp(-0.5 * (u - {THETA.peaks[i]}) * (u - {THETA.peaks[i]}) / {s2!r} - v * v / {s2 * (1 - THETA.rho)!r})"


def interface_sql(i: int, j: int) -> str:
    s2 = THETA.sigma_n**2
    a = s2 * (1 - THETA.rho)
    c = 1 / (2 * 2**0.5 * 3.141592653589793) / (THETA.ds * THETA.sigma_n * a**0.5)
    terms = " + ".join(f"{w!r} * exp(-0.5 * (u - {x!r}) * (u - {x!r}) / {s2!r} - (v - {g!r}) * (v - {g!r}) / {a!r}) * (1 - exp(-4 * v * {g!r} / {a!r})) / {g!r}" for x, g, w in bimm.nodes(THETA, i, j, NODES))
    return f"{c!r} * v * ({terms})"


def pure_marginal_sql(i: int, u: str = "u") -> str:
    s = THETA.sigma_n
    return f"{1 / ((2 * 3.141592653589793) ** 0.5 * s)!r} * exp(-({u} - {THETA.peaks[i]}) * ({u} - {THETA.peaks[i]}) / {2 * s * s!r})"


def interface_marginal_sql(i: int, j: int, u: str = "u") -> str:
    s = THETA.sigma_n
    terms = " + ".join(f"{w!r} * exp(-({u} - {x!r}) * ({u} - {x!r}) / {2 * s * s!r})" for x, _, w in bimm.nodes(THETA, i, j, NODES))
    return f"{1 / ((2 * 3.141592653589793) ** 0.5 * 2 * THETA.ds * s)!r} * ({terms})"


def mixture_sql(parts: list[str]) -> str:
    return " + ".join(f"{w} * ({p})" for w, p in zip(THETA.weights, parts, strict=True))


def window_sql(density: str, lu: str, hu: str, hv: str, points: int = 48) -> str:
    """The integral of an expression of u and v over lu..hu, 0..hv, by products of Gauss-Legendre points; FROM what gives the ends."""
    x, w = np.polynomial.legendre.leggauss(points)
    lists = f"unnest({[(a + 1) / 2 for a in x.tolist()]}) AS {{0}}, unnest({[a / 2 for a in w.tolist()]}) AS w{{0}}"
    grid = f"SELECT {lu} + ({hu} - {lu}) * a AS u, {hv} * b AS v, wa * wb * ({hu} - {lu}) * {hv} AS w FROM ends_uv, (SELECT {lists.format('a')}), (SELECT {lists.format('b')})"
    return f"(SELECT sum(w * ({density})) FROM ({grid}))"


DENSITY_SQL = mixture_sql([*[pure_sql(i) for i in range(3)], *[interface_sql(i, j) for i, j in THETA.pairs]])
MARGINAL_SQL = mixture_sql([*[pure_marginal_sql(i) for i in range(3)], *[interface_marginal_sql(i, j) for i, j in THETA.pairs]])
ELIGIBLE_SQL = f"{G_SQL}, s AS (SELECT * FROM g WHERE v > 0 AND v <= {WINDOW[2]} AND u BETWEEN {WINDOW[0]} AND {WINDOW[1]})"
D_SQL = f'{M_SQL}, dn AS (SELECT n, "row", "col", avg(u) OVER (PARTITION BY "row", "col" ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM m)'


def gmm_sql(k: int) -> str:
    w, m, s = MIXTURE.weights[k], MIXTURE.means[k], MIXTURE.sigmas[k]
    return f"{w / ((2 * 3.141592653589793) ** 0.5 * s)!r} * exp(-0.5 * (u - {m}) * (u - {m}) / {s * s!r})"


def denoise_sql(steps: int) -> str:
    """Common tables t0, a0, t1, a1 ... of the dual iteration."""
    out = [f'{M_SQL}, t0 AS (SELECT n, "row", "col", u, 0.0 AS q1, 0.0 AS q2, 0.0 AS q3, 0.0 AS r FROM m)']
    for k in range(steps):
        out.append(f"a{k} AS (SELECT *, {div_sql(['q1', 'q2', 'q3'])} - u / {LAM} AS w FROM t{k})")
        g = ", ".join(f"coalesce(({next_sql(a, 'w')}) - w, 0.0) AS g{i}" for i, a in enumerate(OTHERS))
        out.append(f"b{k} AS (SELECT *, {g} FROM a{k})")
        new = [f"(q{i + 1} + {denoise.TAU} * g{i}) / (1 + {denoise.TAU} * sqrt(g0 * g0 + g1 * g1 + g2 * g2))" for i in range(3)]
        change = " + ".join(f"(q{i + 1} - {x}) * (q{i + 1} - {x})" for i, x in enumerate(new))
        out.append(f't{k + 1} AS (SELECT n, "row", "col", u, {", ".join(f"{x} AS q{i + 1}" for i, x in enumerate(new))}, {change} AS r FROM b{k})')
    return ", ".join(out)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


VOXEL = 'n, "row", "col"'


@query(f"WITH {M_SQL} SELECT {VOXEL}, round(u, 6) AS u FROM m")
def mask_voxels(spark, sf):
    return masked(spark, sf).select("n", "row", "col", r6(F.col("u")).alias("u"))


@query(f'WITH {M_SQL} SELECT "col", min("row") AS row_begin, max("row") + 1 AS row_end FROM m GROUP BY "col"')
def mask_spans(spark, sf):
    return mask.spans(masked(spark, sf))


@query(f'WITH {M_SQL} SELECT min("row") AS row_begin, max("row") + 1 AS row_end FROM m')
def bounding_rows(spark, sf):
    return mask.bounding_rows(masked(spark, sf))


@query(f'WITH {V_SQL} SELECT CAST(n - (s - s // 2) // 2 AS INT) AS n, "row", "col", round(u, 6) AS u FROM e, cube WHERE n >= (s - s // 2) // 2 AND n < (s - s // 2) // 2 + s // 2')
def crop_height(spark, sf):
    side = cube_side(spark, sf)
    return mask.crop_images(event_volume(spark, sf, side), side, side // 2).select("n", "row", "col", r6(F.col("u")).alias("u"))


@query(f"WITH {O_SQL} SELECT {VOXEL}, round(CASE WHEN v <= 5000 THEN 0.0 WHEN v >= 40000 THEN 1.0 ELSE (v - 5000.0) / 35000.0 END, 6) AS u FROM e")
def normalize(spark, sf):
    return order_volume(spark, sf).select("n", "row", "col", r6(normalise(F.col("v").cast("double"), 5000.0, 40000.0)).alias("u"))


@query(f"WITH {U_SQL} SELECT {VOXEL}, round({LO} + {HI - LO} * u, 6) AS u FROM w")
def denormalize(spark, sf):
    return unit(spark, sf).select("n", "row", "col", r6(denormalise(F.col("u"), LO, HI)).alias("u"))


@query(f"WITH {U_SQL}, l AS (SELECT {'{labels}'} AS k, avg({LO} + {HI - LO} * u) AS c FROM w GROUP BY 1) SELECT k, round((c - {LO}) / {HI - LO}, 6) AS c FROM l".replace("{labels}", f"list_min([{', '.join(f'{{\'d\': abs({c} - ({LO} + {HI - LO} * u)), \'k\': {k}}}' for k, c in enumerate(LABELS))}]).k"))
def label_normalize(spark, sf):
    """The phases' mean levels, on the volume's own scale from 0 to 1."""
    levels = unit(spark, sf).withColumn("level", denormalise(F.col("u"), LO, HI))
    means = levels.groupBy(nearest_label(F.col("level"), LABELS).alias("k")).agg(F.avg("level").alias("c"))
    return means.select("k", r6((F.col("c") - LO) / (HI - LO)).alias("c"))


@query(f"WITH {M_SQL} SELECT round(min(u), 6) AS lo, round(max(u), 6) AS hi FROM m")
def min_max(spark, sf):
    return hist.value_range(masked(spark, sf)).select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(f"WITH {G_SQL} SELECT round(min(CASE WHEN v > 0 THEN v END), 6) AS lo, round(max(CASE WHEN v > 0 THEN v END), 6) AS hi FROM g")
def grad_min_max(spark, sf):
    return hist.positive_range(with_gradient(spark, sf)).select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(f"WITH {V_SQL}, {hist_sql('e', 100, '50.0', '400.0')} SELECT bin, count, round(density, 9) AS density FROM h")
def hist_1d(spark, sf):
    return hist.histogram(event_volume(spark, sf), 100, 50.0, 400.0).select("bin", "count", F.round("density", 9).alias("density"))


@query(f"WITH {M_SQL}, {hist_sql('m', 256)} SELECT bin, count, round(density, 6) AS density, round(lo, 6) AS lo, round(hi, 6) AS hi FROM h")
def hist_density(spark, sf):
    return hist.histogram(masked(spark, sf), 256).select("bin", "count", *[r6(F.col(c)).alias(c) for c in ("density", "lo", "hi")])


@query(f"WITH {V_SQL}, {hist_sql('e', 500)} SELECT round((bin + 0.5) / 500, 6) AS brightness, round(density * (hi - lo), 6) AS ch0 FROM h WHERE bin BETWEEN 1 AND 498")
def hist_text(spark, sf):
    h = hist.histogram(event_volume(spark, sf), 500)
    return hist.histogram_table(h, 500).select(r6(F.col("brightness")).alias("brightness"), r6(F.col("ch0")).alias("ch0"))


@query(
    f"WITH {V_SQL}, ends AS (SELECT min(u) AS lo, max(u) AS hi, count(*) AS total FROM e), c AS (SELECT {bin_sql(f'(u + 2.5 * ({noise_sql(3)} - 0.5))', 'lo', 'hi', 200)} AS bin, count(*) AS count FROM e, ends WHERE lo - 1.25 <= u AND u + 1.25 <= hi GROUP BY 1) "
    "SELECT CAST(b.range AS INT) AS bin, coalesce(c.count, 0) AS count, round(coalesce(c.count, 0) / (total * ((hi - lo) / 200)), 9) AS density FROM range(200) b LEFT JOIN c ON c.bin = b.range, ends"
)
def hist_dithered(spark, sf):
    """Values moved by up to 1.25 either way before they are counted, each by a number made from its place."""
    return hist.histogram(event_volume(spark, sf), 200, jitter=2.5, seed=3).select("bin", "count", F.round("density", 9).alias("density"))


H16_SQL = f"{O_SQL}, h AS (SELECT CAST(b.range AS INT) AS bin, coalesce(c.count, 0) AS count FROM range(65536) b LEFT JOIN (SELECT v, count(*) AS count FROM e GROUP BY v) c ON c.v = b.range)"


@query(f"WITH {H16_SQL} SELECT bin, count FROM h")
def hist_u16(spark, sf):
    return hist.exact_histogram(order_volume(spark, sf))


@query(f"WITH {H16_SQL}, {CUM_SQL.format(what='count')} SELECT bin, count, CAST(cum AS BIGINT) AS cum FROM k WHERE count > 0")
def hist_cumulative(spark, sf):
    return hist.cumulative(hist.exact_histogram(order_volume(spark, sf))).where("count > 0").select("bin", "count", "cum")


@query(f"WITH {H16_SQL}, {CUM_SQL.format(what='count')} SELECT coalesce(max(CASE WHEN 0.01 * total >= cum THEN bin END), 0) AS lo, coalesce(min(CASE WHEN 0.99 * total <= cum THEN bin END), 65536) AS hi FROM k")
def tail_cut_u16(spark, sf):
    return hist.tail_bins(hist.exact_histogram(order_volume(spark, sf)), 0.01, 1 << 16)


@query(
    f"WITH {V_SQL}, {hist_sql('e', 1024)}, k AS (SELECT *, (hi - lo) / 1024 AS bw, sum(density) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM h) "
    "SELECT round(coalesce(max(CASE WHEN 0.0137123 / bw >= cum THEN bin END), 0) * any_value(bw) + any_value(lo), 6) AS lo, round(coalesce(min(CASE WHEN 0.9862877 / bw <= cum THEN bin END), 1024) * any_value(bw) + any_value(lo), 6) AS hi FROM k"
)
def tail_cut_float(spark, sf):
    return hist.tail_values(hist.histogram(event_volume(spark, sf), 1024), 0.0137123, 1024).select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


def quantile_sql(p: float, bins: int) -> str:
    reached = f"count > 0 AND {p} * total <= cum"
    return f"round(coalesce(min_by(lo + (bin + ({p} * total - (cum - count)) / count) * ((hi - lo) / {bins}), bin) FILTER (WHERE {reached}), any_value(hi)), 6)"


@query(f"WITH {V_SQL}, {hist_sql('e', 1024)}, {CUM_SQL.format(what='count')} SELECT {quantile_sql(0.01, 1024)} AS q01, {quantile_sql(0.5, 1024)} AS q50, {quantile_sql(0.99, 1024)} AS q99, round(any_value(lo), 6) AS q0, round(any_value(hi), 6) AS q1 FROM k")
def quantile_interp(spark, sf):
    q = hist.quantiles(hist.histogram(event_volume(spark, sf), 1024), {"q01": 0.01, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q1": 1.0}, 1024)
    return q.select(*[r6(F.col(c)).alias(c) for c in q.columns])


@query(f"WITH {M_SQL}, {hist_sql('m', 500)}, {CUM_SQL.format(what='density')} SELECT round(coalesce(min(CASE WHEN 0.997 * total <= cum THEN bin END), 500) / 500.0, 6) AS hi FROM k")
def tail_gmm(spark, sf):
    return hist.upper_tail(hist.histogram(masked(spark, sf), 500), 0.003, 500).select(r6(F.col("hi")).alias("hi"))


@query(f"WITH {G_SQL} SELECT {VOXEL}, round(u, 6) AS u, round(v, 6) AS v FROM g")
def grad_magnitude(spark, sf):
    return with_gradient(spark, sf).select("n", "row", "col", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query(f"WITH {M_SQL} SELECT {VOXEL}, {', '.join(f'round(coalesce(({next_sql(a, chr(117))}) - u, 0.0), 6) AS g_{a}' for a in OTHERS)} FROM m")
def fwd_gradient(spark, sf):
    return stencil.forward_gradient(masked(spark, sf)).select("n", "row", "col", *[r6(F.col(f"g_{a}")).alias(f"g_{a}") for a in OTHERS])


FG_SQL = f"{M_SQL}, fg AS (SELECT *, {', '.join(f'coalesce(({next_sql(a, chr(117))}) - u, 0.0) AS g_{a}' for a in OTHERS)} FROM m)"


@query(f"WITH {FG_SQL} SELECT {VOXEL}, round({div_sql(['g_n', 'g_row', 'g_col'])}, 6) AS div FROM fg")
def divergence(spark, sf):
    return stencil.divergence(stencil.forward_gradient(masked(spark, sf))).select("n", "row", "col", r6(F.col("div")).alias("div"))


UV_SQL = (
    f"{G_SQL}, ends AS (SELECT min(u) AS ul, max(u) AS uh, min(CASE WHEN v > 0 THEN v END) AS vl, max(CASE WHEN v > 0 THEN v END) AS vh FROM g), "
    f"j AS (SELECT {bin_sql('v', 'vl', 'vh', 512)} AS vbin, {bin_sql('u', 'ul', 'uh', 512)} AS ubin, count(*) AS count FROM g, ends WHERE u BETWEEN ul AND uh AND v BETWEEN vl AND vh GROUP BY 1, 2)"
)


@query(f"WITH {UV_SQL} SELECT * FROM j")
def uv_hist(spark, sf):
    return hist.joint_histogram(written_gradient(spark, sf))


@query(f"WITH {UV_SQL} SELECT 511 - vbin AS y, ubin AS x, CAST(round(ln(count + 1) * 255.0 / (SELECT max(ln(count + 1)) FROM j)) AS INT) AS level FROM j")
def uv_heat(spark, sf):
    return hist.heat_map(hist.joint_histogram(written_gradient(spark, sf)))


@query(f"WITH {G_SQL} SELECT {VOXEL}, round(u, 6) AS u, round(v, 6) AS v FROM w JOIN (SELECT n, \"row\", \"col\", v FROM g) USING (n, \"row\", \"col\")")
def uv_join(spark, sf):
    uv = phases.align(unit(spark, sf), with_gradient(spark, sf).drop("u"))
    return uv.select("n", "row", "col", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query(f'WITH {M_SQL} SELECT "row", "col", len(vals) AS images, round(list_sum(vals), 6) AS total, round(vals[1], 6) AS first, round(vals[-1], 6) AS last FROM (SELECT "row", "col", list(u ORDER BY n) AS vals FROM m GROUP BY ALL)')
def rod_form(spark, sf):
    v = F.col("vals")
    return rods(masked(spark, sf)).select("row", "col", F.size(v).cast("long").alias("images"), r6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(v[0]).alias("first"), r6(F.element_at(v, -1)).alias("last"))


@query(f"WITH {M_SQL} SELECT {VOXEL}, round(u, 6) AS u FROM m")
def rod_round_trip(spark, sf):
    return from_rods(rods(masked(spark, sf))).select("n", "row", "col", r6(F.col("u")).alias("u"))


@query(f'WITH {M_SQL} SELECT {VOXEL}, row_number() OVER (ORDER BY "col", "row", n) - 1 AS id FROM m')
def linear_order(spark, sf):
    return linear_ids(masked(spark, sf), IMAGES).select("n", "row", "col", "id")


@query(f"WITH {M_SQL} SELECT {VOXEL}, {labels_sql('u')} AS label FROM m")
def nearest_labels(spark, sf):
    return masked(spark, sf).select("n", "row", "col", nearest_label(F.col("u"), LABELS).alias("label"))


@query(f"WITH {U_SQL} SELECT {VOXEL}, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS label FROM (SELECT {VOXEL}, u AS a, u * u AS b, 1.0 - (0.0 + u + u * u) AS c FROM w)")
def argmax_labels(spark, sf):
    return unit(spark, sf).select("n", "row", "col", argmax_label(F.array(F.col("u"), F.col("u") * F.col("u"))).alias("label"))


def simplex_sql(parts: list[str]) -> str:
    s = "list_reverse_sort([" + ", ".join(parts) + "])"
    return (
        f"s AS (SELECT *, {s} AS d FROM w), th AS (SELECT *, CASE WHEN d[3] - (d[1] + d[2] + d[3] - 1) / 3 > 0 THEN (d[1] + d[2] + d[3] - 1) / 3 WHEN d[2] - (d[1] + d[2] - 1) / 2 > 0 THEN (d[1] + d[2] - 1) / 2 ELSE d[1] - 1 END AS theta FROM s) "
        f"SELECT {VOXEL}, " + ", ".join(f"round(greatest({p} - theta, 0.0), 6) AS p{k}" for k, p in enumerate(parts)) + " FROM th"
    )


@query(f"WITH {U_SQL}, {simplex_sql(['2 * u', '1 - u', 'u * u'])}")
def simplex_project(spark, sf):
    u = F.col("u")
    p = project_simplex(F.array(2 * u, 1 - u, u * u), 3)
    return unit(spark, sf).select("n", "row", "col", p.alias("p")).select("n", "row", "col", *[r6(F.col("p")[k]).alias(f"p{k}") for k in range(3)])


#: The parameters' ranges, for SQL: name, least, greatest, and whether the range is one of logarithms.
RANGES = (("weight", -4.6, 4.6, False), ("peak", 0.0, 1.0, False), ("sigma_n", 1e-3, 2.0, True), ("sigma_b", 0.1, 10.0, True), ("rho", 0.0, 0.999, False), ("ds", 0.5, 1.5, True))


def range_sql(name: str, lo: float, hi: float, logs: bool) -> str:
    a, b = (f"ln({lo:.6f})", f"ln({hi:.6f})") if logs else (f"{lo:.6f}", f"{hi:.6f}")
    inside = f"({a} + ({b} - {a}) / (1 + exp(6 - 12 * u)))"
    return f"round({f'exp({inside})' if logs else inside}, 6) AS {name}"


@query(f"WITH {U_SQL} SELECT {VOXEL}, {', '.join(range_sql(*r) for r in RANGES)}, round(12 * u - 6, 6) AS back FROM w")
def parameter_ranges(spark, sf):
    """A free number of each voxel into the range of every parameter, and back from the peak's."""
    x = 12 * F.col("u") - 6
    limits = bimm.LIMITS | {"ds": (np.log(0.5), np.log(1.5))}
    inside = {name: sigmoid(x, float(lo), float(hi)) for name, (lo, hi) in limits.items()}
    logs = {"sigma_n", "sigma_b", "ds"}
    columns = [r6(F.exp(c) if name in logs else c).alias(name) for name, c in inside.items()]
    return unit(spark, sf).select("n", "row", "col", *columns, r6(inverse_sigmoid(inside["peak"], *limits["peak"])).alias("back"))


@query(f"WITH {U_SQL}, t AS (SELECT *, 1 + exp(2 * u) + exp(-u) + exp(u * u) AS total FROM w) SELECT {VOXEL}, round(1 / total, 6) AS w0, round(exp(2 * u) / total, 6) AS w1, round(exp(-u) / total, 6) AS w2, round(exp(u * u) / total, 6) AS w3 FROM t")
def weights_from_zero(spark, sf):
    """Shares of a fixed 0 and three numbers of each voxel."""
    u = F.col("u")
    w = unit(spark, sf).select("n", "row", "col", pinned_softmax(F.array(2 * u, -u, u * u)).alias("w"))
    return w.select("n", "row", "col", *[r6(F.col("w")[k]).alias(f"w{k}") for k in range(4)])


GAP = 0.15
GAP_VALUES = ("u", "u * u", "1.1 - u", "0.5")


@query(
    f"""WITH {U_SQL}, x AS (SELECT n, "row", col, unnest([0, 1, 2, 3]) AS k, unnest([{", ".join(GAP_VALUES)}]) AS x FROM w),
    s AS (SELECT *, row_number() OVER (PARTITION BY n, "row", col ORDER BY x, k) - 1 AS place FROM x),
    a AS (SELECT n, "row", col, list(x - {GAP} * place ORDER BY place) AS y FROM s GROUP BY ALL),
    i AS (SELECT *, unnest(range(4)) AS b FROM a), j AS (SELECT *, unnest(range(4)) AS e FROM i), p AS (SELECT *, unnest(range(4)) AS place FROM j),
    q AS (SELECT n, "row", col, place, b, min(list_avg(y[b + 1 : e + 1])) AS lowest FROM p WHERE b <= place AND place <= e GROUP BY ALL),
    l AS (SELECT n, "row", col, place, greatest(0.0, least({1 - 3 * GAP}, max(lowest))) + {GAP} * place AS level FROM q GROUP BY n, "row", col, place)
    SELECT n, "row", col, {", ".join(f"round(max(level) FILTER (k = {k}), 6) AS p{k}" for k in range(4))} FROM s JOIN l USING (n, "row", col, place) GROUP BY n, "row", col"""
)
def gap_projection(spark, sf):
    """Four numbers of each voxel moved as little as can be, until all lie a gap apart in 0..1."""
    u = F.col("u")
    p = unit(spark, sf).select("n", "row", "col", project_gaps(F.array(u, u * u, 1.1 - u, F.lit(0.5)), 4, GAP).alias("p"))
    return p.select("n", "row", "col", *[r6(F.col("p")[k]).alias(f"p{k}") for k in range(4)])


@query(f"WITH {M_SQL} SELECT {VOXEL}, CAST(k AS INT) AS k, round(30.0 * (u - c) * (u - c), 6) AS term FROM m, (SELECT unnest(range(3)) AS k, unnest({LABELS}) AS c)")
def potts_energy_terms(spark, sf):
    return phases.data_terms(masked(spark, sf), phases.label_table(spark, LABELS), 30.0).select("n", "row", "col", "k", r6(F.col("term")).alias("term"))


@query(
    f"WITH {M_SQL}, l AS (SELECT {labels_sql('u')} AS k, avg(u) AS c FROM m GROUP BY 1) SELECT a.k AS i, b.k AS j, round(abs(a.c - b.c), 6) AS gap FROM l a JOIN l b ON a.k < b.k"
)
def pair_labels(spark, sf):
    means = masked(spark, sf).groupBy(nearest_label(F.col("u"), LABELS).alias("k")).agg(F.avg("u").alias("c"))
    return phases.label_pairs(means).select("i", "j", r6(F.abs(F.col("c_i") - F.col("c_j"))).alias("gap"))


RAW_STATS_SQL = (
    f"WITH {D_SQL}, s AS (SELECT {labels_sql('d')} AS label, u FROM m JOIN dn USING (n, \"row\", \"col\")) "
    "SELECT label, count(*) AS count, round(avg(u), 6) AS mean, round(coalesce(var_samp(u), 0.0), 6) AS variance, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM s GROUP BY label"
)


@query(RAW_STATS_SQL)
def raw_stats_by_label(spark, sf):
    v = masked(spark, sf)
    found = phases.statistics_by_label(v, phases.denoised_by_mean(v), LABELS)
    return found.select("label", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "variance", "fraction")])


@query(RAW_STATS_SQL)
def raw_stats_aligned(spark, sf):
    """The same from two volumes saved in buckets of place: neither is shuffled for the join."""
    v = masked(spark, sf)
    raw, quiet = (save_aligned(x, f"aligned_{uuid.uuid4().hex}", 16, shared_file(spark, "volume")) for x in (v, phases.denoised_by_mean(v)))
    found = phases.statistics_by_label(raw, quiet, LABELS)
    return found.select("label", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "variance", "fraction")])


FRACTION_SQL = f"{M_SQL}, f AS (SELECT {labels_sql('u')} AS label, count(*) AS count FROM m GROUP BY 1)"


@query(f"WITH {FRACTION_SQL} SELECT label, count, round(count / sum(count) OVER (), 6) AS fraction FROM f")
def phase_fractions(spark, sf):
    return phases.fractions(masked(spark, sf), LABELS).select("label", "count", r6(F.col("fraction")).alias("fraction"))


@query(f"WITH {FRACTION_SQL} SELECT round(sum(CASE WHEN label <> 2 THEN count ELSE 0 END) / sum(count), 6) AS porosity, round(sum(CASE WHEN label = 0 THEN count ELSE 0 END) / sum(CASE WHEN label <> 2 THEN count ELSE 0 END), 6) AS saturation FROM f")
def porosity(spark, sf):
    return phases.porosity(phases.fractions(masked(spark, sf), LABELS), 2, 0).select(r6(F.col("porosity")).alias("porosity"), r6(F.col("saturation")).alias("saturation"))


@query("WITH x AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS h FROM events ORDER BY h LIMIT 500) SELECT event_id, CAST(h AS BIGINT) AS h, CAST((row_number() OVER (ORDER BY h) - 1) // 50 AS INT) AS batch FROM x")
def sample_batches(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    return phases.sample_batches(events, F.col("event_id"), 500, 50)


@query(f"WITH {ELIGIBLE_SQL} SELECT {VOXEL}, round(u, 6) AS u, round(v, 6) AS v FROM s")
def eligible_voxels(spark, sf):
    return bimm.eligible(with_gradient(spark, sf), *WINDOW).select("n", "row", "col", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


EM_SQL = f"{M_SQL}, d AS (SELECT u, {', '.join(f'{gmm_sql(k)} AS d{k}' for k in range(3))} FROM m)"


@query(
    f"WITH {EM_SQL} SELECT "
    + ", ".join(f"round(sum(d{k} / (d0 + d1 + d2){x}), 4) AS {n}_{k}" for k in range(3) for n, x in (("w", ""), ("s1", " * u"), ("s2", " * u * u")))
    + ", round(sum(-ln(d0 + d1 + d2)), 4) AS nll FROM d"
)
def em_step(spark, sf):
    m = gmm.moments(masked(spark, sf), MIXTURE)
    return m.select(*[F.round(c, 4).alias(c) for c in m.columns])


@query(f"WITH {EM_SQL}, c AS (SELECT u, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS cluster FROM d) SELECT cluster, count(*) AS count, round(avg(u), 6) AS mean FROM c GROUP BY 1")
def gmm_assign(spark, sf):
    return gmm.assign(masked(spark, sf), MIXTURE).groupBy("cluster").agg(F.count("*").alias("count"), r6(F.avg("u")).alias("mean"))


@query(f"WITH {ELIGIBLE_SQL} SELECT {VOXEL}, {', '.join(f'round({pure_sql(i)}, 6) AS p{i}' for i in range(3))} FROM s")
def bimm_density_pure(spark, sf):
    s = bimm.eligible(with_gradient(spark, sf), *WINDOW)
    return s.select("n", "row", "col", *[r6(bimm.pure_density(F.col("u"), F.col("v"), THETA, i)).alias(f"p{i}") for i in range(3)])


@query(f"WITH {ELIGIBLE_SQL} SELECT {VOXEL}, {', '.join(f'round({interface_sql(i, j)}, 6) AS p{i}{j}' for i, j in THETA.pairs)} FROM s")
def bimm_density_interface(spark, sf):
    s = bimm.eligible(with_gradient(spark, sf), *WINDOW)
    return s.select("n", "row", "col", *[r6(bimm.interface_density(F.col("u"), F.col("v"), THETA, i, j, NODES)).alias(f"p{i}{j}") for i, j in THETA.pairs])


@query(f"WITH {ELIGIBLE_SQL}, ends_uv AS (SELECT {WINDOW[0]}::DOUBLE AS lu, {WINDOW[1]}::DOUBLE AS hu, {WINDOW[2]}::DOUBLE AS hv) SELECT count(*) AS n, round(avg(-ln({DENSITY_SQL})) + ln({window_sql(DENSITY_SQL, 'lu', 'hu', 'hv')}), 6) AS nll FROM s")
def bimm_nll(spark, sf):
    s = bimm.eligible(with_gradient(spark, sf), *WINDOW)
    return bimm.negative_log_likelihood(s, THETA, WINDOW, NODES).select("n", r6(F.col("nll")).alias("nll"))


@query(f"WITH {U_SQL} SELECT {VOXEL}, round({MARGINAL_SQL}, 6) AS p FROM w")
def bimm_marginals(spark, sf):
    return unit(spark, sf).select("n", "row", "col", r6(bimm.marginal(F.col("u"), THETA, NODES)).alias("p"))


COMPONENTS = [("full", MARGINAL_SQL), *[(f"{i:02d}", f"{THETA.weights[i]} * ({pure_marginal_sql(i)})") for i in range(3)], *[(f"{i:02d}-{j:02d}", f"{THETA.weights[3 + k]} * ({interface_marginal_sql(i, j)})") for k, (i, j) in enumerate(THETA.pairs)]]


@query(f"WITH {U_SQL}, x AS (SELECT lo + range * ((hi - lo) / 512) AS u FROM range(513), (SELECT min(u) AS lo, max(u) AS hi FROM w)) " + " UNION ALL ".join(f"SELECT '{n}' AS component, round(u, 6) AS u, round({p}, 6) AS pdf FROM x" for n, p in COMPONENTS))
def component_pdfs(spark, sf):
    lo, hi = hist.value_range(unit(spark, sf)).first()
    return bimm.component_tables(spark, THETA, lo, hi, count=NODES).select("component", r6(F.col("u")).alias("u"), r6(F.col("pdf")).alias("pdf"))


MASSES = [*[(f"{i:02d}", pure_sql(i)) for i in range(3)], *[(f"{i:02d}-{j:02d}", interface_sql(i, j)) for i, j in THETA.pairs]]


def share_sql(p: float, bins: int) -> str:
    return quantile_sql(p, bins).removeprefix("round(").removesuffix(", 6)")


@query(
    f"WITH {G_SQL}, {hist_sql('g', 1024)}, {CUM_SQL.format(what='count')}, hu AS (SELECT {share_sql(0.01, 1024)} AS lu, {share_sql(0.99, 1024)} AS hu FROM k), "
    f"gv AS (SELECT * FROM g WHERE v > 0), {hist_sql('gv', 1024, value='v', lo='(SELECT min(v) FROM {s})', hi='(SELECT max(v) FROM {s})').replace('ends AS', 'ends2 AS').replace('FROM gv, ends WHERE', 'FROM gv, ends2 WHERE').replace('c AS (SELECT', 'c2 AS (SELECT', 1).replace('h AS (SELECT CAST', 'h2 AS (SELECT CAST').replace('LEFT JOIN c ON c.bin', 'LEFT JOIN c2 AS c ON c.bin').replace(', ends)', ', ends2)')}, "
    f"{CUM_SQL.format(what='count').replace('k AS', 'k2 AS').replace('FROM h)', 'FROM h2)')}, ends_uv AS (SELECT lu, hu, (SELECT {share_sql(0.99, 1024)} FROM k2) AS hv FROM hu) "
    + " UNION ALL ".join(f"SELECT '{name}' AS component, round({window_sql(sql, 'lu', 'hu', 'hv')}, 6) AS mass" for name, sql in MASSES)
)
def bimm_truncation_mass(spark, sf):
    """(component, mass) of the window that the volume's own tails give: closed forms, against integrals of the densities."""
    uv = written_gradient(spark, sf)
    u = hist.quantiles(hist.histogram(uv, 1024), {"lo": 0.01, "hi": 0.99}, 1024).first()
    v = hist.quantiles(hist.histogram(uv.where("v > 0"), 1024, value="v"), {"hi": 0.99}, 1024).first()
    window = (u.lo, u.hi, v.hi)
    rows = [(f"{i:02d}", bimm.pure_mass(THETA, i, *window)) for i in range(3)] + [(f"{i:02d}-{j:02d}", bimm.interface_mass(THETA, i, j, *window, NODES)) for i, j in THETA.pairs]
    return spark.createDataFrame([(name, round(x, 6)) for name, x in rows], "component string, mass double")


@query(f'WITH {U_SQL} SELECT n, "row", CAST(round(pow(greatest(u, 0.0), {1 / 2.2!r}) * 255) AS INT) AS level FROM w WHERE "col" = (SELECT s // 2 FROM side)')
def slice_png(spark, sf):
    return export.slice_picture(unit(spark, sf), square_side(spark, sf) // 2)


@query(
    f'WITH {U_SQL}, b AS (SELECT min("row") r0, max("row") r1, min("col") c0, max("col") c1 FROM w), '
    'grid AS (SELECT CAST(n.range AS INT) AS n, CAST(r.range AS INT) AS "row", CAST(c.range AS INT) AS "col" FROM range(64) n, (SELECT unnest(range(s)) AS range FROM side) r, (SELECT unnest(range(s)) AS range FROM side) c, b WHERE r.range BETWEEN r0 AND r1 AND c.range BETWEEN c0 AND c1) '
    'SELECT n, "row", "col", CASE WHEN u IS NULL THEN 255 ELSE CAST(least(255, greatest(0, round(255 * u))) AS INT) END AS level FROM grid LEFT JOIN w USING (n, "row", "col")'
)
def vtk_grid(spark, sf):
    return export.image_grid(unit(spark, sf), IMAGES)


@query(
    f'WITH {U_SQL}, b AS (SELECT min("row") r0, max("row") r1, min("col") c0, max("col") c1 FROM w), '
    'grid AS (SELECT CAST(n.range AS INT) AS n, CAST(r.range AS INT) AS "row", CAST(c.range AS INT) AS "col", r0, c0 FROM range(64) n, (SELECT unnest(range(s)) AS range FROM side) r, (SELECT unnest(range(s)) AS range FROM side) c, b WHERE r.range BETWEEN r0 AND r1 AND c.range BETWEEN c0 AND c1), '
    'l AS (SELECT n, "row" - r0 AS "row", "col" - c0 AS "col", CASE WHEN u IS NULL THEN 255 ELSE CAST(least(255, greatest(0, round(255 * u))) AS INT) END AS level FROM grid LEFT JOIN w USING (n, "row", "col")) '
    """SELECT "col", "row", md5(string_agg(printf('%02x', level), '' ORDER BY n)) AS line FROM l GROUP BY "col", "row" """
)
def vtk_file(spark, sf):
    """The volume written as one VTK file by many tasks, and the md5 of each of its lines (in hexadecimal digits) as read back."""
    path = f"{shared_file(spark, 'labels')}.vti"
    export.write_vtk(unit(spark, sf), path, IMAGES)
    return export.read_vtk(spark, path).select("col", "row", F.md5(F.lower(F.hex("bytes")).cast("binary")).alias("line"))


@query(f"WITH {V_SQL} SELECT {VOXEL}, u FROM (SELECT n, \"row\", \"col\", CAST(floor(100 * u) AS INT) AS u FROM e) ")
def tiff_scan(spark, sf):
    """The events' volume, in hundredths, written as a scan of tiled, compressed BigTIFF files and read back by byte ranges; places that no event fills are left out again."""
    v = event_volume(spark, sf).select("n", "row", "col", F.floor(100 * F.col("u")).cast("int").alias("u"))
    path = shared_file(spark, "scan")
    # Hundredths go beyond 16 bits; 32-bit floats hold whole numbers to 2**24, and NaN for null.
    tiff.write_scan(v, path, pages_each=16, kind="f4", big=True, tile=(16, 16))
    back = tiff.Scan.open(spark, path).voxels(part_bytes=1 << 16).select("n", "row", "col", F.when(~F.isnan("u"), F.col("u")).cast("int").alias("u"))
    return back.join(v.select("n", "row", "col"), ["n", "row", "col"], "left_semi")


@query(f"WITH {denoise_sql(2)} SELECT {VOXEL}, round(u, 6) AS u, round(u - {LAM} * ({div_sql(['q1', 'q2', 'q3'])}), 6) AS d FROM t2")
def tv_denoise(spark, sf):
    return denoise.denoise(masked(spark, sf), 2, LAM, block=(32, 32, 32)).select("n", "row", "col", r6(F.col("u")).alias("u"), r6(F.col("d")).alias("d"))


@query(f"WITH {denoise_sql(2)} SELECT round(sqrt(max(r)), 6) AS residual FROM t2")
def dual_residual(spark, sf):
    return denoise.residual(denoise.denoise_by_windows(masked(spark, sf), 2, LAM)).select(r6(F.col("residual")).alias("residual"))


@query(f"WITH {denoise_sql(3)} " + " UNION ALL ".join(f"SELECT {k} AS iter, round(sqrt(max(r)), 6) AS maxdeltaq FROM t{k + 1}" for k in range(3)))
def tv_residuals(spark, sf):
    """(iter, maxdeltaq) of three iterations in two rounds."""
    _, trace = denoise.denoise_traced(masked(spark, sf), 3, LAM, block=(32, 32, 32), per_round=2)
    return trace.select("iter", r6(F.col("maxdeltaq")).alias("maxdeltaq"))


def potts_step_sql() -> str:
    """The largest change of the first iteration, from the nearest labels: dual vectors are still too short to be projected."""
    k = range(3)
    out = [f"{M_SQL}, v AS (SELECT *, " + ", ".join(f"CASE WHEN k = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v{i}" for i in k) + f" FROM (SELECT *, {labels_sql('u')} AS k FROM m))"]
    out.append("x AS (SELECT *, " + ", ".join(f"{potts.TAU!r} * coalesce(({next_sql(a, f'v{i}')}) - v{i}, 0.0) AS x{i}{j}" for i in k for j, a in enumerate(OTHERS)) + " FROM v)")
    out.append("q AS (SELECT *, " + ", ".join(f"v{i} + {potts.TAU!r} * ({div_sql([f'x{i}{j}' for j in range(3)])} - 30.0 * (u - {LABELS[i]}) * (u - {LABELS[i]})) AS q{i}" for i in k) + " FROM x)")
    out.append("d AS (SELECT *, list_reverse_sort([q0, q1, q2]) AS d FROM q)")
    out.append("th AS (SELECT *, CASE WHEN d[3] - (d[1] + d[2] + d[3] - 1) / 3 > 0 THEN (d[1] + d[2] + d[3] - 1) / 3 WHEN d[2] - (d[1] + d[2] - 1) / 2 > 0 THEN (d[1] + d[2] - 1) / 2 ELSE d[1] - 1 END AS t FROM d)")
    change = " + ".join(f"pow(greatest(q{i} - t, 0.0) - v{i}, 2)" for i in k)
    return f"WITH {', '.join(out)} SELECT 0 AS iter, round(sqrt(max({change})), 6) AS maxdeltaq FROM th"


@query(potts_step_sql())
def potts_residuals(spark, sf):
    """(iter, maxdeltaq) of the first iteration."""
    _, trace = potts.segment_traced(masked(spark, sf), LABELS, 30.0, 1, block=(32, 32, 32))
    return trace.select("iter", r6(F.col("maxdeltaq")).alias("maxdeltaq"))


@query()
def tv_denoise_full(spark, sf):
    """150 iterations."""
    return denoise.denoise(masked(spark, sf), per_round=25)


@query()
def potts_segment(spark, sf):
    """(label, count, fraction) after all 100 iterations."""
    s = potts.segment(masked(spark, sf), LABELS, 30.0)
    return s.groupBy("label").agg(F.count("*").alias("count")).withColumn("fraction", F.col("count") / F.sum("count").over(phases.Window.partitionBy()))


def _clusters(spark, m: gmm.Mixture) -> DataFrame:
    return spark.createDataFrame([(k, w, a, s, m.nll) for k, (w, a, s) in enumerate(zip(m.weights, m.means, m.sigmas, strict=True))], "cluster int, weight double, mean double, sigma double, nll double")


@query()
def gmm_fit(spark, sf):
    """(cluster, weight, mean, sigma, nll) of the best attempt."""
    return _clusters(spark, gmm.fit(masked(spark, sf), LABELS))


#: Mixtures that one pass evaluates together.
CANDIDATES = [MIXTURE, gmm.Mixture([0.2, 0.5, 0.3], [-0.2, 0.05, 0.1], [0.05, 0.1, 0.15]), gmm.Mixture([1 / 3] * 3, [-0.1, 0.02, 0.3], [0.1, 0.1, 0.1])]


def pass_sql(attempt: int, m: gmm.Mixture) -> str:
    d = ", ".join(f"{w!r} / ({(2 * 3.141592653589793) ** 0.5!r} * {s!r}) * exp(-0.5 * (u - {a!r}) * (u - {a!r}) / ({s!r} * {s!r})) AS d{k}" for k, (w, a, s) in enumerate(zip(m.weights, m.means, m.sigmas, strict=True)))
    rows = " UNION ALL ".join(f"SELECT {attempt} AS attempt, {k} AS cluster, round(sum(d{k} / t), 4) AS w, round(sum(d{k} / t * u), 4) AS s1, round(sum(d{k} / t * u * u), 4) AS s2, round(sum(-ln(t)), 4) AS nll FROM t{attempt}" for k in range(3))
    return f"t{attempt} AS (SELECT *, d0 + d1 + d2 AS t FROM (SELECT u, {d} FROM m)), r{attempt} AS ({rows})"


@query(f"WITH {M_SQL}, " + ", ".join(pass_sql(k, m) for k, m in enumerate(CANDIDATES)) + " " + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(3)))
def gmm_pass(spark, sf):
    """(attempt, cluster, w, s1, s2, nll): the sums that one pass over the drawn voxels gives for several attempts' mixtures at once."""
    sample = gmm.drawn(masked(spark, sf))
    rows = [(k, c, *(round(float(x[c]), 4) for x in found[:3]), round(found[3], 4)) for k, found in enumerate(gmm.passed(sample, CANDIDATES)) for c in range(3)]
    sample.drop()
    return spark.createDataFrame(rows, "attempt int, cluster int, w double, s1 double, s2 double, nll double")


def em_sql(steps: int) -> str:
    """Common tables p0 (one row: n, wide, and w, m, s of each cluster), p1, p2 ... of the steps from the nearest labels on."""
    pick = labels_sql("u")
    first = f"z AS (SELECT count(*) AS n, (max(u) - min(u)) / 2 AS wide FROM m), a AS (SELECT {pick} AS k, avg((u - {LABELS}[{pick} + 1]) * (u - {LABELS}[{pick} + 1])) AS q FROM m GROUP BY 1)"
    zero = ", ".join(f"{1 / 3!r} AS w{k}, {c} AS m{k}, (SELECT sqrt(q) FROM a WHERE k = {k}) AS s{k}" for k, c in enumerate(LABELS))
    out = [f"{M_SQL}, {first}, p0 AS (SELECT n, wide, {zero} FROM z)"]
    for i in range(steps):
        d = ", ".join(f"w{k} / ({(2 * 3.141592653589793) ** 0.5!r} * s{k}) * exp(-0.5 * (u - m{k}) * (u - m{k}) / (s{k} * s{k})) AS d{k}" for k in range(3))
        t = ", ".join(f"sum(d{k} / (d0 + d1 + d2)) AS a{k}, sum(d{k} / (d0 + d1 + d2) * u) AS b{k}, sum(d{k} / (d0 + d1 + d2) * u * u) AS c{k}" for k in range(3))
        new = ", ".join(f"a{k} / n AS w{k}, b{k} / a{k} AS m{k}, sqrt(abs(c{k} / a{k} - (b{k} / a{k}) * (b{k} / a{k}))) AS s{k}" for k in range(3))
        out.append(f"d{i} AS (SELECT u, p{i}.n, wide, {d} FROM m, p{i}), t{i} AS (SELECT any_value(n) AS n, any_value(wide) AS wide, {t}, sum(-ln(d0 + d1 + d2)) AS nll FROM d{i}), p{i + 1} AS (SELECT n, wide, {new}, nll FROM t{i})")
    return ", ".join(out)


@query(f"WITH {em_sql(3)} " + " UNION ALL ".join(f"SELECT {k} AS cluster, round(w{k}, 6) AS weight, round(m{k}, 6) AS mean, round(s{k}, 6) AS sigma, round(nll, 3) AS nll FROM p3" for k in range(3)))
def gmm_three_steps(spark, sf):
    """The fit's first three steps of one attempt."""
    m = gmm.fit(masked(spark, sf), LABELS, attempts=1, iterations=3)
    return _clusters(spark, m).select("cluster", *[r6(F.col(c)).alias(c) for c in ("weight", "mean", "sigma")], F.round("nll", 3).alias("nll"))


def _bimm_rows(spark, t: bimm.Theta, nll: float) -> DataFrame:
    whole = phases.mixture_fractions(t.weights, len(t.peaks))
    return spark.createDataFrame([(t.peaks[k], t.weights[k], whole[k], t.sigma_n, t.sigma_b, t.ds, t.rho, nll) for k in range(len(t.peaks))], "peak double, weight double, fraction double, sigma_n double, sigma_b double, ds double, rho double, nll double")


@query()
def bimm_fit(spark, sf):
    """(peak, weight, fraction, sigma_n, sigma_b, ds, rho, nll) by phase: the first stage at its full length, the second with 60 passes (the operator's own limit is 10,000), over the eligible voxels up to the operator's bound."""
    s = bimm.eligible(with_gradient(spark, sf), *WINDOW)
    return _bimm_rows(spark, *bimm.fit(s, THETA, WINDOW, last=(60, 1e-4)))


@query()
def circle_fit(spark, sf):
    """(n, yc, xc, r) of every slice of the events' volume."""
    return geometry.circles(event_volume(spark, sf))


RING_SQL = "(SELECT greatest(1, CAST(floor(pow(count(*), 1 / 3.0) + 0.5) AS BIGINT)) AS s FROM events)"


def ringed(spark: SparkSession, sf: str) -> DataFrame:
    """The places of the events' volume with a ring in each slice that moves with it, a bar inside of the ring, and a block beside it."""
    s = cube_side(spark, sf)
    y, x, r = F.col("row") - (s // 2 - F.col("n") % 2), F.col("col") - s // 2, s // 2 - 3
    far = y * y + x * x
    ring = (far <= r * r) & (far > (r - 1) * (r - 1))
    white = ring | ((y == 0) & (F.abs(x) <= 1)) | ((F.col("row") >= s - 1) & (F.col("col").between(1, 3)))
    return event_volume(spark, sf, s).select("n", "row", "col", F.when(white, 1.0).otherwise(0.0).alias("u"))


@query(f"SELECT CAST(n.range AS INT) AS n, CAST(s // 2 - n.range % 2 AS DOUBLE) AS yc, CAST(s // 2 AS DOUBLE) AS xc, CAST(s // 2 - 3 AS DOUBLE) AS r FROM {RING_SQL}, LATERAL (SELECT unnest(range(s)) AS range) n")
def ring_circles(spark, sf):
    """The circle of every slice: the ring encloses more than the block, whatever it weighs."""
    return geometry.circles(ringed(spark, sf)).select("n", *[r6(F.col(c)).alias(c) for c in ("yc", "xc", "r")])


@query(f"SELECT s // 2 - 0.5::DOUBLE AS yc, CAST(s // 2 AS DOUBLE) AS xc, s // 2 - 3.5::DOUBLE AS r FROM {RING_SQL}")
def ring_mask(spark, sf):
    """The circle inside all of the rings."""
    return spark.createDataFrame([tuple(round(x, 6) for x in geometry.volume_mask(ringed(spark, sf)))], "yc double, xc double, r double")


CIRCLES_SQL = f'{V_SQL}, q AS (SELECT n, sum(u * "row") / sum(u) AS y, sum(u * "col") / sum(u) AS x, sqrt(sum(u * ("row" * "row" + "col" * "col")) / sum(u)) AS r FROM e GROUP BY n)'


@query(
    f"WITH {CIRCLES_SQL}, two AS (SELECT a.y + t * (b.y - a.y) AS y, a.x + t * (b.x - a.x) AS x FROM (SELECT a, b, (d + a.r - b.r) / 2 / d AS t FROM (SELECT a, b, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d FROM q a, q b WHERE a.n < b.n) WHERE d > 0) WHERE t BETWEEN 0 AND 1), "
    "tri AS (SELECT a, b, c, 2 * (b.y - a.y) AS m11, 2 * (b.x - a.x) AS m12, 2 * (c.y - a.y) AS m21, 2 * (c.x - a.x) AS m22, b.y * b.y + b.x * b.x - b.r * b.r - a.y * a.y - a.x * a.x + a.r * a.r AS k1, c.y * c.y + c.x * c.x - c.r * c.r - a.y * a.y - a.x * a.x + a.r * a.r AS k2, 2 * (b.r - a.r) AS l1, 2 * (c.r - a.r) AS l2 FROM q a, q b, q c WHERE a.n < b.n AND b.n < c.n), "
    "lin AS (SELECT a, (k1 * m22 - m12 * k2) / det AS p1, (m11 * k2 - k1 * m21) / det AS p2, (l1 * m22 - m12 * l2) / det AS s1, (m11 * l2 - l1 * m21) / det AS s2 FROM (SELECT *, m11 * m22 - m12 * m21 AS det FROM tri) WHERE abs(det) > 1e-12), "
    "quad AS (SELECT p1, p2, s1, s2, s1 * s1 + s2 * s2 - 1 AS qa, 2 * ((p1 - a.y) * s1 + (p2 - a.x) * s2) + 2 * a.r AS qb, (p1 - a.y) * (p1 - a.y) + (p2 - a.x) * (p2 - a.x) - a.r * a.r AS qc FROM lin), "
    "root AS (SELECT p1, p2, s1, s2, unnest([(-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)]) AS f FROM quad WHERE abs(qa) > 1e-12 AND qb * qb - 4 * qa * qc >= 0), "
    "spot AS (SELECT y, x FROM q UNION ALL SELECT y, x FROM two UNION ALL SELECT p1 + s1 * f, p2 + s2 * f FROM root), "
    "room AS (SELECT spot.y, spot.x, min(q.r - sqrt((q.y - spot.y) * (q.y - spot.y) + (q.x - spot.x) * (q.x - spot.x))) AS r FROM spot, q GROUP BY spot.y, spot.x) "
    "SELECT round(max(r), 6) AS r FROM room"
)
def inscribed_circle(spark, sf):
    """The largest circle inside a circle of each slice: around its centre of mass, as wide as its radius of gyration about the corner."""
    u, row, col = F.col("u"), F.col("row"), F.col("col")
    q = event_volume(spark, sf).groupBy("n").agg((F.sum(u * row) / F.sum(u)).alias("y"), (F.sum(u * col) / F.sum(u)).alias("x"), F.sqrt(F.sum(u * (row * row + col * col)) / F.sum(u)).alias("r"))
    _, _, r = geometry.inscribed_circle([(c.y, c.x, c.r) for c in q.collect()])  # a row for each slice
    return spark.createDataFrame([(round(r, 6),)], "r double")


@query()
def volume_mask(spark, sf):
    """(yc, xc, r) of the circle inside all slices' circles."""
    return spark.createDataFrame([geometry.volume_mask(event_volume(spark, sf))], "yc double, xc double, r double")


# --- the programs ---
TRANSPOSE_SQL = (
    f'{V_SQL}, k AS (SELECT CAST(n - (s - s // 2) // 2 AS INT) AS n, "row", "col", u FROM e, cube WHERE n >= (s - s // 2) // 2 AND n < (s - s // 2) // 2 + s // 2 '
    'AND ("row" - (s - 1) / 2.0) * ("row" - (s - 1) / 2.0) + ("col" - (s - 1) / 2.0) * ("col" - (s - 1) / 2.0) < (s / 2.0 - 1) * (s / 2.0 - 1)), '
    f"{hist_sql('k', 1024)}, cum AS (SELECT *, (hi - lo) / 1024 AS bw, sum(density) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM h), "
    "cut AS (SELECT coalesce(max(CASE WHEN 0.0137123 / bw >= cum THEN bin END), 0) * any_value(bw) + any_value(lo) AS low, coalesce(min(CASE WHEN 0.9862877 / bw <= cum THEN bin END), 1024) * any_value(bw) + any_value(lo) AS high FROM cum)"
)


@query(f'WITH {TRANSPOSE_SQL} SELECT {VOXEL}, round(CASE WHEN u <= low THEN 0.0 WHEN u >= high THEN 1.0 ELSE (u - low) / (high - low) END, 6) AS u FROM k, cut')
def program_transpose(spark, sf):
    """Crop, mask, level range and normalisation of the events' volume, with a radius smaller than the circle's."""
    side = cube_side(spark, sf)
    volume = programs.transpose(event_volume(spark, sf, side), side // 2, side / 2 - 1, 0.0137123, circle=((side - 1) / 2, (side - 1) / 2, side / 2))
    return volume.voxels.select("n", "row", "col", r6(F.col("u")).alias("u"))


@query(f"WITH {UV_SQL} SELECT vbin, ubin, count FROM j")
def program_uv_hist(spark, sf):
    return programs.uv_hist(programs.Volume(unit(spark, sf), LO, HI))


TOTALVARMIN_SQL = (
    f"{denoise_sql(2)}, o AS (SELECT {VOXEL}, u - {LAM} * ({div_sql(['q1', 'q2', 'q3'])}) AS u FROM t2), ends AS (SELECT min(u) AS lo, max(u) AS hi, count(*) AS total FROM m), "
    f"x AS (SELECT 'before' AS stage, {VOXEL}, u FROM m UNION ALL SELECT 'after', {VOXEL}, u FROM o), "
    f"c AS (SELECT stage, {bin_sql(f'(u + 0.01 * ({noise_sql(0)} - 0.5))', 'lo', 'hi', 1024)} AS bin, count(*) AS count FROM x, ends WHERE lo - 0.005 <= u AND u + 0.005 <= hi GROUP BY 1, 2), "
    "h AS (SELECT s.stage, b.range AS bin, coalesce(c.count, 0) / (total * ((hi - lo) / 1024)) AS density, lo, hi FROM range(1024) b, (SELECT unnest(['before', 'after']) AS stage) s LEFT JOIN c ON c.bin = b.range AND c.stage = s.stage, ends)"
)


@query(f"WITH {TOTALVARMIN_SQL} SELECT stage, round((bin + 0.5) * (100.0 / 1024), 6) AS brightness, round(density * ((hi - lo) / 100.0), 6) AS ch0 FROM h WHERE bin BETWEEN 1 AND 1022")
def program_totalvarmin(spark, sf):
    """The histogram tables before and after two iterations: the same dithered bins, in levels from 0 to 100."""
    _, *tables = programs.totalvarmin(programs.Volume(masked(spark, sf), 0.0, 100.0), LAM, 2)
    before, after = (t.select(F.lit(stage).alias("stage"), r6(F.col("brightness")).alias("brightness"), r6(F.col("ch0")).alias("ch0")) for stage, t in zip(("before", "after"), tables, strict=True))
    return before.union(after)


GMM_PEAKS_SQL = (
    f"{U_SQL}, dn AS (SELECT {VOXEL}, avg(u) OVER (PARTITION BY \"row\", \"col\" ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS u FROM w), {hist_sql('dn', 500, '0.0', '1.0')}, {CUM_SQL.format(what='density')}, "
    "top AS (SELECT coalesce(min(CASE WHEN 0.997 * total <= cum THEN bin END), 500) / 500.0 AS top FROM k), x AS (SELECT u FROM dn, top WHERE u <= top)"
)


def gmm_peaks_sql() -> str:
    """One EM step from the nearest labels, then the raw statistics by cluster of the denoised values."""
    c = [(p - LO) / (HI - LO) for p in LABELS]
    pick = labels_sql("u", c)
    zero = ", ".join(f"{1 / 3!r} AS w{k}, {x!r} AS m{k}, (SELECT sqrt(q) FROM a WHERE k = {k}) AS s{k}" for k, x in enumerate(c))
    d = lambda: ", ".join(f"w{k} / ({(2 * 3.141592653589793) ** 0.5!r} * s{k}) * exp(-0.5 * (u - m{k}) * (u - m{k}) / (s{k} * s{k})) AS d{k}" for k in range(3))
    t = ", ".join(f"sum(d{k} / (d0 + d1 + d2)) AS a{k}, sum(d{k} / (d0 + d1 + d2) * u) AS b{k}, sum(d{k} / (d0 + d1 + d2) * u * u) AS c{k}" for k in range(3))
    new = ", ".join(f"a{k} / n AS w{k}, b{k} / a{k} AS m{k}, sqrt(abs(c{k} / a{k} - (b{k} / a{k}) * (b{k} / a{k}))) AS s{k}" for k in range(3))
    return (
        f"{GMM_PEAKS_SQL}, a AS (SELECT {pick} AS k, avg((u - {c}[{pick} + 1]) * (u - {c}[{pick} + 1])) AS q FROM x GROUP BY 1), p0 AS (SELECT {zero}), d0 AS (SELECT u, {d()} FROM x, p0), "
        f"t0 AS (SELECT count(*) AS n, {t} FROM d0), p1 AS (SELECT {new} FROM t0), y AS (SELECT {VOXEL}, {d()} FROM dn, p1), z AS (SELECT {VOXEL}, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS cluster FROM y) "
        f'SELECT cluster, count(*) AS count, round(avg({LO} + {HI - LO} * u), 6) AS mean, round(coalesce(var_samp({LO} + {HI - LO} * u), 0.0), 6) AS variance, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM w JOIN z USING (n, "row", "col") GROUP BY cluster'
    )


@query(f"WITH {gmm_peaks_sql()}")
def program_gmm_peaks(spark, sf):
    """Tail, filter, one EM step, and the raw statistics by cluster; denoised by a mean of three."""
    raw = unit(spark, sf)
    quiet = phases.denoised_by_mean(raw).withColumnRenamed("d", "u")
    _, found = programs.gmm_peaks(programs.Volume(quiet, LO, HI), programs.Volume(raw, LO, HI), LABELS, attempts=1, iterations=1)
    return found.select("cluster", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "variance", "fraction")])


@query()
def program_bimm_peaks(spark, sf):
    """The fit of the volume within the window that its own tails give, with 10 batches of 20 iterations and then 60 passes."""
    found = programs.bimm_peaks(programs.Volume(unit(spark, sf), LO, HI), LABELS, batches=10, first=(20, 1e-5), last=(60, 1e-4))
    return _bimm_rows(spark, found.theta, found.nll)


@query(f"WITH {M_SQL} SELECT {VOXEL}, {labels_sql('u')} AS label FROM m")
def program_potts_model(spark, sf):
    """With a data term so strong that the nearest label stays."""
    found = programs.potts_model(programs.Volume(masked(spark, sf)), LABELS, 1e9, 2)
    return found.select("n", "row", "col", "label")


@query(f'WITH {M_SQL} SELECT {VOXEL}, round(u, 5) AS u FROM m')
def archive_round_trip(spark, sf):
    """The masked volume written as archives of four columns each and decoded again."""
    side = square_side(spark, sf)
    slabs = archive_slabs(masked(spark, sf), IMAGES, side, side, 4)

    def decode(batches):
        for b in batches:
            for content in b.content:
                yield Field.decode(bytes(content)).voxels()

    return slabs.select("content").mapInPandas(decode, "n int, row int, col int, u double").select("n", "row", "col", F.round("u", 5).alias("u"))


@query(f'WITH {M_SQL} SELECT {VOXEL}, round(u, 5) AS u FROM m')
def archive_whole(spark, sf):
    """The masked volume written as one archive by many tasks and read back by many."""
    side, path = square_side(spark, sf), f"{shared_file(spark, 'volume')}.field"
    write_archive(masked(spark, sf), path, IMAGES, side, side, lo=LO, hi=HI)
    return read_archive(spark, path)[0].select("n", "row", "col", F.round("u", 5).alias("u"))
