"""The six programs as Spark jobs: functions over voxel tables with the programs' options, and a command line that reads and writes files.

    python -m voxelgrove.jobs.programs transpose scan/*.tif --output volume.parquet --tails 0.001

A volume on disk is a Parquet table (n, row, col, u), sorted by column and row, with u from 0 to 1 and the columns lo and hi: the levels that 0 and 1 stand for.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.voxel import check_labels, denormalise, normalise
from ..operators import bimm, denoise, export, geometry, gmm, mask, phases, potts, stencil
from ..operators import histogram as hist
from ..sources import text, tiff

AXES = ["n", "row", "col"]


@dataclass
class Volume:
    voxels: DataFrame
    lo: float = 0.0
    hi: float = 1.0


def read_volume(spark: SparkSession, path: str) -> Volume:
    table = spark.read.parquet(path)
    ends = table.select("lo", "hi").first()
    return Volume(table.select(*AXES, "u"), *(ends or (0.0, 1.0)))


def write_volume(volume: Volume, path: str) -> None:
    """Ranges of columns, sorted, so that a slice or a mask reads only its row groups."""
    table = volume.voxels.select(*AXES, F.col("u").cast("float").alias("u"), F.lit(float(volume.lo)).alias("lo"), F.lit(float(volume.hi)).alias("hi"))
    table.repartitionByRange("col", "row").sortWithinPartitions("col", "row", "n").write.mode("overwrite").parquet(path)


def transpose(pages: DataFrame, height: int | None = None, radius: float | None = None, tails: float = 0.0, whole_numbers: bool = False, circle: tuple[float, float, float] | None = None) -> Volume:
    """The stack of pages as a volume: the images in the middle, inside the circle that all their circles hold (or ``circle``), from 0 to 1 between the levels that leave ``tails`` out.

    ``whole_numbers``: levels are 16-bit counts, whose histogram is exact; else it has 1,024 bins. ``pages`` is read by several jobs: write what is dear, as ``read_scan`` does. Raises ValueError if
    the circles have no point in common.
    """
    kept = pages.select(*AXES, "u")
    if height:
        kept = mask.crop_images(kept, pages.agg(F.max("n") + 1).first()[0] or 0, height)
    yc, xc, r = circle or geometry.volume_mask(kept)
    if r <= 0:
        raise ValueError("the pages' circles have no point in common")
    inside = mask.in_cylinder(kept, yc, xc, mask.reduced_radius(r, radius))
    if tails <= 0:
        lo, hi = hist.value_range(inside).first()
    elif whole_numbers:
        lo, hi = hist.tail_bins(hist.exact_histogram(inside, "u"), tails, 1 << 16).first()
    else:
        lo, hi = hist.tail_values(hist.histogram(inside, 1024), tails, 1024).first()
    if lo is None or hi is None or not lo < hi:
        raise ValueError(f"no range of levels between {lo} and {hi}")
    return Volume(inside.withColumn("u", normalise(F.col("u").cast("double"), float(lo), float(hi))), float(lo), float(hi))


def read_scan(spark: SparkSession, paths: str | list[str], height: int | None = None) -> tuple[DataFrame, bool]:
    """The pages of a scan, those in the middle if ``height`` says so, decoded once and written; and whether their levels are whole numbers."""
    scan = tiff.Scan.open(spark, paths)
    first, count = ((scan.images - height) // 2, height) if height and 0 < height < scan.images else (0, scan.images)
    return hist.once(scan.voxels(first, count), "pages"), scan.kind == "u2"


def uv_hist(volume: Volume, bins: int = 512) -> DataFrame:
    """(vbin, ubin, count) of intensity and gradient magnitude."""
    return hist.joint_histogram(hist.once(stencil.gradient_magnitude(volume.voxels), "gradient"), bins)


def totalvarmin(volume: Volume, lam: float = denoise.LAMBDA, iterations: int = denoise.ITERATIONS, bins: int = 1024) -> tuple[Volume, DataFrame, DataFrame]:
    """The denoised volume, and the histogram tables (brightness, ch0) before and after, in the volume's own levels. Both have the bins of the first one's range, and the same dithering."""
    jitter = hist.jitter_for(1 / (volume.hi - volume.lo), bins)
    before = hist.once(hist.histogram(volume.voxels, bins, jitter=jitter), "before")
    ends = before.first()
    quiet = hist.once(denoise.denoise(volume.voxels, iterations, lam), "denoised")
    out = Volume(quiet.select(*AXES, F.col("d").alias("u")), volume.lo, volume.hi)
    after = hist.histogram(out.voxels, bins, ends.lo, ends.hi, jitter=jitter)
    return out, *(hist.histogram_table(h, bins, volume.lo, volume.hi) for h in (before, after))


def gmm_peaks(denoised: Volume, noised: Volume, peaks: list[float], tailthr: float = 0.003, report: list | None = None, most: int = gmm.SAMPLE, **limits) -> tuple[gmm.Mixture, DataFrame]:
    """A mixture of the denoised voxels up to the tail's threshold, its means in levels; and (cluster, count, mean, variance, fraction) of the raw voxels, each in the cluster of its denoised value.

    ``limits``: attempts, iterations, tolerance and seed of the fit. ``report``: gets (attempt, steps, nll) of each. Raises ValueError if the volumes differ in size.
    """
    mask.require_equal_size(denoised.voxels, noised.voxels)
    top = hist.upper_tail(hist.histogram(denoised.voxels, 500, 0.0, 1.0), tailthr, 500).first().hi
    kept = mask.below(denoised.voxels, top)
    span = denoised.hi - denoised.lo
    sample = gmm.drawn(kept, most=most)
    attempts = gmm.fit_attempts(sample, [(p - denoised.lo) / span for p in check_labels(peaks)], **limits)
    sample.drop()
    if report is not None:
        report += [(k, steps, m.nll) for k, (m, steps) in enumerate(attempts)]
    found = min((m for m, _ in attempts), key=lambda m: m.nll)
    raw = noised.voxels.withColumn("u", denormalise(F.col("u"), noised.lo, noised.hi))
    statistics = phases.statistics_by_cluster(raw, gmm.assign(denoised.voxels, found).select(*AXES, "cluster"))
    return gmm.Mixture(found.weights, [denoised.lo + span * m for m in found.means], [span * s for s in found.sigmas], found.nll), statistics


@dataclass
class BimmFit:
    theta: bimm.Theta  # peaks from 0 to 1
    peaks: list[float]  # in levels
    fractions: list[float]
    nll: float
    window: tuple[float, float, float]


def bimm_window(volume: Volume, uv: DataFrame, lotailthr: float = 0.01, hitailthr: float = 0.01, vtailthr: float = 0.01, bins: int = 1024) -> tuple[float, float, float]:
    """Where the fit looks: u between its tails, v up to its own."""
    jitter = hist.jitter_for(1 / (volume.hi - volume.lo), bins)
    u = hist.quantiles(hist.histogram(uv, bins, jitter=jitter), {"lo": lotailthr, "hi": 1 - hitailthr}, bins).first()
    top = uv.agg(F.max("v")).first()[0] or 0.0
    v = hist.quantiles(hist.histogram(uv, bins, 0.0, top, value="v"), {"hi": 1 - vtailthr}, bins).first()
    return float(u.lo), float(u.hi), float(v.hi)


def bimm_peaks(volume: Volume, peaks: list[float], tailthr: float | None = None, lotailthr: float = 0.01, hitailthr: float = 0.01, vtailthr: float = 0.01, maxds: float = 1.5, **limits) -> BimmFit:
    """The blurred-interface mixture of a volume. ``tailthr`` stands for both tails of u; ``limits``: most, batches, first, last, count and at_once of the fit."""
    if tailthr is not None:
        lotailthr = hitailthr = tailthr
    uv = hist.once(stencil.gradient_magnitude(volume.voxels), "gradient")
    window = bimm_window(volume, uv, lotailthr, hitailthr, vtailthr)
    k, span = len(check_labels(peaks)), volume.hi - volume.lo
    begin = bimm.first_guess([(p - volume.lo) / span for p in peaks], maxds)
    theta, nll = bimm.fit(bimm.eligible(uv, *window), begin, window, max_ds=maxds, **limits)
    return BimmFit(theta, [volume.lo + span * p for p in theta.peaks], phases.mixture_fractions(theta.weights, k), nll, window)


def bimm_report(spark: SparkSession, volume: Volume, found: BimmFit) -> DataFrame:
    """(name, value): peaks and noise in levels, weights of phases and interfaces, the interfaces' widths, the window in levels, and the likelihood."""
    t, span = found.theta, volume.hi - volume.lo
    rows = [("sigma_b", t.sigma_b), ("sigma_n", t.sigma_n * span), ("ds", t.ds), ("rho", t.rho), ("nll", found.nll)]
    rows += [(f"peak[{k}]", p) for k, p in enumerate(found.peaks)] + [(f"fraction[{k}]", x) for k, x in enumerate(found.fractions)]
    rows += [(f"w[{k}]", w) for k, w in enumerate(t.weights[: len(t.peaks)])] + [(f"w[{i}, {j}]", w) for (i, j), w in zip(t.pairs, t.weights[len(t.peaks) :], strict=True)]
    lo, hi, top = found.window
    rows += [("lo_tail", volume.lo + span * lo), ("hi_tail", volume.lo + span * hi), ("v_tail", span * top)]
    return spark.createDataFrame([(n, float(x)) for n, x in rows], "name string, value double")


def bimm_pdfs(spark: SparkSession, volume: Volume, found: BimmFit, steps: int = 512) -> DataFrame:
    """(component, u, pdf) between the window's ends, in levels: the density is that of a level."""
    span = volume.hi - volume.lo
    table = bimm.component_tables(spark, found.theta, found.window[0], found.window[1], steps)
    return table.select("component", (F.col("u") * F.lit(span) + F.lit(volume.lo)).alias("u"), (F.col("pdf") / F.lit(span)).alias("pdf"))


def potts_model(volume: Volume, labels: list[float], lam: float, iterations: int = potts.ITERATIONS) -> DataFrame:
    """(n, row, col, u, label, c) with c from 0 to 1; ``labels`` in the volume's levels."""
    return potts.segment(volume.voxels, [(c - volume.lo) / (volume.hi - volume.lo) for c in check_labels(labels)], lam, iterations)


def _labels(text: str) -> list[float]:
    """{a,b,c} or a,b,c."""
    return check_labels([float(x) for x in text.strip().removeprefix("{").removesuffix("}").split(",")])


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="programs", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    add = {name: commands.add_parser(name) for name in ("transpose", "uv-hist", "totalvarmin", "gmm-peaks", "bimm-peaks", "potts-model")}
    for name, p in add.items():
        if name != "gmm-peaks":
            p.add_argument("input", nargs="+" if name == "transpose" else None)
        p.add_argument("--output", "-o", help="a folder; shown if none is given")
    add["transpose"].add_argument("--height", type=int)
    add["transpose"].add_argument("--radius", type=float)
    add["transpose"].add_argument("--tails", type=float, default=0.0)
    for name, col in (("totalvarmin", 481), ("potts-model", 400)):
        add[name].add_argument("--slice", type=int, default=col, help="the column whose picture is written beside the output")
    add["potts-model"].add_argument("--rawout", help="a VTK file of the labels' intensities")
    add["totalvarmin"].add_argument("--lambda", dest="lam", type=float, default=denoise.LAMBDA)
    for option, kind, default in (("--denoised", str, None), ("--noised", str, None), ("--peaks", _labels, None), ("--tailthr", float, 0.003)):
        add["gmm-peaks"].add_argument(option, type=kind, default=default, required=default is None)
    add["bimm-peaks"].add_argument("--peaks", type=_labels, required=True)
    for option, default in (("--tailthr", None), ("--lotailthr", 0.01), ("--hitailthr", 0.01), ("--vtailthr", 0.01), ("--maxds", 1.5)):
        add["bimm-peaks"].add_argument(option, type=float, default=default)
    add["bimm-peaks"].add_argument("--pdf-name")
    add["potts-model"].add_argument("--labels", type=_labels, required=True)
    add["potts-model"].add_argument("--lambda", dest="lam", type=float, required=True)
    o = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()

    def put(table: DataFrame, path: str | None, write=None) -> None:
        (write or (lambda t, p: t.write.mode("overwrite").parquet(p)))(table, path) if path else table.show(40, truncate=False)

    if o.command == "transpose":
        pages, whole = read_scan(spark, o.input, o.height)
        volume = transpose(pages, None, o.radius, o.tails, whole)
        write_volume(volume, o.output) if o.output else volume.voxels.show()
    elif o.command == "gmm-peaks":
        report: list = []
        found, statistics = gmm_peaks(read_volume(spark, o.denoised), read_volume(spark, o.noised), o.peaks, o.tailthr, report)
        put(spark.createDataFrame(report, "attempt int, steps int, nll double"), o.output and f"{o.output}-attempts")
        spark.createDataFrame(list(zip(found.weights, found.means, found.sigmas, strict=True)), "weight double, mean double, sigma double").show(truncate=False)
        put(statistics, o.output)
    else:
        volume = read_volume(spark, o.input)
        if o.command == "uv-hist":
            put(uv_hist(volume), o.output)
        elif o.command == "totalvarmin":
            quiet, before, after = totalvarmin(volume, o.lam)
            for name, table in (("before", before), ("after", after)):
                put(table.orderBy("brightness").coalesce(1), o.output and f"{o.output}-{name}", text.write_table)
            for name, v in (("before", volume), ("after", quiet)):
                put(export.slice_picture(v.voxels, o.slice), o.output and f"{o.output}-slice-{name}")
            write_volume(quiet, o.output) if o.output else quiet.voxels.show()
        elif o.command == "bimm-peaks":
            found = bimm_peaks(volume, o.peaks, o.tailthr, o.lotailthr, o.hitailthr, o.vtailthr, o.maxds)
            put(bimm_report(spark, volume, found), o.output)
            if o.pdf_name:
                tables = hist.once(bimm_pdfs(spark, volume, found), "pdfs")
                # A table of 513 rows for each component.
                for (component,) in tables.select("component").distinct().collect():
                    text.write_table(tables.where(F.col("component") == component).select("u", "pdf").orderBy("u").coalesce(1), f"{o.pdf_name}-{component}.txt")
        else:
            found = hist.once(potts_model(volume, o.labels, o.lam), "labels")
            put(found, o.output)
            put(export.slice_picture(found, o.slice, "c"), o.output and f"{o.output}-slice")
            if o.rawout:
                images = found.agg(F.max("n")).first()[0] + 1
                print("images {}, rows {}, columns {}".format(*export.write_vtk(found, o.rawout, images, "c")))


if __name__ == "__main__":
    main()
