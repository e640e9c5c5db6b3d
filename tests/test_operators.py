import random
from math import erf, exp, pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrove.functions import voxel
from voxelgrove.functions.voxel import check_labels, nearest_label, project_simplex
from voxelgrove.operators import bimm, denoise, geometry, gmm, mask, phases, potts, stencil
from voxelgrove.operators import histogram as hist
from voxelgrove.operators.blocks import Dense, check_block
from voxelgrove.streaming.histograms import running_histogram


def volume(spark, x):
    n, row, col = np.indices(x.shape)
    rows = list(zip(n.ravel().tolist(), row.ravel().tolist(), col.ravel().tolist(), x.astype(float).ravel().tolist(), strict=True))
    return spark.createDataFrame(rows, "n int, row int, col int, u double").repartition(4)


def test_mask_is_strict_and_symmetric(spark):
    v = volume(spark, np.zeros((1, 9, 9)))
    got = {(r.row, r.col) for r in mask.in_cylinder(v, 4, 4, 3).collect()}
    assert (1, 4) not in got and (2, 4) in got
    assert {(8 - r, 8 - c) for r, c in got} == got == {(c, r) for r, c in got}
    assert mask.reduced_radius(5, 3) == 3 and mask.reduced_radius(5, 7) == 5 and mask.reduced_radius(5, 1) == 5
    with pytest.raises(ValueError):
        mask.require_equal_size(v, v.limit(3))


def test_constant_volume(spark):
    v = volume(spark, np.full((4, 4, 4), 0.3))
    g = stencil.gradient_magnitude(v)
    assert {r.v for r in g.select("v").distinct().collect()} == {0.0, -1.0}
    assert g.where("v = 0").count() == 8
    assert hist.joint_histogram(g, 8).count() == 0
    assert sum(r["count"] for r in hist.histogram(v, 5).collect()) in (0, 64)
    assert {round(r.d, 12) for r in denoise.denoise(v, 3, block=(8, 8, 8)).collect()} == {0.3}


def test_values_on_the_edges_of_bins(spark):
    v = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, -0.1)], "u double")
    h = {r.bin: (r["count"], r.density) for r in hist.histogram(v, 4, 0.0, 1.0).collect()}
    assert {k: c for k, (c, _) in h.items()} == {0: 1, 1: 1, 2: 1, 3: 2}
    assert np.isclose(h[3][1], 2 / (7 * 0.25))
    assert hist.jitter_for(0.01, 500) == 0.01 and hist.jitter_for(0.5, 500) == 0.0


def test_tails(spark):
    v = spark.createDataFrame([(k,) for k in (5, 5, 6, 9)], "v int")
    h = hist.exact_histogram(v, levels=16)
    assert tuple(hist.tail_bins(h, 0.0, 16).first()) == (4, 9)
    assert tuple(hist.tail_bins(h, 0.5, 16).first()) == (5, 5)
    q = hist.quantiles(hist.histogram(v.select(F.col("v").cast("double").alias("u")), 4), {"a": 0.0, "b": 0.5, "c": 1.0}, 4).first()
    assert (q.a, q.b, q.c) == (5.0, 6.0, 9.0)


def test_labels(spark):
    v = spark.createDataFrame([(0.5,), (0.0,), (1.0,)], "u double")
    assert [r[0] for r in v.select(nearest_label(F.col("u"), [0.0, 1.0])).collect()] == [0, 0, 1]
    for bad in ([1.0], [0.0] * 7):
        with pytest.raises(ValueError):
            check_labels(bad)
    rng = np.random.default_rng(0)
    q = rng.normal(size=(50, 4))
    got = spark.createDataFrame([(x.tolist(),) for x in q], "q array<double>").select(project_simplex(F.col("q"), 4)).collect()
    want = potts.project_simplex(q.T).T
    assert np.allclose([r[0] for r in got], want) and np.allclose(want.sum(axis=1), 1) and (want >= 0).all()


def test_single_voxel_has_no_variance(spark):
    v = volume(spark, np.array([[[0.0, 0.0, 1.0]]]))
    by = {r.label: r for r in phases.statistics_by_label(v, v.withColumnRenamed("u", "d"), [0.0, 1.0]).collect()}
    assert by[1].variance == 0.0 and by[1]["count"] == 1 and np.isclose(by[0].fraction, 2 / 3)


def test_blocks_give_what_the_whole_volume_does(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(13, 11, 9))
    whole = denoise.iterate(Dense(np.ones(x.shape, bool), {"u": x, "q1": 0 * x, "q2": 0 * x, "q3": 0 * x}), 6, 0.2, denoise.TAU)
    d = Dense(np.ones(x.shape, bool), {})
    want = x - 0.2 * sum(d.backward_part(whole[q], k) for k, q in enumerate(("q1", "q2", "q3")))
    got = np.zeros(x.shape)
    for r in denoise.denoise(volume(spark, x), 6, 0.2, block=(4, 5, 6), per_round=3).collect():
        got[r.n, r.row, r.col] = r.d
    assert np.allclose(got, want, atol=1e-12)
    with pytest.raises(ValueError):
        check_block((2, 8, 8), 4)


@pytest.mark.parametrize("labels", [[0.0, 1.0], [0.0, 0.3, 1.0], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]])
def test_segmentation(spark, labels):
    rng = np.random.default_rng(5)
    x = np.zeros((10, 8, 8)) + rng.normal(0, 0.02, (10, 8, 8))
    x[5:] += 1
    rows = potts.segment(volume(spark, x), labels, 500.0, 8, block=(8, 8, 8), per_round=4).collect()
    near = {(r.n, r.row, r.col): int(np.argmin(np.abs(np.array(labels) - r.u))) for r in rows}
    assert all(near[r.n, r.row, r.col] == r.label for r in rows)  # a heavy data term leaves the nearest label
    k = len(labels)
    whole = {"u": x}
    first = np.abs(x[..., None] - labels).argmin(axis=-1)
    for i in range(k - 1):
        whole |= {f"v{i}": (first == i) * 1.0, f"b{i}": (first == i) * 1.0} | {f"x{i}_{a}": 0 * x for a in range(3)}
    done = potts.iterate(Dense(np.ones(x.shape, bool), whole), labels, 8, 5.0, potts.TAU)
    shares = np.stack([done[f"v{i}"] for i in range(k - 1)])
    want = np.concatenate([shares, 1 - shares.sum(axis=0, keepdims=True)]).argmax(axis=0)
    got = np.zeros(x.shape, int)
    for r in potts.segment(volume(spark, x), labels, 5.0, 8, block=(8, 8, 8), per_round=4).collect():
        got[r.n, r.row, r.col] = r.label
    assert (got == want).all()


def test_pairs_end_within_one():
    q = np.random.default_rng(6).normal(0, 2, (4, 3, 200))
    p = potts.project_pairs(q)
    far = max(np.sqrt(((p[i] - p[j]) ** 2).sum(axis=0)).max() for i in range(4) for j in range(i))
    assert far < 1.05 and np.allclose(p.sum(axis=0), q.sum(axis=0))


def test_mixture_fit_finds_the_clusters(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0.2, 0.02, 600), rng.normal(0.6, 0.05, 400)])
    v = spark.createDataFrame([(float(a),) for a in x], "u double")
    m = gmm.fit(v, [0.1, 0.8], attempts=1, iterations=25)
    assert np.allclose(m.means, [0.2, 0.6], atol=0.01) and np.allclose(m.sigmas, [0.02, 0.05], atol=0.005) and np.allclose(m.weights, [0.6, 0.4], atol=0.02)


THETA = bimm.Theta([0.4, 0.3, 0.3], [0.3, 0.6], 0.07, 0.9, 1.2, 0.3)


def test_masses_are_integrals_of_the_densities(spark):
    window = (0.1, 0.8, 0.35)
    u, v = np.meshgrid(np.linspace(*window[:2], 301), np.linspace(1e-6, window[2], 301), indexing="ij")
    grid = spark.createDataFrame(np.stack([u.ravel(), v.ravel()], axis=1).tolist(), "u double, v double")
    got = np.array(grid.select(bimm.pure_density(F.col("u"), F.col("v"), THETA, 0), bimm.interface_density(F.col("u"), F.col("v"), THETA, 0, 1, 40)).collect())
    area = (window[1] - window[0]) * window[2]
    weights = np.ones((301, 301))
    weights[[0, -1]] /= 2
    weights[:, [0, -1]] /= 2
    for k, mass in enumerate((bimm.pure_mass(THETA, 0, *window), bimm.interface_mass(THETA, 0, 1, *window))):
        assert np.isclose((got[:, k].reshape(301, 301) * weights).sum() * area / 300**2, mass, rtol=2e-3)


def test_components_sum_to_the_whole(spark):
    rows = bimm.component_tables(spark, THETA, 0.0, 1.0).collect()
    assert len(rows) == 4 * 513
    full, parts = {}, {}
    for r in rows:
        (full if r.component == "full" else parts).setdefault(r.u, []).append(r.pdf)
    assert all(np.isclose(sum(parts[u]), full[u][0]) for u in full)


def test_parameters_survive_the_round_trip():
    t = bimm.restrict(bimm.free(THETA), 2)
    assert np.allclose(t.weights, THETA.weights) and np.allclose(t.peaks, THETA.peaks)
    assert np.allclose([t.sigma_n, t.sigma_b, t.ds, t.rho], [THETA.sigma_n, THETA.sigma_b, THETA.ds, THETA.rho])
    assert np.isclose(sum(phases.mixture_fractions(THETA.weights, 2)), 1)
    assert bimm.project_gaps([0.5, 0.45, 0.9], 0.1) == pytest.approx([0.525, 0.425, 0.9])
    x, value = bimm.minimise(lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2, [0.0, 0.0], iterations=300, stop=1e-9)
    assert np.allclose(x, [1, -2], atol=1e-4) and value < 1e-7


def test_circles(spark):
    rng = np.random.default_rng(8)
    p = rng.normal(size=(300, 2))
    y, x, r = geometry.enclosing_circle(p)
    assert (np.hypot(p[:, 0] - y, p[:, 1] - x) <= r + 1e-6).all()
    assert r <= min(np.hypot(*(p - c).T).max() for c in [p.mean(axis=0), (y + 0.05, x), (y, x - 0.05)]) + 1e-9
    yy, xx = np.indices((60, 60))
    page = ((yy - 28) ** 2 + (xx - 33) ** 2 < 400) * 100.0 + 20
    page[3:5, 3:5] = 120
    y, x, r = geometry.slice_circle(page)
    assert abs(y - 28) < 0.6 and abs(x - 33) < 0.6 and abs(r - 19.5) < 1
    assert np.allclose(geometry.slice_circle(140 - page), (y, x, r), atol=1)
    y, x, r = geometry.inscribed_circle([(0, 0, 10), (4, 0, 10)])
    assert np.allclose((y, x, r), (2, 0, 8), atol=1e-5)
    stack = np.stack([((yy - 30) ** 2 + (xx - 30 - k) ** 2 < 300) * 1.0 for k in range(3)])
    y, x, r = geometry.volume_mask(volume(spark, stack))
    assert abs(y - 30) < 1 and abs(x - 31) < 1 and r < 17.5


def test_inscribed_circle_is_the_best_of_all_pairs_and_triples():
    rng = np.random.default_rng(11)
    room = lambda at, c: min(r - np.hypot(at[0] - y, at[1] - x) for y, x, r in c)
    for trial in range(300):
        n = int(rng.integers(1, 9))
        c = np.column_stack([rng.normal(50, 3, n), rng.normal(50, 3, n), rng.normal(20, 2, n)])
        c = np.round(c) if trial % 4 == 0 else c
        y, x, r = geometry.inscribed_circle(c.tolist())
        assert abs(r - max(room(p, c) for p in geometry._binding_centres(c))) < 1e-9 and abs(room((y, x), c) - r) < 1e-9
        # The room is concave: nothing near the best centre is better.
        assert all(room((y + dy, x + dx), c) <= r + 1e-9 for dy, dx in rng.normal(0, 10.0 ** rng.uniform(-6, 0), (20, 2)))


def enclosed(white):
    """Of each part of a picture, 8-connected: the area inside the polygon through its outermost points' centres. Holes are what the outside can't reach over edges."""
    h, w = white.shape
    wide = np.pad(white, 1)
    reach = np.zeros_like(wide)
    queue = [(0, 0)]
    reach[0, 0] = True
    while queue:
        r, c = queue.pop()
        for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < h + 2 and 0 <= x < w + 2 and not wide[y, x] and not reach[y, x]:
                reach[y, x] = True
                queue.append((y, x))
    full, seen, out = ~reach, np.zeros_like(wide), []
    for r, c in zip(*np.nonzero(full), strict=True):
        if seen[r, c]:
            continue
        own, queue = np.zeros_like(wide), [(r, c)]
        own[r, c] = seen[r, c] = True
        while queue:
            a, b = queue.pop()
            for y in (a - 1, a, a + 1):
                for x in (b - 1, b, b + 1):
                    if 0 <= y < h + 2 and 0 <= x < w + 2 and full[y, x] and not seen[y, x]:
                        own[y, x] = seen[y, x] = True
                        queue.append((y, x))
        corners = own[:-1, :-1].astype(int) + own[1:, :-1] + own[:-1, 1:] + own[1:, 1:]
        out.append(((corners == 4).sum() + 0.5 * (corners == 3).sum(), own[1:-1, 1:-1]))
    return out


def test_the_part_that_encloses_most_wins():
    yy, xx = np.indices((140, 150))
    far = np.hypot(yy - 55, xx - 55)
    ring = (far <= 50) & (far > 49)
    square = (yy >= 108) & (yy < 138) & (xx >= 115) & (xx < 145)
    inner = (np.abs(yy - 55) <= 20) & (np.abs(xx - 55) <= 20)
    assert square.sum() > ring.sum() and inner.sum() > ring.sum()
    for page in (ring | square, ring | square | inner):
        y, x, r = geometry.enclosing_circle(geometry.largest_part(geometry.runs_of(page)))
        assert np.allclose((y, x, r), (55, 55, 50), atol=0.01)
    assert geometry.enclosed_areas(geometry.runs_of(ring))[0][0] == enclosed(ring)[0][0] > 7600
    broken = ring & ~((yy == 5) & (np.abs(xx - 55) < 3))
    y, x, r = geometry.enclosing_circle(geometry.largest_part(geometry.runs_of(broken | square)))
    assert np.allclose((y, x), (122.5, 129.5), atol=0.6)
    rng = np.random.default_rng(20)
    for k in range(120):
        page = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < (0.3, 0.5, 0.65, 0.9)[k % 4]
        want = sorted(((float(a), int(own.argmax())) for a, own in enclosed(page)))
        got = sorted((float(a), int(r) * page.shape[1] + int(c)) for a, (r, c), _ in geometry.enclosed_areas(geometry.runs_of(page)))
        assert got == want
        if want:
            area, own = max(enclosed(page), key=lambda x: (x[0], -x[1].argmax()))
            assert {tuple(p) for p in geometry.largest_part(geometry.runs_of(page)).astype(int)} <= set(zip(*map(list, np.nonzero(own)), strict=True))


def test_rings_and_specks_in_slices(spark):
    yy, xx = np.indices((60, 60))
    pages = []
    for k in range(3):
        far = np.hypot(yy - 28 - k, xx - 30)
        pages.append(((far <= 20) & (far > 18)) * 1.0 + ((yy > 50) & (xx > 45)) * 1.0 + ((yy == 28) & (np.abs(xx - 30) < 4)) * 1.0)
    for r in geometry.circles(volume(spark, np.stack(pages))).collect():
        assert np.allclose((r.yc, r.xc, r.r), (28 + r.n, 30, 20), atol=0.01)
    y, x, r = geometry.volume_mask(volume(spark, np.stack(pages)))
    assert np.allclose((y, x, r), (29, 30, 19), atol=0.01)


def test_dithering_follows_the_keys(spark):
    from voxelgrove.operators import histogram as hist

    rng = np.random.default_rng(21)
    v = volume(spark, np.round(rng.random((8, 9, 10)), 1))
    counts = lambda t, **more: [r["count"] for r in hist.histogram(t, 64, jitter=0.05, **more).orderBy("bin").collect()]
    one = counts(v.repartition(7))
    assert one == counts(v.coalesce(1)) == counts(v.repartition(3, "u")) and one != counts(v, seed=1)
    plain = [r["count"] for r in hist.histogram(v, 64).orderBy("bin").collect()]
    assert sum(c > 0 for c in one) > 2 * sum(c > 0 for c in plain)
    noise = np.array([r[0] for r in v.select(hist.noise(0)).collect()])
    assert 0 <= noise.min() < 0.01 and 0.99 < noise.max() < 1 and abs(noise.mean() - 0.5) < 0.05


def test_traces_of_the_solvers_are_those_of_the_whole_volume(spark):
    from voxelgrove.operators.blocks import Dense

    x = np.random.default_rng(22).random((11, 9, 10))
    inside = np.ones(x.shape, bool)
    whole = denoise.iterate(Dense(inside, {"u": x, "q1": np.zeros_like(x), "q2": np.zeros_like(x), "q3": np.zeros_like(x)}), 5, 0.2, 0.165)["trace"]
    _, trace = denoise.denoise_traced(volume(spark, x), 5, 0.2, block=(4, 5, 6), per_round=2)
    got = [r.maxdeltaq for r in trace.orderBy("iter").collect()]
    assert np.allclose(got, np.sqrt(whole)) and got[0] > got[-1] and len(got) == 5
    labels = [0.2, 0.5, 0.9]
    _, trace = potts.segment_traced(volume(spark, x), labels, 4.0, 3, block=(6, 6, 6), per_round=2)
    shares = {f"{p}{i}": (np.abs(x[..., None] - labels).argmin(-1) == i) * 1.0 for i in range(2) for p in "vb"}
    state = Dense(inside, {"u": x, **shares, **{f"x{i}_{a}": np.zeros_like(x) for i in range(2) for a in range(3)}})
    whole = potts.iterate(state, labels, 3, 4.0, potts.TAU)["trace"]
    assert np.allclose([r.maxdeltaq for r in trace.orderBy("iter").collect()], np.sqrt(whole))


def test_blocks_are_planned_by_memory_and_cost(spark):
    import tracemalloc

    from voxelgrove.operators import blocks
    from voxelgrove.operators.blocks import Dense, plan_blocks

    scan = ((0, 1425), (0, 1999), (0, 1999))
    potts_plan = lambda k, memory, tasks=2000: plan_blocks(scan, 100, 2, 0, 1 + 5 * (k - 1), potts.arrays(k), memory, tasks)
    two, six = potts_plan(2, 1 << 30), potts_plan(6, 1 << 30)
    assert two.block != six.block and max(two.bytes, six.bytes) <= 1 << 30 and np.prod(six.block) < np.prod(two.block)
    less = potts_plan(2, 64 << 20)
    assert less.bytes <= 64 << 20 and less.rounds * less.copies > two.rounds * two.copies
    assert two.rounds * two.per_round >= 100 and 1 < two.copies < 4
    small = plan_blocks(((3, 30), (0, 20), (0, 19)), 10, 1, 1, 4, denoise.ARRAYS, 1 << 30, 8)
    assert np.prod([-(-x // b) for x, b in zip((28, 21, 20), small.block, strict=True)]) >= 4
    with pytest.raises(ValueError, match="memory"):
        potts_plan(6, 1 << 16)
    # What a block really takes stays within what the plan says.
    for k in (2, 6):
        shape = (30, 30, 30)
        names = ["u", *[f"{p}{i}" for i in range(k - 1) for p in "vb"], *[f"x{i}_{a}" for i in range(k - 1) for a in range(3)]]
        state = Dense(np.ones(shape, bool), {c: np.random.default_rng(1).random(shape) / k for c in names})
        tracemalloc.start()
        potts.iterate(state, list(np.linspace(0.1, 0.9, k)), 2, 3.0, potts.TAU)
        peak = tracemalloc.get_traced_memory()[1] + 8 * 27_000 * len(names)
        tracemalloc.stop()
        assert peak <= 8 * 27_000 * potts.arrays(k)
    x = np.random.default_rng(24).random((9, 10, 11))
    planned = {(r.n, r.row, r.col): r.d for r in denoise.denoise(volume(spark, x), 6, 0.3).collect()}
    given = denoise.denoise(volume(spark, x), 6, 0.3, block=(16, 16, 16), per_round=6).collect()
    assert len(planned) == x.size and all(abs(planned[r.n, r.row, r.col] - r.d) < 1e-12 for r in given)
    assert blocks.bounding_box(volume(spark, x).limit(0)) is None and denoise.denoise(volume(spark, x).limit(0), 6, 0.3).count() == 0


def test_aligned_volumes_join_without_a_shuffle(spark, tmp_path):
    from voxelgrove.operators import phases
    from voxelgrove.sources.volumes import save_aligned

    x = np.random.default_rng(25).random((4, 6, 7))
    v = volume(spark, x)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a, b = (save_aligned(t, f"aligned_test_{k}", 4, str(tmp_path / k)) for k, t in (("a", v), ("b", phases.denoised_by_mean(v))))
    joined = phases.align(a, b)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = phases.align(v, phases.denoised_by_mean(v)).collect()
    assert sorted((r.n, r.row, r.col, r.u, r.d) for r in joined.collect()) == sorted((r.n, r.row, r.col, r.u, r.d) for r in want)


def test_vtk_file(spark, tmp_path):
    from voxelgrove.operators import export

    x = np.random.default_rng(23).random((5, 7, 8)) * 1.2 - 0.1
    v = volume(spark, x).where("(row - 3) * (row - 3) + (col - 3) * (col - 3) < 10 and col <> 2")
    assert export.write_vtk(v, str(tmp_path / "v.vti"), 5) == (5, 7, 7)
    content = (tmp_path / "v.vti").read_bytes()
    body = np.full((7, 7, 5), 255, np.uint8)
    for r in v.collect():
        body[r.col, r.row, r.n] = min(255, max(0, int(np.floor(255 * r.u + 0.5))))
    ends = " ".join(f"0 {k}" for k in (4, 6, 6))
    head = f'<?xml version="1.0"?>\n<VTKFile type="ImageData" byte_order="LittleEndian">\n  <ImageData WholeExtent="{ends}">\n    <Piece Extent="{ends}">\n      <PointData Scalars="labels">\n        <DataArray type="UInt8" Name="labels" format="appended" offset="0"/>\n      </PointData>\n    </Piece>\n  </ImageData>\n  <AppendedData encoding="raw">\n_'
    assert content == head.encode() + np.uint32(body.size).tobytes() + body.tobytes() + b"\n  </AppendedData>\n</VTKFile>\n"
    got = {(r.col, r.row): bytes(r.bytes) for r in export.read_vtk(spark, str(tmp_path / "v.vti")).collect()}
    assert got == {(c, r): body[c, r].tobytes() for c in range(7) for r in range(7)}


def test_slice_circles_equal_those_of_whole_pictures(spark):
    rng = np.random.default_rng(12)
    yy, xx = np.indices((40, 44))
    pages = np.stack([((yy - 18 - k % 3) ** 2 + (xx - 20) ** 2 < 150) * (1.0 if k % 2 else -1.0) + rng.normal(0, 0.3, yy.shape) for k in range(6)])
    for r in geometry.circles(volume(spark, pages)).collect():
        assert np.allclose((r.yc, r.xc, r.r), geometry.slice_circle(pages[r.n]))


def test_samples_are_the_same_however_the_volume_is_dealt_out(spark):
    from voxelgrove.operators.samples import draw, summed

    rng = np.random.default_rng(13)
    rows = [(0, 0, k, float(a)) for k, a in enumerate(rng.uniform(0, 1, 3000))] + [(0, 1, 0, None), (0, 1, 1, float("nan"))]
    table = spark.createDataFrame(rows, "n int, row int, col int, u double")
    one, two, every = (draw(t, ["u"], ["n", "row", "col"], most, 7) for t, most in ((table.repartition(5), 1000), (table.coalesce(1), 1000), (table, 5000)))
    assert (one.count, two.count, every.count) == (1000, 1000, 3000)
    parts = lambda s: sorted(map(tuple, s.table.collect()))
    assert parts(one) == parts(two) and {p for p, _ in parts(one)} == set(range(7)) and {u for _, u in parts(one)} < {u for _, u in parts(every)}
    both = [summed(s, 2, lambda c: np.array([[c[0].sum(), len(c[0])], [(c[0] ** 2).sum(), 0.0]])) for s in (one, two)]
    assert (both[0] == both[1]).all() and both[0][0, 1] == 1000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    assert np.allclose(summed(one, 1, lambda c: np.array([[c[0].sum()]])), both[0][0, 0], rtol=1e-13)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one.drop()


def test_one_pass_evaluates_every_attempt(spark):
    from voxelgrove.operators.samples import in_step

    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0.2, 0.08, 300), rng.normal(0.7, 0.1, 200)])
    v = spark.createDataFrame([(k, float(a)) for k, a in enumerate(x)], "n int, u double")
    sample = gmm.drawn(v, key=("n",))
    mixtures = [gmm.Mixture([0.5, 0.5], [0.1, 0.7], [0.1, 0.2]), gmm.Mixture([0.9, 0.1], [0.3, 5.0], [0.2, 0.01])]
    for got, m in zip(gmm.passed(sample, mixtures), mixtures, strict=True):
        want = gmm.sums(x, m)
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(got, want, strict=True))
    assert len(gmm.fit_attempts(sample, [0.1, 0.7], attempts=4, iterations=5)) == 4
    cells = gmm.cells_of(sample)
    assert cells[0].sum() == 500 and np.allclose(cells[1:].sum(axis=1), [x.sum(), (x * x).sum()])
    for got, want in zip(gmm.sums_of_cells(cells, mixtures[0]), gmm.sums(x, mixtures[0]), strict=True):
        assert np.allclose(got, want, rtol=1e-9)
    found = gmm.fit_attempts(sample, [0.1, 0.7], attempts=3, iterations=400)
    plain, _ = in_step([gmm.climb(gmm.begin(sample, [0.1, 0.7])[0], 500, 1.0, 6000, 0.0)], lambda wanted: [gmm.sums(x, m) for m in wanted])[0]
    assert min(m.nll for m, _ in found) <= plain.nll + 0.05


def test_leaps_end_where_plain_steps_end():
    from voxelgrove.operators.samples import in_step

    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(0.3, 0.09, 4000), rng.normal(0.55, 0.08, 3000)])
    calls = [0]

    def evaluate(wanted):
        calls[0] += 1
        return [gmm.sums(x, m) for m in wanted]

    m = gmm.Mixture([0.5, 0.5], [0.2, 0.7], [0.1, 0.1])
    (fast, steps), _ = in_step([gmm.climb(m, len(x), 0.5, 4000, 1e-12), gmm.climb(m, len(x), 0.5, 30, 1e-12)], evaluate)
    quick, slow = calls[0], m
    for _ in range(6000):
        slow = gmm.next_mixture(slow, len(x), *gmm.sums(x, slow)[:3], 0.5)
    assert steps == quick < 300 and np.allclose(fast.means, slow.means, atol=1e-4) and np.allclose(fast.weights, slow.weights, atol=1e-3)


def test_interface_fit_by_batches_and_passes(spark):
    rng = np.random.default_rng(13)
    rows = [(0, 0, k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(0.2, 0.7, 400), rng.uniform(0.01, 0.3, 400), strict=True))]
    table = spark.createDataFrame(rows, "n int, row int, col int, u double, v double")
    window = (0.1, 0.8, 0.35)
    whole = np.array([(a, b) for *_, a, b in rows]).T
    want = bimm.mean_cost(*whole, THETA, window, 24)
    assert np.isclose(want, bimm.negative_log_likelihood(table, THETA, window, 24).first().nll, rtol=1e-6)
    from voxelgrove.operators.samples import draw

    other = bimm.restrict([x + 0.1 for x in bimm.free(THETA)], 2)
    assert np.allclose(bimm.passed(draw(table, ["u", "v"], ["col"], 1000, 3), [THETA, other], window), [want, bimm.mean_cost(*whole, other, window, 24)], rtol=1e-12)
    flat = bimm.Theta(THETA.weights, [0.4, 0.4], *[THETA.sigma_n, THETA.sigma_b, THETA.ds, THETA.rho])
    assert np.isclose(bimm.mean_cost(*whole, flat, window, 24), bimm.negative_log_likelihood(table, flat, window, 24).first().nll, rtol=1e-6)
    t, nll = bimm.fit(table, THETA, window, batches=2, first=(10, 1e-5), last=(15, 1e-4))
    assert nll <= want + 0.05 and len(t.peaks) == 2
    assert bimm.fit(table.limit(0), THETA, window, batches=2)[0] is THETA


def test_costs_from_sums_over_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    u, v = rng.beta(2, 2, 3000), rng.gamma(2, 0.1, 3000) + 1e-4
    rows, direct, plain = bimm.Rows(u, v), [], bimm.costs
    monkeypatch.setattr(bimm, "costs", lambda u, v, t, count: direct.append(len(u)) or plain(u, v, t, count))
    three = bimm.Theta([0.3, 0.2, 0.3, 0.08, 0.05, 0.07], [0.3, 0.5, 0.7], 0.12, 0.9, 1.2, 0.3)
    assert np.isclose(rows.costs(three, 24), plain(u, v, three, 24), rtol=0, atol=1e-6) and not direct
    for k in range(40):
        t = bimm.restrict((np.array(bimm.free(three)) + rng.normal(0, (0.3, 1.0, 3.0)[k % 3], 12)).tolist(), 3)
        assert np.isclose(rows.costs(t, 24), plain(u, v, t, 24), rtol=1e-12, atol=1e-6)
    # Both ways were taken, also for one set of parameters; narrow peaks, equal ones, two and one phases, v next to 0, one place, no row.
    assert 0 < min(direct) < 3000 == max(direct)
    for t in (bimm.Theta(three.weights, three.peaks, 1e-3, 0.9, 1.2, 0.9), bimm.Theta(three.weights, [0.5] * 3, 0.12, 0.9, 1.2, 0.3), THETA, bimm.Theta([1.0], [0.4], 0.2, 1.0, 1.0, 0.1)):
        assert np.isclose(rows.costs(t, 24), plain(u, v, t, 24), rtol=1e-12, atol=1e-6)
    for x, y in ((u, v - 1e-4 + 1e-12 * (v < 2e-2)), (u, np.where(v < 0.1, 1e-200, v)), (u * 0 + 0.5, v * 0 + 0.1), (u[:7], v[:7]), (u[:0], v[:0])):
        assert np.isclose(bimm.Rows(x, y).costs(three, 24), plain(x, y, three, 24), rtol=1e-12, atol=1e-6)


def test_simplex_with_several_corners_at_once():
    from voxelgrove.operators.samples import in_step

    f = lambda p: float(sum((k + 1) * (x - k) ** 2 for k, x in enumerate(p)) + 0.1 * abs(p[0]))
    passes = []
    for at_once in (1, 3):
        asked = []
        x, value = in_step([bimm.search([2.0] * 6, 0.7, 3000, 1e-7, at_once=at_once)], lambda w, asked=asked: asked.append(1) or [np.array([f(p) for p in points]) for points in w])[0]
        assert np.allclose(x, [0, 1, 2, 3, 4, 5], atol=1e-3) and value < 1e-2
        passes.append(len(asked))
    assert passes[1] < passes[0]


def test_programs_from_files_to_files(spark, tmp_path):
    from voxelgrove.jobs import programs
    from voxelgrove.operators import export
    from voxelgrove.sources import tiff
    from voxelgrove.sources.text import read_table

    rng = np.random.default_rng(14)
    yy, xx = np.indices((24, 24))
    disc = (yy - 12) ** 2 + (xx - 12) ** 2 < 100
    stack = (disc * rng.choice([400, 700], (6, 24, 24)) + rng.integers(0, 40, (6, 24, 24))).astype(np.uint16)
    for k in range(2):
        (tmp_path / f"scan-{k}.tif").write_bytes(tiff.encode(stack[3 * k : 3 * k + 3]))
    to = lambda name: str(tmp_path / name)
    programs.main(["transpose", to("scan-0.tif"), to("scan-1.tif"), "-o", to("volume"), "--height", "4", "--tails", "0.01"])
    v = programs.read_volume(spark, to("volume"))
    rows = v.voxels.collect()
    assert {r.n for r in rows} == set(range(4)) and 0 < v.lo < v.hi < 800
    assert all(abs(r.u - min(1, max(0, (int(stack[r.n + 1, r.row, r.col]) - v.lo) / (v.hi - v.lo)))) < 1e-6 for r in rows)
    programs.main(["uv-hist", to("volume"), "-o", to("uv")])
    assert spark.read.parquet(to("uv")).agg(F.sum("count")).first()[0] > 0
    programs.main(["totalvarmin", to("volume"), "-o", to("quiet"), "--lambda", "0.1", "--slice", "12"])
    assert programs.read_volume(spark, to("quiet")).voxels.count() == len(rows)
    before, after = (read_table(spark, to(f"quiet-{k}")).toPandas() for k in ("before", "after"))
    assert (before.intensity == after.intensity).all() and len(before) == 1022 and before.intensity.between(v.lo, v.hi).all()
    assert spark.read.parquet(to("quiet-slice-after")).count() == sum(r.col == 12 for r in rows)
    programs.main(["potts-model", to("volume"), "-o", to("labels"), "--labels", "{420,720}", "--lambda", "5", "--rawout", to("labels.vti"), "--slice", "12"])
    lines = {(r.col, r.row): r.bytes for r in export.read_vtk(spark, to("labels.vti")).collect()}
    found = spark.read.parquet(to("labels")).collect()
    c0, r0 = min(r.col for r in found), min(r.row for r in found)
    assert all(lines[r.col - c0, r.row - r0][r.n] == int(np.floor(255 * min(1, max(0, r.c)) + 0.5)) for r in found)
    assert {r.level for r in spark.read.parquet(to("labels-slice")).collect()} <= {int(np.floor(255 * min(1, max(0, r.c)) ** (1 / 2.2) + 0.5)) for r in found}
    programs.main(["gmm-peaks", "--denoised", to("quiet"), "--noised", to("volume"), "--peaks", "{420,720}", "--output", to("peaks")])
    assert spark.read.parquet(to("peaks")).count() == 2 and spark.read.parquet(to("peaks-attempts")).count() == 10
    fit = bimm.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bimm, "fit", lambda *a, **k: fit(*a, **k | {"batches": 2, "first": (5, 1e-5), "last": (5, 1e-4)}))
        programs.main(["bimm-peaks", to("volume"), "--peaks", "{420,720}", "-o", to("fit"), "--pdf-name", to("pdf")])
    report = {r["name"]: r["value"] for r in spark.read.parquet(to("fit")).collect()}
    window = (report["lo_tail"], report["hi_tail"])
    tables = {k: read_table(spark, to(f"pdf-{k}.txt")).toPandas() for k in ("full", "00", "01", "00-01")}
    assert all(len(t) == 513 and np.allclose((t.intensity.min(), t.intensity.max()), window) for t in tables.values()) and v.lo <= window[0] < window[1] <= v.hi
    assert np.allclose(tables["full"].ch0, sum(tables[k].ch0 for k in ("00", "01", "00-01")))
    assert np.trapezoid(tables["full"].ch0, tables["full"].intensity) < 1.2 and report["sigma_n"] > 0
    assert {r.label for r in spark.read.parquet(to("labels")).select("label").distinct().collect()} == {0, 1}
    m, by = programs.gmm_peaks(v, v, [420.0, 720.0], attempts=2, iterations=50)
    assert np.allclose(sorted(m.means), [420, 720], atol=60) and sum(r["count"] for r in by.collect()) == len(rows)
    with pytest.raises(ValueError):
        programs.gmm_peaks(v, programs.Volume(v.voxels.limit(5)), [0.1, 0.5])


def test_running_histogram_over_a_stream(spark, tmp_path):
    rng = np.random.default_rng(9)
    for k in range(3):
        volume(spark, rng.random((4, 3, 3))).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    schema = "n int, row int, col int, u double"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_histogram(stream, 5, 0.1, 0.9).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.bin: r["count"] for r in spark.table("running").collect()}
    whole = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert got == {r.bin: r["count"] for r in running_histogram(whole, 5, 0.1, 0.9).collect()}


def test_pure_density_is_a_density():
    # over u a Gaussian, over v the chi distribution of three components
    s, a = THETA.sigma_n, THETA.sigma_n**2 * (1 - THETA.rho)
    v = np.linspace(0, 2, 20001)
    f = 4 / sqrt(pi) / a**1.5 * v * v * np.exp(-v * v / a)
    assert np.isclose(f.sum() * (v[1] - v[0]), 1, atol=1e-6)
    assert np.isclose(bimm.pure_mass(THETA, 0, -9, 9, 9), 1) and erf(1) < 1 and exp(0) == 1 and s > 0


def test_parameter_columns_against_plain_numbers(spark):
    """The column forms of ranges, shares and gaps give what the fit's own functions give; ends, ties and huge numbers too."""
    r = random.Random(5)
    rows = [[r.uniform(-1, 2) for _ in range(5)] for _ in range(200)] + [[0.5] * 5, [0.0] * 5, [1.0] * 5, [2.0, 1.0, 1.0, -1.0, -1.0], [700.0, -700.0, 1e9, 0.0, 5.0]]
    for gap in (0.0, 0.1, 0.25, 0.4):
        found = spark.createDataFrame([(x,) for x in rows], "x array<double>").select("x", voxel.project_gaps(F.col("x"), 5, gap).alias("p")).collect()
        for x, p in found:
            assert p == pytest.approx(bimm.project_gaps(x, gap), abs=1e-6)
    shares = spark.createDataFrame([(x,) for x in rows[:-1]], "x array<double>").select("x", voxel.pinned_softmax(F.col("x")).alias("w")).collect()
    for x, w in shares:
        assert w == pytest.approx(bimm.softmax_from_zero(x), abs=1e-12)
    huge = spark.createDataFrame([([1000.0, 0.0],)], "x array<double>").select(voxel.pinned_softmax(F.col("x"))).first()[0]
    assert huge == [0.0, 1.0, 0.0]
    numbers = spark.createDataFrame([(x,) for x in (-1e4, -3.0, 0.0, 0.5, 8.0, 1e4)], "x double")
    for x, s, back in numbers.select("x", voxel.sigmoid(F.col("x"), -2.0, 3.0), voxel.inverse_sigmoid(voxel.sigmoid(F.col("x"), -2.0, 3.0), -2.0, 3.0)).collect():
        assert s == pytest.approx(bimm.sigmoid(x, -2.0, 3.0)) and back == pytest.approx(bimm.inverse_sigmoid(s, -2.0, 3.0))
