"""Calibration analytics: correspondences, homography fit, overlap hulls, error statistics, threshold sweeps, size priors.

Joins and aggregates are SQL. The fit and the hull run as grouped Arrow functions a camera pair, over points thinned to their
distinct values; there are as many groups as pairs of cameras.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, project
from .matching import counted_broadcast


def tracks(gt: DataFrame) -> DataFrame:
    """Ground-truth boxes as points: the bottom centre and the width."""
    return gt.select("camera_id", "frame_id", "object_id", (F.col("x") + F.col("w") / 2.0).alias("px"), (F.col("y") + F.col("h")).cast("double").alias("py"), F.col("w").cast("double").alias("pw"))


def correspondences(points: DataFrame, src: str, ref: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The same object in the same frame of two cameras."""
    own = points
    if start is not None:
        own = own.where(F.col("frame_id") >= start)
    if end is not None:
        own = own.where(F.col("frame_id") <= end)
    a = own.where(F.col("camera_id") == src).select("frame_id", "object_id", F.col("px").alias("sx"), F.col("py").alias("sy"))
    b = own.where(F.col("camera_id") == ref).select("frame_id", "object_id", F.col("px").alias("rx"), F.col("py").alias("ry"))
    return a.join(b, ["frame_id", "object_id"])


def fit_plane(src: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """A homography by the normalised direct linear transform."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / max(1e-12, float(np.sqrt(((p - c) ** 2).sum(1)).mean()))
        T = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return (p - c) * s, T

    (a, Ta), (b, Tb) = normal(src), normal(ref)
    z, o = np.zeros(len(a)), np.ones(len(a))
    A = np.concatenate([np.stack([-a[:, 0], -a[:, 1], -o, z, z, z, b[:, 0] * a[:, 0], b[:, 0] * a[:, 1], b[:, 0]], 1), np.stack([z, z, z, -a[:, 0], -a[:, 1], -o, b[:, 1] * a[:, 0], b[:, 1] * a[:, 1], b[:, 1]], 1)])
    H = np.linalg.inv(Tb) @ np.linalg.svd(A)[2][-1].reshape(3, 3) @ Ta
    return H / H[2, 2] if abs(H[2, 2]) > 1e-12 else H


def apply_plane(H: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ H.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def ransac_plane(src: np.ndarray, ref: np.ndarray, threshold: float = 3.0, rounds: int = 500, seed: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """A homography and its inliers by random samples of four; None with fewer than four points."""
    if len(src) < 4:
        return None
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    for _ in range(rounds if len(src) > 4 else 1):
        pick = rng.choice(len(src), 4, replace=False)
        try:
            ok = np.sqrt(((apply_plane(fit_plane(src[pick], ref[pick]), src) - ref) ** 2).sum(1)) <= threshold
        except np.linalg.LinAlgError:
            continue
        if ok.sum() > best.sum():
            best = ok
    if best.sum() < 4:
        best[:] = True
    return fit_plane(src[best], ref[best]), best


def all_correspondences(points: DataFrame, pairs: list[tuple[str, str]], start: int | None = None, end: int | None = None) -> DataFrame:
    """correspondences() of several pairs of cameras: src_cam, ref_cam, frame_id, object_id, sx, sy, rx, ry."""
    own = points
    if start is not None:
        own = own.where(F.col("frame_id") >= start)
    if end is not None:
        own = own.where(F.col("frame_id") <= end)
    spec = points.sparkSession.createDataFrame(pairs, "src_cam string, ref_cam string")  # as given
    a = own.join(F.broadcast(spec), F.col("camera_id") == F.col("src_cam")).select("src_cam", "ref_cam", "frame_id", "object_id", F.col("px").alias("sx"), F.col("py").alias("sy"))
    b = own.select(F.col("camera_id").alias("ref_cam"), "frame_id", "object_id", F.col("px").alias("rx"), F.col("py").alias("ry"))
    return a.join(b, ["ref_cam", "frame_id", "object_id"])


FIT_POINTS = 20_000  # of a pair, about: the seeded sample that a homography is fitted on


def fit_homographies(points: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Per pair (src_cam, ref_cam): H, inliers, n, from correspondences sx, sy, rx, ry; pairs of fewer than four points are left out.

    A pair of more than FIT_POINTS distinct correspondences is fitted on those of the smallest hashes, in that number.
    """

    def run(table: pa.Table) -> pa.Table:
        src = np.stack([np.asarray(table[c]) for c in ("sx", "sy")], 1)
        ref = np.stack([np.asarray(table[c]) for c in ("rx", "ry")], 1)
        order = np.lexsort((ref[:, 1], ref[:, 0], src[:, 1], src[:, 0]))
        found = ransac_plane(src[order], ref[order], threshold)
        rows = [] if found is None else [{"src_cam": table["src_cam"][0].as_py(), "ref_cam": table["ref_cam"][0].as_py(), "H": found[0].tolist(), "inliers": int(found[1].sum()), "n": table["total"][0].as_py()}]
        return pa.Table.from_pylist(rows, pa.schema([("src_cam", pa.string()), ("ref_cam", pa.string()), ("H", pa.list_(pa.list_(pa.float64()))), ("inliers", pa.int64()), ("n", pa.int64())]))

    own = points.select("src_cam", "ref_cam", "sx", "sy", "rx", "ry").distinct()
    total = own.groupBy("src_cam", "ref_cam").agg(F.count("*").alias("total"))
    place = (F.pmod(F.xxhash64("sx", "sy", "rx", "ry"), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    some = own.join(counted_broadcast(total), ["src_cam", "ref_cam"]).where(place * F.col("total") <= FIT_POINTS)
    return some.groupBy("src_cam", "ref_cam").applyInArrow(run, "src_cam string, ref_cam string, H array<array<double>>, inliers long, n long")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise corners by a monotone chain, without collinear ones."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(reversed(pts)))


def overlap_regions(points: DataFrame) -> DataFrame:
    """Per pair the hull of co-visible source points (array of x, y) and its area; null with fewer than three corners.

    Each task sends only the corners of its own points' hulls; their hull is the pair's.
    """

    def corners(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            pairs = table.group_by(["src_cam", "ref_cam"]).aggregate([("sx", "list"), ("sy", "list")]).to_pylist()
            out = [(r["src_cam"], r["ref_cam"], float(x), float(y)) for r in pairs for x, y in convex_hull(np.stack([r["sx_list"], r["sy_list"]], 1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["src_cam", "ref_cam", "sx", "sy"])

    def run(table: pa.Table) -> pa.Table:
        hull = convex_hull(np.stack([np.asarray(table[c]) for c in ("sx", "sy")], 1))
        ok = len(hull) >= 3
        x, y = (hull[:, 0], hull[:, 1]) if ok else (np.zeros(0), np.zeros(0))
        size = abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2
        return pa.Table.from_pylist([{"src_cam": table["src_cam"][0].as_py(), "ref_cam": table["ref_cam"][0].as_py(), "hull": [{"x": float(a), "y": float(b)} for a, b in hull] if ok else None, "area": size}], pa.schema([("src_cam", pa.string()), ("ref_cam", pa.string()), ("hull", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("area", pa.float64())]))

    thin = points.select("src_cam", "ref_cam", F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy")).mapInArrow(corners, "src_cam string, ref_cam string, sx double, sy double")
    return thin.groupBy("src_cam", "ref_cam").applyInArrow(run, "src_cam string, ref_cam string, hull array<struct<x:double,y:double>>, area double")


def error_stats(errors: DataFrame, value: str = "err", keys: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, median, p90 and p95 with linear interpolation."""
    q = F.expr(f"percentile({value}, array(0.5D, 0.9D, 0.95D))")
    out = errors.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("_q"))
    return out.select(*keys, "n", "mean", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p90"), F.col("_q")[2].alias("p95"))


def error_cdf(errors: DataFrame, value: str, order: str, key: str, ranges: int = 64) -> DataFrame:
    """The empirical distribution within each key: rank (by value, then order) over count.

    A key's values are cut in ranges at approximate quantiles: ranks are counted within a range, after the rows of the ranges below.
    """
    cuts = errors.groupBy(key).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1000).alias("_cuts"))
    cut = errors.join(counted_broadcast(cuts.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key"))).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts", "_key")
    sums = cut.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    over = Window.partitionBy("_key")
    below = F.coalesce(F.sum("_n").over(over.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_key", "_r", below.alias("_below"), F.sum("_n").over(over).alias("_all"))
    met = cut.join(counted_broadcast(sums), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    rank = F.col("_below") + F.row_number().over(Window.partitionBy(key, "_range").orderBy(value, order))
    return met.withColumn("cdf", rank / F.col("_all")).drop("_key", "_r", "_range", "_below", "_all")


def same_diff_pairs(points: DataFrame, pairs: list[tuple[str, str]], cap: int | None = None) -> DataFrame:
    """Per frame every pair of points of two cameras with its distance and whether the object is the same.

    cap: frames are taken in order up to and with the one at which more than cap pairs of different objects were seen.
    """
    spec = points.sparkSession.createDataFrame(pairs, "src string, ref string")
    a = points.join(F.broadcast(spec), F.col("camera_id") == F.col("src")).select("frame_id", "src", "ref", F.col("object_id").alias("oa"), F.col("px").alias("ax"), F.col("py").alias("ay"))
    b = points.select("frame_id", F.col("camera_id").alias("ref"), F.col("object_id").alias("ob"), F.col("px").alias("bx"), F.col("py").alias("by"))
    out = a.join(b, ["frame_id", "ref"]).select("frame_id", "src", "ref", "oa", "ob", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("d"), (F.col("oa") == F.col("ob")).alias("same"))
    if cap is None:
        return out
    per = out.groupBy("src", "ref", "frame_id").agg(F.sum((~F.col("same")).cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "ref").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.join(per.withColumn("_b", before).where(f"_b <= {cap}").select("src", "ref", "frame_id"), ["src", "ref", "frame_id"], "left_semi")


def tau_sweep(pairs: DataFrame, top: float = 200.0, steps: int = 200) -> DataFrame:
    """Precision, recall and F1 at each threshold i * top / (steps - 1): one histogram pass and a running sum, no theta join."""
    width = top / (steps - 1)
    # the first step whose threshold holds d
    step = F.ceil(F.col("d") / F.lit(width)).cast("int")
    step = F.when((step > 0) & ((step - 1) * F.lit(width) >= F.col("d")), step - 1).when(step * F.lit(width) < F.col("d"), step + 1).otherwise(step)
    hist = pairs.groupBy("src", "ref", step.alias("i")).agg(F.sum(F.col("same").cast("long")).alias("s"), F.sum((~F.col("same")).cast("long")).alias("f"))
    total = pairs.groupBy("src", "ref").agg(F.sum(F.col("same").cast("long")).alias("total"))
    grid = total.select("src", "ref", "total", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    run = Window.partitionBy("src", "ref").orderBy("i")
    both = grid.join(hist, ["src", "ref", "i"], "left").fillna(0, ["s", "f"]).withColumn("tp", F.sum("s").over(run)).withColumn("fp", F.sum("f").over(run))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("total") > 0, F.col("tp") / F.col("total")).otherwise(0.0)
    return both.select("src", "ref", "i", (F.col("i") * F.lit(width)).alias("tau"), "tp", "fp", (F.col("total") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def best_tau(sweep: DataFrame) -> DataFrame:
    """The first threshold of largest F1."""
    return sweep.withColumn("_r", F.row_number().over(Window.partitionBy("src", "ref").orderBy(F.desc("f1"), "i"))).where("_r = 1").drop("_r")


def distance_histogram(pairs: DataFrame, top: float = 200.0, bins: int = 59) -> DataFrame:
    """Counts and densities of distances in equal bins over [0, top], the last one closed; per class."""
    width = top / bins
    own = pairs.where(f"d >= 0 and d <= {top}").withColumn("bin", F.least(F.floor(F.col("d") / F.lit(width)), F.lit(bins - 1)).cast("int"))
    counts = own.groupBy("same", "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy("same")) * F.lit(width)))


def size_priors(gt: DataFrame, bin_size: int = 20, height: int = 360, least: int = 5) -> DataFrame:
    """Median and 0.9 quantile of width, height and area per camera and bin of the bottom edge; bins without enough boxes take the nearest."""
    bins = -(-height // bin_size)
    y = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("y") + F.col("h")) / bin_size))).cast("int")
    own = gt.where("w > 0 and h > 0").withColumn("y_bin", y).withColumn("a", F.col("w") * F.col("h"))
    q = [F.expr(f"percentile({c}, array(0.5D, 0.9D))").alias(f"_{c}") for c in ("w", "h", "a")]
    full = own.groupBy("camera_id", "y_bin").agg(F.count("*").alias("n"), *q).where(f"n >= {least}")
    names = [(f"{k}_{c}", F.col(f"_{c}")[i]) for i, k in enumerate(("median", "q90")) for c in ("w", "h", "a")]
    full = full.select("camera_id", F.col("y_bin").alias("have"), *(v.alias(n) for n, v in names))
    grid = full.select("camera_id").distinct().select("camera_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("y_bin"))
    near = Window.partitionBy("camera_id", "y_bin").orderBy(F.abs(F.col("have") - F.col("y_bin")), "have")
    return grid.join(full, "camera_id").withColumn("_r", F.row_number().over(near)).where("_r = 1").select("camera_id", "y_bin", (F.col("have") == F.col("y_bin")).alias("has_data"), *(n for n, _ in names))


def four_points(points: DataFrame, key: str = "pair") -> DataFrame:
    """Per key the point (idx, sx, sy) nearest each corner of the bounding box, no point twice."""
    box = points.groupBy(key).agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"))
    corners = box.select(key, F.posexplode(F.array(*(F.struct(F.col(a).alias("cx"), F.col(b).alias("cy")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1"))))).alias("corner", "c"))
    d = F.pow(F.col("sx") - F.col("c.cx"), 2) + F.pow(F.col("sy") - F.col("c.cy"), 2)
    # each corner needs only its four nearest: at most three were taken before
    ranked = points.join(counted_broadcast(corners), key).withColumn("d2", d).withColumn("_r", F.row_number().over(Window.partitionBy(key, "corner").orderBy("d2", "idx"))).where("_r <= 4")
    lists = ranked.groupBy(key, "corner").agg(F.array_sort(F.collect_list(F.struct("d2", "idx", "sx", "sy"))).alias("near")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("corner", "near"))).alias("all"))
    start = F.filter(F.col("all")[0].near, lambda _: F.lit(False))
    pick = F.aggregate("all", start, lambda acc, c: F.concat(acc, F.slice(F.filter(c.near, lambda p: ~F.exists(acc, lambda q: q.idx == p.idx)), 1, 1)))
    return lists.select(key, F.posexplode(pick).alias("corner", "p")).select(key, "corner", "p.idx", "p.sx", "p.sy")


def projected_pairs(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Per frame every pair of points of two cameras: its distance after projection by planes (src_cam, ref_cam, H) and whether the object is the same."""
    x, y = project(F.col("H"), F.col("px"), F.col("py"))
    a = points.join(counted_broadcast(planes.select("src_cam", "ref_cam", "H")), F.col("camera_id") == F.col("src_cam")).select("frame_id", F.col("src_cam").alias("src"), F.col("ref_cam").alias("ref"), F.col("object_id").alias("oa"), x.alias("ax"), y.alias("ay"))
    b = points.select("frame_id", F.col("camera_id").alias("ref"), F.col("object_id").alias("ob"), F.col("px").alias("bx"), F.col("py").alias("by"))
    return a.join(b, ["frame_id", "ref"]).where("ax IS NOT NULL").select("frame_id", "src", "ref", "oa", "ob", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("d"), (F.col("oa") == F.col("ob")).alias("same"))


def calibrate(gt: DataFrame, pairs: list[tuple[str, str]], start: int | None = None, end: int | None = None, threshold: float = 3.0, margin: float = 20.0) -> DataFrame:
    """The calibration run: for each pair with at least four correspondences its homography, overlap hulls, best threshold and F1, errors, and margin.

    gt has camera_id, frame_id, object_id, x, y, w, h. Without a pair of the same object tau and pair_f1 are 0.
    """
    points = tracks(gt)
    met = all_correspondences(points, pairs, start, end)
    planes = fit_homographies(met, threshold)
    src = overlap_regions(met).select("src_cam", "ref_cam", F.col("hull").alias("hull_src"))
    ref = overlap_regions(met.select("src_cam", "ref_cam", F.col("rx").alias("sx"), F.col("ry").alias("sy"))).select("src_cam", "ref_cam", F.col("hull").alias("hull_ref"))
    apart = projected_pairs(points, planes)
    best = best_tau(tau_sweep(apart)).where("tp + fn > 0").select(F.col("src").alias("src_cam"), F.col("ref").alias("ref_cam"), F.col("tau").alias("t"), F.col("f1").alias("f"))
    errors = error_stats(apart.where("same"), "d", ("src", "ref")).select(F.col("src").alias("src_cam"), F.col("ref").alias("ref_cam"), F.col("mean").alias("error_mean"), F.col("median").alias("error_median"), F.col("p95").alias("error_p95"))
    key = ["src_cam", "ref_cam"]
    out = planes.join(src, key, "left").join(ref, key, "left").join(best, key, "left").join(errors, key, "left")
    return out.select(*key, "H", "hull_src", "hull_ref", F.coalesce("t", F.lit(0.0)).alias("tau"), F.coalesce("f", F.lit(0.0)).alias("pair_f1"), F.lit(margin).alias("margin"), "inliers", "n", "error_mean", "error_median", "error_p95")
