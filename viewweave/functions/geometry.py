"""Scalar expressions over boxes, points, homographies and polygons; all run inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import EPS, IMAGE_HEIGHT, IMAGE_WIDTH, REDUNDANCY_WEIGHT, SHARPNESS_WEIGHT, SIZE_WEIGHT, BinSize


def area(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def bin_count(total: Column, bin_area: int) -> Column:
    return F.when(total <= 0, F.lit(0)).otherwise(F.ceil(total / F.lit(bin_area))).cast("long")


def bottom_center(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / F.lit(2.0), (y + h).cast("double")


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def center_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, sx: Column | float = 1.0, sy: Column | float = 1.0) -> list[Column]:
    sx, sy = (s if isinstance(s, Column) else F.lit(s) for s in (sx, sy))
    return [(cx - w / 2) * sx, (cy - h / 2) * sy, (cx + w / 2) * sx, (cy + h / 2) * sy]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    iw = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    ih = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = iw * ih
    size = lambda v: F.greatest(F.lit(0.0), v[2] - v[0]) * F.greatest(F.lit(0.0), v[3] - v[1])
    union = size(a) + size(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def project(H: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography; null where it goes to infinity."""
    row = lambda i: H[i][0] * x + H[i][1] * y + H[i][2]
    return F.try_divide(row(0), row(2)), F.try_divide(row(1), row(2))


def invert(H: Column) -> Column:
    """The inverse of a 3 x 3 matrix by its adjugate; null entries where it is singular."""
    m = lambda i, j: H[i % 3][j % 3]
    cofactor = lambda i, j: m(i + 1, j + 1) * m(i + 2, j + 2) - m(i + 1, j + 2) * m(i + 2, j + 1)
    det = sum((m(0, j) * cofactor(0, j) for j in range(1, 3)), m(0, 0) * cofactor(0, 0))
    return F.array(*(F.array(*(F.try_divide(cofactor(j, i), det) for j in range(3))) for i in range(3)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def edge_score(d: Column, tau: Column) -> Column:
    return F.when(tau > 0, 1 - d / tau).otherwise(0.0)


def rescale_half_even(v: Column, ratio: float) -> Column:
    return F.bround(v * F.lit(ratio), 0).cast("long")


def in_hull(hull: Column, x: Column, y: Column, margin: Column) -> Column:
    """Whether a point lies in a polygon or within margin of it; a null polygon holds every point."""
    n = F.size(hull)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(hull[i].alias("a"), hull[(i + 1) % n].alias("b")))

    def crosses(e: Column) -> Column:
        spans = (e.a.y > y) != (e.b.y > y)
        return spans & (x < (e.b.x - e.a.x) * F.try_divide(y - e.a.y, e.b.y - e.a.y) + e.a.x)

    inside = F.size(F.filter(edges, crosses)) % 2 == 1

    def gap(e: Column) -> Column:
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - e.a.x) * dx + (y - e.a.y) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return distance(x, y, e.a.x + t * dx, e.a.y + t * dy)

    near = F.array_min(F.transform(edges, gap)) <= margin
    return hull.isNull() | F.coalesce(inside | near, F.lit(False))


def macroblocks(x1: Column, y1: Column, x2: Column, y2: Column, size: int = 16) -> Column:
    """Row-major (r, c) of the macroblocks that a box covers."""
    rows = F.sequence(F.floor(y1 / size).cast("int"), F.floor((y2 - 1) / size).cast("int"))
    cols = F.sequence(F.floor(x1 / size).cast("int"), F.floor((x2 - 1) / size).cast("int"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("r"), c.alias("c")))))


def size_score(w: Column, h: Column) -> Column:
    return F.log(w * h / F.lit(float(IMAGE_WIDTH * IMAGE_HEIGHT)) + F.lit(EPS))


def clip01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def quality(size: Column, sharpness: Column) -> Column:
    return clip01(F.lit(SIZE_WEIGHT) * size + F.lit(SHARPNESS_WEIGHT) * sharpness)


def importance(views: Column, q: Column, w: Column, h: Column, size: BinSize = BinSize()) -> Column:
    """Utility per share of a bin of enhancing an object's chosen view."""
    redundancy = (views - 1) / views
    gain = F.greatest(F.lit(0.0), 1 - clip01(F.coalesce(q, F.lit(1.0))))
    cost = F.greatest(F.greatest(F.lit(1), w) * F.greatest(F.lit(1), h) / F.lit(float(size.area)), F.lit(EPS))
    return F.greatest(F.lit(0.0), F.lit(REDUNDANCY_WEIGHT) * redundancy + F.lit(1 - REDUNDANCY_WEIGHT) * gain) / cost


def fitted_size(w: Column, h: Column, size: BinSize = BinSize()) -> tuple[Column, Column]:
    """A patch's sides in a bin: shrunk to fit if too large, 0 if empty."""
    s = F.least(F.lit(float(size.width)) / w, F.lit(float(size.height)) / h)
    fit = lambda v: F.when((w <= 0) | (h <= 0), 0).when((w > size.width) | (h > size.height), F.greatest(F.lit(1), F.bround(v * s, 0).cast("int"))).otherwise(v).cast("int")
    return fit(w), fit(h)


def placement_cost(ow: Column, oh: Column, rect: Column, size: BinSize = BinSize()) -> Column:
    """Lexicographic cost of putting a patch in a free rectangle (x, y, w, h); structs compare in order."""
    side = float(max(size.width, size.height))
    return F.struct(((rect.w * rect.h - ow * oh) / F.lit(float(size.area))).alias("area"), (F.least(rect.w - ow, rect.h - oh) / F.lit(side)).alias("short"), (F.greatest(rect.w - ow, rect.h - oh) / F.lit(side)).alias("long"), rect.y.alias("y"), rect.x.alias("x"))


def overlaps(a: Column, b: Column) -> Column:
    return (a.x < b.x + b.w) & (a.x + a.w > b.x) & (a.y < b.y + b.h) & (a.y + a.h > b.y)


def split_rect(free: Column, used: Column) -> Column:
    """The up to four largest free rectangles left of `free` around `used`."""
    r = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    parts = F.array(r(free.x, free.y, used.x - free.x, free.h), r(used.x + used.w, free.y, free.x + free.w - used.x - used.w, free.h), r(free.x, free.y, free.w, used.y - free.y), r(free.x, used.y + used.h, free.w, free.y + free.h - used.y - used.h))
    return F.filter(parts, lambda p: (p.w > 0) & (p.h > 0))


def f1_metrics(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def gop_of(frame: Column, gop: int, start: int = 1) -> Column:
    """The count window of consecutive frames that a frame is in."""
    return F.floor((frame - start) / gop).cast("long")


def identifier(kind: str, *parts: Column) -> Column:
    """Zero-padded names: proposal, cluster, single or stem."""
    # The formats of identifiers.
    formats = {"proposal": "%s_f%06d_p%04d", "loaded": "%s_f%06d_p%06d", "cluster": "f%06d_c%04d", "single": "f%06d_%s_p%04d", "stem": "g%06d_f%06d"}
    return F.format_string(formats[kind], *parts)


def int_set(text: Column) -> Column:
    """The sorted distinct integers of a comma-separated list; null (no filter) for none, all or an asterisk."""
    bare = F.lower(F.trim(text))
    values = F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("int")), lambda v: v.isNotNull())
    return F.when(bare.isin("", "all", "none", "*"), F.lit(None)).otherwise(F.array_sort(F.array_distinct(values)))


def pair_list(text: Column, outer: str = ",", inner: str = ":") -> Column:
    """key:value lists, such as batch sizes with their engines, as a map."""
    return F.str_to_map(text, F.lit(outer), F.lit(inner))


def launch_plan(count: int, latency: dict[int, float] | None) -> list[int]:
    """Batches that cover `count` bins at the least latency, then in the fewest launches, then the lexicographically largest.

    A plan's rank is one key; latencies count in whole 1e-9 ms, so that sums that differ only by rounding tie.
    """
    if count <= 0:
        return []
    sizes = {int(k): round(float(v) * 1e9) for k, v in (latency or {}).items() if int(k) > 0}
    if not sizes:
        return [count]
    plans: dict[int, tuple[int, int, tuple[int, ...]]] = {0: (0, 0, ())}
    for total in range(1, count + 1):
        # negated batches make the largest plan the smallest key; each plan is extended at its end
        extended = [(plans[total - k][0] + ms, plans[total - k][1] + 1, (*plans[total - k][2], -k)) for k, ms in sizes.items() if total - k in plans]
        if extended:
            plans[total] = min(extended)
    if count not in plans:
        raise ValueError(f"no batches of {sorted(sizes)} make {count} bins")
    return [-k for k in plans[count][2]]


def register_functions(spark: SparkSession) -> None:
    """SQL names for the expressions: vw_iou, vw_area, vw_distance, vw_edge_score, vw_gop, and vw_launch_plan (Arrow)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    box = lambda p: f"{p}x1 DOUBLE, {p}y1 DOUBLE, {p}x2 DOUBLE, {p}y2 DOUBLE"
    inter = "greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))"
    size = lambda p: f"greatest(0D, {p}x2 - {p}x1) * greatest(0D, {p}y2 - {p}y1)"
    union = f"({size('a')} + {size('b')} - {inter})"
    for sql in (
        f"vw_iou({box('a')}, {box('b')}) RETURNS DOUBLE RETURN CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0D END",
        "vw_area(w BIGINT, h BIGINT) RETURNS BIGINT RETURN greatest(0, w) * greatest(0, h)",
        "vw_distance(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE RETURN sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))",
        "vw_edge_score(d DOUBLE, tau DOUBLE) RETURNS DOUBLE RETURN CASE WHEN tau > 0 THEN 1 - d / tau ELSE 0D END",
        "vw_gop(frame BIGINT, gop BIGINT, start BIGINT) RETURNS BIGINT RETURN floor((frame - start) / gop)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")

    @pandas_udf("array<int>")
    def plan(count: pd.Series, sizes: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([launch_plan(int(c), dict(zip(map(int, s), map(float, m)))) for c, s, m in zip(count, sizes, ms)])

    spark.udf.register("vw_launch_plan", plan)
