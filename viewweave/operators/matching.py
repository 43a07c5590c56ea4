"""Cross-camera matching, view quality and ranking.

Edges are one equi-join on (frame_id, camera pair) with the distance as a residual; calibration is a small table whose size is
counted before it is broadcast. Clusters are an ordered fold within a frame (of bounded size), done by a grouped Arrow
function; the rest are window functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS, BinSize
from ..functions.geometry import bottom_center, clip01, distance, edge_score, importance, in_hull, project, quality, size_score

SMALL = 10_000


def counted_broadcast(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def strong_pairs(pairs: DataFrame, min_f1: float = 0.5) -> DataFrame:
    return pairs.where((F.col("pair_f1") >= min_f1) & (F.col("tau") > 0))


def edges(props: DataFrame, pairs: DataFrame, min_score: float = 0.0, inclusive: bool = True) -> DataFrame:
    """Matches of proposals (proposal_id, camera_id, frame_id, x, y, w, h) across strong pairs: frame_id, src, ref, distance, score."""
    bx, by = bottom_center(*(F.col(c) for c in "xywh"))
    points = props.select("frame_id", "camera_id", "proposal_id", bx.alias("px"), by.alias("py"))
    own = counted_broadcast(pairs)
    px, py = project(F.col("H"), F.col("px"), F.col("py"))
    src = points.join(own, F.col("camera_id") == F.col("src_cam")).where(in_hull(F.col("hull_src"), F.col("px"), F.col("py"), F.col("margin")))
    src = src.select("frame_id", F.col("proposal_id").alias("src"), F.col("camera_id").alias("src_camera"), "ref_cam", "tau", "hull_ref", "margin", px.alias("qx"), py.alias("qy"))
    ref = points.select("frame_id", F.col("proposal_id").alias("ref"), F.col("camera_id").alias("ref_cam"), F.col("px").alias("rx"), F.col("py").alias("ry"))
    met = src.join(ref, ["frame_id", "ref_cam"]).where(in_hull(F.col("hull_ref"), F.col("rx"), F.col("ry"), F.col("margin")))
    met = met.withColumn("distance", distance(F.col("qx"), F.col("qy"), F.col("rx"), F.col("ry")))
    near = F.col("distance") <= F.col("tau") if inclusive else F.col("distance") < F.col("tau")
    return met.where(near).withColumn("score", edge_score(F.col("distance"), F.col("tau"))).where(F.col("score") >= min_score).select("frame_id", "src", "src_camera", "ref", F.col("ref_cam").alias("ref_camera"), "distance", "score")


def fold_clusters(edge_rows: list[tuple], cameras: dict) -> dict:
    """Labels (smallest member) of proposals after taking ordered edges, never joining two clusters that share a camera."""
    root = {n: n for n in cameras}
    held = {n: {c} for n, c in cameras.items()}
    members = {n: [n] for n in cameras}
    for a, b in edge_rows:
        x, y = root[a], root[b]
        if x != y and not held[x] & held[y]:
            held[x] |= held[y]
            members[x] += members[y]
            for n in members[y]:
                root[n] = x
    low = {r: min(m) for r, m in members.items()}
    return {n: low[r] for n, r in root.items()}


def clusters(props: DataFrame, matched: DataFrame, offline: bool = False) -> DataFrame:
    """(frame_id, proposal_id, camera_id, cluster): clusters named by their smallest proposal; each holds a camera once.

    Edges are taken by falling score, then by distance and names; offline by score alone, equal ones as they arise: by cameras, then names.
    """
    node = props.select("frame_id", F.lit(0).alias("kind"), F.col("proposal_id").cast("string").alias("a"), F.col("camera_id").alias("b"), F.lit(0.0).alias("s"), F.lit(0.0).alias("d"))
    link = matched.select("frame_id", F.lit(1).alias("kind"), F.col("src").cast("string").alias("a"), F.col("ref").cast("string").alias("b"), F.col("score").alias("s"), F.col("distance").alias("d"))

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("kind", "a", "b", "s", "d"))))
        cameras = {a: b for k, a, b, _, _ in rows if not k}
        arises = lambda r: (cameras.get(r[1], ""), cameras.get(r[2], ""), r[1], r[2])
        order = sorted((r for r in rows if r[0]), key=lambda r: (-r[3], *arises(r)) if offline else (-r[3], r[4], r[1], r[2]))
        label = fold_clusters([(r[1], r[2]) for r in order], cameras)
        names = sorted(cameras)
        return pa.table({"frame_id": pa.array([table["frame_id"][0].as_py()] * len(names), pa.int64()), "proposal_id": names, "camera_id": [cameras[n] for n in names], "cluster": [label[n] for n in names]})

    return node.unionByName(link).groupBy("frame_id").applyInArrow(run, "frame_id long, proposal_id string, camera_id string, cluster string")


def name_clusters(clustered: DataFrame) -> DataFrame:
    """Adds cluster_id f%06d_c%04d, in order of each cluster's first member (camera_id, proposal_id)."""
    frame = Window.partitionBy("frame_id").orderBy("camera_id", "proposal_id")
    place = clustered.withColumn("_n", F.row_number().over(frame)).withColumn("_first", F.min("_n").over(Window.partitionBy("frame_id", "cluster")))
    return place.withColumn("cluster_id", F.format_string("f%06d_c%04d", "frame_id", F.dense_rank().over(Window.partitionBy("frame_id").orderBy("_first")) - 1)).drop("_n", "_first")


def offline_clusters(points: DataFrame, pairs: DataFrame, min_f1: float = 0.5) -> DataFrame:
    """Clusters of whole recordings: strong pairs, edges below their threshold, and the offline order; frames of fewer than two boxes are left out."""
    many = points.groupBy("frame_id").count().where("count >= 2").select("frame_id")
    own = points.join(many, "frame_id", "left_semi")
    return clusters(own, edges(own, strong_pairs(pairs, min_f1), inclusive=False), offline=True)


def single_view_clusters(props: DataFrame) -> DataFrame:
    """One cluster a proposal: cluster_id f%06d_camera_p%04d with a running index over sorted cameras."""
    n = F.row_number().over(Window.partitionBy("frame_id").orderBy("camera_id", "proposal_id")) - 1
    return props.withColumn("cluster_id", F.format_string("f%06d_%s_p%04d", "frame_id", "camera_id", n))


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    """How many clusters have each number of cameras."""
    return clustered.groupBy("frame_id", "cluster").agg(F.countDistinct("camera_id").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def pairwise_counts(labelled: DataFrame) -> DataFrame:
    """tp, fp, fn over pairs of a frame's nodes (frame_id, node, camera_id, cluster, object_id) in different cameras."""
    a, b = labelled.alias("a"), labelled.alias("b")
    cond = (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.camera_id") != F.col("b.camera_id"))
    same, true = F.col("a.cluster") == F.col("b.cluster"), F.col("a.object_id") == F.col("b.object_id")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return a.join(b, cond).agg(n(same & true).alias("tp"), n(same & ~true).alias("fp"), n(~same & true).alias("fn"))


# ---------------------------------------------------------------- quality and ranking


def _normal(v: str, over) -> Column:
    low, high = F.min(v).over(over), F.max(v).over(over)
    return F.when(high - low <= EPS, 0.5).otherwise(clip01((F.col(v) - low) / F.when(high - low > EPS, high - low)))


def view_quality(views: DataFrame, keys: list[str]) -> DataFrame:
    """Adds q to views (w, h, sharpness): size and sharpness normalised within each cluster."""
    over = Window.partitionBy(*keys)
    raw = views.withColumn("_s", size_score(F.col("w"), F.col("h"))).withColumn("_c", F.coalesce(F.col("sharpness").cast("double"), F.lit(0.0)))
    return raw.withColumn("q", quality(_normal("_s", over), _normal("_c", over))).drop("_s", "_c")


def best_views(scored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The view of lowest quality of each cluster (it gains most), with n_views."""
    over = Window.partitionBy(*keys)
    return scored.withColumn("n_views", F.count("*").over(over)).withColumn("_r", F.row_number().over(over.orderBy("q", *order))).where("_r = 1").drop("_r")


def rank(best: DataFrame, size: BinSize = BinSize()) -> DataFrame:
    return best.withColumn("importance", importance(F.col("n_views"), F.col("q"), F.col("w"), F.col("h"), size))


def normal_importance(cands: DataFrame, gop: str = "gop") -> DataFrame:
    """Adds importance_norm: min-max within each GOP; a flat GOP is all 1 if positive, else 0."""
    v = F.when(F.isnan("importance") | F.col("importance").isNull() | (F.col("importance") <= 0) | (F.col("importance") == float("inf")), 0.0).otherwise(F.col("importance"))
    over = Window.partitionBy(gop)
    own = cands.withColumn("_v", v)
    low, high = F.min("_v").over(over), F.max("_v").over(over)
    flat = F.when(high > 0, 1.0).otherwise(0.0)
    return own.withColumn("importance_norm", F.when(high - low <= EPS, flat).otherwise(clip01((F.col("_v") - low) / F.when(high - low > EPS, high - low)))).drop("_v")
