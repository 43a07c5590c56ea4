"""The registered queries of the vision operators and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BinSize, ProposalSettings
from ..functions import geometry as g
from ..operators import calibration as cal
from ..operators import evaluation as ev
from ..operators import matching as ma
from ..operators import packing as pk
from ..operators import reporting as rp
from .fixtures import DET_SQL, GT_SQL, H, PAIRS, PAIRS_SQL, detections, ground_truth, pairs, pixel_frames, with_corners

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WITH_DET = f"WITH {DET_SQL}"
WITH_GT = f"WITH {DET_SQL}, {GT_SQL}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def iou_sql(a: str, b: str) -> str:
    """IoU of xywh boxes in SQL."""
    iw = f"greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    ih = f"greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(CAST({iw} * {ih} AS DOUBLE) / ({a}.w * {a}.h + {b}.w * {b}.h - {iw} * {ih}))"


# ---------------------------------------------------------------- scalars and filters


@query(f"{WITH_DET} SELECT det_id, round(x + w / 2.0, 6) AS cx, CAST(y + h AS DOUBLE) AS cy, greatest(0, w) * greatest(0, h) AS area FROM det")
def q_project_bottom_center(spark, d):
    det = detections(spark, d)
    cx, cy = g.bottom_center(*(F.col(c) for c in "xywh"))
    return det.select("det_id", r6(cx, "cx"), cy.alias("cy"), g.area(F.col("w"), F.col("h")).alias("area"))


@query(f"{WITH_DET} SELECT frame_id // 10 AS gop, CAST(sum(w * h) AS BIGINT) AS area, CAST(ceil(sum(w * h) / 65536.0) AS BIGINT) AS bins FROM det GROUP BY 1")
def q_bbox_area_bins(spark, d):
    own = detections(spark, d).groupBy(F.expr("frame_id div 10").alias("gop")).agg(F.sum(g.area(F.col("w"), F.col("h"))).alias("area"))
    return own.withColumn("bins", g.bin_count(F.col("area"), 65536))


@query(f"{WITH_GT} SELECT a.det_id, b.gt_id, round({iou_sql('a', 'b')}, 6) AS iou FROM det a JOIN gt b ON a.camera_id = b.camera_id AND a.frame_id = b.frame_id WHERE {iou_sql('a', 'b')} >= 0.5")
def q_iou_pairs(spark, d):
    det = detections(spark, d)
    a, b = with_corners(det).alias("a"), with_corners(ground_truth(det)).alias("b")
    v = g.iou([F.col(f"a.{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, (F.col("a.camera_id") == F.col("b.camera_id")) & (F.col("a.frame_id") == F.col("b.frame_id"))).select("a.det_id", "b.gt_id", v.alias("iou")).where("iou >= 0.5").withColumn("iou", r6("iou"))


@query(f"{WITH_DET} SELECT det_id, CAST(round_even(x * 0.5, 0) AS BIGINT) AS x, CAST(round_even(y * 0.25, 0) AS BIGINT) AS y FROM det")
def q_rescale_half_even(spark, d):
    return detections(spark, d).select("det_id", g.rescale_half_even(F.col("x"), 0.5).alias("x"), g.rescale_half_even(F.col("y"), 0.25).alias("y"))


@query(f"{WITH_DET} SELECT det_id, count(*) AS blocks, CAST(sum(r * 40 + c) AS BIGINT) AS checksum FROM (SELECT det_id, unnest(range(y // 16, (y + h - 1) // 16 + 1)) AS r, x, w FROM det), unnest(range(x // 16, (x + w - 1) // 16 + 1)) AS u(c) GROUP BY 1 HAVING count(*) >= 2")
def q_macroblocks(spark, d):
    det = with_corners(detections(spark, d))
    cells = det.select("det_id", F.explode(g.macroblocks(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("m"))
    return cells.groupBy("det_id").agg(F.count("*").alias("blocks"), F.sum(F.col("m.r") * 40 + F.col("m.c")).alias("checksum")).where("blocks >= 2")


@query(f"WITH {PAIRS_SQL} SELECT src_cam, ref_cam, tau, pair_f1 FROM pairs WHERE pair_f1 >= 0.5 AND tau > 0")
def q_strong_pairs(spark, d):
    return ma.strong_pairs(pairs(spark)).select("src_cam", "ref_cam", "tau", "pair_f1")


@query(
    f"""{WITH_DET}, h AS (SELECT * FROM (VALUES (0,40.0,40.0,600.0,30.0),(1,600.0,30.0,620.0,330.0),(2,620.0,330.0,300.0,350.0),(3,300.0,350.0,30.0,300.0),(4,30.0,300.0,40.0,40.0)) t(i,ax,ay,b_x,b_y)),
 p AS (SELECT det_id, x + w / 2.0 AS px, CAST(y + h AS DOUBLE) AS py FROM det),
 e AS (SELECT det_id, sum(CASE WHEN (ay > py) <> (b_y > py) AND px < (b_x - ax) * (py - ay) / nullif(b_y - ay, 0) + ax THEN 1 ELSE 0 END) AS n,
 min(sqrt(power(px - (ax + greatest(0, least(1, ((px - ax) * (b_x - ax) + (py - ay) * (b_y - ay)) / (power(b_x - ax, 2) + power(b_y - ay, 2)))) * (b_x - ax)), 2) + power(py - (ay + greatest(0, least(1, ((px - ax) * (b_x - ax) + (py - ay) * (b_y - ay)) / (power(b_x - ax, 2) + power(b_y - ay, 2)))) * (b_y - ay)), 2))) AS gap FROM p, h GROUP BY det_id)
 SELECT det_id FROM e WHERE n % 2 = 1 OR gap <= 20"""
)
def q_in_hull(spark, d):
    det = detections(spark, d)
    px, py = g.bottom_center(*(F.col(c) for c in "xywh"))
    hull = pairs(spark, hull=True).limit(1).select("hull_src", "margin")
    return det.crossJoin(F.broadcast(hull)).where(g.in_hull(F.col("hull_src"), px, py, F.col("margin"))).select("det_id")


@query(f"{WITH_DET} SELECT det_id, label, score FROM det WHERE score >= 0.5 AND label IN (2, 5, 7)")
def q_class_conf_filter(spark, d):
    return ev.filter_predictions(with_corners(detections(spark, d))).select("det_id", "label", "score")


@query(f"{WITH_DET} SELECT det_id FROM det WHERE w * h >= 1200 AND CAST(w AS DOUBLE) / h > 0.5 AND CAST(w AS DOUBLE) / h < 2.0")
def q_aspect_filter(spark, d):
    """Each box as a component of w x h pixels, through the filter of components."""
    import pyarrow as pa

    from ..operators.images import filter_boxes

    s = ProposalSettings(min_area=1200, min_aspect=0.5, max_aspect=2.0)

    def run(batches):
        for b in batches:
            keep = [bool(filter_boxes([((0, 0, w, h), w * h)], s)) for w, h in zip(b["w"].to_pylist(), b["h"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["det_id"].filter(pa.array(keep, pa.bool_()))], names=["det_id"])

    return detections(spark, d).select("det_id", "w", "h").mapInArrow(run, "det_id long")


@query(f"{WITH_DET} SELECT camera_id, count(*) AS frames FROM (SELECT camera_id, frame_id, row_number() OVER (PARTITION BY camera_id ORDER BY frame_id) AS n FROM (SELECT DISTINCT camera_id, frame_id FROM det)) WHERE n > 300 GROUP BY 1")
def q_warmup_gate(spark, d):
    """Frames of one pixel through the background model; those after the warm-up."""
    from ..operators.enhance import foreground_counts

    seen = foreground_counts(pixel_frames(detections(spark, d)), ProposalSettings(warmup_frames=300))
    return seen.where("NOT warm").groupBy("camera_id").agg(F.count("*").alias("frames"))


@query("SELECT o_orderkey, list_sort(list_distinct([CAST(trim(v) AS INTEGER) FOR v IN str_split(concat_ws(',', o_orderkey % 7, o_orderkey % 3, o_orderkey % 5), ',')]))::VARCHAR AS ids FROM orders")
def q_int_set(spark, d):
    k = F.col("o_orderkey")
    own = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", g.int_set(F.concat_ws(",", k % 7, k % 3, k % 5)).alias("a"))
    return own.select("o_orderkey", F.concat(F.lit("["), F.array_join("a", ", "), F.lit("]")).alias("ids"))


# ---------------------------------------------------------------- joins and clusters

def _row(i: int) -> str:
    return f"({H[i][0]!r}::DOUBLE * px + {H[i][1]!r}::DOUBLE * py + {H[i][2]!r}::DOUBLE)"


EDGE_SQL = f"""{WITH_DET}, {PAIRS_SQL}, pt AS (SELECT det_id, camera_id, frame_id, x + w / 2.0 AS px, CAST(y + h AS DOUBLE) AS py FROM det),
 to_ref AS (SELECT *, {_row(0)} / {_row(2)} AS qx, {_row(1)} / {_row(2)} AS qy FROM pt),
 edges AS (SELECT a.frame_id, a.det_id AS src, b.det_id AS ref, a.camera_id AS src_camera, b.camera_id AS ref_camera, sqrt(power(a.qx - b.px, 2) + power(a.qy - b.py, 2)) AS d, tau FROM to_ref a JOIN pairs ON a.camera_id = src_cam JOIN pt b ON b.frame_id = a.frame_id AND b.camera_id = ref_cam WHERE pair_f1 >= 0.5 AND tau > 0)"""


def _edges(spark, d, inclusive=True):
    props = detections(spark, d).withColumnRenamed("det_id", "proposal_id")
    return props, ma.edges(props, ma.strong_pairs(pairs(spark)), inclusive=inclusive)


@query(f"{EDGE_SQL} SELECT frame_id, src, ref, round(d, 6) AS distance, round(1 - d / tau, 6) AS score FROM edges WHERE d <= tau")
def q_cross_camera_edges(spark, d):
    return rounded(_edges(spark, d)[1].select("frame_id", "src", "ref", "distance", "score"), "distance", "score")


@query(f"{EDGE_SQL} SELECT src_camera, ref_camera, count(*) AS n FROM edges WHERE d < tau GROUP BY 1, 2")
def q_edges_strict(spark, d):
    return _edges(spark, d, False)[1].groupBy("src_camera", "ref_camera").agg(F.count("*").alias("n"))


CLUSTER_SQL = f"""WITH RECURSIVE {EDGE_SQL.removeprefix('WITH ')},
 ord AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY 1 - d / tau DESC, d, CAST(src AS VARCHAR), CAST(ref AS VARCHAR)) AS n FROM edges WHERE d <= tau),
 node AS (SELECT frame_id, list(det_id ORDER BY det_id) AS ids, list(camera_id ORDER BY det_id) AS cams FROM det GROUP BY 1),
 f AS (SELECT frame_id, 0 AS n, ids, cams, ids AS lab FROM node UNION ALL
 SELECT f.frame_id, f.n + 1, ids, cams, CASE WHEN a = b OR len(list_intersect([cams[i] FOR i IN range(1, len(ids) + 1) IF lab[i] = a], [cams[i] FOR i IN range(1, len(ids) + 1) IF lab[i] = b])) > 0 THEN lab ELSE [CASE WHEN l IN (a, b) THEN least(a, b) ELSE l END FOR l IN lab] END
 FROM (SELECT f.*, lab[list_position(ids, src)] AS a, lab[list_position(ids, ref)] AS b FROM f JOIN ord ON ord.frame_id = f.frame_id AND ord.n = f.n + 1) f),
 done AS (SELECT frame_id, unnest(ids) AS det_id, unnest(lab) AS lab FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC) AS k FROM f) WHERE k = 1),
 clus AS (SELECT frame_id, det_id, min(det_id) OVER (PARTITION BY frame_id, lab) AS cluster FROM done)"""


def _clusters(spark, d):
    props, e = _edges(spark, d)
    own = ma.clusters(props.withColumn("proposal_id", F.lpad(F.col("proposal_id").cast("string"), 12, "0")), e.withColumn("src", F.lpad(F.col("src").cast("string"), 12, "0")).withColumn("ref", F.lpad(F.col("ref").cast("string"), 12, "0")))
    return own.select("frame_id", F.col("proposal_id").cast("long").alias("det_id"), "camera_id", F.col("cluster").cast("long").alias("cluster"))


CLUSTER_SQL = CLUSTER_SQL.replace("CAST(src AS VARCHAR), CAST(ref AS VARCHAR)", "src, ref")


@query(f"{CLUSTER_SQL} SELECT frame_id, det_id, cluster FROM clus")
def q_clusters(spark, d):
    return _clusters(spark, d).select("frame_id", "det_id", "cluster")


OFFLINE_SQL = CLUSTER_SQL.replace("ORDER BY 1 - d / tau DESC, d, src, ref", "ORDER BY 1 - d / tau DESC, src_camera, ref_camera, src, ref").replace("FROM edges WHERE d <= tau)", "FROM edges WHERE d < tau)")


@query(f"{OFFLINE_SQL} SELECT frame_id, det_id, cluster FROM clus")
def q_offline_clusters(spark, d):
    """Clusters in the order of whole recordings; every frame of the events has more than one box."""
    props = detections(spark, d).withColumn("proposal_id", F.lpad(F.col("det_id").cast("string"), 12, "0"))
    own = ma.offline_clusters(props, pairs(spark))
    return own.select("frame_id", F.col("proposal_id").cast("long").alias("det_id"), F.col("cluster").cast("long").alias("cluster"))


@query(f"{WITH_DET} SELECT camera_id, frame_id, row_number() OVER (ORDER BY camera_id, frame_id) - 1 AS target FROM (SELECT DISTINCT camera_id, frame_id FROM det WHERE score > 0.6)")
def q_detect_targets(spark, d):
    from ..operators.enhance import detect_targets

    det = detections(spark, d)
    return detect_targets(pixel_frames(det), det.where("score > 0.6")).select("camera_id", "frame_id", "target")


@query(f"{WITH_DET}, f AS (SELECT DISTINCT frame_id, frame_id // 10 AS gop FROM det) SELECT gop, frame_id, max(frame_id) OVER (PARTITION BY gop) + 1 AS next_start FROM f")
def q_next_gop_start(spark, d):
    frames = detections(spark, d).select("frame_id").distinct().select(g.gop_of(F.col("frame_id"), 10, 0).alias("gop"), "frame_id")
    return pk.next_gop_start(frames).select("gop", "frame_id", "next_start")


@query(f"{WITH_DET} SELECT det_id, 'f' || lpad(CAST(frame_id AS VARCHAR), 6, '0') || '_' || camera_id || '_p' || lpad(CAST(row_number() OVER (PARTITION BY frame_id ORDER BY camera_id, det_id) - 1 AS VARCHAR), 4, '0') AS cluster_id FROM det")
def q_single_view_clusters(spark, d):
    return ma.single_view_clusters(detections(spark, d).withColumnRenamed("det_id", "proposal_id")).select(F.col("proposal_id").alias("det_id"), "cluster_id")


@query(f"{CLUSTER_SQL} SELECT size, count(*) AS clusters FROM (SELECT frame_id, cluster, count(*) AS size FROM clus GROUP BY 1, 2) GROUP BY 1")
def q_cluster_size_hist(spark, d):
    return ma.cluster_sizes(_clusters(spark, d))


@query(f"{CLUSTER_SQL}, l AS (SELECT c.*, det.user_id % 5 AS o, det.camera_id FROM clus c JOIN det USING (det_id)) SELECT CAST(sum(CASE WHEN a.cluster = b.cluster AND a.o = b.o THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN a.cluster = b.cluster AND a.o <> b.o THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN a.cluster <> b.cluster AND a.o = b.o THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM l a JOIN l b ON a.frame_id = b.frame_id AND a.det_id < b.det_id AND a.camera_id <> b.camera_id")
def q_pairwise_f1(spark, d):
    own = _clusters(spark, d).join(detections(spark, d).select("det_id", (F.col("user_id") % 5).alias("object_id")), "det_id")
    return ma.pairwise_counts(own.withColumnRenamed("det_id", "node"))


# ---------------------------------------------------------------- quality and ranking

QUALITY_SQL = f"""{CLUSTER_SQL}, raw AS (SELECT det.*, cluster, ln(w * h / 230400.0 + 1e-6) AS s, coalesce(CAST(sharpness AS DOUBLE), 0) AS c FROM det JOIN clus USING (det_id)),
 n AS (SELECT *, min(s) OVER k AS s0, max(s) OVER k AS s1, min(c) OVER k AS c0, max(c) OVER k AS c1, count(*) OVER k AS views FROM raw WINDOW k AS (PARTITION BY cluster)),
 q AS (SELECT *, greatest(0, least(1, 0.48 * CASE WHEN s1 - s0 <= 1e-6 THEN 0.5 ELSE (s - s0) / (s1 - s0) END + 0.52 * CASE WHEN c1 - c0 <= 1e-6 THEN 0.5 ELSE (c - c0) / (c1 - c0) END)) AS q FROM n),
 b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(q, 9), camera_id, det_id) AS r FROM q),
 i AS (SELECT *, greatest(0, 0.5 * (views - 1) / views + 0.5 * greatest(0, 1 - q)) / greatest(w * h / 65536.0, 1e-6) AS importance, frame_id // 10 AS gop FROM b WHERE r = 1)"""


def _quality(spark, d):
    views = detections(spark, d).join(_clusters(spark, d).select("frame_id", "det_id", "cluster"), ["frame_id", "det_id"])
    return ma.view_quality(views, ["frame_id", "cluster"])


def _ranked(spark, d):
    best = ma.best_views(_quality(spark, d).withColumn("q9", F.round("q", 9)).withColumnRenamed("q", "q_").withColumnRenamed("q9", "q"), ["frame_id", "cluster"], ["camera_id", "det_id"])
    return ma.rank(best.drop("q").withColumnRenamed("q_", "q")).withColumn("gop", F.expr("frame_id div 10"))


@query(f"{QUALITY_SQL} SELECT det_id, cluster, round(q, 6) AS q FROM q")
def q_view_quality(spark, d):
    return rounded(_quality(spark, d).select("det_id", "cluster", "q"), "q")


@query(f"{QUALITY_SQL} SELECT cluster, det_id, views AS n_views FROM i")
def q_best_view(spark, d):
    return _ranked(spark, d).select("cluster", "det_id", "n_views")


@query(f"{QUALITY_SQL} SELECT det_id, round(importance, 6) AS importance FROM i")
def q_importance(spark, d):
    return rounded(_ranked(spark, d).select("det_id", "importance"), "importance")


@query(f"{QUALITY_SQL} SELECT det_id, gop, round(CASE WHEN hi - lo <= 1e-6 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (importance - lo) / (hi - lo) END, 6) AS importance_norm FROM (SELECT *, min(importance) OVER (PARTITION BY gop) AS lo, max(importance) OVER (PARTITION BY gop) AS hi FROM i)")
def q_importance_norm(spark, d):
    return rounded(ma.normal_importance(_ranked(spark, d)).select("det_id", "gop", "importance_norm"), "importance_norm")


# ---------------------------------------------------------------- admission, packing, accounting


def _cands(spark, d):
    """Candidates of 40-frame groups: w and h four times as large for one in five, importance is the score."""
    det = detections(spark, d)
    big = F.when(F.col("det_id") % 5 == 0, 5).otherwise(1)
    own = det.select(F.expr("frame_id div 40").alias("gop"), F.lpad(F.col("det_id").cast("string"), 10, "0").alias("cluster_id"), F.col("camera_id").alias("cam_id"), "frame_id", (F.col("w") * big).cast("int").alias("w"), (F.col("h") * big).cast("int").alias("h"), F.col("score").alias("importance"))
    return own.withColumn("orig_bbox", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), "w", "h"))


CAND_SQL = f"""{WITH_DET}, c AS (SELECT frame_id // 40 AS gop, lpad(CAST(det_id AS VARCHAR), 10, '0') AS cluster_id, camera_id AS cam_id, frame_id, w * CASE WHEN det_id % 5 = 0 THEN 5 ELSE 1 END AS w, h * CASE WHEN det_id % 5 = 0 THEN 5 ELSE 1 END AS h, score AS importance FROM det),
 c2 AS (SELECT *, CASE WHEN w > 256 OR h > 256 THEN greatest(1, CAST(round_even(w * least(256.0 / w, 256.0 / h), 0) AS BIGINT)) * greatest(1, CAST(round_even(h * least(256.0 / w, 256.0 / h), 0) AS BIGINT)) ELSE w * h END AS est FROM c)"""


@query(
    f"""WITH RECURSIVE {CAND_SQL.removeprefix('WITH ')}, o AS (SELECT *, row_number() OVER (PARTITION BY gop ORDER BY importance DESC, w * h DESC, frame_id, cam_id, cluster_id) AS n FROM c2),
 f AS (SELECT gop, 0 AS n, CAST(0 AS BIGINT) AS used, FALSE AS took, CAST(NULL AS VARCHAR) AS cluster_id, CAST(0 AS BIGINT) AS est FROM (SELECT DISTINCT gop FROM o) UNION ALL
 SELECT f.gop, f.n + 1, used + CASE WHEN used = 0 OR used + o.est <= 8 * 65536 * 0.95 THEN o.est ELSE 0 END, used = 0 OR used + o.est <= 8 * 65536 * 0.95, o.cluster_id, o.est FROM f JOIN o ON o.gop = f.gop AND o.n = f.n + 1)
 SELECT gop, cluster_id, CAST(est AS DOUBLE) AS est_area, took AS admitted FROM f WHERE n > 0"""
)
def q_admission_area_fold(spark, d):
    return pk.admit_by_area(_cands(spark, d), 8).select("gop", "cluster_id", "est_area", "admitted")


@query()
def q_pack_objects(spark, d):
    return pk.admit_and_pack(_cands(spark, d), 8).select("gop", "cluster_id", "status", "bin_idx", "bx", "by", "bw", "bh")


def _tiles(spark, d):
    """Candidates of one size, 64 x 64, so that 16 fill a bin in a known order; orig_bbox is the detection's own size."""
    own = _cands(spark, d).drop("orig_bbox").withColumns({"w": F.lit(64), "h": F.lit(64)})
    sizes = detections(spark, d).select(F.lpad(F.col("det_id").cast("string"), 10, "0").alias("cluster_id"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h")).alias("orig_bbox"))
    return own.join(sizes, "cluster_id")


# The places that 64 x 64 patches take in a bin, in turn; the budget of 8 bins (0.95 of their area) holds 121 of them.
TILE_PLACES = [(0, 0), (64, 0), (128, 0), (192, 0), (0, 64), (0, 128), (0, 192), (64, 64), (128, 64), (192, 64), (64, 128), (64, 192), (128, 128), (192, 128), (128, 192), (192, 192)]
TILE_SQL = f"""{WITH_DET}, place AS (SELECT * FROM (VALUES {', '.join(f'({k}, {x}, {y})' for k, (x, y) in enumerate(TILE_PLACES))}) t(k, bx, "by")),
 o AS (SELECT det_id, frame_id // 40 AS gop, w, h, row_number() OVER (PARTITION BY frame_id // 40 ORDER BY score DESC, frame_id, camera_id, det_id) - 1 AS n FROM det),
 t AS (SELECT gop, lpad(CAST(det_id AS VARCHAR), 10, '0') AS cluster_id, w, h, CASE WHEN n < 121 THEN 'placed' ELSE 'deferred' END AS status, n < 121 AS selected, CASE WHEN n < 121 THEN n // 16 END AS bin_idx, CASE WHEN n < 121 THEN place.bx END AS bx, CASE WHEN n < 121 THEN place."by" END AS "by" FROM o JOIN place ON k = n % 16)"""


@query(f'{TILE_SQL} SELECT gop, cluster_id, status, selected, CAST(bin_idx AS INT) AS bin_idx, bx, "by" FROM t')
def q_pack_tiles(spark, d):
    return pk.admit_and_pack(_tiles(spark, d), 8).select("gop", "cluster_id", "status", "selected", "bin_idx", "bx", "by")


ACCOUNT_SQL = f"""{TILE_SQL}, a AS (SELECT gop, count(*) AS raw_count, CAST(sum(w * h) AS BIGINT) AS raw_area, count(*) FILTER (selected) AS selected_count, count(*) FILTER (NOT selected) AS budget_deferred_count, count(*) FILTER (status = 'placed') AS placed_count,
 CAST(coalesce(sum(w * h) FILTER (status = 'placed'), 0) AS BIGINT) AS placed_area, count(*) FILTER (status <> 'placed') AS deferred_count, CAST(coalesce(sum(w * h) FILTER (status <> 'placed'), 0) AS BIGINT) AS deferred_area, max(bin_idx) + 1 AS bins FROM t GROUP BY gop),
 acc AS (SELECT *, raw_count AS dedup_count, raw_area AS dedup_area, bins * 65536 AS canvas, CAST(ceil(raw_area / 65536.0) AS BIGINT) AS raw_bins, CAST(ceil(raw_area / 230400.0) AS BIGINT) AS raw_frames FROM a)"""


@query(f"{ACCOUNT_SQL} SELECT gop, TRUE AS cross_camera, 8 AS max_bins, raw_count, raw_area, dedup_count, dedup_area, selected_count, budget_deferred_count, placed_count, placed_area, deferred_count, deferred_area, bins, canvas, placed_area AS placed_pixels, round(placed_area / CAST(canvas AS DOUBLE), 6) AS fill_ratio, raw_bins, raw_bins AS dedup_bins, raw_frames, raw_frames AS dedup_frames FROM acc")
def q_gop_accounting(spark, d):
    """All metrics of each GOP, of the placements that packing made."""
    c = _tiles(spark, d)
    boxes = c.select("gop", "orig_bbox.w", "orig_bbox.h")
    return rounded(pk.gop_accounting(boxes, pk.admit_and_pack(c, 8), max_bins=8), "fill_ratio")


@query(f"{ACCOUNT_SQL} SELECT count(*) AS gops, CAST(sum(raw_area) AS BIGINT) AS raw_area, CAST(sum(dedup_area) AS BIGINT) AS dedup_area, CAST(sum(placed_area) AS BIGINT) AS placed_area, CAST(sum(bins) AS BIGINT) AS bins, CAST(sum(raw_bins) AS BIGINT) AS raw_bins_by_gop, CAST(ceil(sum(raw_area) / 65536.0) AS BIGINT) AS raw_bins_total, round(1 - CAST(sum(dedup_area) AS DOUBLE) / sum(raw_area), 6) AS area_reduction FROM acc")
def q_run_totals(spark, d):
    c = _tiles(spark, d)
    gops = pk.gop_accounting(c.select("gop", "orig_bbox.w", "orig_bbox.h"), pk.admit_and_pack(c, 8), max_bins=8)
    return rounded(pk.run_totals(gops).select("gops", "raw_area", "dedup_area", "placed_area", "bins", "raw_bins_by_gop", "raw_bins_total", "area_reduction"), "area_reduction")


GOPS_SQL = f"{WITH_DET}, f AS (SELECT DISTINCT frame_id FROM det), gp AS (SELECT frame_id // 10 AS gop, list(frame_id) AS frame_ids, max(frame_id) AS top, 4 * count(*) AS camera_frames, (frame_id // 10) % 7 + 1.0 AS cpu_seconds, (frame_id // 10) % 5 + 0.5 AS gpu_seconds FROM f GROUP BY frame_id // 10)"


@query(f"{GOPS_SQL}, m AS (SELECT max(top) - 99 AS cut FROM gp) SELECT count(*) AS gops, CAST(sum(len([x FOR x IN frame_ids IF x >= cut])) AS BIGINT) AS frames, CAST(sum(camera_frames) AS BIGINT) AS camera_frames, max(cut) AS cutoff, round(sum(cpu_seconds + gpu_seconds), 6) AS seconds, round(sum(len([x FOR x IN frame_ids IF x >= cut])) / sum(cpu_seconds + gpu_seconds), 6) AS video_fps FROM gp, m WHERE top >= cut")
def q_tail_throughput(spark, d):
    f = detections(spark, d).select("frame_id").distinct().withColumn("gop", F.expr("frame_id div 10"))
    gp = f.groupBy("gop").agg(F.collect_list("frame_id").alias("frame_ids"), (F.count("*") * 4).alias("camera_frames")).withColumn("cpu_seconds", F.col("gop") % 7 + 1.0).withColumn("gpu_seconds", F.col("gop") % 5 + 0.5)
    return rounded(rp.tail_throughput(gp, 100).select("gops", "frames", "camera_frames", "cutoff", "seconds", "video_fps"), "seconds", "video_fps")


@query(
    """WITH RECURSIVE lat AS (SELECT * FROM (VALUES (1, 1.0), (2, 1.8), (4, 3.3), (8, 7.5)) t(k, ms)),
 p AS (SELECT 0 AS total, CAST([] AS INTEGER[]) AS plan, 0.0::DOUBLE AS cost UNION ALL SELECT total + k, list_append(plan, k), cost + ms FROM p, lat WHERE total + k <= 13 AND (len(plan) = 0 OR k <= plan[len(plan)])),
 b AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY round(cost, 6), len(plan), plan DESC) AS r FROM p WHERE total > 0)
 SELECT total AS n_bins, CAST(plan AS VARCHAR) AS plan FROM b WHERE r = 1"""
)
def q_launch_plan(spark, d):
    lat = spark.createDataFrame([(1, 1.0), (2, 1.8), (4, 3.3), (8, 7.5)], "batch_size int, mean_ms double")
    plans = pk.launch_plans(spark.range(1, 14).select(F.col("id").cast("int").alias("n_bins")), lat)
    return plans.select("n_bins", F.concat(F.lit("["), F.array_join("plan", ", "), F.lit("]")).alias("plan"))


# ---------------------------------------------------------------- evaluation


def nms_sql(t: float, source: str = "det") -> str:
    return f"""nr AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY score DESC, det_id) AS n FROM {source}),
 nf AS (SELECT DISTINCT camera_id, frame_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(det_id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]) AS kept FROM {source} UNION ALL
 SELECT nf.camera_id, nf.frame_id, nf.n + 1, CASE WHEN len(list_filter(kept, lambda k: {iou_sql('k', 'nr')} >= {t})) > 0 THEN kept ELSE list_append(kept, struct_pack(det_id := nr.det_id, x := nr.x, y := nr.y, w := nr.w, h := nr.h)) END FROM nf JOIN nr ON nr.camera_id = nf.camera_id AND nr.frame_id = nf.frame_id AND nr.n = nf.n + 1),
 kept AS (SELECT camera_id, frame_id, unnest(kept).det_id AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY n DESC) AS r FROM nf) WHERE r = 1)"""


@query(f"WITH RECURSIVE {DET_SQL}, {nms_sql(0.1)} SELECT camera_id, frame_id, det_id FROM kept")
def q_nms(spark, d):
    return ev.suppress(with_corners(detections(spark, d)), 0.1).select("camera_id", "frame_id", "det_id")


def _counts(spark, d, keys="pred"):
    det = detections(spark, d)
    pred = ev.suppress(with_corners(det).where("score >= 0.3"), 0.5)
    return ev.match_counts(with_corners(ground_truth(det)).where("gt_id % 11 <> 0 or frame_id % 2 = 0"), pred, 0.5, keys)


MATCH_SQL = f"""WITH RECURSIVE {DET_SQL}, {GT_SQL}, hi AS (SELECT * FROM det WHERE score >= 0.3), {nms_sql(0.5, 'hi')},
 pr AS (SELECT d.*, row_number() OVER (PARTITION BY d.camera_id, d.frame_id ORDER BY score DESC, d.det_id) AS n FROM hi d JOIN kept USING (camera_id, frame_id, det_id)),
 g AS (SELECT * FROM gt WHERE gt_id % 11 <> 0 OR frame_id % 2 = 0),
 gl AS (SELECT camera_id, frame_id, list(struct_pack(gt_id := gt_id, x := x, y := y, w := w, h := h) ORDER BY gt_id) AS g FROM g GROUP BY 1, 2),
 m AS (SELECT gl.camera_id, gl.frame_id, CAST(0 AS BIGINT) AS n, g, CAST([] AS BIGINT[]) AS used FROM gl UNION ALL
 SELECT m.camera_id, m.frame_id, m.n + 1, g, CASE WHEN b IS NOT NULL AND b.v > 0 AND b.v >= 0.5 THEN list_append(used, -b.f) ELSE used END FROM (
 SELECT m.*, list_max(list_transform(list_filter(g, lambda k: NOT list_contains(used, k.gt_id)), lambda k: struct_pack(v := CASE WHEN {iou_sql('k', 'pr')} > 0 THEN {iou_sql('k', 'pr')} ELSE 0 END, f := -k.gt_id))) AS b FROM m JOIN pr ON pr.camera_id = m.camera_id AND pr.frame_id = m.frame_id AND pr.n = m.n + 1) m),
 tp AS (SELECT camera_id, frame_id, len(used) AS tp FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY n DESC) AS r FROM m) WHERE r = 1),
 np AS (SELECT camera_id, frame_id, count(*) AS p FROM pr GROUP BY 1, 2), ng AS (SELECT camera_id, frame_id, count(*) AS g FROM g GROUP BY 1, 2)"""


def counts_sql(join: str) -> str:
    return f"{MATCH_SQL}, k AS (SELECT camera_id, frame_id, coalesce(ng.g, 0) AS gt_boxes, coalesce(np.p, 0) AS pred_boxes, CASE WHEN ng.g IS NULL OR np.p IS NULL THEN 0 ELSE tp.tp END AS tp FROM ng {join} np USING (camera_id, frame_id) LEFT JOIN tp USING (camera_id, frame_id))"


ROLLUP_SQL = "SELECT coalesce(camera_id, 'overall') AS scope, count(*) AS frames, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pred_boxes - tp) AS BIGINT) AS fp, CAST(sum(gt_boxes - tp) AS BIGINT) AS fn, round(sum(tp) / nullif(sum(pred_boxes), 0), 6) AS precision, round(sum(tp) / nullif(sum(gt_boxes), 0), 6) AS recall, round(2.0 * sum(tp) / nullif(sum(pred_boxes) + sum(gt_boxes), 0), 6) AS f1 FROM k GROUP BY ROLLUP (camera_id)"


@query(counts_sql("RIGHT JOIN") + " SELECT camera_id, frame_id, gt_boxes, pred_boxes, tp FROM k")
def q_greedy_match(spark, d):
    return _counts(spark, d).select("camera_id", "frame_id", "gt_boxes", "pred_boxes", "tp")


def _rollup(spark, d, keys):
    return rounded(ev.evaluation(_counts(spark, d, keys)).select("scope", "frames", "tp", "fp", "fn", "precision", "recall", "f1"), "precision", "recall", "f1")


@query(counts_sql("RIGHT JOIN") + ROLLUP_SQL.replace("SELECT", " SELECT", 1))
def q_eval_rollup(spark, d):
    return _rollup(spark, d, "pred")


@query(counts_sql("FULL JOIN") + " " + ROLLUP_SQL)
def q_eval_full_outer(spark, d):
    return _rollup(spark, d, "all")


# ---------------------------------------------------------------- calibration

POINT_SQL = f"{WITH_DET}, pt AS (SELECT camera_id, frame_id, det_id // 4 AS object_id, x + w / 2.0 AS px, CAST(y + h AS DOUBLE) AS py, det_id FROM det)"
SAME_SQL = f"{POINT_SQL}, sd AS (SELECT a.camera_id AS src, b.camera_id AS ref, sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2)) AS d, a.object_id = b.object_id AS same, a.frame_id FROM pt a JOIN pt b ON a.frame_id = b.frame_id AND a.camera_id < b.camera_id)"


def _points(spark, d):
    return cal.tracks(detections(spark, d).withColumn("object_id", F.expr("det_id div 4")))


def _same_diff(spark, d):
    return cal.same_diff_pairs(_points(spark, d), [p[:2] for p in PAIRS])


@query(f"{POINT_SQL} SELECT a.frame_id, a.object_id, a.px AS sx, b.px AS rx FROM pt a JOIN pt b ON a.frame_id = b.frame_id AND a.object_id = b.object_id WHERE a.camera_id = 'c001' AND b.camera_id = 'c002'")
def q_same_id_join(spark, d):
    return cal.correspondences(_points(spark, d), "c001", "c002").select("frame_id", "object_id", "sx", "rx")


@query(f"{SAME_SQL} SELECT src, ref, same, count(*) AS n, round(sum(d), 3) AS total FROM sd GROUP BY 1, 2, 3")
def q_same_diff(spark, d):
    return _same_diff(spark, d).groupBy("src", "ref", "same").agg(F.count("*").alias("n"), F.round(F.sum("d"), 3).alias("total"))


@query(f"{SAME_SQL} SELECT src, ref, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95 FROM sd GROUP BY 1, 2")
def q_reproj_stats(spark, d):
    return rounded(cal.error_stats(_same_diff(spark, d), "d", ("src", "ref")), "mean", "median", "p90", "p95")


@query(f"{WITH_DET} SELECT det_id, round(row_number() OVER (PARTITION BY camera_id ORDER BY score, det_id) / CAST(count(*) OVER (PARTITION BY camera_id) AS DOUBLE), 6) AS cdf FROM det")
def q_error_cdf(spark, d):
    return rounded(cal.error_cdf(detections(spark, d), "score", "det_id", "camera_id").select("det_id", "cdf"), "cdf")


@query(f"{SAME_SQL}, b AS (SELECT same, least(CAST(floor(d / (200.0 / 59)) AS INTEGER), 58) AS bin, count(*) AS n FROM sd WHERE d <= 200 GROUP BY 1, 2) SELECT same, bin, n, round(n / (sum(n) OVER (PARTITION BY same) * (200.0 / 59)), 6) AS density FROM b")
def q_distance_hist(spark, d):
    return rounded(cal.distance_histogram(_same_diff(spark, d)), "density")


SWEEP_SQL = f"{SAME_SQL}, s AS (SELECT src, ref, i, i * (200.0 / 199) AS tau, count(*) FILTER (same AND d <= i * (200.0::DOUBLE / 199)) AS tp, count(*) FILTER (NOT same AND d <= i * (200.0::DOUBLE / 199)) AS fp, count(*) FILTER (same) AS total FROM sd, range(200) r(i) GROUP BY 1, 2, 3), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 1.0 END AS p, tp / CAST(total AS DOUBLE) AS r FROM s), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)"


@query(f"{SWEEP_SQL} SELECT src, ref, CAST(i AS INTEGER) AS i, tp, fp, total - tp AS fn, round(f1, 6) AS f1 FROM f")
def q_tau_sweep(spark, d):
    return rounded(cal.tau_sweep(_same_diff(spark, d)).select("src", "ref", "i", "tp", "fp", "fn", "f1"), "f1")


@query(f"{SWEEP_SQL} SELECT src, ref, CAST(i AS INTEGER) AS i, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY src, ref ORDER BY round(f1, 9) DESC, i) AS k FROM f) WHERE k = 1")
def q_best_tau(spark, d):
    sweep = cal.tau_sweep(_same_diff(spark, d)).withColumn("f1", F.round("f1", 9))
    return rounded(cal.best_tau(sweep).select("src", "ref", "i", "f1"), "f1")


PRIOR_SQL = f"{WITH_GT}, b AS (SELECT camera_id, least(17, greatest(0, CAST(floor((y + h) / 20.0) AS INTEGER))) AS y_bin, w, h, w * h AS a FROM gt WHERE w > 0 AND h > 0 AND (y + h) % 60 >= 20), f AS (SELECT camera_id, y_bin AS have, quantile_cont(w, 0.5) AS mw, quantile_cont(h, 0.5) AS mh, quantile_cont(a, 0.9) AS qa FROM b GROUP BY 1, 2 HAVING count(*) >= 5)"


@query(f"{PRIOR_SQL} SELECT camera_id, CAST(y_bin AS INTEGER) AS y_bin, have = y_bin AS has_data, round(mw, 6) AS median_w, round(mh, 6) AS median_h, round(qa, 6) AS q90_a FROM (SELECT f.*, y_bin, row_number() OVER (PARTITION BY camera_id, y_bin ORDER BY abs(have - y_bin), have) AS k FROM f, range(18) r(y_bin)) WHERE k = 1")
def q_prior_nn_fill(spark, d):
    own = ground_truth(detections(spark, d)).where((F.col("y") + F.col("h")) % 60 >= 20)
    return rounded(cal.size_priors(own).select("camera_id", "y_bin", "has_data", "median_w", "median_h", "q90_a"), "median_w", "median_h", "q90_a")


LOOKUP_SQL = f"""{WITH_GT}, b AS (SELECT camera_id, least(17, greatest(0, CAST(floor((y + h) / 20.0) AS INTEGER))) AS y_bin, w, h, w * h AS a FROM gt),
 f AS (SELECT camera_id, y_bin AS have, quantile_cont(w, 0.5) AS mw, quantile_cont(a, 0.5) AS ma, quantile_cont(w, 0.9) AS qw, quantile_cont(a, 0.9) AS qa FROM b GROUP BY 1, 2 HAVING count(*) >= 5),
 p AS (SELECT * FROM (SELECT f.*, y_bin, row_number() OVER (PARTITION BY camera_id, y_bin ORDER BY abs(have - y_bin), have) AS k FROM f, range(18) r(y_bin)) WHERE k = 1),
 j AS (SELECT det_id, w > 1.2::DOUBLE * mw OR w * h > 1.5::DOUBLE * ma AS by_median, w > qw OR w * h > qa AS by_q90 FROM (SELECT *, least(17, greatest(0, CAST(floor((y + h) / 20.0) AS INTEGER))) AS y_bin FROM det) d JOIN p USING (camera_id, y_bin))
 SELECT det_id, by_median, by_q90 FROM j WHERE by_median OR by_q90"""


@query(LOOKUP_SQL)
def q_prior_lookup(spark, d):
    """Boxes that the sizes known for their place make candidates for a split, by median and by 0.9 quantile."""
    import pyarrow as pa

    from ..operators.enhance import with_priors
    from ..operators.images import prior_of, triggered

    det = detections(spark, d)
    own = with_priors(det.select("camera_id", "det_id", "x", "y", "w", "h"), cal.size_priors(ground_truth(det)))
    settings = [ProposalSettings(split_gamma_width=1.2, split_gamma_area=1.5, split_by_q90=q) for q in (False, True)]

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            found = [[triggered(box, "h", s, prior_of(box, r["priors"])) for r in rows for box in [(r["x"], r["y"], r["w"], r["h"])]] for s in settings]
            yield pa.RecordBatch.from_arrays([b["det_id"], *(pa.array(f, pa.bool_()) for f in found)], names=["det_id", "by_median", "by_q90"])

    return own.where("priors IS NOT NULL").mapInArrow(run, "det_id long, by_median boolean, by_q90 boolean").where("by_median OR by_q90")


@query(
    f"""WITH RECURSIVE {POINT_SQL.removeprefix('WITH ')}, b AS (SELECT camera_id, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM pt GROUP BY 1),
 co AS (SELECT camera_id, corner, CASE WHEN corner % 2 = 0 THEN x0 ELSE x1 END AS cx, CASE WHEN corner < 2 THEN y0 ELSE y1 END AS cy FROM b, range(4) r(corner)),
 rk AS (SELECT camera_id, corner, det_id, row_number() OVER (PARTITION BY camera_id, corner ORDER BY power(px - cx, 2) + power(py - cy, 2), det_id) AS r FROM pt JOIN co USING (camera_id)),
 nr AS (SELECT camera_id, corner, list(det_id ORDER BY r) AS ids FROM rk WHERE r <= 4 GROUP BY 1, 2),
 f AS (SELECT camera_id, CAST(-1 AS BIGINT) AS corner, CAST([] AS BIGINT[]) AS got FROM b UNION ALL SELECT f.camera_id, f.corner + 1, list_append(got, list_filter(ids, lambda v: NOT list_contains(got, v))[1]) FROM f JOIN nr ON nr.camera_id = f.camera_id AND nr.corner = f.corner + 1)
 SELECT camera_id AS pair, CAST(corner AS INTEGER) AS corner, got[len(got)] AS idx FROM f WHERE corner >= 0"""
)
def q_four_points(spark, d):
    own = detections(spark, d).select(F.col("camera_id").alias("pair"), F.col("det_id").alias("idx"), (F.col("x") + F.col("w") / 2.0).alias("sx"), (F.col("y") + F.col("h")).cast("double").alias("sy"))
    return cal.four_points(own).select("pair", "corner", "idx")


# ---------------------------------------------------------------- detector output


ANCHOR_SQL = "a AS (SELECT vec_id, vec_id % 5 AS image, CAST(list_max(embedding) AS DOUBLE) AS score, list_position(embedding, list_max(embedding)) - 1 AS label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)"


def _anchors(spark, d):
    own = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null and size(embedding) > 0")
    label, score = g_anchor(F.col("embedding"))
    return own.select("vec_id", (F.col("vec_id") % 5).alias("image"), score.cast("double").alias("score"), label.alias("label"))


g_anchor = ev.anchor_class


@query(f"WITH {ANCHOR_SQL} SELECT vec_id, CAST(label AS INTEGER) AS label, round(score, 6) AS score FROM a")
def q_anchor_argmax(spark, d):
    return rounded(_anchors(spark, d).select("vec_id", "label", "score"), "score")


@query(f"WITH {ANCHOR_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, vec_id) AS r FROM a) SELECT vec_id, image FROM t WHERE r <= 20 AND score >= 0.3 AND label IN (2, 5, 7, 11, 13, 17, 19, 23, 29, 31)")
def q_topk_then_filter(spark, d):
    return ev.top_then_filter(_anchors(spark, d), "image", "vec_id", 20, 0.3, [2, 5, 7, 11, 13, 17, 19, 23, 29, 31]).select("vec_id", "image")


@query(f"WITH {ANCHOR_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, vec_id) AS r FROM a WHERE score >= 0.3 AND label IN (2, 5, 7, 11, 13, 17, 19, 23, 29, 31)) SELECT vec_id, image FROM t WHERE r <= 20")
def q_filter_then_topk(spark, d):
    return ev.filter_then_top(_anchors(spark, d), "image", "vec_id", 20, 0.3, [2, 5, 7, 11, 13, 17, 19, 23, 29, 31]).select("vec_id", "image")


@query(f"{WITH_GT} SELECT a.gt_id AS obj_id, round(coalesce(max(b.score), 0), 6) AS confidence FROM gt a LEFT JOIN det b ON a.camera_id = b.camera_id AND a.frame_id = b.frame_id AND {iou_sql('a', 'b')} > 0.3 GROUP BY 1")
def q_best_confidence(spark, d):
    det = detections(spark, d)
    return rounded(ev.best_confidence(with_corners(ground_truth(det)).withColumnRenamed("gt_id", "obj_id"), with_corners(det)), "confidence")


# ---------------------------------------------------------------- artifacts and studies


@query(f"{WITH_DET} SELECT camera_id, count(*) AS n, CAST(sum(x + y) AS BIGINT) AS checksum, min('{{}}' || lpad(CAST(frame_id AS VARCHAR), 6, '0')) AS first FROM det GROUP BY 1".replace("'{}' || ", ""))
def q_artifact_roundtrip(spark, d):
    from ..sources.readers import parse_proposals
    from ..sources.sinks import proposal_payload

    box = F.struct(*(F.col(c).cast("int").alias(c) for c in "xywh"))
    own = detections(spark, d).select(F.lit("").alias("proposal_id"), "camera_id", "frame_id", box.alias("bbox"), "score", F.col("frame_id").alias("source_frame"))
    read = parse_proposals(proposal_payload(own))
    return read.groupBy("camera_id").agg(F.count("*").alias("n"), F.sum(F.col("bbox.x").cast("long") + F.col("bbox.y")).alias("checksum"), F.min(F.substring(F.split("proposal_id", "_")[1], 2, 6)).alias("first"))


@query(f"{WITH_DET}, p AS (SELECT frame_id, user_id % 3 AS o, count(*) AS v, sum(w * h) AS a, max(w * h) AS m FROM det GROUP BY 1, 2) SELECT v AS cam_num, count(*) AS objects, CAST(sum(v) AS BIGINT) AS all_count, count(*) AS max_count, CAST(sum(a) AS BIGINT) AS all_area, CAST(sum(m) AS BIGINT) AS max_area FROM p GROUP BY 1")
def q_max_view_saving(spark, d):
    own = detections(spark, d).select("frame_id", (F.col("user_id") % 3).alias("object_id"), "w", "h", F.col("det_id").cast("string").alias("path"), F.col("det_id").alias("nth"))
    return rp.max_view_saving(own).select("cam_num", "objects", "all_count", "max_count", "all_area", "max_area")


@query(f"{WITH_DET}, m AS (SELECT unnest(['bilinear', 'object', 'full']) AS method, unnest([score * 0.5, score * 0.9, score]) AS v FROM det) SELECT method, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM m GROUP BY 1")
def q_method_confidence_stats(spark, d):
    own = detections(spark, d).select((F.col("score") * 0.5).alias("bilinear"), (F.col("score") * 0.9).alias("object"), F.col("score").alias("full"))
    return rounded(rp.method_stats(own, ["bilinear", "object", "full"]), "mean", "std")


@query("WITH r AS (SELECT l_linenumber AS batch, CAST(l_quantity AS DOUBLE) AS ms FROM lineitem) SELECT batch, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, min(ms) AS min, max(ms) AS max, round(avg(ms) / batch, 6) AS per_item, round(1000 * batch / avg(ms), 4) AS throughput FROM r GROUP BY 1")
def q_latency_stats(spark, d):
    own = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("batch"), F.col("l_quantity").cast("double").alias("ms"))
    return rounded(rp.latency_stats(own), "mean", "median", "p90", "p95", "per_item").withColumn("throughput", F.round("throughput", 4))


@query(f"{WITH_DET}, s AS (SELECT frame_id // 10 AS gop, camera_id, sum(w) AS decode, sum(h) AS proposal, sum(w + h) AS total FROM det GROUP BY 1, 2) SELECT gop, CAST(max(decode) AS BIGINT) AS decode, CAST(sum(proposal) AS BIGINT) AS proposal, CAST(max(total) AS BIGINT) AS total, (list(camera_id ORDER BY total DESC, camera_id))[1] AS bottleneck FROM s GROUP BY 1")
def q_bottleneck_camera(spark, d):
    own = detections(spark, d).groupBy(F.expr("frame_id div 10").alias("gop"), "camera_id").agg(F.sum("w").alias("decode"), F.sum("h").alias("proposal"), F.sum(F.col("w") + F.col("h")).alias("total"))
    return rp.worker_stats(own)


@query(f"{WITH_DET}, e AS (SELECT CASE WHEN det_id % 2 = 0 THEN 'h' ELSE 'v' END AS axis, CASE det_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'abort_no_peak' ELSE 'abort_too_small' END AS status FROM det) SELECT axis, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'abort_no_peak') AS abort_no_peak, count(*) FILTER (status = 'abort_too_small') AS abort_too_small FROM e GROUP BY 1")
def q_split_status_pivot(spark, d):
    k = F.col("det_id") % 3
    own = detections(spark, d).select(F.when(F.col("det_id") % 2 == 0, "h").otherwise("v").alias("axis"), F.when(k == 0, "success").when(k == 1, "abort_no_peak").otherwise("abort_too_small").alias("status"))
    return rp.split_diagnostics(own, ["success", "abort_no_peak", "abort_too_small"])


@query(f"{WITH_GT}, a AS (SELECT DISTINCT camera_id, frame_id FROM det WHERE score > 0.8), b AS (SELECT DISTINCT camera_id, frame_id FROM gt WHERE gt_id % 5 = 0) SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both_sides, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS missed")
def q_key_union_intersect_anti(spark, d):
    det = detections(spark, d)
    a = det.where("score > 0.8").select("camera_id", "frame_id").distinct()
    b = ground_truth(det).where("gt_id % 5 = 0").select("camera_id", "frame_id").distinct()
    tagged = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("camera_id", "frame_id").agg(F.sum("s").alias("s"))
    return tagged.agg(F.count("*").alias("either"), F.count_if(F.col("s") == 3).alias("both_sides"), F.count_if(F.col("s") == 2).alias("missed"))


@query(f"{WITH_DET}, c AS (SELECT frame_id, list(DISTINCT camera_id) FILTER (score > 0.7) AS p, list(DISTINCT camera_id) FILTER (score < 0.2) AS q FROM det GROUP BY 1) SELECT frame_id, len(list_intersect(p, q)) > 0 AS met FROM c WHERE p IS NOT NULL AND q IS NOT NULL")
def q_disjoint_arrays(spark, d):
    own = detections(spark, d).groupBy("frame_id").agg(F.collect_set(F.when(F.col("score") > 0.7, F.col("camera_id"))).alias("p"), F.collect_set(F.when(F.col("score") < 0.2, F.col("camera_id"))).alias("q"))
    return own.where("size(p) > 0 and size(q) > 0").select("frame_id", F.arrays_overlap("p", "q").alias("met"))


@query(f"{WITH_DET} SELECT frame_id // 10 AS gop, count(*) AS n FROM det GROUP BY 1")
def q_stream_gop_window(spark, d):
    """Streams the events' files to their end through event-time windows and reads the sink."""
    from .streams import gop_windows

    return gop_windows(spark, d)


@query(f"{WITH_DET}, f AS (SELECT camera_id, frame_id, CAST(sum(w) % 200 AS BIGINT) AS v FROM det GROUP BY 1, 2), s AS (SELECT *, lag(v) OVER (PARTITION BY camera_id ORDER BY frame_id) AS p FROM f) SELECT camera_id, count(*) AS frames, count(*) FILTER (p IS NOT NULL AND abs(v - p) > 25) AS moved FROM s GROUP BY 1")
def q_stream_absdiff_state(spark, d):
    """A one-pixel camera a stream: running background with a rate of one, kept as state."""
    from .streams import absdiff_state

    return absdiff_state(spark, d)
