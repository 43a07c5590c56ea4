"""Relations derived from the driver's events table, for queries; the SQL form of the same relations serves the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POINTS

# Pair F1 scores with thresholds of the demonstration calibration.
PAIRS = [("c001", "c002", 120.0, 0.2323), ("c001", "c003", 46.0, 0.5), ("c001", "c004", 120.0, 0.3671), ("c002", "c003", 46.0, 0.2993), ("c002", "c004", 46.0, 0.963), ("c003", "c004", 120.0, 0.7654)]
HULL = [(40.0, 40.0), (600.0, 30.0), (620.0, 330.0), (300.0, 350.0), (30.0, 300.0)]

H = [[1.0, 0.02, 3.0], [-0.01, 1.0, -2.0], [0.00002, 0.00001, 1.0]]

DET_SQL = """det AS (SELECT event_id AS det_id, 'c00' || CAST(event_id % 4 + 1 AS VARCHAR) AS camera_id, event_id // 16 AS frame_id,
 (event_id * 37 + user_id * 11) % 560 AS x, (event_id * 53 + user_id * 7) % 300 AS y, 24 + user_id % 56 AS w, 20 + event_id % 36 AS h,
 CAST((event_id * 29 + user_id * 13) % 1000 AS DOUBLE) / 1000.0 AS score,
 CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 5 WHEN 'purchase' THEN 7 WHEN 'signup' THEN 0 ELSE 1 END AS label, value AS sharpness, user_id FROM events)"""
GT_SQL = "gt AS (SELECT det_id AS gt_id, camera_id, frame_id, x + det_id % 7 - 3 AS x, y + det_id % 5 - 2 AS y, w, h, det_id AS object_id FROM det WHERE det_id % 9 <> 0)"
PAIRS_SQL = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST({t} AS DOUBLE), CAST({f} AS DOUBLE))" for a, b, t, f in PAIRS) + ") p(src_cam, ref_cam, tau, pair_f1))"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 5).when(F.col("event_type") == "purchase", 7).when(F.col("event_type") == "signup", 0).otherwise(1)
    own = spark.read.parquet(f"{sf_dir}/events.parquet")
    return own.select(
        e.alias("det_id"), F.concat(F.lit("c00"), (e % 4 + 1).cast("string")).alias("camera_id"), F.expr("event_id div 16").alias("frame_id"), ((e * 37 + u * 11) % 560).alias("x"), ((e * 53 + u * 7) % 300).alias("y"), (u % 56 + 24).alias("w"), (e % 36 + 20).alias("h"),
        (((e * 29 + u * 13) % 1000).cast("double") / 1000.0).alias("score"), kind.cast("int").alias("label"), F.col("value").alias("sharpness"), u.alias("user_id"),
    )


def pixel_frames(det: DataFrame) -> DataFrame:
    """A frame of one grey pixel for each camera and frame: the sum of its boxes' widths, modulo 200."""
    own = det.groupBy("camera_id", "frame_id").agg((F.sum("w") % 200).alias("v"))
    return own.select("camera_id", "frame_id", F.lit(1).alias("height"), F.lit(1).alias("width"), F.lit(3).alias("n_channels"), F.unhex(F.repeat(F.lpad(F.hex("v"), 2, "0"), 3)).alias("data"))


def ground_truth(det: DataFrame) -> DataFrame:
    d = F.col("det_id")
    return det.where(d % 9 != 0).select(d.alias("gt_id"), "camera_id", "frame_id", (F.col("x") + d % 7 - 3).alias("x"), (F.col("y") + d % 5 - 2).alias("y"), "w", "h", d.alias("object_id"))


def with_corners(df: DataFrame) -> DataFrame:
    d = lambda c: c.cast("double")
    return df.withColumn("x1", d(F.col("x"))).withColumn("y1", d(F.col("y"))).withColumn("x2", d(F.col("x") + F.col("w"))).withColumn("y2", d(F.col("y") + F.col("h")))


def pairs(spark: SparkSession, hull: bool = False) -> DataFrame:
    own = [{"x": x, "y": y} for x, y in HULL] if hull else None
    return spark.createDataFrame([(a, b, H, own, None, t, f, 20.0) for a, b, t, f in PAIRS], f"src_cam string, ref_cam string, H array<array<double>>, hull_src {POINTS}, hull_ref {POINTS}, tau double, pair_f1 double, margin double")
