"""Writers of artifacts, run outputs and metric tables. The default store is parquet; JSON and CSV are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rescale_half_even


FRAMES_PER_DOCUMENT = 1000


def proposal_payload(props: DataFrame, cameras: list[str] | None = None) -> DataFrame:
    """The proposal artifact as JSON texts, one a camera and range of FRAMES_PER_DOCUMENT frames; a declared camera without rows has an empty one."""
    record = F.struct("proposal_id", "camera_id", "frame_id", F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h").alias("bbox"), "score", "source_frame")
    frames = props.groupBy("camera_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("proposal_id", record.alias("r")))).alias("rs"))
    part = F.floor(F.col("frame_id") / F.lit(FRAMES_PER_DOCUMENT)).alias("part")
    cams = frames.groupBy("camera_id", part).agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame_id").cast("string"), F.transform("rs", lambda x: x.r)))).alias("f"))
    if cameras:
        declared = props.sparkSession.createDataFrame([(c,) for c in cameras], "camera_id string")
        cams = cams.join(declared, "camera_id", "full").withColumn("f", F.coalesce("f", F.create_map().cast(cams.schema["f"].dataType)))
    return cams.select(F.create_map("camera_id", "f").alias("cameras")).select(F.to_json(F.struct(F.lit(1).alias("version"), "cameras")).alias("value"))


def write_proposals(props: DataFrame, path: str, as_json: bool = False, cameras: list[str] | None = None) -> None:
    if as_json:
        # each document is a file of its own, as readers take a file as one document
        proposal_payload(props, cameras).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    else:
        props.write.mode("overwrite").partitionBy("camera_id").parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The calibration artifact: cameras and pairs as one JSON document (a few camera pairs)."""
    hull = lambda c: F.transform(c, lambda p: F.array(p.x, p.y)).alias(c)
    rows = F.array_sort(F.collect_list(F.struct("src_cam", "ref_cam", "H", hull("hull_src"), hull("hull_ref"), "tau", "pair_f1", "margin")))
    doc = pairs.agg(rows.alias("pairs"), F.array_sort(F.array_union(F.collect_set("src_cam"), F.collect_set("ref_cam"))).alias("cameras"))
    doc.select(F.to_json(F.struct(F.lit(1).alias("version"), "cameras", "pairs"))).write.mode("overwrite").text(path)


def pair_report(pairs: DataFrame) -> DataFrame:
    """The calibration's text report: a line a camera pair with its best distance and F1, in order of cameras."""
    line = F.format_string("%s -> %s: tau %.4f px, F1 %.4f", "src_cam", "ref_cam", F.col("tau").cast("double"), F.col("pair_f1").cast("double"))
    return pairs.orderBy("src_cam", "ref_cam").select(line.alias("value"))


def write_matrices(pairs: DataFrame, path: str) -> None:
    """The homographies alone (a few camera pairs), and the text report beside them."""
    pairs.select("src_cam", "ref_cam", "H").write.mode("overwrite").parquet(f"{path}/homographies")
    pair_report(pairs).coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_detections(records: DataFrame, path: str, as_json: bool = False) -> None:
    (records.write.mode("overwrite").json if as_json else records.write.mode("overwrite").parquet)(path)


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Metrics as text with six decimals, the overall row first, then cameras."""
    texts = [F.format_string("%.6f", c).alias(c) for c in ("precision", "recall", "f1")]
    return metrics.orderBy(F.col("scope") != "overall", "scope").select("scope", "frames", "tp", "fp", "fn", *texts)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A CSV file of one row a camera."""
    metric_rows(metrics).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_benchmark(stats: DataFrame, path: str) -> None:
    """The rows of reporting.latency_stats() by batch, as one CSV file and as one JSON document beside it."""
    rows = stats.orderBy(stats.columns[0])
    rows.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    doc = rows.agg(F.array_sort(F.collect_list(F.struct(*stats.columns))).alias("rows"))  # a row a batch size
    doc.select(F.to_json(F.struct("rows"))).write.mode("overwrite").text(f"{path}/json")


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def rescaled_gt_lines(lines: DataFrame, x_ratio: float = 640 / 1920, y_ratio: float = 360 / 1080) -> DataFrame:
    """Ground-truth lines with boxes scaled (halves to even); short lines pass, blank ones go."""
    f = F.split("value", ",")
    scaled = [rescale_half_even(F.trim(f[i]).try_cast("double"), r).cast("string") for i, r in ((2, x_ratio), (3, y_ratio), (4, x_ratio), (5, y_ratio))]
    whole = F.concat_ws(",", f[0], f[1], *scaled, F.when(F.size(f) > 6, F.array_join(F.slice(f, 7, 1000), ",")))
    return lines.where(F.trim("value") != "").select(F.when(F.size(f) < 6, F.col("value")).otherwise(whole).alias("value"))
