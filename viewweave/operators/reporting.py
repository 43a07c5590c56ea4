"""Run accounting and the tables behind the studies' charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TAIL_FRAMES


def tail_throughput(gops: DataFrame, tail: int = TAIL_FRAMES) -> DataFrame:
    """Frames of the last `tail` ones over the whole seconds of the GOPs that reach into them; gops: gop, frame_ids, camera_frames, cpu_seconds, gpu_seconds."""
    top = gops.select(F.max(F.array_max("frame_ids")).alias("m"))
    cut = gops.crossJoin(F.broadcast(top)).withColumn("cutoff", F.col("m") - tail + 1).where(F.array_max("frame_ids") >= F.col("cutoff"))  # one row
    frames = F.size(F.filter("frame_ids", lambda f: f >= F.col("cutoff")))
    out = cut.agg(F.count("*").alias("gops"), F.sum(frames).alias("frames"), F.sum("camera_frames").alias("camera_frames"), F.max("cutoff").alias("cutoff"), F.sum("cpu_seconds").alias("cpu_seconds"), F.sum("gpu_seconds").alias("gpu_seconds"))
    s = F.col("cpu_seconds") + F.col("gpu_seconds")
    return out.withColumn("seconds", s).withColumn("video_fps", F.when(s > 0, F.col("frames") / s).otherwise(0.0))


def worker_stats(stats: DataFrame) -> DataFrame:
    """Per GOP: decoding and totals by the slowest camera, the rest summed, and the slowest camera (first of equals)."""
    slow = F.max(F.struct("total", F.col("nth").alias("n"), "camera_id"))
    return stats.withColumn("nth", -F.dense_rank().over(Window.partitionBy("gop").orderBy("camera_id"))).groupBy("gop").agg(F.max("decode").alias("decode"), F.sum("proposal").alias("proposal"), F.max("total").alias("total"), slow.alias("s")).select("gop", "decode", "proposal", "total", F.col("s.camera_id").alias("bottleneck"))


def gop_summary(gops: DataFrame) -> DataFrame:
    """frames per second of a GOP and its one-line text."""
    ms = F.col("cpu_ms") + F.col("gpu_ms")
    out = gops.withColumn("fps", F.when(ms > 0, F.col("frames") * 1000.0 / ms).otherwise(0.0))
    return out.withColumn("line", F.format_string("GOP %d: %d frames, cpu %.1f ms, gpu %.1f ms, %.2f fps", "gop", "frames", "cpu_ms", "gpu_ms", "fps"))


def latency_stats(runs: DataFrame, key: str = "batch", value: str = "ms") -> DataFrame:
    """mean, median, p90, p95, min, max, per item and throughput of timed runs by batch size."""
    q = F.expr(f"percentile({value}, array(0.5D, 0.9D, 0.95D))")
    out = runs.groupBy(key).agg(F.avg(value).alias("mean"), q.alias("_q"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(key, "mean", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p90"), F.col("_q")[2].alias("p95"), "min", "max", (F.col("mean") / F.col(key)).alias("per_item"), F.when(F.col("mean") > 0, 1000.0 * F.col(key) / F.col("mean")).otherwise(0.0).alias("throughput"))


def method_stats(results: DataFrame, methods: list[str]) -> DataFrame:
    """Mean and population deviation of each method's column."""
    long = results.unpivot([], methods, "method", "value")
    return long.groupBy("method").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def max_view_saving(targets: DataFrame) -> DataFrame:
    """By number of cameras: patches when all views are enhanced, and when only the largest is (all, for a single camera)."""
    per = targets.groupBy("frame_id", "object_id").agg(F.count("*").alias("views"), F.sum(F.col("w") * F.col("h")).alias("all_area"), F.max(F.col("w") * F.col("h")).alias("max_area"), F.max_by("path", F.struct(F.col("w") * F.col("h"), -F.col("nth"))).alias("best"))
    return per.groupBy(F.col("views").alias("cam_num")).agg(F.count("*").alias("objects"), F.sum("views").alias("all_count"), F.sum(F.when(F.col("views") == 1, F.col("views")).otherwise(1)).alias("max_count"), F.sum("all_area").alias("all_area"), F.sum("max_area").alias("max_area"))


def examples(rows: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows in an order, for a look at them."""
    return rows.orderBy(*order).limit(n)


def split_diagnostics(events: DataFrame, statuses: list[str]) -> DataFrame:
    """Counts by axis and status, a column a status."""
    return events.groupBy("axis").pivot("status", statuses).count().fillna(0)


def cyclic_batches(frames: DataFrame, batch: int, repeats: int) -> DataFrame:
    """(repeat, slot, frame) of batches that go round the frames (nth from 0); the count is one row."""
    spark = frames.sparkSession
    n = frames.agg(F.count("*").alias("n"))
    slots = spark.range(repeats * batch).select((F.col("id") / batch).cast("long").alias("repeat"), (F.col("id") % batch).alias("slot"), "id").crossJoin(F.broadcast(n))
    return slots.where("n > 0").withColumn("nth", F.pmod("id", "n")).join(frames, "nth").select("repeat", "slot", "frame")
