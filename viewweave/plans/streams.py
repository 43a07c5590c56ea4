"""Streaming queries: run to their end over files; their results are what the sink holds, and nothing else."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProposalSettings
from ..operators.enhance import FOREGROUND
from ..schemas import FRAMES
from ..streaming.background import foreground_stream, gop_counts, run_to_end, with_event_time
from .fixtures import detections, pixel_frames


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weave")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def gop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by GOP, as windows that the watermark closed. A last row a GOP later than all others closes theirs; its own stays open."""
    at = _folder(spark)
    frames = detections(spark, sf_dir).select("det_id", (F.col("frame_id") + 1).alias("frame_id"))
    closing = frames.agg(F.max("frame_id").alias("top")).where("top IS NOT NULL").select(F.lit(-1).cast("long").alias("det_id"), (F.col("top") + 20).alias("frame_id"))
    stored = with_event_time(frames.unionByName(closing))
    stored.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(stored.schema).parquet(f"{at}/in")
    run_to_end(gop_counts(stream, 10, 10.0, "0 seconds").select("gop", "n"), f"{at}/out", f"{at}/state")
    return spark.read.schema("gop long, n long").parquet(f"{at}/out")


def absdiff_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per camera its frames and those with foreground, by the streaming background model at a learning rate of one."""
    at = _folder(spark)
    pixel_frames(detections(spark, sf_dir)).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(FRAMES).parquet(f"{at}/in")
    s = ProposalSettings(background="average", warmup_frames=0, learning_rate=1.0)
    run_to_end(foreground_stream(stream, s), f"{at}/out", f"{at}/state")
    done = spark.read.schema(FOREGROUND).parquet(f"{at}/out")
    return done.groupBy("camera_id").agg(F.count("*").alias("frames"), F.count_if(F.col("pixels") > 0).alias("moved"))
