"""Streaming form of the background state and of GOP windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ProposalSettings
from ..operators import images as im
from ..operators.enhance import FOREGROUND, PROPOSED, foreground_camera, propose_camera

STATE = "seen long, model binary"


def propose_stream(frames: DataFrame, s: ProposalSettings = ProposalSettings()) -> DataFrame:
    """Proposals of a stream of frames; per camera the state is the frames seen and the background."""
    import pandas as pd

    def run(key, batches, state):
        seen, model = 0, None
        if state.exists:
            seen, blob = state.get
            model = im.load_model(blob)
        rows = pd.concat(list(batches)).sort_values("frame_id").to_dict("records")
        found, (seen, model) = propose_camera(rows, s, (int(seen), model))
        state.update((int(seen), im.dump_model(model)))
        yield pd.DataFrame(found, columns=["proposal_id", "camera_id", "frame_id", "bbox", "score", "tag", "splits"])

    return frames.groupBy("camera_id").applyInPandasWithState(run, PROPOSED, STATE, "append", "NoTimeout")


def foreground_stream(frames: DataFrame, s: ProposalSettings = ProposalSettings()) -> DataFrame:
    """foreground_camera() over a stream of frames; per camera the state is the frames seen and the background."""
    import pandas as pd

    def run(key, batches, state):
        seen, blob = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("frame_id").to_dict("records")
        found, (seen, model) = foreground_camera(rows, s, (int(seen), im.load_model(blob)))
        state.update((int(seen), im.dump_model(model)))
        yield pd.DataFrame(found, columns=["camera_id", "frame_id", "seen", "warm", "pixels"])

    return frames.groupBy("camera_id").applyInPandasWithState(run, FOREGROUND, STATE, "append", "NoTimeout")


def with_event_time(frames: DataFrame, fps: float = 10.0) -> DataFrame:
    """Adds ts, from the 1-based frame number."""
    return frames.withColumn("ts", F.timestamp_seconds((F.col("frame_id") - 1) / F.lit(fps)))


def gop_counts(events: DataFrame, gop: int = 10, fps: float = 10.0, delay: str = "5 seconds") -> DataFrame:
    """Rows and largest frame by GOP of a stream (frame_id, ts), as tumbling event-time windows; late rows beyond delay are dropped."""
    width = f"{int(round(gop / fps * 1000))} milliseconds"
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.max("frame_id").alias("last_frame"))
    return out.select((F.unix_millis("window.start") / F.lit(int(round(gop / fps * 1000)))).cast("long").alias("gop"), "n", "last_frame")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there now into parquet, exactly once, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
