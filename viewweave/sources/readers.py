"""Readers of ground truth, predictions, proposal and calibration artifacts, latency profiles, images and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import invert
from ..schemas import BBOX, DETECTIONS, FRAMES, POINTS


def _lines(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path).select("value", name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_gt_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation ground truth from files named camera_*: corners; a short line is an error, an empty box is dropped."""
    f = F.split("value", ",")
    num = lambda i: F.trim(f[i]).cast("double")
    short = F.when(F.size(f) < 6, F.raise_error(F.concat(F.lit("a ground-truth line of fewer than 6 fields: "), "value")).cast("double")).otherwise(num(2))
    own = _lines(spark, path).where(F.trim("value") != "").select(F.split("file", "_")[0].alias("camera_id"), num(0).cast("long").alias("frame_id"), F.trim(f[1]).try_cast("long").alias("object_id"), short.alias("x"), num(3).alias("y"), num(4).alias("w"), num(5).alias("h"))
    return own.where("w > 0 and h > 0").select("camera_id", "frame_id", "object_id", "x", "y", "w", "h", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


def read_gt_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Calibration ground truth: blank lines, comments (//) and short lines are skipped; of a repeated (frame, object) the last line counts."""
    f = F.split("value", ",")
    num = lambda i: F.trim(f[i]).try_cast("double")
    own = _lines(spark, path).where((F.trim("value") != "") & ~F.trim("value").startswith("//") & (F.size(f) >= 6))
    rows = own.select(F.split("file", "_")[0].alias("camera_id"), num(0).cast("long").alias("frame_id"), num(1).cast("long").alias("object_id"), F.struct("line", num(2).alias("x"), num(3).alias("y"), num(4).alias("w"), num(5).alias("h")).alias("s"))
    return rows.groupBy("camera_id", "frame_id", "object_id").agg(F.max("s").alias("s")).select("camera_id", "frame_id", "object_id", "s.x", "s.y", "s.w", "s.h")


def read_gt_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth for size priors: lines that do not parse are skipped; the camera is the digit of the file's name."""
    f = F.split("value", ",")
    num = lambda i: F.trim(f[i]).try_cast("double")
    own = _lines(spark, path).where(F.size(f) >= 6).select((F.substring("file", 4, 1).try_cast("int") - 1).alias("camera"), num(2).alias("x"), num(3).alias("y"), num(4).alias("w"), num(5).alias("h"))
    return own.where("camera is not null and x is not null and y is not null and w > 0 and h > 0")


def read_gt_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Integer ground truth: frame_id, object_id, x, y, w, h."""
    schema = "frame_id long, object_id long, x long, y long, w long, h long, a string, b string, c string, d string"
    return spark.read.csv(path, schema=schema).select("frame_id", "object_id", "x", "y", "w", "h")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Detection records of a JSON list."""
    return spark.read.json(path, schema=DETECTIONS, multiLine=True)


PROPOSAL_RECORD = f"proposal_id string, camera_id string, frame_id bigint, bbox array<int>, score double, source_frame bigint"


def parse_proposals(payload: DataFrame, column: str = "value") -> DataFrame:
    """Proposals of artifact texts {cameras: {camera: {frame: [record]}}}; missing ids are made of camera, frame and place."""
    kind = f"struct<cameras:map<string,map<string,array<struct<{', '.join(f'{a}:{b}' for a, b in (x.rsplit(' ', 1) for x in PROPOSAL_RECORD.split(', ')))}>>>>>"
    cams = payload.select(F.explode(F.from_json(column, kind).cameras).alias("camera", "frames"))
    frames = cams.select("camera", F.explode("frames").alias("frame", "records"))
    rows = frames.select("camera", F.col("frame").cast("long").alias("frame"), F.posexplode("records").alias("idx", "r"))
    name = F.when(F.coalesce(F.col("r.proposal_id"), F.lit("")) != "", F.col("r.proposal_id")).otherwise(F.format_string("%s_f%06d_p%06d", "camera", "frame", "idx"))
    box = F.struct(*(F.col("r.bbox")[i].alias(k) for i, k in enumerate("xywh"))).cast(BBOX)
    return rows.select(name.alias("proposal_id"), F.coalesce("r.camera_id", "camera").alias("camera_id"), F.coalesce("r.frame_id", "frame").alias("frame_id"), box.alias("bbox"), F.coalesce("r.score", F.lit(1.0)).alias("score"), F.coalesce("r.source_frame", "r.frame_id", "frame").alias("source_frame"))


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    return parse_proposals(spark.read.text(path, wholetext=True))


def frame_proposals(props: DataFrame, frames: list[int], cameras: list[str] | None = None) -> DataFrame:
    """Proposals of one or several frames (a GOP), of the given cameras; cameras without any have no rows."""
    out = props.where(F.col("frame_id").isin(*frames))
    return out if cameras is None else out.where(F.col("camera_id").isin(*cameras))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Calibration pairs; of a repeated pair the last counts, missing numbers have their defaults, empty hulls are null."""
    record = "struct<src_cam:string,ref_cam:string,H:array<array<double>>,hull_src:array<array<double>>,hull_ref:array<array<double>>,tau:double,pair_f1:double,margin:double>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"struct<pairs:array<{record}>>").pairs).alias("pos", "p"))
    last = rows.groupBy("p.src_cam", "p.ref_cam").agg(F.max_by("p", "pos").alias("p"))
    hull = lambda c: F.when(F.size(F.col(c)) > 0, F.transform(c, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))).cast(POINTS)
    return last.select("src_cam", "ref_cam", "p.H", hull("p.hull_src").alias("hull_src"), hull("p.hull_ref").alias("hull_ref"), F.coalesce("p.tau", F.lit(0.0)).alias("tau"), F.coalesce("p.pair_f1", F.lit(0.0)).alias("pair_f1"), F.coalesce("p.margin", F.lit(20.0)).alias("margin"))


def with_reversed(pairs: DataFrame) -> DataFrame:
    """The pairs and, where only the other direction is given, their inverses with hulls swapped."""
    back = pairs.select(F.col("ref_cam").alias("src_cam"), F.col("src_cam").alias("ref_cam"), invert(F.col("H")).alias("H"), F.col("hull_ref").alias("hull_src"), F.col("hull_src").alias("hull_ref"), "tau", "pair_f1", "margin")
    return pairs.unionByName(back.join(pairs.select("src_cam", "ref_cam"), ["src_cam", "ref_cam"], "left_anti"))


def get_pair(pairs: DataFrame, src: str, ref: str) -> DataFrame:
    return with_reversed(pairs.where(F.col("src_cam").isin(src, ref) & F.col("ref_cam").isin(src, ref))).where((F.col("src_cam") == src) & (F.col("ref_cam") == ref))


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """Latency by batch size from {batch_latency_ms}, {rows: [...]} or a bare list; an error if there is none."""
    row = "array<struct<batch_size:int,mean_ms:double>>"
    text = spark.read.text(path, wholetext=True)
    shapes = text.select(F.from_json("value", f"struct<batch_latency_ms:map<string,double>,rows:{row}>").alias("o"), F.from_json("value", row).alias("a"))
    listed = F.transform(F.map_entries("o.batch_latency_ms"), lambda e: F.struct(e.key.cast("int").alias("batch_size"), e.value.alias("mean_ms")))
    found = F.coalesce(listed, F.col("o.rows"), F.when(F.size("a") > 0, F.col("a")))
    none = F.raise_error(F.lit("no latency profile")).cast(row)
    return shapes.select(F.explode(F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(none)).alias("r")).select("r.batch_size", "r.mean_ms")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Cropped targets camera_frame_object.jpg with their sizes, by Spark's image source."""
    image = spark.read.format("image").load(path).select("image.origin", F.col("image.width").alias("w"), F.col("image.height").alias("h"))
    part = F.split(F.regexp_extract("origin", "([^/]+)\\.[^.]+$", 1), "_")
    return image.select(F.col("origin").alias("path"), part[0].alias("camera_id"), part[1].cast("long").alias("frame_id"), part[2].cast("long").alias("object_id"), "w", "h")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder as frames, sorted names giving frame numbers."""
    from pyspark.sql import Window

    image = spark.read.format("image").load(path).select("image.*")
    n = F.row_number().over(Window.partitionBy(F.regexp_extract("origin", "^(.*)/[^/]*$", 1)).orderBy("origin"))
    return image.select(F.lit("c001").alias("camera_id"), n.cast("long").alias("frame_id"), "height", "width", F.col("nChannels").alias("n_channels"), "data", "origin")


def read_image_gt(spark: SparkSession, path: str) -> DataFrame:
    """Per-image ground truth: a list (image) of lists of {bbox, class, confidence}."""
    kind = "array<array<struct<bbox:array<double>,class:int,confidence:double>>>"
    lists = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("image", "boxes"))
    rows = lists.select("image", F.posexplode("boxes").alias("idx", "b"))
    return rows.select("image", "idx", *(F.col("b.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.col("b.class").alias("label"), F.col("b.confidence").alias("score"))


def engine_paths(paths: DataFrame, column: str = "path", batches: str = "batches") -> DataFrame:
    """Sibling engine files of each batch size: name_b4.engine gives name_b{k}.engine, any other folder EDSR_256_b{k}.engine."""
    stem = F.regexp_extract(column, "^(.+)_b(\\d+)(\\.engine)$", 1)
    folder = F.regexp_extract(column, "^(.*/)?[^/]*$", 1)
    rows = paths.select("*", F.explode(batches).alias("batch_size"))
    return rows.withColumn("engine", F.when(stem != "", F.concat(stem, F.lit("_b"), "batch_size", F.lit(".engine"))).otherwise(F.concat(folder, F.lit("EDSR_256_b"), "batch_size", F.lit(".engine"))))


class FrameSource(DataSource):
    """format('vw_frames'): raw BGR video files {camera}*.bgr of a folder; options path, width, height, start, frames. A partition a camera."""

    @classmethod
    def name(cls) -> str:
        return "vw_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return FrameReader(dict(self.options))


class _Camera(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        import glob

        return [_Camera(p) for p in sorted(glob.glob(self.options["path"].removeprefix("file://") + "/*.bgr"))]

    def read(self, partition):
        import os

        w, h = int(self.options.get("width", 640)), int(self.options.get("height", 360))
        start, count = int(self.options.get("start", 1)), int(self.options.get("frames", 1 << 62))
        camera = os.path.basename(partition.path).split("_")[0].split(".")[0]
        with open(partition.path, "rb") as f:
            f.seek((start - 1) * w * h * 3)
            n = start
            while n < start + count and len(data := f.read(w * h * 3)) == w * h * 3:
                yield camera, n, h, w, 3, data
                n += 1


def lock_step(frames: DataFrame, cameras: int | None = None) -> DataFrame:
    """Frames that any camera has (None), or only those that so many cameras have."""
    if cameras is None:
        return frames
    full = frames.groupBy("frame_id").agg(F.countDistinct("camera_id").alias("n")).where(F.col("n") >= cameras).select("frame_id")
    return frames.join(full, "frame_id", "left_semi")


def interleave(frames: DataFrame, limit: int) -> DataFrame:
    """Round-robin over sources up to a limit."""
    return frames.orderBy("frame_id", "camera_id").limit(limit)
