"""Pixels on Spark: sharpness, proposals from frames, bins, enhancement, blending and detection, by Arrow functions.

Frames are rows (camera_id, frame_id, height, width, n_channels, data). Pixels are joined late: placements are narrow, and a
frame meets only its own. Models are functions of numpy arrays, loaded once a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SCALE, BinSize, ProposalSettings
from ..functions.geometry import launch_plan
from ..schemas import BBOX, DETECTIONS, FRAMES
from . import images as im
from .matching import counted_broadcast

Model = Callable[[np.ndarray], np.ndarray]
Detector = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def unpack(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["n_channels"])


def packed(image: np.ndarray) -> dict:
    return {"height": image.shape[0], "width": image.shape[1], "n_channels": image.shape[2], "data": image.tobytes()}


def bilinear_model(batch: np.ndarray) -> np.ndarray:
    """The stand-in for an enhancement model: (n, h, w, 3) to three times the size."""
    return np.stack([im.upscale(x, SCALE) for x in batch])


def constant_detector(_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stand-in for a detector."""
    return np.array([[0.0, 0.0, 10.0, 10.0]]), np.array([0.9]), np.array([1])


def sharpness(views: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds sharpness (Laplacian variance of the crop) to views (camera_id, frame_id, x, y, w, h); views without a frame have 0.

    The views of a frame meet its pixels as one group, so that these move and are decoded once, however many views there are.
    """
    names = views.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in views.schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        image = unpack(right.slice(0, 1).to_pylist()[0]) if right.num_rows else None
        boxes = zip(*(left[c].to_pylist() for c in "xywh"))
        return left.append_column("sharpness", pa.array([0.0 if image is None else im.laplacian_variance(im.crop(image, box)) for box in boxes], pa.float64()))

    key = ["camera_id", "frame_id"]
    pixels = frames.join(views.select(*key).distinct(), key, "left_semi").select(*key, "height", "width", "n_channels", "data")
    return views.select(*names).groupBy(*key).cogroup(pixels.groupBy(*key)).applyInArrow(run, schema + ", sharpness double")


FOREGROUND = "camera_id string, frame_id bigint, seen bigint, warm boolean, pixels bigint"


def foreground_camera(frames, s: ProposalSettings, state: tuple = (0, None)) -> tuple[list[dict], tuple]:
    """One camera's frames in order, from and to a state: how many it had before, whether it still warms up, and its foreground pixels."""
    seen, model = state
    out = []
    for row in frames:
        warm = seen < s.warmup_frames
        mask, model = im.foreground(im.to_grey(unpack(row)), model, s.warmup_learning_rate if warm else s.learning_rate, s)
        out.append({"camera_id": row["camera_id"], "frame_id": row["frame_id"], "seen": seen, "warm": warm, "pixels": int(mask.sum())})
        seen += 1
    return out, (seen, model)


def foreground_counts(frames: DataFrame, s: ProposalSettings = ProposalSettings()) -> DataFrame:
    """foreground_camera() over a batch of frames, a camera a run."""
    kinds = pa.schema([("camera_id", pa.string()), ("frame_id", pa.int64()), ("seen", pa.int64()), ("warm", pa.bool_()), ("pixels", pa.int64())])

    def run(batches):
        state, camera = (0, None), None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["camera_id"] != camera:
                    camera, state = row["camera_id"], (0, None)
                found, state = foreground_camera([row], s, state)
                out += found
            yield from pa.Table.from_pylist(out, kinds).to_batches()

    own = frames.select(*(c.split()[0] for c in FRAMES.split(", ")))
    return own.repartition("camera_id").sortWithinPartitions("camera_id", "frame_id").mapInArrow(run, FOREGROUND)


SPLITS = "array<struct<axis:string,status:string>>"
PROPOSED = f"proposal_id string, camera_id string, frame_id bigint, bbox {BBOX}, score double, tag string, splits {SPLITS}"
PRIORS = "array<struct<bin_size:int,median_w:double,median_h:double,median_a:double,q90_w:double,q90_h:double,q90_a:double>>"


def propose_camera(frames, s: ProposalSettings, state: tuple = (0, None)) -> tuple[list[dict], tuple]:
    """Proposals of one camera's frames in order, from and to a state (frames seen, background model); a frame may carry priors."""
    seen, model = state
    out = []
    for row in frames:
        warm = seen < s.warmup_frames
        mask, model = im.foreground(im.to_grey(unpack(row)), model, s.warmup_learning_rate if warm else s.learning_rate, s)
        seen += 1
        if warm:
            continue
        events: list[list[tuple[str, str]]] = []
        for k, ((x, y, w, h), tag) in enumerate(im.detect(mask, s, row.get("priors"), events)):
            out.append({"proposal_id": f"{row['camera_id']}_f{row['frame_id']:06d}_p{k:04d}", "camera_id": row["camera_id"], "frame_id": row["frame_id"], "bbox": {"x": x, "y": y, "w": w, "h": h}, "score": float(w * h), "tag": tag, "splits": [{"axis": a, "status": t} for a, t in events[k]]})
    return out, (seen, model)


PROPOSED_ARROW = pa.schema([("proposal_id", pa.string()), ("camera_id", pa.string()), ("frame_id", pa.int64()), ("bbox", pa.struct([(k, pa.int32()) for k in "xywh"])), ("score", pa.float64()), ("tag", pa.string()), ("splits", pa.list_(pa.struct([("axis", pa.string()), ("status", pa.string())])))])


def with_priors(frames: DataFrame, priors: DataFrame, bin_size: int = 20) -> DataFrame:
    """Adds each camera's size priors (of calibration.size_priors: a row a band of rows) as an array from the top; cameras without have null."""
    fields = [F.col(f"{k}_{c}").cast("double").alias(f"{k}_{c}") for k in ("median", "q90") for c in "wha"]
    bands = F.transform(F.array_sort(F.collect_list(F.struct("y_bin", F.struct(F.lit(bin_size).alias("bin_size"), *fields).alias("p")))), lambda x: x.p)
    per = priors.groupBy("camera_id").agg(bands.cast(PRIORS).alias("priors"))
    return frames.join(counted_broadcast(per), "camera_id", "left")


def propose(frames: DataFrame, s: ProposalSettings = ProposalSettings(), priors: DataFrame | None = None) -> DataFrame:
    """Batch proposals: each camera's frames stream in order through one grouped function, a batch of frames in memory at a time.

    A background model depends on all frames before, so a camera is one sequential run; cameras run side by side.
    """

    def run(batches):
        state: tuple = (0, None)
        camera = None
        for b in batches:
            for row in b.to_pylist():
                if row["camera_id"] != camera:
                    camera, state = row["camera_id"], (0, None)
                found, state = propose_camera([row], s, state)
                if found:
                    yield from pa.Table.from_pylist(found, PROPOSED_ARROW).to_batches()

    own = frames.select(*(c.split()[0] for c in FRAMES.split(", ")))
    own = with_priors(own, priors) if priors is not None else own.withColumn("priors", F.lit(None).cast(PRIORS))
    return own.repartition("camera_id").sortWithinPartitions("camera_id", "frame_id").mapInArrow(run, PROPOSED)


def split_events(proposals: DataFrame) -> DataFrame:
    """(camera_id, frame_id, axis, status): the tries to split, for reporting.split_diagnostics()."""
    return proposals.select("camera_id", "frame_id", F.explode("splits").alias("e")).select("camera_id", "frame_id", "e.*")


def materialise_bins(placements: DataFrame, frames: DataFrame, size: BinSize = BinSize()) -> DataFrame:
    """(gop, bin_idx, height, width, n_channels, data): each bin's patches cut from their frames and put in place; missing frames are skipped.

    The placements of a frame meet its pixels as one group; only patches go on to their bins.
    """
    kinds = {"gop": pa.int64(), **{c: pa.int32() for c in ("bin_idx", "bx", "by", "bw", "bh")}, "patch": pa.binary()}

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            image = unpack(right.slice(0, 1).to_pylist()[0])
            for r in left.to_pylist():
                patch = im.crop(image, tuple(r["orig_bbox"][k] for k in "xywh"))
                out.append([r[c] for c in ("gop", "bin_idx", "bx", "by", "bw", "bh")] + [im.resize(patch, r["bw"], r["bh"]).tobytes() if patch.size else None])
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(kinds.items())})

    own = placements.select("gop", F.col("cam_id").alias("camera_id"), "frame_id", "bin_idx", "bx", "by", "bw", "bh", "orig_bbox")
    key = ["camera_id", "frame_id"]
    pixels = frames.join(own.select(*key).distinct(), key, "left_semi").select(*key, "height", "width", "n_channels", "data")
    patches = own.groupBy(*key).cogroup(pixels.groupBy(*key)).applyInArrow(cut, "gop long, bin_idx int, bx int, by int, bw int, bh int, patch binary")

    def paste(table: pa.Table) -> pa.Table:
        canvas = np.zeros((size.height, size.width, 3), np.uint8)
        for r in table.to_pylist():
            if r["patch"]:
                canvas[r["by"] : r["by"] + r["bh"], r["bx"] : r["bx"] + r["bw"]] = np.frombuffer(r["patch"], np.uint8).reshape(r["bh"], r["bw"], 3)
        return pa.Table.from_pylist([{"gop": table["gop"][0].as_py(), "bin_idx": table["bin_idx"][0].as_py(), **packed(canvas)}], pa.schema([("gop", pa.int64()), ("bin_idx", pa.int32()), *((k, pa.int32()) for k in ("height", "width", "n_channels")), ("data", pa.binary())]))

    return patches.groupBy("gop", "bin_idx").applyInArrow(paste, "gop long, bin_idx int, height int, width int, n_channels int, data binary")


def run_batches(batch: list[np.ndarray], models: dict[int, Model] | Model, plan: list[int] | None = None, latency: dict[int, float] | None = None) -> list[np.ndarray]:
    """Images through models by a launch plan (its sum must be their number); BGR in and out, RGB for the model."""
    if not batch:
        return []
    sizes = plan if plan is not None else launch_plan(len(batch), latency)
    if sum(sizes) != len(batch):
        raise ValueError(f"a plan of {sum(sizes)} for {len(batch)} images")
    out, at = [], 0
    for n in sizes:
        model = models if callable(models) else models.get(n)
        if model is None:
            raise ValueError(f"no model for batches of {n}")
        out += [im.to_image(x[..., ::-1]) for x in model(im.as_batch(batch[at : at + n])[..., ::-1])]
        at += n
    return out


def enhance(images: DataFrame, model: Model | dict[int, Model] = bilinear_model, latency: dict[int, float] | None = None, key: str = "gop") -> DataFrame:
    """The images (key, height, width, n_channels, data and any others, such as bin_idx) three times as large.

    The images of one key value, in order of the other columns, are one launch: its plan covers their number. They are a GOP's bins, which
    the budget bounds.
    """
    keys = [c for c in images.columns if c not in ("height", "width", "n_channels", "data")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in keys])
        made = [packed(x) for x in run_batches([unpack(r) for r in table.select(["height", "width", "n_channels", "data"]).to_pylist()], model, None, latency)]
        return pa.table([*(table[c] for c in keys), *(pa.array([m[c] for m in made], pa.int32()) for c in ("height", "width", "n_channels")), pa.array([m["data"] for m in made], pa.binary())], names=[*keys, "height", "width", "n_channels", "data"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in keys)
    return images.select(*keys, "height", "width", "n_channels", "data").groupBy(key).applyInArrow(run, f"{schema}, height int, width int, n_channels int, data binary")


def blend_back(frames: DataFrame, placements: DataFrame, enhanced: DataFrame, scale: int = SCALE) -> DataFrame:
    """Frames upscaled, with their enhanced patches; frames without placements are only upscaled.

    Each placement takes its own patch out of its bin before it meets its frame, so whole bins do not go to frames.
    """
    ord_kind = pa.struct([("bin_idx", pa.int32()), ("by", pa.int32()), ("bx", pa.int32()), ("cluster_id", pa.string())])
    cut_kinds = {"camera_id": pa.string(), "frame_id": pa.int64(), "ord": ord_kind, "orig_bbox": pa.struct([(k, pa.int32()) for k in "xywh"]), "bw": pa.int32(), "bh": pa.int32(), "patch": pa.binary()}

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            image = unpack(right.slice(0, 1).to_pylist()[0])
            for r in left.to_pylist():
                patch = image[r["by"] * scale : (r["by"] + r["bh"]) * scale, r["bx"] * scale : (r["bx"] + r["bw"]) * scale]
                out.append({**{c: r[c] for c in ("camera_id", "frame_id", "orig_bbox", "bw", "bh")}, "ord": {c: r[c] for c in ("bin_idx", "by", "bx", "cluster_id")}, "patch": patch.tobytes()})
        return pa.Table.from_pylist(out, pa.schema(list(cut_kinds.items())))

    schema = f"camera_id string, frame_id long, ord struct<bin_idx:int,by:int,bx:int,cluster_id:string>, orig_bbox {BBOX}, bw int, bh int, patch binary"
    own = placements.select("gop", "bin_idx", F.col("cam_id").alias("camera_id"), "frame_id", "cluster_id", "orig_bbox", "bx", "by", "bw", "bh")
    whole = enhanced.select("gop", "bin_idx", "height", "width", "n_channels", "data")
    patches = own.groupBy("gop", "bin_idx").cogroup(whole.groupBy("gop", "bin_idx")).applyInArrow(cut, schema)
    kinds = pa.schema([("camera_id", pa.string()), ("frame_id", pa.int64()), *((k, pa.int32()) for k in ("height", "width", "n_channels")), ("data", pa.binary())])

    def paste(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        own = sorted(right.to_pylist(), key=lambda r: tuple(r["ord"].values()))
        bins = {k: np.frombuffer(r["patch"], np.uint8).reshape(r["bh"] * scale, r["bw"] * scale, 3) for k, r in enumerate(own)}
        places = [{"bin_idx": k, "bx": 0, "by": 0, "bw": r["bw"], "bh": r["bh"], "orig_bbox": r["orig_bbox"]} for k, r in enumerate(own)]
        for r in left.to_pylist():
            out.append({"camera_id": r["camera_id"], "frame_id": r["frame_id"], **packed(im.blend(unpack(r), places, bins, scale))})
        return pa.Table.from_pylist(out, kinds)

    return frames.groupBy("camera_id", "frame_id").cogroup(patches.groupBy("camera_id", "frame_id")).applyInArrow(paste, FRAMES)


def each_alone(detector: Detector) -> Callable[[list[np.ndarray]], list[tuple]]:
    """A batch detector from one of single images."""
    return lambda images: [detector(x) for x in images]


def detect(frames: DataFrame, detector: Callable[[list[np.ndarray]], list[tuple]] = each_alone(constant_detector), max_batch: int = 8) -> DataFrame:
    """Detection records of frames, in order: a call of the detector takes at most max_batch images and must answer each."""
    kinds = pa.schema([("frame_id", pa.int64()), ("camera_id", pa.string()), ("boxes", pa.list_(pa.list_(pa.float64()))), ("scores", pa.list_(pa.float64())), ("labels", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, max_batch):
                rows = b.slice(k, max_batch).to_pylist()
                found = detector([unpack(r) for r in rows])
                if len(found) != len(rows):
                    raise ValueError(f"the detector gave {len(found)} results for {len(rows)} images")
                out = [{"frame_id": r["frame_id"], "camera_id": r["camera_id"], "boxes": np.asarray(boxes, float).tolist(), "scores": np.asarray(scores, float).tolist(), "labels": np.asarray(labels, int).tolist()} for r, (boxes, scores, labels) in zip(rows, found)]
                yield from pa.Table.from_pylist(out, kinds).to_batches()

    return frames.mapInArrow(run, DETECTIONS)


def detect_targets(frames: DataFrame, active: DataFrame) -> DataFrame:
    """The frames that detection takes (of active: camera_id, frame_id), with target, their place: cameras in order, then frames."""
    own = frames.join(active.select("camera_id", "frame_id").distinct(), ["camera_id", "frame_id"], "left_semi")
    narrow = own.select("camera_id", "frame_id")
    per = narrow.groupBy("camera_id").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("camera_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a camera
    nth = F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_id")) - 1
    placed = narrow.withColumn("nth", nth).join(F.broadcast(per.select("camera_id", before.alias("base"))), "camera_id")
    return own.join(placed.select("camera_id", "frame_id", (F.col("base") + F.col("nth")).alias("target")), ["camera_id", "frame_id"])


def mosaics(frames: DataFrame) -> DataFrame:
    """Per frame_id the views of four cameras, in order, as one image; frames with fewer views are left out."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["camera_id"])
        out = [{"frame_id": rows[0]["frame_id"], **packed(im.mosaic([unpack(r) for r in rows]))}] if len(rows) >= 4 else []
        return pa.Table.from_pylist(out, pa.schema([("frame_id", pa.int64()), *((k, pa.int32()) for k in ("height", "width", "n_channels")), ("data", pa.binary())]))

    return frames.groupBy("frame_id").applyInArrow(run, "frame_id long, height int, width int, n_channels int, data binary")
