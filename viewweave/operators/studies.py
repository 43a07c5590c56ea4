"""Studies of partial enhancement: how sure a detector is of an object when only parts of its frame are enhanced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SCALE
from ..functions.geometry import macroblocks
from . import images as im
from .enhance import Detector, Model, bilinear_model, constant_detector, run_batches, unpack

METHODS = ["conf_bilinear", "conf_mb_based", "conf_obj_based", "conf_full_sr"]


def crossing(objects: DataFrame, size: int = 16, least: int = 2) -> DataFrame:
    """objects (camera_id, frame_id, obj_id, x1, y1, x2, y2) that cover at least so many macroblocks, with these as cells."""
    cells = macroblocks(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)
    return objects.select("camera_id", "frame_id", "obj_id", "x1", "y1", "x2", "y2", cells.alias("cells")).where(F.size("cells") >= least)


def confidence(found: tuple[np.ndarray, np.ndarray, np.ndarray], box: np.ndarray, threshold: float = 0.3) -> float:
    """The largest score of detections whose IoU with a box is above threshold, else 0."""
    boxes, scores = np.asarray(found[0], float).reshape(-1, 4), np.asarray(found[1], float)
    sides = np.clip(np.minimum(boxes[:, 2:], box[2:]) - np.maximum(boxes[:, :2], box[:2]), 0, None)
    area = lambda b: np.clip(b[..., 2:] - b[..., :2], 0, None).prod(-1)
    common = sides.prod(1)
    union = area(boxes) + area(box) - common
    near = common > threshold * union
    return float(scores[near].max()) if near.any() else 0.0


def macroblock_study(frames: DataFrame, objects: DataFrame, model: Model = bilinear_model, detector: Detector = constant_detector, share: float = 0.5, size: int = 16) -> DataFrame:
    """For each object over several macroblocks the confidence of four images: upscaled, enhanced in a share of its macroblocks, in its
    box, and whole.

    A frame meets its objects once: it is enhanced once, and the two images that all its objects share are detected once. Objects
    without a frame, and frames without such objects, have no row. Corners are whole numbers of low-resolution pixels.
    """
    schema = "camera_id string, frame_id long, obj_id long, num_mbs int, num_kept_mbs int, " + ", ".join(f"{c} double" for c in METHODS)
    kinds = pa.schema([("camera_id", pa.string()), ("frame_id", pa.int64()), ("obj_id", pa.int64()), ("num_mbs", pa.int32()), ("num_kept_mbs", pa.int32()), *((c, pa.float64()) for c in METHODS)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for frame in left.to_pylist() if right.num_rows else []:
            low = unpack(frame)
            (high,) = run_batches([low], model, [1])
            rows, columns = low.shape[0] // size, low.shape[1] // size
            whole, plain = detector(high), detector(im.upscale(low, SCALE))
            for o in sorted(right.to_pylist(), key=lambda r: r["obj_id"]):
                box = [int(o[c]) for c in ("x1", "y1", "x2", "y2")]
                cells = [(c["r"], c["c"]) for c in o["cells"]]
                kept = im.kept_macroblocks(cells, share, rows, columns)
                images = plain, detector(im.mask_blend(low, high, kept, size, SCALE)), detector(im.box_blend(low, high, tuple(box), SCALE)), whole
                scores = [confidence(x, np.array(box, float) * SCALE) for x in images]
                out.append({"camera_id": frame["camera_id"], "frame_id": frame["frame_id"], "obj_id": o["obj_id"], "num_mbs": len(cells), "num_kept_mbs": len(kept), **dict(zip(METHODS, scores))})
        return pa.Table.from_pylist(out, kinds)

    keys = ["camera_id", "frame_id"]
    return frames.groupBy(*keys).cogroup(crossing(objects, size).groupBy(*keys)).applyInArrow(run, schema)
