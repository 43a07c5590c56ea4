"""Detection post-processing and evaluation: suppression, greedy matching, precision and recall.

The greedy folds are SQL higher-order aggregates over one key's sorted boxes (a camera's frame, so of bounded size); the
rest are joins on (camera_id, frame_id) and one rollup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import f1_metrics, iou

KEY = ["camera_id", "frame_id"]


def _corners(b: Column) -> list[Column]:
    return [b.x1, b.y1, b.x2, b.y2]


def filter_predictions(boxes: DataFrame, score: float = 0.5, labels: list[int] | None = (2, 5, 7)) -> DataFrame:
    """Score at least `score`, label among `labels` (None: any), no degenerate boxes."""
    out = boxes.where((F.col("score") >= score) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return out if labels is None else out.where(F.col("label").isin(*labels))


def explode_predictions(records: DataFrame) -> DataFrame:
    """Detection records (parallel arrays) as one row a box; missing scores are 1.0, missing labels -1."""
    zipped = records.select("camera_id", "frame_id", F.posexplode(F.arrays_zip("boxes", "scores", "labels")).alias("det_idx", "z"))
    whole = zipped.where(F.size("z.boxes") >= 4)
    return whole.select("camera_id", F.col("frame_id").cast("long").alias("frame_id"), "det_idx", *(F.col("z.boxes")[i].cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.coalesce("z.scores", F.lit(1.0)).cast("double").alias("score"), F.coalesce("z.labels", F.lit(-1)).cast("int").alias("label"))


def suppress(boxes: DataFrame, threshold: float = 0.5, order: str = "det_id") -> DataFrame:
    """Class-agnostic non-maximum suppression per camera and frame: a box stays if its IoU with every kept box is below threshold.

    boxes: camera_id, frame_id, x1, y1, x2, y2, score and the tie-break `order`. A threshold of 0 or less keeps all.
    """
    if threshold <= 0:
        return boxes
    rest = [c for c in boxes.columns if c not in KEY]
    packed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), F.col(order).alias("_o"), *(F.col(c) for c in rest))))
    grouped = boxes.groupBy(*KEY).agg(packed.alias("b"))
    keep = F.aggregate("b", F.filter("b", lambda _: F.lit(False)), lambda kept, b: F.when(F.exists(kept, lambda k: iou(_corners(k), _corners(b)) >= threshold), kept).otherwise(F.concat(kept, F.array(b))))
    return grouped.select(*KEY, F.explode(keep).alias("b")).select(*KEY, *(F.col(f"b.{c}").alias(c) for c in rest))


def match_counts(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, keys: str = "pred", start: int | None = None, end: int | None = None) -> DataFrame:
    """Per camera and frame: gt_boxes, pred_boxes, tp, fp, fn.

    Predictions by falling score (then det_id) each take the unmatched ground-truth box of largest IoU (first of equals), if it is
    at least threshold. keys: 'pred' for frames with predictions only, 'all' for those of either side; a frame bound implies 'all'.
    """
    g = gt.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("gt_id", "x1", "y1", "x2", "y2"))).alias("g"))
    p = pred.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "det_id", "x1", "y1", "x2", "y2"))).alias("p"))
    both = g.join(p, KEY, "full" if keys == "all" or start is not None or end is not None else "right")
    if start is not None:
        both = both.where(F.col("frame_id") >= start)
    if end is not None:
        both = both.where(F.col("frame_id") <= end)
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    none = F.array().cast("array<bigint>")

    def take(used: Column, b: Column) -> Column:
        free = F.filter(F.col("g"), lambda x: ~F.array_contains(used, x.gt_id))
        scored = F.transform(free, lambda x: F.struct(iou(_corners(x), _corners(b)).alias("v"), (-x.gt_id).alias("first")))
        best = F.array_max(scored)
        return F.when((best.v > 0) & (best.v >= threshold), F.concat(used, F.array(-best.first))).otherwise(used)

    used = F.aggregate(F.coalesce("p", F.filter(F.col("p"), lambda _: F.lit(False))), none, take)
    counted = both.withColumn("tp", F.when(F.col("g").isNull() | F.col("p").isNull(), 0).otherwise(F.size(used)).cast("long"))
    return counted.select(*KEY, n("g").cast("long").alias("gt_boxes"), n("p").cast("long").alias("pred_boxes"), "tp", (n("p") - F.col("tp")).cast("long").alias("fp"), (n("g") - F.col("tp")).cast("long").alias("fn"))


def evaluation(counts: DataFrame) -> DataFrame:
    """Overall (scope 'overall') and per-camera sums and metrics, in one rollup."""
    sums = counts.rollup("camera_id").agg(F.grouping("camera_id").alias("all"), F.count("*").alias("frames"), *(F.sum(c).alias(c) for c in ("gt_boxes", "pred_boxes", "tp", "fp", "fn")))
    p, r, f1 = f1_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("camera_id")).alias("scope"), "frames", "gt_boxes", "pred_boxes", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def best_confidence(objects: DataFrame, detections: DataFrame, threshold: float = 0.3) -> DataFrame:
    """For each object (obj_id, key, corners) the largest confidence of detections with an IoU above threshold, else 0."""
    o, d = objects.alias("o"), detections.alias("d")
    hit = iou([F.col(f"o.{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"d.{c}") for c in ("x1", "y1", "x2", "y2")]) > threshold
    cond = (F.col("o.camera_id") == F.col("d.camera_id")) & (F.col("o.frame_id") == F.col("d.frame_id")) & hit
    return o.join(d, cond, "left").groupBy(F.col("o.obj_id").alias("obj_id")).agg(F.coalesce(F.max("d.score"), F.lit(0.0)).alias("confidence"))


# ---------------------------------------------------------------- detector output


def top_then_filter(scores: DataFrame, key: str, order: str, k: int = 100, conf: float = 0.5, labels: list[int] | None = None) -> DataFrame:
    """Batch form: the k best anchors of each image first, then score and label filters."""
    from pyspark.sql import Window

    best = scores.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order))).where(f"_r <= {k}").drop("_r")
    out = best.where(F.col("score") >= conf)
    return out if labels is None else out.where(F.col("label").isin(*labels))


def filter_then_top(scores: DataFrame, key: str, order: str, k: int = 100, conf: float = 0.5, labels: list[int] | None = None) -> DataFrame:
    """Single-image form: score and label filters first, then the k best anchors."""
    from pyspark.sql import Window

    kept = scores.where(F.col("score") >= conf)
    kept = kept if labels is None else kept.where(F.col("label").isin(*labels))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order))).where(f"_r <= {k}").drop("_r")


def anchor_class(values: Column) -> tuple[Column, Column]:
    """The best class of an anchor's score array (the first of equals) and its score."""
    top = F.array_max(values)
    return (F.array_position(values, top) - 1).cast("int"), top


def nms_single(rows: DataFrame, sx: float, sy: float, conf: float = 0.5, labels: list[int] | None = None) -> DataFrame:
    """Output of (x1, y1, x2, y2, score, class) rows: scaled boxes above conf in order."""
    out = rows.select(*[c for c in rows.columns if c not in ("x1", "y1", "x2", "y2")], *((F.col(c) * s).alias(c) for c, s in (("x1", sx), ("y1", sy), ("x2", sx), ("y2", sy)))).where(F.col("score") >= conf)
    return out if labels is None else out.where(F.col("label").isin(*labels))


def nms_multi(images: DataFrame, conf: float = 0.5, labels: list[int] | None = None) -> DataFrame:
    """Output of four tensors (num, boxes, scores, labels): the first clamp(num) rows, then filters."""
    rows = images.select("image_id", F.greatest(F.lit(0), F.least("num", F.size("boxes"))).alias("n"), F.posexplode(F.arrays_zip("boxes", "scores", "labels")).alias("pos", "z")).where("pos < n")
    out = rows.select("image_id", "pos", *(F.col("z.boxes")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.col("z.scores").alias("score"), F.col("z.labels").alias("label")).where(F.col("score") >= conf)
    return out if labels is None else out.where(F.col("label").isin(*labels))


def output_kind(outputs: Column, last_dim: Column) -> Column:
    """nms_multi for four outputs, nms_single for one whose last dimension is 6, else raw_yolo."""
    return F.when(outputs == 4, "nms_multi").when((outputs == 1) & (last_dim == 6), "nms_single").otherwise("raw_yolo")


def output_roles(tensors: DataFrame) -> DataFrame:
    """(engine, num, boxes, scores, labels): roles of tensors (engine, position, name, last_dim, rank, dtype); names first, then position. A role without a tensor is an error."""
    name = F.lower("name")
    role = F.when(name.contains("num"), "num").when(name.contains("box") | ((F.col("rank") >= 2) & (F.col("last_dim") == 4)), "boxes").when(name.contains("score") | name.contains("conf"), "scores").when(name.contains("label") | name.contains("class"), "labels").when(F.col("dtype") == "int32", "weak")
    named = tensors.withColumn("role", role)
    last = lambda r: F.max_by("name", F.when(F.col("role") == r, F.col("position")))
    first_weak = F.min_by("name", F.when(F.col("role") == "weak", F.col("position")))
    by_place = [F.max(F.when(F.col("position") == i, F.col("name"))) for i in range(4)]
    roles = named.groupBy("engine").agg(F.coalesce(last("num"), by_place[0]).alias("num"), F.coalesce(last("boxes"), by_place[1]).alias("boxes"), F.coalesce(last("scores"), by_place[2]).alias("scores"), F.coalesce(last("labels"), first_weak, by_place[3]).alias("labels"))
    known = [F.col(c) for c in ("num", "boxes", "scores", "labels")]
    missing = F.concat_ws(", ", *(F.when(c.isNull(), F.lit(n)) for c, n in zip(known, ("num", "boxes", "scores", "labels"))))
    whole = F.when(missing == "", F.col("num")).otherwise(F.raise_error(F.concat(F.lit("no output of engine "), "engine", F.lit(" for "), missing)))
    return roles.withColumn("num", whole)
