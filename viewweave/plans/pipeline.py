"""The online flow: frames to proposals, clusters, ranked candidates, packed bins, enhanced frames and detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BinSize, ProposalSettings
from ..functions.geometry import gop_of
from ..operators import enhance as en
from ..operators.matching import best_views, clusters, edges, name_clusters, normal_importance, rank, single_view_clusters, strong_pairs, view_quality
from ..operators.packing import admit_and_pack, gop_accounting


@dataclass
class Run:
    """The relations of a run; each is lazy until asked for."""

    proposals: DataFrame
    candidates: DataFrame
    packed: DataFrame
    accounts: DataFrame
    frames: DataFrame
    detections: DataFrame


def candidates_of(props: DataFrame, pairs: DataFrame | None, gop: int = 10, size: BinSize = BinSize()) -> DataFrame:
    """Ranked candidates of proposals (with sharpness): one best view a cluster, or every view without pairs."""
    if pairs is None:
        named = single_view_clusters(props)
    else:
        labels = name_clusters(clusters(props, edges(props, strong_pairs(pairs)))).select("frame_id", "proposal_id", "cluster_id")
        named = props.join(labels, ["frame_id", "proposal_id"])
    best = best_views(view_quality(named, ["frame_id", "cluster_id"]), ["frame_id", "cluster_id"], ["camera_id", "proposal_id"])
    ranked = normal_importance(rank(best.withColumn("gop", gop_of(F.col("frame_id"), gop)), size))
    box = F.struct(*(F.col(c).cast("int").alias(c) for c in "xywh"))
    return ranked.select("gop", "cluster_id", F.col("camera_id").alias("cam_id"), "frame_id", "w", "h", box.alias("orig_bbox"), F.col("importance_norm").alias("importance"))


def run_pipeline(frames: DataFrame, pairs: DataFrame | None, settings: ProposalSettings = ProposalSettings(), gop: int = 10, max_bins: int | None = 8, size: BinSize = BinSize(), model: en.Model = en.bilinear_model, detector: en.Detector = en.constant_detector, priors: DataFrame | None = None) -> Run:
    """Pixels are read again where they are needed (sharpness, bins, blending) instead of moving with proposals."""
    proposals = en.propose(frames, settings, priors)
    flat = proposals.select("proposal_id", "camera_id", "frame_id", "bbox.*")
    cands = candidates_of(en.sharpness(flat, frames), pairs, gop, size)
    packed = admit_and_pack(cands, max_bins, size)
    placed = packed.where("status = 'placed'")
    bins = en.enhance(en.materialise_bins(placed, frames, size), model)
    done = en.blend_back(frames, placed, bins)
    accounts = gop_accounting(flat.withColumn("gop", gop_of(F.col("frame_id"), gop)), packed, size)
    return Run(proposals, cands, packed, accounts, done, en.detect(done, en.each_alone(detector)))
