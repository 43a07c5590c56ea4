"""Schemas of the relations that operators take and give."""

BBOX = "struct<x:int,y:int,w:int,h:int>"
PROPOSALS = f"proposal_id string, camera_id string, frame_id bigint, bbox {BBOX}, score double, source_frame bigint, metadata map<string,string>"
POINTS = "array<struct<x:double,y:double>>"
PAIRS = f"src_cam string, ref_cam string, H array<array<double>>, hull_src {POINTS}, hull_ref {POINTS}, tau double, pair_f1 double, margin double, metadata map<string,string>"
CANDIDATES = f"cluster_id string, cam_id string, frame_id bigint, w int, h int, orig_bbox {BBOX}, importance double"
PLACEMENTS = f"gop bigint, cluster_id string, cam_id string, frame_id bigint, bin_idx int, bx int, by int, bw int, bh int, orig_bbox {BBOX}, orig_w int, orig_h int, importance double"
FRAMES = "camera_id string, frame_id bigint, height int, width int, n_channels int, data binary"
DETECTIONS = "frame_id bigint, camera_id string, boxes array<array<double>>, scores array<double>, labels array<int>"
LATENCY = "batch_size int, mean_ms double"
