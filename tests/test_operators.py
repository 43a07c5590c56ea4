"""Operators that SQL does not express, on small fixtures: background models, splits, calibration, sources and late rows."""

import json

import numpy as np
import pytest

from viewweave.config import ProposalSettings
from viewweave.operators import images as im
from viewweave.schemas import FRAMES


def frame_row(camera, n, image):
    return (camera, n, *image.shape[:2], 3, image.tobytes())


def test_mixture_learns_forgets_and_sees_shadows():
    model, grey = im.Mixture((4, 6)), np.full((4, 6), 120, np.uint8)
    assert (model.apply(grey, 0.01, 60.0) == im.Mixture.FOREGROUND).all()  # nothing is known at the start
    for _ in range(30):
        out = model.apply(grey, 0.01, 60.0)
    assert not out.any()
    x = grey.copy()
    x[0, 0], x[0, 1], x[0, 2] = 255, 80, 125  # an object, a shadow (two thirds as bright), noise
    out = model.apply(x, 0.01, 60.0)
    assert out[0, 0] == im.Mixture.FOREGROUND and out[0, 1] == im.Mixture.SHADOW and out[0, 2] == 0 and not out[1:].any()
    assert model.apply(x, 0.0, 60.0, shadows=False)[0, 1] == im.Mixture.FOREGROUND
    for _ in range(200):
        out = model.apply(x, 0.05, 60.0)
    assert not out.any()  # what stays becomes background
    assert np.allclose(model.weight.sum(0), 1, atol=1e-5) and (np.diff(model.weight, axis=0) <= 0).all() and model.variance[model.weight > 0].min() >= im.Mixture.LEAST
    again = im.load_model(im.dump_model(model))
    assert (again.apply(grey, 0.01, 60.0) == model.apply(grey, 0.01, 60.0)).all()
    mask, state = im.foreground(grey, None, 0.01, ProposalSettings())
    mask, state = im.foreground(grey, state, 0.01, ProposalSettings())
    assert not mask.any()
    with pytest.raises(ValueError):
        im.foreground(grey, None, 0.01, ProposalSettings(background="none"))


def two_blobs():
    mask = np.zeros((60, 130), bool)
    for c, top in ((30, 15), (90, 14)):
        for x in range(-20, 21):
            half = max(2, top - abs(x) * 2 // 3)
            mask[25 - half : 25 + half, c + x] = True
    mask[23:27, 50:70] = True
    return mask


def test_split_statuses():
    s, mask = ProposalSettings(min_area=100), two_blobs()
    whole = (10, 10, 100, 30)
    parts, status = im.split_axis(whole, mask, "h", s)
    assert status == im.Split.SUCCESS and len(parts) == 2 and parts[0][0] == 10 and parts[1][0] + parts[1][2] == 110
    turned, status = im.split_axis((10, 10, 30, 100), mask.T, "v", s)
    assert status == "success" and turned == [(y, x, h, w) for x, y, w, h in parts]
    cases = {
        im.Split.NOT_TRIGGERED: ((0, 0, 10, 10), mask, s),
        im.Split.TOO_SMALL: ((0, 0, 200, 3), mask, s),
        im.Split.NO_PEAK: ((0, 0, 120, 30), np.zeros_like(mask), s),
        im.Split.PEAK_HEIGHT: (whole, mask & (np.arange(130) < 60)[None, :], s),
        im.Split.VALLEY_SHALLOW: ((0, 0, 120, 60), np.ones_like(mask), s),
        im.Split.EMPTY_SIDE: (whole, mask, ProposalSettings(min_area=100_000)),
    }
    for want, (box, m, settings) in cases.items():
        assert im.split_axis(box, m, "h", settings) == ([box], want)
    events = []
    assert [t for _, t in im.split_blob(whole, mask, s, events=events)] == ["h", "h"]
    assert events[0] == ("h", "success") and {a for a, _ in events[1:]} == {"v"}


def test_priors_decide_splits():
    bands = [{"bin_size": 20, "median_w": 10.0, "median_h": 10.0, "median_a": 100.0, "q90_w": 90.0, "q90_h": 90.0, "q90_a": 9000.0}, {"bin_size": 20, "median_w": 200.0, "median_h": 200.0, "median_a": 40000.0, "q90_w": 20.0, "q90_h": 20.0, "q90_a": 400.0}]
    small, large, by_q90 = ProposalSettings(), (0, 30, 60, 50), ProposalSettings(split_by_q90=True)
    assert im.prior_of((0, 0, 5, 5), bands) is bands[0] and im.prior_of(large, bands) is bands[1] and im.prior_of(large, None) is None
    assert im.triggered((0, 0, 17, 5), "h", small, bands[0]) and not im.triggered((0, 0, 16, 5), "h", small, bands[0])
    assert not im.triggered(large, "h", small, bands[1]) and im.triggered(large, "h", by_q90, bands[1]) and im.triggered(large, "v", by_q90, bands[1])
    assert not im.triggered((0, 0, 60, 50), "h", by_q90, bands[0])


def test_proposals_carry_splits_and_take_priors(spark):
    from pyspark.sql import functions as F

    from viewweave.operators.enhance import propose, split_events
    from viewweave.operators.reporting import split_diagnostics

    rows = []
    for n in range(1, 4):
        image = np.full((60, 130, 3), 40, np.uint8)
        if n == 3:
            image[two_blobs()] = 255
        rows.append(frame_row("c001", n, image))
    frames = spark.createDataFrame(rows, FRAMES)
    s = ProposalSettings(warmup_frames=1, min_area=100)
    found = propose(frames, s).collect()
    assert [r.tag for r in found] == ["h", "h"] and found[0].splits[0] == ("h", "success") and not found[1].splits
    counted = {r.axis: (r.success, r.not_triggered) for r in split_diagnostics(split_events(propose(frames, s)), ["success", "not_triggered"]).collect()}
    assert counted["h"][0] == 1
    wide = spark.createDataFrame([("c001", b, 500.0, 500.0, 250000.0, 500.0, 500.0, 250000.0) for b in range(3)], "camera_id string, y_bin int, median_w double, median_h double, median_a double, q90_w double, q90_h double, q90_a double")
    assert [r.tag for r in propose(frames, s, wide).collect()] == ["normal"]
    assert propose(frames.where(F.col("frame_id") < 0), s).count() == 0


def scene(H, n=60, seed=2):
    """Ground truth of two cameras: boxes of the second stand where H takes those of the first."""
    rng, rows = np.random.default_rng(seed), []
    for f in range(1, n + 1):
        for k in range(4):
            x, y = rng.uniform(50, 500), rng.uniform(50, 250)
            rows.append(("c001", f, k, x - 10, y - 20, 20.0, 20.0))
            u = np.array(H) @ [x, y, 1]
            u = u[:2] / u[2] + (200 if k == 3 and f % 5 == 0 else 0)  # outliers
            rows.append(("c002", f, k, float(u[0]) - 10, float(u[1]) - 20, 20.0, 20.0))
    return rows


def test_calibration_run(spark, monkeypatch):
    import viewweave.operators.calibration as cal

    H = [[1.1, 0.05, 12.0], [-0.03, 0.95, 7.0], [1e-4, 5e-5, 1.0]]
    schema = "camera_id string, frame_id long, object_id long, x double, y double, w double, h double"
    rows = scene(H) + [("c003", f, 9, 1.0, 1.0, 2.0, 2.0) for f in range(3)]
    gt = spark.createDataFrame(rows, schema)
    found = cal.calibrate(gt, [("c001", "c002"), ("c001", "c003")], 1, 1800).collect()
    assert [(r.src_cam, r.ref_cam) for r in found] == [("c001", "c002")]  # no four points with c003
    r = found[0]
    assert np.allclose(r.H, H, atol=1e-4) and r.n == 240 and r.inliers == 228 and r.error_median < 1e-3
    assert 0 < r.tau < 60 and r.pair_f1 > 0.8 and r.margin == 20.0 and len(r.hull_src) >= 3 and len(r.hull_ref) >= 3
    pts = np.array([(q[3] + 10, q[4] + 20) for q in rows if q[0] == "c001"])
    hull = {(round(p.x, 6), round(p.y, 6)) for p in r.hull_src}
    assert hull == {(round(x, 6), round(y, 6)) for x, y in cal.convex_hull(pts)}
    square = cal.convex_hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0], [0, 0]], float))
    assert len(square) == 4
    assert cal.ransac_plane(np.zeros((3, 2)), np.zeros((3, 2))) is None
    monkeypatch.setattr(cal, "FIT_POINTS", 60)
    some = cal.calibrate(gt, [("c001", "c002")]).first()
    assert np.allclose(some.H, H, atol=1e-3) and some.n == 240 and some.inliers < 120


def test_best_views_of_offline_clusters_keep_insertion_order(spark):
    from viewweave.operators.matching import clusters

    props = spark.createDataFrame([(1, "b", "c001"), (1, "a", "c002"), (1, "d", "c002")], "frame_id long, proposal_id string, camera_id string")
    links = spark.createDataFrame([(1, "b", "a", 0.5, 20.0), (1, "b", "d", 0.5, 10.0)], "frame_id long, src string, ref string, score double, distance double")
    label = lambda df: {r.proposal_id: r.cluster for r in df.collect()}
    assert label(clusters(props, links)) == {"a": "a", "b": "b", "d": "b"}  # the nearer one first
    assert label(clusters(props, links, offline=True)) == {"a": "a", "b": "a", "d": "d"}  # equal scores as they arise


def test_detector_batches_and_roles(spark):
    from viewweave.operators.enhance import detect
    from viewweave.operators.evaluation import output_roles

    frames = spark.createDataFrame([frame_row("c001", n, np.full((2, 2, 3), n, np.uint8)) for n in range(7)], FRAMES).coalesce(1)

    def batched(images):
        if len(images) > 3:
            raise ValueError("too many")
        return [(np.array([[0, 0, len(images), int(x[0, 0, 0])]]), [0.5], [2]) for x in images]

    got = {r.frame_id: r.boxes[0] for r in detect(frames, batched, 3).collect()}
    assert {k: v[3] for k, v in got.items()} == {k: float(k) for k in range(7)} and sorted(v[2] for v in got.values()) == [1.0] + [3.0] * 6
    with pytest.raises(Exception, match="results for"):
        detect(frames, lambda images: batched(images)[1:], 3).collect()
    tensors = "engine string, position int, name string, last_dim int, rank int, dtype string"
    full = spark.createDataFrame([("e", 0, "num_dets", 1, 2, "int32"), ("e", 1, "x", 4, 3, "float"), ("e", 2, "conf", 100, 2, "float"), ("e", 3, "y", 100, 2, "int32")], tensors)
    assert output_roles(full).first()[:] == ("e", "num_dets", "x", "conf", "y")
    with pytest.raises(Exception, match="scores, labels"):
        output_roles(full.where("position < 2")).collect()


def test_kernels_of_the_study():
    cells = [(r, c) for r in range(20, 24) for c in range(38, 42)]
    assert im.kept_macroblocks(cells, 0.5) == [(20, 38), (20, 39), (21, 38), (21, 39)] and im.kept_macroblocks(cells[:1], 0.1) == cells[:1]
    assert im.stack_frames([]).shape == (0, 3, 0, 0) and im.stack_frames([np.zeros((4, 6, 3), np.uint8)] * 2).shape == (2, 3, 4, 6)
    low, high = np.zeros((16, 32, 3), np.uint8), np.full((48, 96, 3), 9, np.uint8)
    out = im.mask_blend(low, high, [(0, 1)])
    assert (out[:, 48:] == 9).all() and not out[:, :48].any()
    out = im.box_blend(low, high, (2, 3, 10, 8))
    assert out.sum() == 9 * 3 * 24 * 15 and (out[9:24, 6:30] == 9).all()
    views = [np.full((2, 3, 3), k, np.uint8) for k in range(4)]
    whole = im.mosaic(views)
    assert whole.shape == (4, 6, 3) and [whole[0, 0, 0], whole[0, 5, 0], whole[3, 0, 0], whole[3, 5, 0]] == [0, 1, 2, 3]
    assert im.consolidate([(0, 0, 10, 10), (1, 1, 10, 10), (50, 50, 5, 5)], ProposalSettings()) == [(0, 0, 11, 11), (50, 50, 5, 5)]
    assert im.as_batch([np.zeros((3, 4, 5), np.uint8)]).shape == (1, 4, 5, 3)
    with pytest.raises(ValueError):
        im.as_batch([np.zeros((2, 2, 3)), np.zeros((3, 2, 3))])
    assert (im.to_grey(np.full((2, 2, 3), 100, np.uint8)) == 100).all()


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows behind the watermark of an earlier batch do not count; rows within the delay do."""
    from viewweave.streaming.background import gop_counts, run_to_end, with_event_time

    def feed(name, frames):
        with_event_time(spark.createDataFrame([(f,) for f in frames], "frame_id long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("frame_id long, ts timestamp").parquet(str(tmp_path / "in"))
        run_to_end(gop_counts(stream, 10, 10.0, "1 seconds").select("gop", "n"), str(tmp_path / "out"), str(tmp_path / "state"))

    feed("a", [*range(1, 31), 55])
    feed("b", [2, 42])  # frame 2 is 5 s late, frame 42 is not yet behind the watermark
    feed("c", [200])
    assert {r.gop: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 10, 1: 10, 2: 10, 4: 1, 5: 1}


def test_exchange_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from viewweave.operators.reporting import latency_stats
    from viewweave.sources import readers as rd
    from viewweave.sources import sinks

    pair = spark.createDataFrame([("a", "b", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], None, 3.0, 0.5, 20.0)], "src_cam string, ref_cam string, H array<array<double>>, hull_src array<struct<x:double,y:double>>, hull_ref array<struct<x:double,y:double>>, tau double, pair_f1 double, margin double")
    sinks.write_pairs(pair, str(tmp_path / "pairs"))
    back = rd.read_pairs(spark, str(tmp_path / "pairs")).first()
    assert back.tau == 3.0 and len(back.hull_src) == 3 and back.hull_ref is None
    runs = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "batch int, ms double")
    sinks.write_benchmark(latency_stats(runs), str(tmp_path / "bench"))
    rows = spark.read.csv(str(tmp_path / "bench" / "csv"), header=True, inferSchema=True).collect()
    assert [(r.batch, r["mean"]) for r in rows] == [(1, 3.0), (2, 5.0)]
    assert json.loads(spark.read.text(str(tmp_path / "bench" / "json")).first()[0])["rows"][1]["mean"] == 5.0
    metrics = spark.createDataFrame([("c001", 2, 1, 0, 1, 1.0, 0.5, 2 / 3), ("overall", 2, 1, 0, 1, 1.0, 0.5, 2 / 3)], "scope string, frames long, tp long, fp long, fn long, precision double, recall double, f1 double")
    sinks.write_metrics(metrics, str(tmp_path / "m"))
    assert [r.f1 for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()] == ["0.666667"] * 2
    lines = spark.createDataFrame([("1,2,30,60,15,9,1,-1",), ("",), ("short",)], "value string")
    assert [r.value for r in sinks.rescaled_gt_lines(lines).collect()] == ["1,2,10,20,5,3,1,-1", "short"]
    spark.createDataFrame([("1,7,10,20,30,40,1,-1,-1,-1",)], "value string").write.text(str(tmp_path / "gt"))
    assert spark.read.text(str(tmp_path / "gt")).count() == 1 and F is not None
    records = spark.createDataFrame([("c001", 4, [[0.0, 1.0, 2.0, 3.0], [1.0, 1.0, 5.0, 5.0]], [0.25], [])], "camera_id string, frame_id long, boxes array<array<double>>, scores array<double>, labels array<int>")
    from viewweave.operators.evaluation import explode_predictions

    assert [(r.score, r.label) for r in explode_predictions(records).orderBy("det_idx").collect()] == [(0.25, -1), (1.0, -1)]
