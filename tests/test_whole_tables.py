"""Queries over the whole of a table that is larger than the prefixes and caps they once had."""

from collections import Counter, defaultdict

import pytest

N = 16 * 420  # events: frames 0 to 419


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    kinds = ["view", "click", "purchase", "signup", "other"]
    rows = [(i, (i * 7919) % 503, kinds[i % 5], float(i % 11)) for i in range(N)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(3).write.parquet(str(at / "events.parquet"))
    return str(at), rows


def test_streams_read_all_events(spark, events):
    from viewweave.plans.queries import QUERIES

    at, rows = events
    assert Counter({r.gop: r.n for r in QUERIES["q_stream_gop_window"](spark, at).collect()}) == Counter(i // 16 // 10 for i, *_ in rows)
    sums = defaultdict(Counter)
    for i, u, *_ in rows:
        sums[f"c00{i % 4 + 1}"][i // 16] += 24 + u % 56
    want = set()
    for c, own in sums.items():
        v = [own[f] % 200 for f in sorted(own)]
        want.add((c, len(v), sum(abs(a - b) > 25 for a, b in zip(v[1:], v))))
    assert {(r.camera_id, r.frames, r.moved) for r in QUERIES["q_stream_absdiff_state"](spark, at).collect()} == want


def test_artifact_holds_all_events(spark, events, tmp_path):
    from pyspark.sql import functions as F

    from viewweave.plans.queries import QUERIES
    from viewweave.sources.readers import read_proposals
    from viewweave.sources.sinks import proposal_payload, write_proposals

    at, rows = events
    want = defaultdict(lambda: [0, 0])
    for i, u, *_ in rows:
        own = want[f"c00{i % 4 + 1}"]
        own[0], own[1] = own[0] + 1, own[1] + (i * 37 + u * 11) % 560 + (i * 53 + u * 7) % 300
    assert {(r.camera_id, r.n, r.checksum, r["first"]) for r in QUERIES["q_artifact_roundtrip"](spark, at).collect()} == {(c, n, s, "000000") for c, (n, s) in want.items()}
    box = F.expr("named_struct('x', 1, 'y', 2, 'w', 3, 'h', 4)")
    frames = spark.createDataFrame([("a", f) for f in (0, 1, 999, 1000, 2500, 2500)] + [("b", 7)], "camera_id string, frame_id long")
    props = frames.select(F.lit("").alias("proposal_id"), "camera_id", "frame_id", box.alias("bbox"), F.lit(0.5).alias("score"), F.col("frame_id").alias("source_frame"))
    assert proposal_payload(props, ["a", "c"]).count() == 5  # a: three ranges, b, and c without rows
    write_proposals(props, str(tmp_path / "json"), as_json=True, cameras=["a", "c"])
    back = read_proposals(spark, str(tmp_path / "json"))
    assert Counter((r.proposal_id, r.camera_id, r.frame_id, r.score) for r in back.collect()) == Counter([*((f"a_f{f:06d}_p{k:06d}", "a", f, 0.5) for f, k in ((0, 0), (1, 0), (999, 0), (1000, 0), (2500, 0), (2500, 1))), ("b_f000007_p000000", "b", 7, 0.5)])


def test_pairs_of_all_frames(spark, events):
    from viewweave.operators.calibration import same_diff_pairs, tracks
    from viewweave.plans.fixtures import detections
    from viewweave.plans.queries import QUERIES

    at, rows = events
    px = {i: (i * 37 + u * 11) % 560 + (24 + u % 56) / 2 for i, u, *_ in rows}
    got = Counter((r.frame_id, r.object_id, r.sx, r.rx) for r in QUERIES["q_same_id_join"](spark, at).collect())
    assert got == Counter((i // 16, i // 4, px[i], px[i + 1]) for i in range(0, N, 4))
    n = N // 16  # a frame has four objects in each camera: 4 pairs that are the same, 12 that are not
    cameras = ["c001", "c002", "c003", "c004"]
    whole = {(a, b, same): each * n for k, b in enumerate(cameras) for a in cameras[:k] for same, each in ((True, 4), (False, 12))}
    assert {(r.src, r.ref, r.same): r.n for r in QUERIES["q_same_diff"](spark, at).collect()} == whole
    from pyspark.sql import functions as F

    points = tracks(detections(spark, at).withColumn("object_id", F.expr("det_id div 4")))
    some = same_diff_pairs(points, [("c001", "c002")], 100).groupBy("same").count().collect()
    assert {r.same: r["count"] for r in some} == {True: 4 * 9, False: 12 * 9}  # the frame that passes the cap is the last
