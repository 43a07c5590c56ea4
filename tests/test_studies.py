"""The macroblock study against a plain loop, drawings and image files read back, and the calibration's report."""

import struct
import zlib

import numpy as np

from viewweave.operators import images as im
from viewweave.operators.enhance import packed
from viewweave.operators.studies import confidence, macroblock_study
from viewweave.sources.drawings import draw_box, drawn, png, write_images
from viewweave.sources.sinks import write_matrices

FRAME = "camera_id string, frame_id long, height int, width int, n_channels int, data binary"


def frames(spark):
    rng = np.random.default_rng(3)
    found = {(c, f): rng.integers(0, 180, (48, 64, 3)).astype(np.uint8) for c in ("c001", "c002") for f in (1, 2)}
    return found, spark.createDataFrame([{"camera_id": c, "frame_id": f, **packed(x)} for (c, f), x in found.items()], FRAME)


def test_macroblock_study(spark):
    def brighter(batch):
        return np.stack([np.clip(im.upscale(x, 3).astype(int) + 40, 0, 255).astype(np.uint8) for x in batch])

    def by_brightness(image):  # one box, whose score is the mean brightness inside
        return np.array([[24.0, 24.0, 120.0, 96.0]]), np.array([image[24:96, 24:120].mean() / 255]), np.array([2])

    found, table = frames(spark)
    objects = [("c001", 1, 1, 8, 8, 40, 32), ("c001", 1, 2, 0, 0, 10, 10), ("c001", 2, 3, 30, 20, 64, 48), ("c002", 1, 4, 8, 8, 41, 33), ("c009", 1, 5, 8, 8, 40, 32)]
    rows = {r.obj_id: r for r in macroblock_study(table, spark.createDataFrame(objects, "camera_id string, frame_id long, obj_id long, x1 int, y1 int, x2 int, y2 int"), brighter, by_brightness).collect()}
    assert sorted(rows) == [1, 3, 4]  # object 2 lies in one macroblock, 5 has no frame
    for cam, frame, k, *box in objects:
        if k not in rows:
            continue
        low = found[cam, frame]
        high = brighter(low[None, ..., ::-1])[0][..., ::-1]
        cells = [(r, c) for r in range(box[1] // 16, (box[3] - 1) // 16 + 1) for c in range(box[0] // 16, (box[2] - 1) // 16 + 1)]
        kept = [x for x in cells[: max(1, len(cells) // 2)] if x[0] < 3 and x[1] < 4]
        mixed = im.upscale(low, 3)
        for r, c in kept:
            mixed[r * 48 : r * 48 + 48, c * 48 : c * 48 + 48] = high[r * 48 : r * 48 + 48, c * 48 : c * 48 + 48]
        boxed = im.upscale(low, 3)
        x1, y1, x2, y2 = (3 * v for v in box)
        boxed[y1:y2, x1:x2] = high[y1:y2, x1:x2]
        want = [confidence(by_brightness(x), np.array([x1, y1, x2, y2], float)) for x in (im.upscale(low, 3), mixed, boxed, high)]
        r = rows[k]
        assert (r.num_mbs, r.num_kept_mbs) == (len(cells), len(kept))
        assert np.allclose([r.conf_bilinear, r.conf_mb_based, r.conf_obj_based, r.conf_full_sr], want)
    assert rows[1].conf_full_sr > rows[1].conf_mb_based > rows[1].conf_bilinear > 0
    assert rows[3].conf_full_sr == 0.0  # its box is far from the only detection


def test_confidence_of_no_and_empty_boxes():
    assert confidence((np.zeros((0, 4)), np.zeros(0), np.zeros(0)), np.array([0.0, 0, 5, 5])) == 0.0
    assert confidence((np.array([[3.0, 3, 3, 3]]), np.array([0.9]), np.array([1])), np.array([3.0, 3, 3, 3])) == 0.0


def samples(data):
    """An unfiltered PNG's pixels, BGR."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        own = data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(kind + own)
        head = struct.unpack(">IIBBBBB", own) if kind == b"IHDR" else head
        body += own if kind == b"IDAT" else b""
        at += 12 + n
    width, height, channels = head[0], head[1], {0: 1, 2: 3}[head[3]]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, channels)[..., ::-1]


def test_drawings_and_image_files(spark, tmp_path):
    found, table = frames(spark)
    boxes = spark.createDataFrame([("c001", 1, 5.0, 6.0, 30.0, 20.0), ("c001", 1, -4.0, 40.0, 12.0, 70.0), ("c001", 2, None, 1.0, 2.0, 3.0), ("c003", 1, 1.0, 1.0, 9.0, 9.0)], "camera_id string, frame_id long, x1 double, y1 double, x2 double, y2 double")
    out = drawn(table, boxes)
    folder = f"file://{tmp_path}/images"
    assert write_images(out.selectExpr("concat(camera_id, '_', frame_id) AS label", "height", "width", "n_channels", "data"), folder, "label").count() == 4
    assert sorted(p.name for p in (tmp_path / "images").iterdir()) == ["c001_1.png", "c001_2.png", "c002_1.png", "c002_2.png"]
    for (cam, frame), image in found.items():
        got = samples((tmp_path / "images" / f"{cam}_{frame}.png").read_bytes())
        want = image.copy()
        if (cam, frame) == ("c001", 1):
            inside = np.zeros((48, 64), bool)
            for x1, y1, x2, y2 in ((5, 6, 30, 20), (0, 40, 12, 48)):
                inside[y1:y2, x1:x2] = True
            inside[8:18, 7:28] = False
            inside[42:48, 0:10] = False
            want[inside] = (0, 255, 0)
        assert np.array_equal(got, want)
    assert np.array_equal(samples(png(image[..., :1]))[..., 0], image[..., 0])


def test_a_small_box_is_filled():
    image = np.zeros((10, 10, 3), np.uint8)
    draw_box(image, [2, 2, 5, 5])
    assert image[2:5, 2:5, 1].min() == 255 and image.sum() == 9 * 255
    draw_box(image, [-9, -9, -3, -3])
    assert image.sum() == 9 * 255


def test_matrices_and_report(spark, tmp_path):
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    pairs = spark.createDataFrame([("c002", "c003", eye, 38.19096, 0.29934), ("c001", "c002", eye, None, 0.5)], "src_cam string, ref_cam string, H array<array<double>>, tau double, pair_f1 double")
    write_matrices(pairs, f"file://{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/out/report").collect()] == ["c001 -> c002: tau null px, F1 0.5000", "c002 -> c003: tau 38.1910 px, F1 0.2993"]
    assert {(r.src_cam, r.ref_cam): r.H for r in spark.read.parquet(f"file://{tmp_path}/out/homographies").collect()} == {("c002", "c003"): eye, ("c001", "c002"): eye}
