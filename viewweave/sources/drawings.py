"""Images for people: boxes drawn on frames, and PNG files that tasks write to shared storage."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.enhance import packed, unpack
from ..schemas import FRAMES


def draw_box(image: np.ndarray, box: list[float], colour: tuple[int, int, int] = (0, 255, 0), width: int = 2) -> None:
    """Draws the outline of (x1, y1, x2, y2) inside the box; what lies outside the image is left out."""
    x1, y1, x2, y2 = (int(round(v)) for v in box)
    inner = slice(max(0, y1), max(0, y2)), slice(max(0, x1), max(0, x2))
    before = image[max(0, y1 + width) : max(0, y2 - width), max(0, x1 + width) : max(0, x2 - width)].copy()
    image[inner] = colour
    image[max(0, y1 + width) : max(0, y2 - width), max(0, x1 + width) : max(0, x2 - width)] = before


def drawn(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """frames with the outlines of boxes (camera_id, frame_id, x1, y1, x2, y2); a frame meets its own boxes once."""
    kinds = pa.schema([("camera_id", pa.string()), ("frame_id", pa.int64()), *((k, pa.int32()) for k in ("height", "width", "n_channels")), ("data", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for frame in left.to_pylist():
            image = unpack(frame).copy()
            for b in sorted(tuple(b[c] for c in ("x1", "y1", "x2", "y2")) for b in right.to_pylist()):
                draw_box(image, b)
            out.append({"camera_id": frame["camera_id"], "frame_id": frame["frame_id"], **packed(image)})
        return pa.Table.from_pylist(out, kinds)

    keys, corners = ["camera_id", "frame_id"], ["x1", "y1", "x2", "y2"]
    own = boxes.select(*keys, *corners).dropna(subset=corners)
    return frames.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, FRAMES)


def png(image: np.ndarray) -> bytes:
    """A BGR or grey image as a PNG file: 8 bits a sample, no filter."""
    height, width, channels = image.shape
    samples = image[..., ::-1] if channels == 3 else image
    lines = np.concatenate([np.zeros((height, 1), np.uint8), samples.reshape(height, -1)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(images: DataFrame, path: str, name: str = "name") -> DataFrame:
    """Writes each row (name, height, width, n_channels, data) as path/name.png; one row (name, n_bytes) a file.

    path is a folder that all executors share, as a URI that pyarrow's file systems know. A file takes its name only once it is
    whole, so a task that runs twice leaves the same files. Evaluated when the result is.
    """

    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        for b in batches:
            out = []
            for r in b.to_pylist():
                body, part = png(unpack(r)), f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(body)
                store.move(part, f"{folder}/{r['name']}.png")
                out.append({"name": r["name"], "n_bytes": len(body)})
            yield from pa.Table.from_pylist(out, pa.schema([("name", pa.string()), ("n_bytes", pa.int64())])).to_batches()

    own = images.select(images[f"`{name}`"].cast("string").alias("name"), "height", "width", "n_channels", "data")
    return own.mapInArrow(run, "name string, n_bytes long")
