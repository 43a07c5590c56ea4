"""Baseline JPEG media columns: parse markers, Huffman-decode scans, rebuild DC-only luminance thumbnails.

decode_thumbnails() reads any baseline (SOF0, 8 bits, Huffman) JPEG: grey or colour, any sampling, with or without restart
markers. All restart intervals of many images are decoded side by side, a symbol a step, in numpy; AC coefficients are
skipped, the DC of each luminance block gives one pixel. encode_payload() is the lossless opposite for 8-bit samples: each
byte becomes the DC of a block (quantiser 8), 24 blocks a row and a restart interval, so a payload comes back bit by bit as the
thumbnail. A payload of more rows than a JPEG can hold is several images, one after the other.

Scale: one scan of narrow work, no exchange; batches are cut to a megabyte of payload, so memory does not grow with texts.

Cases: null and empty texts are one row of padding (576 bytes of 255); texts of any length are whole; equal texts give equal
values; rows with the same or a null id stay rows of their own; an image that cannot be parsed raises ValueError in the decoder and
is a null thumbnail in the column operator; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, in_chunks, lean

UNIT, ROW, TALLEST = 576, 24, 341 * 24  # bytes of a payload unit; blocks of a row; rows of an image
DC_LENGTHS = {7: 2, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 0: 4, 1: 5, 8: 6}  # category: bits of its code
EOB = 0


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """The DHT counts and symbols of a code, and each symbol's code word."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    code, last, words = 0, 0, {}
    for s in symbols:
        code <<= lengths[s] - last
        words[s], last = code, lengths[s]
        code += 1
    return counts, symbols, words


def header(width: int, height: int) -> bytes:
    """Everything before the entropy-coded data of a grey image."""
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    out += b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
    for kind, lengths in ((0x00, DC_LENGTHS), (0x10, {EOB: 1})):
        counts, symbols, _ = canonical(lengths)
        out += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), kind) + bytes(counts) + bytes(symbols)
    return out + b"\xff\xdd" + struct.pack(">HH", 4, ROW) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)


def encode_payload(samples: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """One media value for each payload; samples are the payloads end to end, sizes their lengths (multiples of 576)."""
    _, _, words = canonical(DC_LENGTHS)
    code = np.array([words[c] for c in range(9)], np.uint32)
    bits_of = np.array([DC_LENGTHS[c] for c in range(9)], np.int64)
    category = np.zeros(512, np.int64)
    for d in range(-255, 256):
        category[d + 256] = abs(d).bit_length()
    x = samples.astype(np.int32).reshape(-1, ROW) - 128
    diff = np.diff(x, axis=1, prepend=0)
    cat = category[diff + 256]
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff).astype(np.uint32)
    value = ((code[cat] << cat.astype(np.uint32)) | extra) << np.uint32(1)  # and the one-bit end of block
    width = bits_of[cat] + cat + 1
    spare = -width.sum(1) % 8
    value = np.concatenate([value, ((1 << spare) - 1).astype(np.uint32)[:, None]], 1).reshape(-1)
    width = np.concatenate([width, spare[:, None]], 1)
    row_bytes = width.sum(1) // 8
    width = width.reshape(-1)
    left = (value << (16 - width).astype(np.uint32)).astype(">u2")
    bits = np.unpackbits(left.view(np.uint8)).reshape(-1, 16)
    packed = np.packbits(bits[np.arange(16) < width[:, None]])
    # stuffing after 255 and a restart marker (or the end) after each row
    stuffed = packed == 255
    ends = np.cumsum(row_bytes)
    before = np.cumsum(stuffed) - stuffed
    row = np.repeat(np.arange(len(row_bytes)), row_bytes)
    at = np.arange(len(packed)) + before + 2 * row
    n_stuffed = np.add.reduceat(stuffed.astype(np.int64), ends - row_bytes)
    row_end = np.cumsum(row_bytes + n_stuffed + 2)
    out = np.zeros(int(row_end[-1]), np.uint8)
    out[at] = packed
    rows = sizes // ROW
    first = np.repeat(np.cumsum(rows) - rows, rows)
    inside = np.arange(len(row_bytes)) - first
    last = np.zeros(len(row_bytes), bool)
    last[np.cumsum(rows) - 1] = True
    inside %= TALLEST
    last |= inside == TALLEST - 1
    out[row_end - 2] = 255
    out[row_end - 1] = np.where(last, 0xD9, 0xD0 + inside % 8)
    media, r, raw = [], 0, out.tobytes()
    for n in rows.tolist():
        parts = []
        for a in range(0, n, TALLEST):
            m = min(TALLEST, n - a)
            begin = int(row_end[r + a - 1]) if r + a else 0
            parts += [header(8 * ROW, 8 * m), raw[begin : int(row_end[r + a + m - 1])]]
        media.append(b"".join(parts))
        r += n
    return media


# ---------------------------------------------------------------- decoding


@dataclass(frozen=True)
class Spec:
    """What a scan's decoding depends on, besides its data."""

    dc: tuple[bytes, ...]  # DHT payload (counts and symbols) of each component
    ac: tuple[bytes, ...]
    sampling: tuple[tuple[int, int], ...]
    quantiser: int


@dataclass
class Image:
    width: int
    height: int
    spec: Spec
    restart: int
    begin: int
    end: int


def parse(data: bytes) -> list[Image]:
    """The images of a media value, one after the other."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        dc, ac, quant, frame, restart = {}, {}, {}, None, 0
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("no marker")
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC0:
                if body[0] != 8:
                    raise ValueError("samples are not of 8 bits")
                frame = (*struct.unpack(">HH", body[1:5]), {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])})
            elif kind in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and kind != 0xCC:
                raise ValueError("not baseline")
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = body[1:n]
                    body = body[n:]
            elif kind == 0xDD:
                restart = int.from_bytes(body, "big")
            elif kind == 0xDA:
                break
        if frame is None:
            raise ValueError("no frame")
        height, width, parts = frame
        order = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        if len(order) != len(parts):
            raise ValueError("a scan without all components")
        end = data.find(b"\xff\xd9", at)
        if end < 0:
            raise ValueError("no end of image")
        sampling = tuple(parts[c][:2] for c, _ in order)
        if len(order) == 1:
            sampling = ((1, 1),)
        spec = Spec(tuple(dc[t >> 4] for _, t in order), tuple(ac[t & 15] for _, t in order), sampling, quant[parts[order[0][0]][2]])
        out.append(Image(width, height, spec, restart, at, end))
        at = end + 2
    return out


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits (length 0: no code)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            a, b = code << (16 - n), (code + 1) << (16 - n)
            symbol[a:b], length[a:b] = table[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def _decode(spec: Spec, data: np.ndarray, starts: np.ndarray, mcus: np.ndarray) -> np.ndarray:
    """The first component's quantised DCs, (lane, MCU x block), of restart intervals that start at byte `starts`."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data) + 8, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(word)]
    top = len(word) - 1
    tables = [(lookup(d), lookup(a)) for d, a in zip(spec.dc, spec.ac)]
    lanes, most = len(starts), int(mcus.max())
    luma = spec.sampling[0][0] * spec.sampling[0][1]
    out = np.zeros((lanes, most * luma), np.int32)
    pos, last = starts.astype(np.int64) * 8, [np.zeros(lanes, np.int64) for _ in spec.dc]

    def peek(where: np.ndarray) -> np.ndarray:
        return word[np.minimum(where >> 3, top)] << (where & 7).astype(np.uint64)

    for m in range(most):
        live = np.flatnonzero(mcus > m) if int(mcus.min()) <= m else slice(None)
        p = pos[live]
        for c, (h, v) in enumerate(spec.sampling):
            (dsym, dlen), (asym, alen) = tables[c]
            for b in range(h * v):
                w = peek(p)
                key = (w >> np.uint64(48)).astype(np.int64)
                size, n = dsym[key], dlen[key]
                if not n.all():
                    raise ValueError("no such code")
                bits = ((w << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
                last[c][live] += np.where(bits < (np.int64(1) << size >> 1), bits - (np.int64(1) << size) + 1, bits)
                p = p + n + size
                if c == 0:
                    out[live, m * luma + b] = last[0][live]
                open_at, k = np.arange(len(p)), np.ones(len(p), np.int64)
                while len(open_at):
                    w = peek(p[open_at])
                    key = (w >> np.uint64(48)).astype(np.int64)
                    s, n = asym[key], alen[key]
                    if not n.all():
                        raise ValueError("no such code")
                    p[open_at] += n + (s & 15)
                    k[open_at] += (s >> 4) + 1
                    going = (s != EOB) & (k[open_at] < 64)
                    open_at = open_at[going]
        pos[live] = p
    return out


def decode_thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each media value the DC-only luminance thumbnails of its images, as uint8 arrays of one pixel a block."""
    found = [(i, image) for i, data in enumerate(media) for image in parse(data)]
    out: list[list[np.ndarray]] = [[] for _ in media]
    for spec in dict.fromkeys(image.spec for _, image in found):
        mine = [(i, image) for i, image in found if image.spec == spec]
        raw = np.frombuffer(b"".join(part for i, image in mine for part in (media[i][image.begin : image.end], b"\xff\xd8")), np.uint8)
        ff = np.flatnonzero(raw[:-1] == 255)
        follow = raw[ff + 1]
        gone = np.zeros(len(raw), bool)
        gone[ff[follow == 0] + 1] = True
        breaks = ff[(follow >= 0xD0) & (follow <= 0xD8)]
        breaks = breaks[~gone[breaks]]
        gone[breaks] = gone[breaks + 1] = True
        final = raw[breaks + 1] == 0xD8  # put in above: the end of an image
        kept = np.cumsum(~gone)
        clean = raw[~gone]
        starts = np.concatenate([[0], kept[breaks]])[:-1]
        image_of = np.concatenate([[0], np.cumsum(final)])[:-1]
        h, v = max(a for a, _ in spec.sampling), max(b for _, b in spec.sampling)
        wide = np.array([-(-image.width // (8 * h)) for _, image in mine])
        total = wide * np.array([-(-image.height // (8 * v)) for _, image in mine])
        restart = np.array([image.restart or t for (_, image), t in zip(mine, total)])
        lane_first = np.searchsorted(image_of, np.arange(len(mine)))
        nth = np.arange(len(starts)) - lane_first[image_of]
        mcus = np.minimum(restart[image_of], total[image_of] - nth * restart[image_of])
        if (mcus < 1).any() or (np.bincount(image_of, mcus, len(mine)) != total).any():
            raise ValueError("restart intervals do not fit the image")
        dcs = _decode(spec, clean, starts, mcus)
        pixels = np.clip((dcs * spec.quantiser + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        lh, lv = spec.sampling[0]
        used = np.arange(dcs.shape[1]) < (mcus * lh * lv)[:, None]
        flat = pixels[used]
        cuts = np.cumsum(total * lh * lv)
        for (i, image), w, a, b in zip(mine, wide.tolist(), [0, *cuts.tolist()], cuts.tolist()):
            grid = flat[a:b].reshape(-1, w, lv, lh).transpose(0, 2, 1, 3).reshape(-1, w * lh)
            out[i].append(grid[: -(-image.height * lv // (8 * v)), : -(-image.width * lh // (8 * h))])
    return out


def thumbnail_hash(pixels: np.ndarray) -> str:
    """A 64-bit average hash of an 8 x 8 reduction, in hexadecimal."""
    h, w = pixels.shape
    ys, xs = np.arange(8) * h // 8, np.arange(8) * w // 8
    small = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), ys, 0), xs, 1)
    area = np.maximum(1, np.diff(np.append(ys, h)))[:, None] * np.maximum(1, np.diff(np.append(xs, w)))[None, :]
    mean = small / area
    return f"{int.from_bytes(np.packbits(mean > mean.mean()).tobytes(), 'big'):016x}"


# ---------------------------------------------------------------- columns


def media_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column: each whole text as a JPEG payload."""

    def run(batches):
        for batch in batches:
            whole, at = flat_bytes(batch["text"])
            for a, b in in_chunks(at, 1 << 19):
                buf, offs = whole[at[a] : at[b]], at[a : b + 1] - at[a]
                n = np.diff(offs)
                sizes = np.maximum(1, -(-n // UNIT)) * UNIT
                samples = np.full(int(sizes.sum()), 255, np.uint8)
                samples[np.arange(len(buf)) + np.repeat(np.cumsum(sizes) - sizes - offs[:-1], n)] = buf
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array(n), pa.array(encode_payload(samples, sizes), pa.binary())], names=["doc_id", "n_bytes", "media"])
            lean()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe_media(table: DataFrame, payload: bool = False) -> DataFrame:
    """Reads a media column back: the table's other columns, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the payload if asked for."""
    names = [c for c in table.columns if c != "media"]

    def run(batches):
        for batch in batches:
            stored = batch["media"].to_pylist()
            ends = np.cumsum([len(x or b"") for x in stored])
            for a, b in in_chunks(np.concatenate([[0], ends]).astype(np.int64), 1 << 20):
                media = stored[a:b]
                try:
                    pictures = decode_thumbnails([x or b"" for x in media])
                except (ValueError, KeyError, IndexError, struct.error):
                    pictures = [_one(x) for x in media]
                rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload")}
                for x, images in zip(media, pictures):
                    whole = b"".join(p.tobytes() for p in images) if images else None
                    rows["payload_bytes"].append(None if whole is None else len(whole))
                    rows["payload_sha256"].append(None if whole is None else hashlib.sha256(whole).hexdigest())
                    rows["tail_crc32"].append(None if whole is None else zlib.crc32(whole[-32:]))
                    rows["media_bytes"].append(None if x is None else len(x))
                    rows["media_sha256"].append(None if x is None else hashlib.sha256(x).hexdigest())
                    rows["feature"].append(";".join(f"{8 * p.shape[1]}x{8 * p.shape[0]}:{thumbnail_hash(p)}" for p in images) if images else None)
                    rows["payload"].append(whole)
                kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "payload": pa.binary()}
                keep = [k for k in kinds if payload or k != "payload"]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in names), *(pa.array(rows[k], kinds[k]) for k in keep)], names=[*names, *keep])
            lean()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "media")
    return table.mapInArrow(run, schema + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", payload binary" if payload else ""))


def _one(data: bytes | None) -> list[np.ndarray]:
    try:
        return decode_thumbnails([data])[0] if data else []
    except (ValueError, KeyError, IndexError, struct.error):
        return []
