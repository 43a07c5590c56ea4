"""WARC archives with a two-level capture index.

Archives are .warc.gz files (a warcinfo record, then one gzip member a record) in a folder of the shared store, written by the tasks.
A task names its files anew each time it runs, and the table of segments names the files of the tasks that ended well, so a lost task
leaves at most a file that nothing reads. The index sorts reversed-host URL keys by range into shards of compressed blocks; the sparse
directory is each block's first key. A look-up finds its shard among the shards' first keys, binary-searches the shard's directory,
opens one block, binary-searches its lines, and reads one byte range of a file.

Equal payloads of at least min_bytes are stored once: the capture with the largest page_id is the response, others are revisits
that name it.

Scale: html moves at most once, and not at all while the duplicated payloads' digests are few enough to broadcast (counted; else
a sort-merge join whose skewed digests adaptive execution splits, as its other side has one row a digest). Archives never move:
records stream into files, and ranges are read out of them in order of file and place. Index entries are narrow and sorted by range, so
a hot host spreads over shards. The driver sees the first keys of at most SHARDS shards.

Files are opened by pyarrow's file systems (file, hdfs, s3, gs), by the URI of the shared folder.

Cases: null html is an empty payload; null or odd URLs have keys of their own text; rows with the same page_id are captures of
their own, and all of the largest id of a payload are responses; a null page_id is smaller than any other; texts of any length are whole;
an empty table gives an empty result; other columns are not read. Length and digest of a revisit are those that its record states; those
of a response are computed from the payload read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, materialise, shared_dir, sized_join

SEGMENT_BYTES = 64 << 20  # of compressed records, about
BLOCK_LINES = 3000
SHARD_ROWS, SHARDS = 50_000, 4096  # of captures, while there are no more shards than that
SEGMENTS = "segment long, path string, entries array<struct<key:string,page:long,row:long,start:long,length:long>>"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query, without scheme, user, default port or fragment; lower-case host."""
    text = (url or "").strip()
    scheme, mark, rest = text.partition("://")
    if not mark:
        return text
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:].partition("#")[0]
    name, colon, port = host.partition(":")
    if colon and port and port != {"http": "80", "https": "443"}.get(scheme.lower(), ""):
        name += ":" + port
    labels, colon, port = name.partition(":")
    return ",".join(reversed(labels.removeprefix("www.").split("."))) + colon + port + ")" + (path if path.startswith("/") else "/" + path)


def record(kind: str, page: int | None, url: str | None, digest: str, payload: bytes, refers: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit's block is the HTTP header alone, with the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and the payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda raw: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_segments(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives a stored table of pages; the stored segments with the place of each record."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("html"), F.sha1(body).alias("digest"))
    twice = own.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")
    marked = sized_join(own, materialise(twice), ["digest"])

    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    kind = pa.list_(pa.struct([("key", pa.string()), ("page", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, row, file, entries = TaskContext.get().partitionId() << 24, 0, 0, None, []
        for batch in batches:
            for page, url, html, digest, original in zip(*(batch[c].to_pylist() for c in ("page", "url", "html", "digest", "original"))):
                if file is None:
                    name = f"segment-{base + made:016d}-{uuid.uuid4().hex}.warc.gz"
                    file = create(f"{folder}/{name}")
                    file.write(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:segment:{base + made}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n\r\n".encode()))
                revisit = original is not None and page != original
                start = file.tell()
                file.write(member(record("revisit" if revisit else "response", page, url, base64.b32encode(bytes.fromhex(digest)).decode(), html.encode(), original, date)))
                entries.append({"key": url_key(url), "page": page, "row": (base << 20) + row, "start": start, "length": file.tell() - start})
                row += 1
                if file.tell() >= SEGMENT_BYTES:
                    file.close()
                    yield segment_row(base + made, f"{folder}/{name}", entries)
                    made, file, entries = made + 1, None, []
        if file is not None:
            file.close()
            yield segment_row(base + made, f"{folder}/{name}", entries)

    def segment_row(segment: int, path: str, entries: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([path]), pa.array([entries], kind)], names=["segment", "path", "entries"])

    with arrow_rows(pages.sparkSession, TEXT_ROWS):
        return materialise(marked.select("page", "url", "html", "digest", "original").mapInArrow(run, SEGMENTS))


def create(uri: str):
    """A new file of the store, with the folders above it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # records are compressed already


def open_file(uri: str) -> pa.NativeFile:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


# ---------------------------------------------------------------- the index


#: What a key must not hold inside a line; keys are sorted, stored and searched in this escaped form.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\x00", "\\0"))


def _line(key: str, row: int) -> str:
    """A line's sort key, of an escaped key."""
    return f"{key}\x00{row:020d}"


def build_index(segments: DataFrame) -> DataFrame:
    """The stored index: (shard, block, first, lines): blocks of sorted lines, compressed; (shard, block, first) is the directory."""
    entries = segments.select("segment", F.explode("entries").alias("e")).select("e.*", "segment")
    for plain, safe in ESCAPES:
        entries = entries.withColumn("key", F.replace("key", F.lit(plain), F.lit(safe)))
    n = segments.agg(F.sum(F.size("entries"))).first()[0] or 0
    ordered = entries.repartitionByRange(max(1, min(SHARDS, -(-n // SHARD_ROWS))), "key", "row").sortWithinPartitions("key", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, lines = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            first = lines[0].split("\t", 1)[0]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([first]), pa.array([zlib.compress("\n".join(lines).encode(), 6)], pa.binary())], names=["shard", "block", "first", "lines"])

        for batch in batches:
            for key, row, segment, start, length in zip(*(batch[c].to_pylist() for c in ("key", "row", "segment", "start", "length"))):
                lines.append(f"{_line(key, row)}\t{segment}\t{start}\t{length}")
                if len(lines) == BLOCK_LINES:
                    yield flush()
                    block, lines = block + 1, []
        if lines:
            yield flush()

    return materialise(ordered.mapInArrow(run, "shard long, block long, first string, lines binary"))


def find_line(first_keys: list[str], block_of, key: str) -> str | None:
    """The line of a key: binary search in the directory, then in one block."""
    k = bisect.bisect_right(first_keys, key) - 1
    if k < 0:
        return None
    lines = block_of(k)
    at = bisect.bisect_left(lines, key)
    return lines[at] if at < len(lines) and lines[at].split("\t", 1)[0] == key else None


def look_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, page, segment, start, length) of wanted captures (key, row, page); one that is not found is an error. Keys sort by code points in blocks and in shards alike."""
    starts = index.where("block = 0").select("shard", "first").orderBy("shard").collect()  # at most SHARDS rows
    first, shards = [r["first"] for r in starts], [r.shard for r in starts]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_line(reduce(lambda x, e: x.replace(*e), ESCAPES, k), r) for k, r in zip(batch["key"].to_pylist(), batch["row"].to_pylist())]
            shard = [shards[max(0, bisect.bisect_right(first, k) - 1)] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(keys, pa.string()), batch["row"], batch["page"]], names=["shard", "line_key", "row", "page"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("block")
        names, packed, opened = left["first"].to_pylist(), left["lines"].to_pylist(), {}

        def block_of(k: int) -> list[str]:
            if k not in opened:
                opened.clear()  # look-ups come in order of keys
                opened[k] = zlib.decompress(packed[k]).decode().split("\n")
            return opened[k]

        found = []
        for key, row, page in sorted(zip(right["line_key"].to_pylist(), right["row"].to_pylist(), right["page"].to_pylist()), key=lambda x: x[0]):
            line = find_line(names, block_of, key)
            if line is None:
                raise ValueError(f"the capture {key!r} of page {page} is not in the index")
            found.append((row, page, *map(int, line.split("\t")[1:])))
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate(("row", "page", "segment", "start", "length"))})

    dealt = wanted.mapInArrow(deal, "shard long, line_key string, row long, page long")
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(search, "row long, page long, segment long, start long, length long")


def read_captures(segments: DataFrame, places: DataFrame, with_payload: bool = False) -> DataFrame:
    """Reads byte ranges of archive files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload if asked for.

    places (segment, start, length) are dealt by ranges of file and place; each task reads its ranges in order.
    """
    number = lambda text: None if text is None or text.endswith(":None>") else int(text.rpartition(":")[2].rstrip(">"))
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
    names = [k for k in kinds if with_payload or k != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            out = []
            for own, start, length in zip(*(batch[c].to_pylist() for c in ("path", "start", "length"))):
                if own != path:
                    if file is not None:
                        file.close()
                    path, file = own, open_file(own)
                file.seek(start)
                warc, http, payload = parse_record(zlib.decompress(file.read(length), 31))
                full = warc["warc-type"] == "response"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else warc["warc-payload-digest"].removeprefix("sha1:")
                if full and f"sha1:{digest}" != warc["warc-payload-digest"]:
                    raise ValueError(f"the payload of {warc['warc-record-id']} is damaged")
                out.append((number(warc["warc-record-id"]), len(payload) if full else int(http["content-length"]), digest, warc["warc-type"], number(warc.get("warc-refers-to")), warc["warc-target-uri"], payload if with_payload else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(kinds.items()) if k in names], names=names)
        if file is not None:
            file.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if with_payload else "")
    found = sized_join(places.select("segment", "start", "length"), segments.select("segment", "path"), ["segment"], "inner")
    return found.repartitionByRange(max(1, 2 * segments.count()), "path", "start").sortWithinPartitions("path", "start").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives all pages, builds the index, and reads every capture back through it."""
    segments = write_segments(pages, min_bytes)
    index = build_index(segments)
    wanted = segments.select(F.explode("entries").alias("e")).select("e.key", "e.row", "e.page")
    return read_captures(segments, look_up(index, wanted))
