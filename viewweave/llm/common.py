"""Shared storage, size-checked joins and the numpy text kit of the training-data operators."""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block at most; a block is so small that its numpy arrays fit beside the JVM.
BLOCK_ROWS = 400_000

#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


# ---------------------------------------------------------------- storage and joins


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors see.

    Where none is named, a session whose tasks all run in this process (a local master) gets a temporary one; on a cluster
    that is an error, as each machine would keep its own rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weave")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that holds while a stored result is computed; the session's own holds again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def arrow_rows(spark: SparkSession, rows: int):
    """While a stored result is computed, at most so many rows (whole texts, packed blocks) go to Python at a time."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors.

    Once it is written its exchanges are of no more use; their files go at once.
    """
    path = f"{shared_dir(df.sparkSession)}/weave-{uuid.uuid4().hex}"
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes what materialise() wrote; for tables that no plan reads any more."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; reads no more than it must to tell."""
    return df.limit(limit + 1).count() <= limit


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins left, whose keys may be skewed, to a right side with one row a key.

    A counted small right side is broadcast. A larger one is a sort-merge join without salt: with one row a key on the right,
    adaptive execution splits a skewed partition on the left; nothing above it in these operators asks for its partitioning,
    so that rule applies.
    """
    return left.join(F.broadcast(right) if small_enough(right, limit) else right, keys, how)


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as make it none of the taken names (case counts for nothing)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; the bytes of wide integers are laid out by significance, which compresses sorted deltas."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.dtype.itemsize > 1 and len(a) else a.tobytes()
        parts += [struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)), body]
    raw = b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", level).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", blob)
    raw = pa.Codec("zstd").decompress(blob[8:], size, asbytes=True)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, length = struct.unpack_from("<4sQ", raw, at)
        at += 12
        dtype = np.dtype(kind.decode().strip())
        body = np.frombuffer(raw, np.uint8, length * dtype.itemsize, at)
        at += length * dtype.itemsize
        out.append(np.ascontiguousarray(body.reshape(dtype.itemsize, length).T).view(dtype).reshape(-1) if dtype.itemsize > 1 and length else body.view(dtype))
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


def small_ints(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds a."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


# ---------------------------------------------------------------- texts as bytes


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) in one buffer, and the n + 1 offsets."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def in_chunks(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about limit bytes; a longer text stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def sized_batches(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Regroups a partition's batches (with a column text) in tables of about limit bytes of text.

    Where they are cut depends on the rows alone, not on the batches.
    """
    held: list[pa.Table] = []
    size = count = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        _, offs = flat_bytes(table["text"])
        a, n = 0, len(offs) - 1
        while a < n:
            b = min(n, a + BLOCK_ROWS - count, int(np.searchsorted(offs, offs[a] + limit - size, "right")) - 1)
            if b <= a:
                if held:
                    yield pa.concat_tables(held)
                    held, size, count = [], 0, 0
                    continue
                b = a + 1
            held.append(table.slice(a, b - a))
            size, count, a = size + int(offs[b] - offs[a]), count + b - a, b
    if held:
        yield pa.concat_tables(held)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2^64, and of its inverse; kept for the task up to 4 M entries."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            grown = np.ones(1, np.uint64)
            while len(grown) < size:
                grown = np.concatenate([grown, grown * np.uint64(pow(base, len(grown), 1 << 64))])
            _powers[name] = grown
    out = _powers["up"][:n], _powers["down"][:n]
    if n > 1 << 22:
        _powers.clear()
    return out


def prefix_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for hashes of any slice: hash(a, b) = (sums[b] - sums[a]) * down[a]."""
    up, down = powers(len(codes) + 1)
    table = mix(np.arange(1, 257, dtype=np.uint64)) if codes.dtype == np.uint8 else None
    value = table[codes] if table is not None else mix(codes.astype(np.uint64) + np.uint64(1))
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(value * up[:-1], out=sums[1:])
    return sums, down


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words [^\\x20\\x09-\\x0D]+ of each text, in order, and how many each text has."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    solid = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end = solid
    end[:-1] &= ~solid[1:] | edge[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums, down = prefix_hash(_LOWER[buf])
    counts = np.diff(np.searchsorted(begin, offs))
    return mix((sums[end] - sums[begin]) * down[begin]), counts


def chunked_words(buf: np.ndarray, offs: np.ndarray, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """words() in pieces of whole texts, so that its temporary arrays stay small."""
    parts = [words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in in_chunks(offs, limit)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the sorted distinct hashes of its k-word shingles (of all its words, if fewer), flat, with their counts."""
    n = len(hashes)
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - first[owner]
    left = counts[owner] - place
    width = np.minimum(counts[owner], k)
    ok = (left >= width) & ((place == 0) | (counts[owner] >= k))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        live = ok & (j < width)
        at = np.flatnonzero(live)
        out[at] = mix(out[at] * np.uint64(_BASE) + hashes[at + j] + np.uint64(j + 1))
    at = np.flatnonzero(ok)
    own, out = owner[at], out[at]
    order = np.lexsort((out, own))
    own, out = own[order], out[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    return out[keep], np.bincount(own[keep], minlength=len(counts)).astype(np.int64)


# ---------------------------------------------------------------- blocks of documents


BLOCK_BYTES = 2 << 20
BLOCK_SCHEMA = "block long, part int, data binary"
UID_BITS = 20  # rows of a block; a row's number is its block's, shifted, and its place there
TEXT_ROWS, PACKED_ROWS = 1000, 4  # whole texts and packed blocks that go to Python at a time


def store_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Packs whole texts into a stored table of compressed blocks (block, part = -1, data).

    Everything that numbers rows reads these blocks, so a scan that is cut otherwise later, or a lost executor, changes no
    number; docs may be any DataFrame. With carry, a block also holds the other columns, for carried().
    """
    others = [c for c in docs.columns if c != text_col] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 24
        for k, table in enumerate(sized_batches(batches, block_bytes)):
            buf, offs = flat_bytes(table["text"])
            ids = table["id"].combine_chunks()
            null = np.asarray(ids.is_null())
            rest = []
            if others:
                sink = pa.BufferOutputStream()
                own = table.drop_columns(["id", "text"]).combine_chunks()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_table(own)
                rest = [np.frombuffer(sink.getvalue(), np.uint8)]
            data = pack(np.asarray(ids.fill_null(0)).astype(np.int64), null, offs, buf, np.asarray(table["text"].combine_chunks().is_valid()), *rest)
            yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([-1], pa.int32()), pa.array([data], pa.binary())], names=["block", "part", "data"])
            lean()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(others)))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return materialise(own.mapInArrow(run, BLOCK_SCHEMA))


def with_rows(blocks: DataFrame, uids: DataFrame) -> DataFrame:
    """blocks with the column rows: the places of those of uids (uid) that lie in the block, null if there are none.

    At most BROADCAST_ROWS numbers are broadcast; more are joined, for which each block moves once.
    """
    own = uids.select(F.shiftright("uid", UID_BITS).alias("block"), F.col("uid").bitwiseAND((1 << UID_BITS) - 1).cast("int").alias("row"))
    lists = own.groupBy("block").agg(F.collect_list("row").alias("rows"))
    return blocks.join(F.broadcast(lists) if small_enough(uids) else lists, "block", "left")


def carried(data: bytes) -> pa.Table:
    """The other columns of a block, in their order."""
    return pa.ipc.open_stream(pa.py_buffer(unpack(data)[5].tobytes())).read_all()


def text_valid(data: bytes) -> np.ndarray:
    """Whether each text of a block is not null."""
    return unpack(data)[4]


def open_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, whether each is null, the offsets and the bytes of a block."""
    ids, null, offs, buf = unpack(data)[:4]
    return ids, null, offs, buf


def lean() -> None:
    """Gives what a worker's block has freed back to the machine."""
    import ctypes

    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    """A reply of packed rows; called at the end of a block's work, when its arrays are done with."""
    lean()
    return pa.table({"block": pa.array([x[0] for x in found], pa.int64()), "part": pa.array([x[1] for x in found], pa.int32()), "data": pa.array([x[2] for x in found], pa.binary())})
