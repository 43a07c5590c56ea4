"""Vector best-fit packing of token pieces into sequences.

Every document becomes its token ids and a final id 0, cut into pieces of at most `capacity` tokens. Pieces are items with
three sizes (tokens, one document, attention cost = length squared); a sequence has a capacity for each. Bins are chosen by
the smallest weighted residual norm, or the largest weighted dot product, among those that hold the item under every
constraint, longest items first.

Scale: the choice of bins needs only how many pieces have each length, a table of at most `capacity` rows. One driver-side
plan works on these counts (bins in the same state are one entry with a multiplicity); the pieces are then placed by
their rank within their length, in a distributed pass over narrow rows. No text and no key is ever dealt out by a hot value.

Cases: null and empty texts are one piece with the id 0 alone; texts of any length are cut, never shortened; rows with the
same or a null id are packed as rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, flat_bytes, in_chunks, lean, materialise, mix, powers

CHUNK_BYTES = 1 << 20  # of text that is tokenized at a time
PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, task int, nth long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weights of the three dimensions in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


# ---------------------------------------------------------------- tokens


class WordTokens:
    """Token ids of many texts by a tokenizers file whose pieces never cross its pre-tokens.

    Texts of plain Latin characters are split in numpy and each distinct pre-token is given to the tokenizer once;
    any other text, and any that holds an added token, goes to the tokenizer whole, so results are those of the tokenizer itself.
    """

    LIMIT = 400_000  # distinct pre-tokens kept; beyond it the memory starts anew

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # added tokens cross pre-tokens; one that is sought in the normalised text can stand there in other letters
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.exact = [t.content for t in added if not t.normalized]
        self.folded = [t.content.lower() for t in added if t.normalized]
        kinds = np.full(0x251, 9, np.uint8)  # the last entry stands for all other characters
        for c in [*range(9, 14), *range(0x20, 0x7F), *range(0xA1, 0x250)]:
            ch, cat = chr(c), unicodedata.category(chr(c))
            if len(ch.lower()) == 1 and ord(ch.lower()) < 0x250 and unicodedata.normalize("NFC", ch) == ch:
                kinds[c] = 0 if c < 0x21 else 1 if cat[0] == "L" else 2 if cat[0] == "N" else 9 if cat == "Cf" else 3
        self.kinds = kinds
        lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x251)], np.uint64)
        self.value = mix(lower + np.uint64(1))
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted keys of pre-tokens
        self.entry = np.zeros(0, np.int32)  # their places in first and size
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def holds_added(self, text: str) -> bool:
        return any(c in text for c in self.exact) or bool(self.folded) and any(c in text.lower() for c in self.folded)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Encodes new pre-tokens; keys are sorted."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        more, n = int(size.sum()), len(self.known)
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(found) > len(self.size):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(found), np.int32, more)
        self.first[n : n + len(found)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(found)] = size
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.entry = np.insert(self.entry, at, np.arange(n, n + len(found), dtype=np.int32))
        self.used += more

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and how many each text has."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        codes = np.minimum(codes, 0x250).astype(np.intp)
        kind = self.kinds[codes]
        odd = np.flatnonzero((kind == 9) | (codes == 0x27))
        odd = np.searchsorted(begin, odd, "right") - 1
        if self.holds_added(joined):
            odd = np.concatenate([odd, np.array([d for d, text in enumerate(texts) if self.holds_added(text)], odd.dtype)])
        odd = np.unique(odd)
        for d in odd:
            kind[begin[d] : begin[d] + lens[d]] = 0
        first = kind != 0
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        last = kind != 0
        last[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.value[codes] * up[:-1], out=sums[1:])
        keys = mix((sums[b] - sums[a]) * down[a])
        some, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(some) > self.LIMIT:
            self.clear()
        new = np.arange(len(some))
        if len(self.known):
            new = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)] != some)
        if len(new):
            self.learn(some[new], [joined[x:y] for x, y in zip(a[at[new]].tolist(), b[at[new]].tolist())])
        entry = self.entry[np.searchsorted(self.known, some)][back].astype(np.int64)
        size = self.size[entry] if len(entry) else np.zeros(0, np.int64)
        head = self.first[entry] if len(entry) else np.zeros(0, np.int64)
        total = np.cumsum(size)
        ids = self.flat[np.repeat(head - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)]
        count = np.bincount(np.searchsorted(begin, a, "right") - 1, size, len(texts)).astype(np.int64) if len(a) else np.zeros(len(texts), np.int64)
        if len(odd):
            cut = np.split(ids, np.cumsum(count)[:-1])
            for d in odd:
                cut[d] = self.whole(texts[d])
                count[d] = len(cut[d])
            ids = np.concatenate(cut)
        return ids, count


@lru_cache(maxsize=1)
def coder_of(path: str) -> WordTokens:
    """The Python worker's coder for this file; its next tasks find at most WordTokens.LIMIT pre-tokens known."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, (task, nth): its rank among this task's pieces of that length; ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, task, seen = coder_of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, offs = flat_bytes(batch["text"])
            for x, y in in_chunks(offs, CHUNK_BYTES):
                texts = [t or "" for t in batch["text"].slice(x, y - x).to_pylist()]
                ids, count = coder.encode(texts)
                total = count + 1
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                ends = np.cumsum(total)
                whole = np.zeros(int(ends[-1]), np.uint32)
                keep = np.ones(len(whole), bool)
                keep[ends - 1] = False
                whole[keep] = ids
                head = (ends - total)[doc] + start
                view = memoryview(whole.view(np.uint8))
                crc = [zlib.crc32(view[4 * h : 4 * (h + n)]) for h, n in zip(head.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                group = np.diff(np.append(new, len(ranked)))
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(ranked)) - np.repeat(new, group) + seen[ranked]
                seen[ranked[new]] += group
                cols = [batch["id"].slice(x, y - x).take(pa.array(doc)), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if with_ids:
                    cols.append(pa.array([whole[h : h + n].astype(np.int32) for h, n in zip(head.tolist(), length.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
            lean()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- the plan


@dataclass
class Plan:
    """Runs of pieces: piece ranks [rank, rank + bins * each) of a length go, `each` a bin, to bins [bin, bin + bins) at `offset`."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    bins: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def add(self, *row: int) -> None:
        for name, value in zip(("length", "rank", "bin", "bins", "each", "offset"), row):
            getattr(self, name).append(value)


def best_fit(counts: dict[int, int], cap: Capacity = Capacity()) -> tuple[Plan, int]:
    """Packs counts[length] pieces of each length; the plan and the number of bins.

    An open entry is (residual tokens, residual documents, residual attention, first bin, bins). The last length's
    exact fits come first: an entry whose token residual equals the item is a perfect fit under either rule.
    """
    plan, made = Plan(), 0
    open_bins: list[tuple[int, int, int, int, int]] = []  # sorted by residual tokens
    norm = (1 / cap.tokens, 1 / cap.documents, 1 / cap.attention)

    def fits(e: tuple[int, int, int, int, int], n: int) -> int:
        return min(e[0] // n, e[1], e[2] // (n * n))

    def score(e: tuple[int, int, int, int, int], n: int) -> float:
        item = (n, 1, n * n)
        if cap.rule == "dot":
            return -sum(w * a * s * b * s for w, a, b, s in zip(cap.weights, e, item, norm)) / max(1e-12, sum(w * (a * s) ** 2 for w, a, s in zip(cap.weights, e, norm)) ** 0.5)
        return sum(w * ((a - b) * s) ** 2 for w, a, b, s in zip(cap.weights, e, item, norm))

    for n in sorted((k for k, c in counts.items() if c > 0), reverse=True):
        if n > cap.tokens or n * n > cap.attention:
            raise ValueError(f"a piece of {n} tokens exceeds a sequence's capacity")
        left, rank = counts[n], 0
        while left:
            a = bisect.bisect_left(open_bins, (n,))
            found = min((e for e in open_bins[a:] if fits(e, n)), key=lambda e: (score(e, n), e[0], e[3]), default=None)
            if found:
                open_bins.remove(found)
                tokens, docs, cost, bin0, bins = found
            else:
                tokens, docs, cost, bin0 = cap.tokens, cap.documents, cap.attention, made
                bins = -(-left // fits((tokens, docs, cost, 0, 0), n))
                made += bins
            each = min(fits((tokens, docs, cost, 0, 0), n), left)
            full = min(bins, left // each)
            plan.add(n, rank, bin0, full, each, cap.tokens - tokens)
            for first, some, put in ((bin0, full, each), (bin0 + full, 1 if full < bins and left - full * each else 0, left - full * each)):
                if first != bin0 and some:
                    if not 0 < put < each:
                        some = 0
                    else:
                        plan.add(n, rank + full * each, first, 1, put, cap.tokens - tokens)
                if some and tokens - put * n > 0:
                    bisect.insort(open_bins, (tokens - put * n, docs - put, cost - put * n * n, first, some))
                if first != bin0:
                    full_end = first + some
                    if bin0 + bins > full_end:
                        bisect.insort(open_bins, (tokens, docs, cost, full_end, bin0 + bins - full_end))
                    used = full * each + (put if some else 0)
            left -= used
            rank += used
    return plan, made


def pack_pieces(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to stored pieces (length, task, nth)."""
    spark = pieces.sparkSession
    from pyspark.sql import Window

    per_task = pieces.groupBy("length", "task").agg(F.max("nth").alias("top")).withColumn("n", F.col("top") + 1)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most cap.tokens rows
    plan, _ = best_fit(counts, cap)
    order = np.lexsort((np.array(plan.rank, np.int64), np.array(plan.length, np.int64)))
    table = {k: np.array(getattr(plan, k), np.int64)[order] for k in ("length", "rank", "bin", "bins", "each", "offset")}
    shared = spark.sparkContext.broadcast(table)  # bounded: a few entries for each of at most cap.tokens lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        width = np.int64(1) << np.int64(48)
        keys = t["length"] * width + t["rank"]
        for b in batches:
            n = b.num_rows
            length, rank = np.asarray(b["length"]), np.asarray(b["rank"])
            e = np.searchsorted(keys, length * width + rank, "right") - 1 if n else np.zeros(0, np.int64)
            inside = rank - t["rank"][e]
            seq = t["bin"][e] + inside // t["each"][e]
            off = t["offset"][e] + inside % t["each"][e] * length
            names = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(b[x] for x in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "task", "nth")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs whole documents: doc_id, piece, start, length, ids_crc32, (ids), sequence_id, offset."""
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        pieces = materialise(token_pieces(docs, tokenizer, id_col, text_col, cap.tokens, with_ids))
    return pack_pieces(pieces, cap)
