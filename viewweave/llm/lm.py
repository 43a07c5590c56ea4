"""Deleted-interpolation language model: trigram, bigram and unigram estimates mixed by context-frequency buckets.

P_n(w | h) = m_nb * c(h, w) / c(h) + (1 - m_nb) * P_(n-1)(w | h without its first word), where b is the power-of-two bucket of c(h),
P_1 the additively smoothed unigram estimate, and m_nb comes from expectation-maximisation on held-out counts: one training fold
(the deleted one) is scored by the counts of the others, order by order. An unseen context has m = 0, and a text's first word has
no context longer than the end before it. Final counts take all training folds.

Scale: texts stay in compressed blocks. A block asks for the counts of its distinct words, then of its distinct pairs, then of its
distinct triples; requests are sorted 64-bit keys dealt by their top bits, so a frequent word is one key a block, and each bucket
replies to each block. An n-gram with a part that training texts do not have is not asked for, nor is one with a part that
no other block asked for: the block's own counts are the corpus's. No key's rows meet in one place and nothing that grows with the corpus is
broadcast: the driver sees the totals and, for each order, a histogram of at most 64 x 4096 cells. Words are compared by 64-bit hashes.

Cases: null and empty texts are the single end token; rows with the same id are texts of their own; a null id trains and is
scored with crc32 of the empty string (remainder 0); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, BLOCK_SCHEMA, PACKED_ROWS, arrow_rows, chunked_words, deltas, lean, materialise, mix, open_block, pack, power_of_two, rows, small_ints, store_blocks, undelta, unpack

END = np.uint64(0x51ED270B1F4B2C35)  # the key of the end token, and of the context before the first word
BINS, STEP = 4096, 1 / 64  # cells of log(c(h, w) / c(h) / P_(n-1)) in the held-out histogram
FINE, NO_CONTEXT = 1024, 64  # requests hold log(c(h) P_(n-1)) in steps of 1 / FINE; the bucket of an unseen context
LEVEL = 24  # the bits of a reply's part below its order

TEST, DELETED = 1, 4  # remainders of crc32(id) mod 5: kept from training; used for the mixture weights


def _folds(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.array([0 if z else zlib.crc32(str(i).encode()) % 5 for i, z in zip(ids.tolist(), null.tolist())], np.int64)


def _tokens(data: bytes):
    """ids, nulls, folds, and per token its key and its document."""
    ids, null, offs, buf = open_block(data)
    h, counts = chunked_words(buf, offs)
    n = len(ids)
    ends = np.cumsum(counts + 1) - 1
    key = np.empty(len(h) + n, np.uint64)
    is_word = np.ones(len(key), bool)
    is_word[ends] = False
    key[is_word] = h
    key[ends] = END
    return ids, null, _folds(ids, null), key, np.repeat(np.arange(n), counts + 1)


def _pair(before: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(key + np.uint64(0x7F4A7C15)))


def _dealt(block: int, keys: np.ndarray, bits: int, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """Rows (block, bucket, data) for sorted keys by their top bits."""
    cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    out, at = [], 0
    for bucket, to in enumerate([*cut.tolist(), len(keys)]):
        if to > at:
            out.append((block, bucket, pack(deltas(keys[at:to]), *(small_ints(c[at:to]) for c in columns))))
        at = to
    return out


def _fold_counts(inverse: np.ndarray, fold: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(inverse[mask], minlength=n) for mask in ((fold != TEST) & (fold != DELETED), fold == DELETED)]


# ---------------------------------------------------------------- the n-grams of a block


@dataclass
class Level:
    """A block's n-grams of one order. Counts are those of the kept folds and of the deleted one."""

    keys: np.ndarray  # sorted and distinct
    place: np.ndarray  # each token's n-gram in keys, -1 where training texts lack a part of it
    context: np.ndarray  # the n-gram of the order below that stands before the token, -1 for none
    own: list[np.ndarray]  # counts in the block's training texts
    counts: list[np.ndarray]  # in all training texts
    asked: np.ndarray  # whether other blocks may hold the n-gram, in training texts or others
    alone: np.ndarray  # whether none does

    def answer(self, blobs: list[bytes]) -> None:
        if blobs:
            got = [unpack(x) for x in blobs]
            for k, c in enumerate(self.counts):
                c[self.asked] = np.concatenate([g[k] for g in got])
            self.alone[self.asked] = np.concatenate([g[2] for g in got])


def _words(key: np.ndarray, fold: np.ndarray) -> Level:
    keys, place = np.unique(key, return_inverse=True)
    own = _fold_counts(place, fold, len(keys))
    return Level(keys, place, np.full(len(key), -1), own, [c.copy() for c in own], np.ones(len(keys), bool), np.zeros(len(keys), bool))


def _longer(below: Level, linked: np.ndarray, fold: np.ndarray) -> Level:
    """The n-grams one token longer than those of below, of the tokens that are linked to the one before them."""
    context = np.where(linked, np.roll(below.place, 1), -1)
    known = np.append(every(below) > 0, False)
    at = np.flatnonzero(known[context] & known[below.place])
    keys, inverse = np.unique(_pair(below.keys[context[at]], below.keys[below.place[at]]), return_inverse=True)
    place = np.full(len(context), -1)
    place[at] = inverse
    own = _fold_counts(inverse, fold[at], len(keys))
    asked = np.ones(len(keys), bool)
    asked[inverse[below.alone[context[at]] | below.alone[below.place[at]]]] = False
    return Level(keys, place, context, own, [c.copy() for c in own], asked, ~asked)


def _levels(key: np.ndarray, doc: np.ndarray, fold: np.ndarray, replies: dict[int, bytes], order: int) -> list[Level]:
    """The levels 1 to order, with the counts that replies hold. The end before a text's first word is that of the text before it."""
    inner = np.append(False, doc[1:] == doc[:-1])
    out: list[Level] = []
    for n in range(order):
        out.append(_longer(out[-1], inner if n > 1 else np.ones(len(key), bool), fold) if n else _words(key, fold))
        out[-1].answer([replies[k] for k in sorted(replies) if k >> LEVEL == n])
    return out


def kept(level: Level) -> np.ndarray:
    return level.counts[0]


def every(level: Level) -> np.ndarray:
    return level.counts[0] + level.counts[1]


def _base(count: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return (count + 0.5) / (total + 0.5 * (distinct + 1))


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count).astype(np.int64), 63)


def _chance(levels: list[Level], weights: list[list[float]], count: Callable[[Level], np.ndarray], total: int, distinct: int) -> np.ndarray:
    """Each token's probability by the model of the given levels, from the counts that count picks."""
    p = _base(count(levels[0])[levels[0].place], total, distinct)
    for below, level, m in zip(levels, levels[1:], weights):
        context = np.append(count(below), 0)[level.context]
        at = np.flatnonzero(context)
        context, n = context[at], np.append(count(level), 0)[level.place[at]]
        share = np.array(m)[_bucket(context)]
        p[at] = share * n / context + (1 - share) * p[at]
    return p


# ---------------------------------------------------------------- requests and replies


def _ask_words(bits: int):
    def run(batches):
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["data"].to_pylist()):
                _, _, fold, key, doc = _tokens(data)
                level = _words(key, fold[doc])
                yield from rows(_dealt(block, level.keys, bits, level.own)).to_batches()

    return run


def _gathered(parts: list[list[np.ndarray]]):
    """Of a bucket's requests: each one's own two counts, end to end; the sums by key, each request's key, and the packed replies."""
    some, back = np.unique(np.concatenate([undelta(p[0]) for p in parts]), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    own = [np.concatenate([p[k].astype(np.int64) for p in parts]) for k in (1, 2)]
    counts = [np.bincount(back, c, len(some)).astype(np.int64) for c in own]
    alone = (np.bincount(back, minlength=len(some)) == 1).astype(np.uint8)
    return own, counts, back, [pack(*(small_ints(c[back[a:b]]) for c in counts), alone[back[a:b]]) for a, b in zip(cuts, cuts[1:])]


def _reply_words(table: pa.Table) -> pa.Table:
    _, (a, b), _, packed = _gathered([unpack(x) for x in table["data"].to_pylist()])
    out = list(zip(table["block"].to_pylist(), table["part"].to_pylist(), packed))
    out.append((-1, table["part"][0].as_py(), np.array([(a + b).sum(), (a + b > 0).sum(), a.sum(), (a > 0).sum()], np.int64).tobytes()))
    return rows(out)


def _split(table: pa.Table) -> tuple[int, bytes, dict[int, bytes]]:
    block, data, replies = table["block"][0].as_py(), b"", {}
    for part, blob in zip(table["part"].to_pylist(), table["data"].to_pylist()):
        if part < 0:
            data = blob
        else:
            replies[part] = blob
    return block, data, replies


def _cells(count: np.ndarray, bucket: np.ndarray, lower: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The held-out histogram of n-grams with a seen context: cells (bucket, log of the estimates' ratio; 0: never kept), weights."""
    ok = bucket < NO_CONTEXT
    count, bucket, lower, weight = count[ok], bucket[ok].astype(np.int64), lower[ok].astype(np.int64), weight[ok]
    ratio = np.log(np.maximum(count, 1)) - (lower - 32 * FINE) / FINE
    cell = np.where(count > 0, np.clip(np.rint(ratio / STEP) + BINS // 2, 1, BINS - 1), 0).astype(np.int64)
    cells, inverse = np.unique(bucket * BINS + cell, return_inverse=True)
    return cells, np.bincount(inverse, weight, len(cells)).astype(np.int64)


def _ask(bits: int, total: int, distinct: int, weights: list[list[float]]):
    """Requests for the counts of a block's n-grams of the order after those that weights stand for.

    Those of the deleted fold also hold their context's bucket and what else the ratio of their estimates needs. Of those that need
    no request the block sends their part of the histogram.
    """

    def run(table: pa.Table) -> pa.Table:
        block, data, replies = _split(table)
        if not data:
            return rows([])
        _, _, fold, key, doc = _tokens(data)
        *lower, top = _levels(key, doc, fold[doc], replies, len(weights) + 2)
        context = np.append(kept(lower[-1]), 0)[top.context]
        p = _chance(lower, weights, kept, total, distinct)
        token = np.zeros(len(top.keys), np.int64)
        token[top.place[top.place >= 0]] = np.flatnonzero(top.place >= 0)
        context, p = context[token], p[token]
        seen = np.maximum(context, 1)
        bucket = np.where(context > 0, _bucket(seen), NO_CONTEXT).astype(np.uint8)
        scale = np.clip(np.rint(np.log(seen * p) * FINE) + 32 * FINE, 0, 64 * FINE - 1).astype(np.uint16)
        held = top.own[1] > 0
        here = np.flatnonzero(held & ~top.asked)
        cells, n = _cells(top.own[0][here], bucket[here], scale[here], top.own[1][here])
        out = [(-1, block % (1 << bits), pack(cells, n))] if len(cells) else []
        keys, held, bucket, scale, own = top.keys[top.asked], held[top.asked], bucket[top.asked], scale[top.asked], [c[top.asked] for c in top.own]
        cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else []
        at = 0
        for part, to in enumerate([*cut, len(keys)]):
            if to > at:
                some = np.flatnonzero(held[at:to]) + at
                out.append((block, part, pack(deltas(keys[at:to]), *(small_ints(c[at:to]) for c in own), bucket[some], scale[some])))
            at = to
        return rows(out)

    return run


def _reply(level: int):
    """Counts of each requested n-gram over the training folds, and the histogram for the mixture weights."""

    def run(table: pa.Table) -> pa.Table:
        part, asks, hists = table["part"][0].as_py(), [], []
        for block, blob in zip(table["block"].to_pylist(), table["data"].to_pylist()):
            asks.append((block, unpack(blob))) if block >= 0 else hists.append(unpack(blob))
        out = []
        if asks:
            parts = [p for _, p in asks]
            own, counts, back, packed = _gathered(parts)
            out = [(block, part + (level << LEVEL), reply) for (block, _), reply in zip(asks, packed)]
            held = np.flatnonzero(own[1])
            hists.append(_cells(counts[0][back[held]], *(np.concatenate([p[k] for p in parts]) for k in (3, 4)), own[1][held]))
        cells, inverse = np.unique(np.concatenate([h[0] for h in hists]), return_inverse=True)
        out.append((-1, part, pack(cells, np.bincount(inverse, np.concatenate([h[1] for h in hists]), len(cells)).astype(np.int64))))
        return rows(out)

    return run


# ---------------------------------------------------------------- weights and scores


def mixture_weights(cells: np.ndarray, weights: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For each bucket the weight m that EM finds for an order against those below it, from counts of held-out tokens by the log of the estimates' ratio."""
    m = np.zeros(64)
    for b in range(64):
        mine = cells // BINS == b
        if mine.any():
            cell, n = cells[mine] % BINS, weights[mine].astype(float)
            ratio = np.where(cell > 0, np.exp((cell - BINS // 2) * STEP), 0.0)
            m[b] = 0.5
            for _ in range(rounds):
                m[b] = (n * (m[b] * ratio / (m[b] * ratio + 1 - m[b]))).sum() / n.sum()
            m[b] = min(m[b], 1 - 1e-6)
    return m


def _score(total: int, distinct: int, weights: list[list[float]]):
    def run(table: pa.Table) -> pa.Table:
        _, data, replies = _split(table)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not data:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        ids, null, fold, key, doc = _tokens(data)
        levels = _levels(key, doc, fold[doc], replies, len(weights) + 1)
        count = every(levels[0])[levels[0].place]
        n = len(ids)
        sums = [np.bincount(doc, x, n) for x in (count > 0, np.log10(_base(count, total, distinct)), np.log10(_chance(levels, weights, every, total, distinct)))]
        lean()
        return pa.table([pa.array(ids, mask=null), pa.array(fold == TEST), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, total)), pa.array(sums[1]), pa.array(sums[2])], names=names)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Trains on the texts whose crc32(id) mod 5 is not 1 and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = store_blocks(docs, id_col, text_col, block_bytes)
    bits = power_of_two(max(16, blocks.count() // 4)).bit_length() - 1
    with arrow_rows(docs.sparkSession, PACKED_ROWS):
        replies = [materialise(blocks.mapInArrow(_ask_words(bits), BLOCK_SCHEMA).groupBy("part").applyInArrow(_reply_words, BLOCK_SCHEMA))]
    total, distinct, kept_total, kept_distinct = _summed(replies[0])
    weights: list[list[float]] = []
    answered = blocks.unionByName(replies[0].where("block >= 0"))
    for level in range(1, order):
        asked = answered.groupBy("block").applyInArrow(_ask(bits, kept_total, kept_distinct, weights), BLOCK_SCHEMA)
        with arrow_rows(docs.sparkSession, PACKED_ROWS):
            replies.append(materialise(asked.groupBy("part").applyInArrow(_reply(level), BLOCK_SCHEMA)))
        weights = [*weights, _weights(replies[-1])]
        answered = answered.unionByName(replies[-1].where("block >= 0"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.groupBy("block").applyInArrow(_score(total, distinct, weights), schema)


def _summed(replies: DataFrame) -> list[int]:
    """The four totals, summed on the executors."""

    def parts(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.stack([np.frombuffer(x, np.int64) for x in b["data"].to_pylist()]).T.copy()], names=list("abcd"))

    found = replies.where("block = -1").mapInArrow(parts, "a long, b long, c long, d long").agg(*(F.sum(c).alias(c) for c in "abcd")).first()
    return [int(x or 0) for x in found]


def _weights(replies: DataFrame) -> list[float]:
    def parts(batches):
        for b in batches:
            for x in b["data"].to_pylist():
                cells, n = unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    found = replies.where("block = -1").mapInArrow(parts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most 64 x 4096 rows
    return mixture_weights(np.array([r.cell for r in found], np.int64), np.array([r.n for r in found], np.int64)).tolist()
