"""Suffix-array removal of byte strings that repeat across documents.

A byte of a document goes when it is covered by a `width`-byte string that also starts in a document with a smaller id.
Strings never cross documents and are judged on the input.

The suffix array comes from two-stage sorting: only suffixes whose first byte is not larger than the next are sorted
directly (by `width` bytes); scanning the buckets of first bytes in order then induces the place of every other suffix from
its successor's. Adjacent common prefixes of at least `width` bytes join suffixes in classes, and the smallest id of each class decides.

Scale: each window of `width` bytes is keyed by the smallest hash of its 25-byte substrings, so equal windows have equal
keys and neighbouring windows mostly share one: a run. Blocks first ask, by key, which keys stand in two documents; only
runs with such keys are sorted. A run's bytes go to its key's bucket once a block, however many copies there are, and equal
runs of several blocks are one entry there. Keys in very many documents are dealt by whole windows instead. Texts move only in
compressed blocks; nothing is broadcast.

Cases: null and empty texts have no bytes; rows with the same id are one document's parts and do not count against each
other; a null id is the largest; texts of any length are whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLOCK_SCHEMA, PACKED_ROWS, arrow_rows, carried, deltas, in_chunks, lean, materialise, mix, open_block, pack, power_of_two, prefix_hash, rows, store_blocks, undelta, unpack

GRAM = 25
LAST = np.int64(2**63 - 1)
LONGEST = 64  # windows of a run
HOT = 5000  # documents with a key, beyond which it is dealt by whole windows


# ---------------------------------------------------------------- two-stage suffix sorting


def suffix_order(text: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """The wanted suffixes of text (bytes, padded beyond the last wanted suffix) sorted by their first `width` bytes.

    A suffix is direct if its first byte is at most the next, else induced; the successor of each induced suffix joins the
    set until a direct one ends the chain.
    """
    n = len(text)
    grown = np.zeros(n + 1, bool)
    grown[wanted] = True
    induced = np.zeros(n + 1, bool)
    induced[: n - 1] = text[:-1] > text[1:]
    at = wanted
    while len(at := at[induced[at]] + 1):
        at = at[~grown[at]]
        grown[at] = True
    all_at = np.flatnonzero(grown[:n])
    direct = all_at[~induced[all_at]]
    padded = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    order = _by_prefix(padded, direct, width)
    direct = direct[order]
    first = text[direct]
    cut = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        # induced suffixes precede the direct ones of their bucket: their second byte is smaller
        bucket = np.concatenate([*waiting[c], direct[cut[c] : cut[c + 1]]]) if waiting[c] else direct[cut[c] : cut[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[grown[before] & induced[before]]
        if len(before):
            kind = text[before]
            order = np.argsort(kind, kind="stable")
            before, kind = before[order], kind[order]
            for group in np.split(before, np.flatnonzero(np.diff(kind)) + 1):
                waiting[text[group[0]]].append(group)
    got = np.concatenate(out) if out else np.zeros(0, np.int64)
    mark = np.zeros(n + 1, bool)
    mark[wanted] = True
    return got[mark[got]]


def _by_prefix(padded: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The order of suffixes by `width` bytes: 8 at a time, sorting again only within ties."""

    def word(k: int, where: np.ndarray) -> np.ndarray:
        out = np.zeros(len(where), np.uint64)
        for j in range(8 * k, 8 * k + 8):
            out = (out << np.uint64(8)) | (padded[where + j].astype(np.uint64) if j < width else np.uint64(0))
        return out

    order = np.argsort(first := word(0, at), kind="stable")
    ranked = first[order]
    tied = np.zeros(len(at), np.int64)
    tied[1:] = np.cumsum(ranked[1:] != ranked[:-1])
    for k in range(1, -(-width // 8)):
        # positions in groups of more than one suffix
        size = np.bincount(tied, minlength=int(tied[-1]) + 1) if len(tied) else np.zeros(0, np.int64)
        open_at = np.flatnonzero(size[tied] > 1) if len(tied) else tied
        if not len(open_at):
            break
        w = word(k, at[order[open_at]])
        again = np.lexsort((w, tied[open_at]))
        order[open_at] = order[open_at[again]]
        w, group = w[again], tied[open_at]
        new = np.zeros(len(at), bool)
        new[1:] = tied[1:] != tied[:-1]
        inner = np.flatnonzero((w[1:] != w[:-1]) & (group[1:] == group[:-1])) + 1
        new[open_at[inner]] = True
        tied = np.cumsum(new)
    return order


def common_prefix_classes(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For sorted suffixes the number of their class: neighbours with a common prefix of at least `width` bytes share one."""
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    same = np.ones(max(0, len(order) - 1), bool)
    a, b = order[:-1], order[1:]
    for j in range(width):
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = padded[a[live] + j] == padded[b[live] + j]
    out = np.zeros(len(order), np.int64)
    out[1:] = np.cumsum(~same)
    return out


# ---------------------------------------------------------------- runs of windows


def _runs(buf: np.ndarray, offs: np.ndarray, width: int, limit: int = 1 << 19):
    """Runs of neighbouring windows with one key: document, first window, windows, key."""
    span = width - GRAM + 1
    parts = []
    for a, b in in_chunks(offs, limit):
        x, y = int(offs[a]), int(offs[b])
        if y - x < width:
            continue
        sums, down = prefix_hash(buf[x:y])
        h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: y - x - GRAM + 1])
        reach, low = 1, h
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(h) - span + 1], low[span - reach :][: len(h) - span + 1])
        ok = np.ones(len(low), bool)  # windows within one document
        inner = offs[a + 1 : b] - x
        for e in inner.tolist():
            ok[max(0, e - width + 1) : e] = False
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
        new &= ok
        start = np.flatnonzero(new)
        if not len(start):
            continue
        stop = np.ones(len(low) + 1, bool)
        stop[:-1] = new | ~ok
        stops = np.flatnonzero(stop)
        end = stops[np.searchsorted(stops, start + 1)]
        pieces = -(-(end - start) // LONGEST)  # text of a short period has very long runs
        which = np.repeat(np.arange(len(start)), pieces)
        begin = start[which] + LONGEST * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        # keys are minima and so crowd near zero; mixed again they are even
        parts.append((np.searchsorted(offs, begin + x, "right") - 1, begin + x, np.minimum(end[which] - begin, LONGEST), mix(low[begin] + np.uint64(1))))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _block(data: bytes):
    ids, null, offs, buf = open_block(data)
    return ids, null, np.where(null, LAST, ids), offs, buf


def _ask_keys(bits: int, width: int):
    """Per block its distinct keys and in how many of its documents (up to 255) each stands."""

    def run(batches):
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["data"].to_pylist()):
                _, _, owner, offs, buf = _block(data)
                doc, _, _, key = _runs(buf, offs, width)
                some, back = np.unique(key, return_inverse=True)
                pair = np.unique(np.stack([back, owner[doc]], 1), axis=0)[:, 0] if len(set(owner.tolist())) < len(owner) else _distinct_pairs(back, doc)
                n = np.minimum(np.bincount(pair, minlength=len(some)), 255).astype(np.uint8)
                cut = np.searchsorted(some, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
                found, at = [], 0
                for bucket, to in enumerate([*cut, len(some)]):
                    if to > at:
                        found.append((block, bucket, pack(deltas(some[at:to]), n[at:to])))
                    at = to
                yield from rows(found).to_batches()

    return run


def _distinct_pairs(back: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order = np.argsort(back, kind="stable")  # documents ascend within a key
    k, d = back[order], doc[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[keep]


def _reply_keys(table: pa.Table) -> pa.Table:
    """For each requested key 0: in one document, 1: in several, 2: in very many."""
    parts = [unpack(x) for x in table["data"].to_pylist()]
    keys = np.concatenate([undelta(p[0]) for p in parts])
    some, back = np.unique(keys, return_inverse=True)
    n = np.bincount(back, np.concatenate([p[1].astype(np.int64) for p in parts]), len(some))
    code = ((n > 1).astype(np.uint8) + (n > HOT).astype(np.uint8))[back]
    cuts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    return rows([(block, part, pack(code[a:b])) for block, part, a, b in zip(table["block"].to_pylist(), table["part"].to_pylist(), cuts, cuts[1:])])


def _shared_runs(data: bytes, replies: dict[int, bytes], width: int):
    """The block and its runs with keys of several documents, in a fixed order, those of hot keys split in single windows."""
    ids, null, owner, offs, buf = _block(data)
    doc, start, n, key = _runs(buf, offs, width)
    some, back = np.unique(key, return_inverse=True)
    code = np.concatenate([unpack(replies[k])[0] for k in sorted(replies)]) if replies else np.zeros(0, np.uint8)
    code = code[back] if len(some) else np.zeros(0, np.uint8)
    keep = code > 0
    doc, start, n, key, code = doc[keep], start[keep], n[keep], key[keep], code[keep]
    hot = code > 1
    if hot.any():
        at = np.repeat(start[hot], n[hot]) + np.arange(int(n[hot].sum())) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
        own = np.repeat(doc[hot], n[hot])
        text = [buf[i : i + width].tobytes() for i in at.tolist()]
        of_text = {t: int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big") for t in set(text)}
        doc, start, n, key = (np.concatenate([x[~hot], y]) for x, y in ((doc, own), (start, at), (n, np.ones(len(at), np.int64)), (key, np.array([of_text[t] for t in text], np.uint64))))
    return ids, null, owner, offs, buf, doc, start, n, key


def _distinct_runs(buf: np.ndarray, owner: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, width: int):
    """Equal runs as one: representatives in order of key, and each run's place among them."""
    text = [buf[a : a + m].tobytes() for a, m in zip(start.tolist(), (n + width - 1).tolist())]
    places: dict[bytes, int] = {}
    where = np.array([places.setdefault(t, len(places)) for t in text], np.int64)
    texts = list(places)
    first = np.full(len(texts), LAST)
    np.minimum.at(first, where, owner[doc])
    rep = np.zeros(len(texts), np.int64)
    rep[where[::-1]] = np.arange(len(where))[::-1]
    order = np.argsort(key[rep], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [texts[k] for k in order.tolist()], key[rep][order], first[order], rank[where]


def _split(table: pa.Table):
    block, data, first, second = table["block"][0].as_py(), b"", {}, {}
    for part, blob in zip(table["part"].to_pylist(), table["data"].to_pylist()):
        if part < 0:
            data = blob
        elif part < 1 << 24:
            first[part] = blob
        else:
            second[part] = blob
    return block, data, first, second


def _ask_runs(bits: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        block, data, replies, _ = _split(table)
        if not data:
            return rows([])
        _, _, owner, offs, buf, doc, start, n, key = _shared_runs(data, replies, width)
        texts, keys, first, _ = _distinct_runs(buf, owner, doc, start, n, key, width)
        cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
        found, at = [], 0
        for bucket, to in enumerate([*cut, len(keys)]):
            if to > at:
                mine = texts[at:to]
                found.append((block, bucket, pack(np.fromiter(map(len, mine), np.uint32, len(mine)), first[at:to], np.frombuffer(b"".join(mine), np.uint8))))
            at = to
        return rows(found)

    return run


def _reply_runs(width: int):
    """For each window of each requested run the smallest id that has this window."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table["data"].to_pylist()]
        places: dict[bytes, int] = {}
        where, first = [], []
        for size, ids, body in parts:
            ends = np.cumsum(size, dtype=np.int64)
            raw = body.tobytes()
            where.append(np.array([places.setdefault(raw[a:b], len(places)) for a, b in zip((ends - size).tolist(), ends.tolist())], np.int64))
            first.append(ids)
        low = np.full(len(places), LAST)
        np.minimum.at(low, np.concatenate(where), np.concatenate(first))
        size = np.fromiter(map(len, places), np.int64, len(places))
        text = np.frombuffer(b"".join(places), np.uint8)
        begin = np.cumsum(size) - size
        windows = size - width + 1
        total = np.cumsum(windows)
        run_of = np.repeat(np.arange(len(size)), windows)
        wanted = begin[run_of] + np.arange(int(total[-1])) - np.repeat(total - windows, windows)
        order = suffix_order(text, wanted, width)
        kind = common_prefix_classes(text, order, width)
        owner = low[np.searchsorted(begin, order, "right") - 1]
        least = np.full(int(kind[-1]) + 1, LAST)
        np.minimum.at(least, kind, owner)
        answer = np.zeros(len(text), np.int64)
        answer[order] = least[kind]
        answer = answer[wanted]
        head = total - windows
        found = []
        for block, part, w in zip(table["block"].to_pylist(), table["part"].to_pylist(), where):
            m = windows[w]
            at = np.repeat(head[w] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            found.append((block, part + (1 << 24), pack(answer[at])))
        return rows(found)

    return run


def _marked(data: bytes, replies: dict[int, bytes], answers: dict[int, bytes], width: int):
    """ids, nulls, offsets and bytes of a block, and per byte whether it goes."""
    ids, null, owner, offs, buf, doc, start, n, key = _shared_runs(data, replies, width)
    if not len(doc):
        return ids, null, offs, buf, np.zeros(len(buf), np.int8)
    texts, _, _, rank = _distinct_runs(buf, owner, doc, start, n, key, width)
    least = np.concatenate([unpack(answers[k])[0] for k in sorted(answers)])
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - width + 1
    head = np.cumsum(windows) - windows
    spread = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hit = (np.repeat(start, n) + spread)[least[np.repeat(head[rank], n) + spread] < np.repeat(owner[doc], n)]
    step = np.zeros(len(buf) + 1, np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    return ids, null, offs, buf, (np.cumsum(step[:-1]) > 0).astype(np.int8)


def _cut(width: int, with_text: bool):
    def run(table: pa.Table) -> pa.Table:
        _, data, replies, answers = _split(table)
        found: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        if data:
            ids, null, offs, buf, gone = _marked(data, replies, answers, width)
            for k, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist())):
                mark = gone[a:b]
                removed = int(mark.sum())
                edge = np.diff(mark, prepend=np.int8(0), append=np.int8(0)) if removed else mark[:0]
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                kept = (buf[a:b][mark == 0] if removed else buf[a:b]).tobytes()
                for name, value in (("doc_id", None if null[k] else int(ids[k])), ("n_bytes", b - a), ("n_removed", removed), ("n_spans", len(begin)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if with_text else b""), ("spans", [{"start": int(x), "stop": int(y)} for x, y in zip(begin, end)] if with_text else [])):
                    found[name].append(value)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}
        names = [k for k in kinds if with_text or k not in ("kept", "spans")]
        lean()
        return pa.table({k: pa.array(found[k], kinds[k]) for k in names})

    return run


def _cut_rows(width: int, names: list[str], text_col: str, size_col: str, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        _, data, replies, answers = _split(table)
        if not data:
            return schema.empty_table()
        _, null, offs, buf, gone = _marked(data, replies, answers, width)
        others = carried(data)
        texts, stay = [], np.ones(len(null), bool)
        for k, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist())):
            if gone[a:b].any():
                kept = buf[a:b][gone[a:b] == 0].tobytes().decode("utf-8", "ignore")  # a cut may leave part of a character
                stay[k] = bool(kept.strip())
                texts.append(kept)
            else:
                texts.append(buf[a:b].tobytes().decode("utf-8", "replace"))
        columns, k = [], 0
        for name in names:
            if name == text_col:
                columns.append(pa.array(texts, schema.field(name).type))
            else:
                own = others.column(k)
                k += 1
                columns.append(pa.array([len(t) for t in texts], schema.field(name).type) if name == size_col else own.cast(schema.field(name).type))
        lean()
        return pa.Table.from_arrays(columns, schema=schema).filter(pa.array(stay))

    return run


def _repeats(docs: DataFrame, id_col: str, text_col: str, width: int, carry: bool = False) -> DataFrame:
    """Blocks met with all replies, a group a block."""
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    blocks = store_blocks(docs, id_col, text_col, carry=carry)
    bits = power_of_two(max(16, blocks.count() // 4)).bit_length() - 1
    with arrow_rows(docs.sparkSession, PACKED_ROWS):
        shared = materialise(blocks.mapInArrow(_ask_keys(bits, width), BLOCK_SCHEMA).groupBy("part").applyInArrow(_reply_keys, BLOCK_SCHEMA))
        least = materialise(blocks.unionByName(shared).groupBy("block").applyInArrow(_ask_runs(bits, width), BLOCK_SCHEMA).groupBy("part").applyInArrow(_reply_runs(width), BLOCK_SCHEMA))
    return blocks.unionByName(shared).unionByName(least)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, with_text: bool = True) -> DataFrame:
    """Per row of a stored table: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text also the kept bytes and the removed spans."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:long,stop:long>>" if with_text else "")
    return _repeats(docs, id_col, text_col, width).groupBy("block").applyInArrow(_cut(width, with_text), schema)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", width: int = 50) -> DataFrame:
    """The rows of a stored table with the repeated bytes cut from their text and size_col, if there, counted anew.

    A row of which only white space is left goes; null texts become empty ones.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _cut_rows(width, docs.columns, text_col, size_col, to_arrow_schema(docs.schema))
    return _repeats(docs, id_col, text_col, width, carry=True).groupBy("block").applyInArrow(run, docs.schema)
