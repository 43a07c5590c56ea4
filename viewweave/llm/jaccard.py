"""N-gram Jaccard join by PartEnum signatures, with the classes that its links form.

Sets of word shingles are dealt to size bands such that similar sets lie in one band or in neighbours. Within a band's
instance a similarity of num/den bounds the symmetric difference by k. The hash domain is cut in n1 parts of three cells;
two sets that differ in at most k features have parts that differ in at most one feature, so one of the part's three pairs
of cells is equal: each pair of cells is a signature. n1 is chosen so that more parts than a number of spare ones agree. A set
gives signatures of at least t features, where t is the largest threshold that no more than the spare parts fall below: unlike sets
share thin signatures by chance. No similar pair is lost: the set with the larger threshold has an agreeing part that
reaches it, and the other set gives that signature too.

Classes: exact copies count once, by a fingerprint of the set; only the first of them gives signatures. Only sets that share a signature directly are ever
compared, in two steps. First each group of a shared signature is a star: its members against its smallest member. The classes that
these links form are known before the second step, in which a group's members are compared only where their classes differ.
In both steps sizes and parity sketches (their distance never exceeds the sets') drop pairs that cannot be similar; every other pair
is verified by its exact similarity. A large cluster of near copies thus costs a star, not its pairs.

Scale: signatures are sorted 64-bit keys in packed rows, dealt by their top bits, in ROUNDS ranges one after the other (each
block's are computed anew for each), so that only a range of them is on disk at a time; only members of shared signatures become
rows. A group of more than TILE members that still has several classes is compared in tiles, a task each. Pairs to verify are
dealt by their first set, cut in pieces of bounded weight; only texts of such sets move. Nothing is broadcast without a count.

Cases: null texts and texts without words have empty sets and link with nothing; fewer than k words are one shingle; rows
with the same id are documents of their own, linked if alike; null ids take part and a class of none but null ids has a
null component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_SCHEMA, PACKED_ROWS, UID_BITS, arrow_rows, carried, chunked_words, deltas, discard, flat_bytes, in_chunks, lean, materialise, mix, open_block, pack, power_of_two, rows, shingles, sized_join, small_ints, store_blocks, text_valid, undelta, unpack, with_rows

THIN = 3  # the largest threshold of features in a signature
ROUNDS = 2  # ranges of signatures that meet one after the other; a power of two
SKETCH = 8  # 64-bit words of a sketch
TILE = 8192  # members of one side of a tile
NEAR = 128  # neighbours in a group that are compared by shifts of whole arrays
PIECE, TASK = 50_000, 200_000  # shingles of a piece of one set's pairs, and of a verifying task


# ---------------------------------------------------------------- signatures


def bands(top: int, num: int, den: int) -> np.ndarray:
    """The largest size of each band, up to one past the band of size top."""
    out, low = [], 1
    while not out or len(out) < 2 or out[-2] < top:
        out.append(low * den // num)
        low = out[-1] + 1
    return np.array(out, np.int64)


def part_counts(r: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For instances of largest size r: the bound k, the spare parts and n1."""
    k = 2 * (den - num) * r // (den + num)
    least = k // 2 + 1
    spare = np.maximum(1, (least * (1 if 100 * num >= 85 * den else 2)) // 8)
    return k, spare, least + spare


def signatures(sets: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of flat sets and the set that each belongs to."""
    edge = bands(int(sizes.max()) if len(sizes) else 1, num, den)
    band = np.searchsorted(edge, sizes)
    k, spare, n1 = part_counts(edge, num, den)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sigs, own = [], []
    for shift in (0, 1):
        tag = band + shift
        use = (sizes > 0) & (k[tag] > 0)
        parts = np.where(use, n1[tag], 0)
        base = np.cumsum(parts) - parts
        live = use[owner]
        o, h = owner[live], sets[live]
        salted = mix(h ^ (tag[o].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        cell = (base[o] * 3 + ((salted >> np.uint64(11)) % (parts[o] * 3).astype(np.uint64)).astype(np.int64)) if len(o) else np.zeros(0, np.int64)
        cells = int(parts.sum()) * 3
        total = np.zeros(cells, np.uint64)
        np.add.at(total, cell, mix(h + np.uint64(0x632BE59BD9B4E019)))
        n = np.bincount(cell, minlength=cells).reshape(-1, 3)
        total = total.reshape(-1, 3)
        doc = np.repeat(np.arange(len(sizes)), parts)
        place = (np.arange(len(doc)) - base[doc] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + tag[doc].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        pairs = ((0, 1), (0, 2), (1, 2))
        count = np.stack([n[:, a] + n[:, b] for a, b in pairs], 1) if len(n) else np.zeros((0, 3), np.int64)
        # a set's threshold is the largest that no more parts than the spare ones fall below
        least = np.minimum(count.min(1), THIN) if len(count) else np.zeros(0, np.int64)
        at_least = np.zeros(len(sizes), np.int64)
        for t in range(1, THIN + 1):
            thin = np.bincount(doc, least < t, len(sizes)) if len(doc) else np.zeros(len(sizes))
            at_least[thin <= spare[tag]] = t
        for j, (a, b) in enumerate(pairs):
            keep = count[:, j] >= at_least[doc]
            s = mix(mix(total[keep, a] + place[keep]) * np.uint64(0x9FB21C651E98DF25) + mix(total[keep, b] + np.uint64(j + 1)))
            sigs.append(s)
            own.append(doc[keep])
    return np.concatenate(sigs), np.concatenate(own)


def _sets(data: bytes, k: int, limit: int = 1 << 19):
    """For each chunk of a block: first row, flat sets, sizes."""
    ids, null, offs, buf = open_block(data)
    for a, b in in_chunks(offs, limit):
        h, c = chunked_words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        yield a, ids[a:b], null[a:b], *shingles(h, c, k)


def _prints(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
        total = np.zeros(len(sizes), np.uint64)
        np.add.at(total, owner, mix(sets * np.uint64(salt) + np.uint64(salt >> 7)))
        out.append(mix(total + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sketches(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set SKETCH words of 64 bits: the parities of its shingles' counts in 64 * SKETCH hash cells.

    Two sets that differ in d shingles have sketches that differ in at most d bits.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = (mix(sets ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(64 * SKETCH - 1)).astype(np.int64)
    odd = np.bincount(owner * (64 * SKETCH) + cell, minlength=len(sizes) * 64 * SKETCH).astype(np.uint8).reshape(len(sizes), -1) & 1
    return np.packbits(odd, axis=1).reshape(len(sizes), SKETCH, 8).view(np.int64).reshape(len(sizes), SKETCH)


def _describe(k: int):
    def run(batches):
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"].to_pylist()):
                for a, ids, null, sets, sizes in _sets(data, k):
                    uid = (np.int64(block) << UID_BITS) + a + np.arange(len(ids))
                    x, y = _prints(sets, sizes)
                    sketch = sketches(sets, sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(ids, mask=null), pa.array(sizes), pa.array(x), pa.array(y), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(SKETCH))], names=["uid", "doc_id", "n", "fp", "fq", *SKETCHES])
                lean()

    return run


def _sign(k: int, num: int, den: int, bits: int, turn: int = 0, turns: int = 1):
    """Packed signatures of a block's rows but for those of rows, copies of others; those of range turn of turns (a power of two)."""

    def run(batches):
        for batch in batches:
            for block, data, copies in zip(batch["block"].to_pylist(), batch["data"].to_pylist(), batch["rows"]):
                keys, owners = [], []
                gone = np.asarray(copies.values) if copies.is_valid else np.zeros(0, np.int32)
                for a, ids, _, sets, sizes in _sets(data, k):
                    new = (sizes > 0) & ~np.isin(np.arange(a, a + len(sizes)), gone)
                    s, o = signatures(sets[np.repeat(new, sizes)], sizes[new], num, den)
                    if turns > 1:
                        own = s >> np.uint64(65 - turns.bit_length()) == turn
                        s, o = s[own], o[own]
                    keys.append(s)
                    owners.append(np.flatnonzero(new)[o] + a)
                s, o = np.concatenate(keys), np.concatenate(owners).astype(np.int32)
                keys.clear()
                owners.clear()
                order = np.argsort(s)
                s, o = s[order], o[order]
                del order
                cut = np.searchsorted(s, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
                found, at = [], 0
                for bucket, to in enumerate([*cut, len(s)]):
                    if to > at:
                        found.append((block, bucket, pack(deltas(s[at:to]), small_ints(o[at:to]))))
                    at = to
                yield from rows(found).to_batches()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Members (gid, uid) of a bucket's shared signatures; signatures with the same members are one group."""
    parts = [(block, unpack(x)) for block, x in zip(table["block"].to_pylist(), table["data"].to_pylist())]
    sig = np.concatenate([undelta(p[0]) for _, p in parts])
    uid = np.concatenate([(np.int64(block) << UID_BITS) + p[1].astype(np.int64) for block, p in parts])
    order = np.lexsort((uid, sig))
    sig, uid = sig[order], uid[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (uid[1:] != uid[:-1])
    sig, uid = sig[keep], uid[keep]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(sig)))
    group = np.add.reduceat(mix(uid.view(np.uint64) + np.uint64(77)), start) if len(start) else np.zeros(0, np.uint64)
    group = mix(group + size.astype(np.uint64))
    many = np.flatnonzero(size > 1)
    _, first = np.unique(group[many], return_index=True)
    many = many[first]
    at = np.repeat(start[many] - np.cumsum(size[many]) + size[many], size[many]) + np.arange(int(size[many].sum()))
    lean()
    return pa.table({"gid": pa.array(np.repeat(group[many], size[many]).view(np.int64)), "uid": pa.array(uid[at])})


# ---------------------------------------------------------------- candidates

SKETCHES = [f"s{j}" for j in range(SKETCH)]


def plausible(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, na, nb): the pairs (a, b) that sizes and sketches allow to be as similar as num/den."""
    side = lambda x: facts.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), *(F.col(c).alias(f"{c}{x}") for c in SKETCHES))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in SKETCHES), F.lit(0))
    fits = (F.greatest("na", "nb") * num <= F.least("na", "nb") * den) & (apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    return both.where(fits).select("a", "b", "na", "nb")


def _across(num: int, den: int):
    """Plausible pairs of one task's groups (gid, i, j): members of different classes, but for those with the group's leader."""

    def allowed(t: dict[str, np.ndarray], x, y) -> np.ndarray:
        n, m = t["n"][x], t["n"][y]
        ok = (t["label"][x] != t["label"][y]) & (t["uid"][x] != t["lead"][x]) & (t["uid"][y] != t["lead"][y]) & (np.maximum(n, m) * num <= np.minimum(n, m) * den)
        return ok & (np.bitwise_count(t["sketch"][x] ^ t["sketch"][y]).sum(-1, dtype=np.int64) * (den + num) <= (n + m) * (den - num))

    def run(table: pa.Table) -> pa.Table:
        t = {c: np.asarray(table[c]) for c in ("gid", "i", "j", "side", "uid", "lead", "label", "n")}
        order = np.lexsort((t["uid"], t["side"], t["j"], t["i"], t["gid"]))
        t = {c: x[order] for c, x in t.items()}
        t["sketch"] = np.stack([np.asarray(table[c])[order].view(np.uint64) for c in SKETCHES], 1)
        new = np.ones(len(order), bool)
        for c in ("gid", "i", "j"):
            new[1:] &= t[c][1:] == t[c][:-1]
        new[1:] = ~new[1:]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(order)))
        left, right = [], []
        whole = np.repeat((size <= NEAR) & (t["i"][start] == t["j"][start]), size)
        at, end = np.flatnonzero(whole), np.repeat(start + size, size)
        for d in range(1, NEAR):
            at = at[at + d < end[at]]
            if not len(at):
                break
            hit = at[allowed(t, at, at + d)]
            left.append(t["uid"][hit])
            right.append(t["uid"][hit + d])
        for a, m in zip(start[~whole[start]].tolist(), size[~whole[start]].tolist()):
            own = np.arange(a, a + m)
            if t["i"][a] == t["j"][a]:
                kinds, count = np.unique(t["label"][own], return_counts=True)
                # members of the largest class meet the others only
                few = own[t["label"][own] != kinds[np.argmax(count)]]
                many = own
            else:
                few, many = own[t["side"][own] == 0], own[t["side"][own] == 1]
            for x in few.tolist():
                hit = many[allowed(t, np.full(len(many), x), many)]
                left.append(np.minimum(t["uid"][x], t["uid"][hit]))
                right.append(np.maximum(t["uid"][x], t["uid"][hit]))
        lean()
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": flat(left), "b": flat(right)})

    return run


def across_classes(members: DataFrame, groups: DataFrame, label: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs within the groups (gid, lead, m) of members (gid, uid) that are of different classes and that sketches allow."""
    named = members.join(groups.where("m > 2"), "gid").join(label.select(F.col("node").alias("uid"), "comp"), "uid", "left").select("gid", "uid", "lead", "m", F.coalesce("comp", "uid").alias("label"))
    mixed = named.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("gid")
    named = named.join(mixed, "gid", "left_semi").withColumn("nt", F.ceil(F.col("m") / TILE).cast("int")).withColumn("b", F.pmod(F.xxhash64("uid"), F.col("nt")).cast("int"))
    tiled = named.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nt") - 1))).select("gid", "uid", "lead", "label", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "nt")
    tiled = materialise(tiled)
    parts = power_of_two(1 + tiled.count() // 4000)  # small groups share tasks, a tile of a large one is its own
    dealt = tiled.withColumn("g", F.when(F.col("nt") == 1, F.pmod(F.xxhash64("gid"), F.lit(parts))).otherwise(F.xxhash64("gid", "i", "j"))).drop("nt")
    return dealt.join(facts.select("uid", "n", *SKETCHES), "uid").groupBy("g").applyInArrow(_across(num, den), "a long, b long").distinct()


# ---------------------------------------------------------------- verification


def _texts_of(blocks: DataFrame, uids: DataFrame) -> DataFrame:
    """(uid, text) of the wanted uids."""

    def run(batches):
        for batch in batches:
            for block, data, wanted in zip(batch["block"].to_pylist(), batch["data"].to_pylist(), batch["rows"]):
                if wanted.is_valid:
                    take = np.sort(np.asarray(wanted.values)).tolist()
                    ids, _, offs, buf = open_block(data)
                    for x in range(0, len(take), 500):
                        some = take[x : x + 500]
                        yield pa.RecordBatch.from_arrays([pa.array([(block << UID_BITS) + j for j in some], pa.int64()), pa.array([buf[offs[j] : offs[j + 1]].tobytes() for j in some], pa.binary())], names=["uid", "text"])
                lean()

    return with_rows(blocks, uids).select("block", "data", "rows").mapInArrow(run, "uid long, text binary")


def _verify(k: int, num: int, den: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = np.asarray(left["a"]), np.asarray(left["b"])
        buf, offs = flat_bytes(right["text"].cast(pa.string()))
        flat, sizes = shingles(*chunked_words(buf, offs), k)
        ends = np.cumsum(sizes)
        place = {u: x for x, u in enumerate(right["uid"].to_pylist())}
        keep = np.zeros(len(a), bool)
        before, own = None, np.zeros(0, np.uint64)
        for p in np.argsort(a, kind="stable").tolist():
            x, y = place[int(a[p])], place[int(b[p])]
            if x != before:
                before, own = x, flat[ends[x] - sizes[x] : ends[x]]
            other = flat[ends[y] - sizes[y] : ends[y]]
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            common = int((own[at] == other).sum())
            keep[p] = den * common >= num * (len(own) + len(other) - common)
        lean()
        return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})

    return run


def verified(pairs: DataFrame, blocks: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The stored links (a, b) among pairs (a, b, na, nb): those whose sets are as similar as num/den or more."""
    pairs = materialise(pairs)
    pieces = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / PIECE).cast("int").alias("np"))
    tasks = power_of_two(1 + (pairs.agg(F.sum("nb")).first()[0] or 0) // TASK)
    dealt = materialise(pairs.join(pieces, "a").select("a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("np"))), F.lit(tasks)).cast("int").alias("g")))
    need = materialise(dealt.select("g", F.col("a").alias("uid")).union(dealt.select("g", "b")).distinct())
    sent = sized_join(_texts_of(blocks, need.select("uid").distinct()), need, ["uid"], "inner")
    with arrow_rows(blocks.sparkSession, PACKED_ROWS * 64):
        out = materialise(dealt.groupBy("g").cogroup(sent.groupBy("g")).applyInArrow(_verify(k, num, den), "a long, b long"))
    discard(pairs, dealt, need)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each class of linked nodes (a, b, stored), by repeated minima and shortcuts."""
    edges = materialise(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct())
    label = materialise(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("changed")))
    while True:
        heard = edges.join(label.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("m"))
        low = label.join(heard, "node").select("node", F.least("comp", "m").alias("low"), "comp")
        up = label.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        least = F.least(F.col("low"), F.coalesce("lower", "low"))
        new = materialise(low.join(up, "low", "left").select("node", least.alias("comp"), (least < F.col("comp")).alias("changed")))
        discard(label)
        label = new
        if not new.where("changed").limit(1).count():
            discard(edges)
            return label.select("node", "comp")


# ---------------------------------------------------------------- classes


FACTS = "uid long, doc_id long, n long, fp long, fq long, " + ", ".join(f"{c} long" for c in SKETCHES)


def classes_of(blocks: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Per row of stored blocks: uid, doc_id, n_shingles, component_id, first."""
    if not 0 < num <= den:
        raise ValueError(f"a similarity of {num}/{den} is not in (0, 1]")
    spark = blocks.sparkSession
    n_blocks = blocks.count()
    bits = power_of_two(max(16 * ROUNDS, n_blocks // 2)).bit_length() - 1  # a set has hundreds of signatures
    with arrow_rows(spark, PACKED_ROWS):
        facts = materialise(blocks.mapInArrow(_describe(shingle), FACTS))
    twice = facts.where("n > 0").groupBy("fp", "fq", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m")
    twice = materialise(twice)
    rep_of = materialise(sized_join(facts.where("n > 0"), twice, ["fp", "fq", "n"]).select("uid", F.coalesce("rep", "uid").alias("rep")))
    todo, met = with_rows(blocks, rep_of.where("uid <> rep").select("uid")).select("block", "data", "rows"), []
    with arrow_rows(spark, PACKED_ROWS):
        for turn in range(ROUNDS):
            met.append(materialise(todo.mapInArrow(_sign(shingle, num, den, bits, turn, ROUNDS), BLOCK_SCHEMA).groupBy("part").applyInArrow(_meet, "gid long, uid long").distinct()))
    members = materialise(reduce(DataFrame.union, met).distinct())
    discard(twice, *met)
    groups = materialise(members.groupBy("gid").agg(F.min("uid").alias("lead"), F.count("*").alias("m")).where("m > 1"))
    star = members.join(groups, "gid").where("uid <> lead").select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct()
    links = verified(plausible(star, facts, num, den), blocks, shingle, num, den)
    label = components(links)
    rest = across_classes(members, groups, label, facts, num, den)
    more = verified(plausible(rest, facts, num, den), blocks, shingle, num, den)
    comp = components(links.union(more))
    discard(members, groups)
    named = rep_of.join(comp, rep_of.rep == comp.node, "left").select("uid", F.coalesce("comp", "rep").alias("comp"))
    every = materialise(facts.join(named, "uid", "left").select("uid", "doc_id", "n", F.coalesce("comp", "uid").alias("comp")))
    discard(facts, rep_of, links, more)
    least = every.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("s"), F.count("*").alias("m")).where("m > 1")
    least = materialise(least.select("comp", F.col("s.doc_id").alias("least_id"), F.col("s.uid").alias("least_uid")))
    many = F.col("least_uid").isNotNull()
    return sized_join(every, least, ["comp"]).select("uid", "doc_id", F.col("n").alias("n_shingles"), F.when(many, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce(F.col("uid") == F.col("least_uid"), F.lit(True)).alias("first"))


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Per row: uid, doc_id, n_shingles, component_id (the smallest doc_id reachable by links of similarity num/den or more), first (whether it is that document; one row a class)."""
    return classes_of(store_blocks(docs, id_col, text_col), shingle, num, den)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows without those whose class has an earlier document: of each class the smallest id stays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = store_blocks(docs, id_col, text_col, carry=True)
    classes = classes_of(blocks, shingle, num, den)
    gone = materialise(classes.where("not first").select("uid"))
    names, schema = docs.columns, to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, dropped in zip(batch["data"].to_pylist(), batch["rows"]):
                ids, _, offs, buf = open_block(data)
                others, valid = carried(data), text_valid(data)
                stay = np.ones(len(ids), bool)
                if dropped.is_valid:
                    stay[np.asarray(dropped.values)] = False
                take = np.flatnonzero(stay)
                for x in range(0, len(take), 500):
                    some = pa.array(take[x : x + 500])
                    texts = pa.array([buf[offs[j] : offs[j + 1]].tobytes() if valid[j] else None for j in take[x : x + 500].tolist()], pa.binary()).cast(pa.string())
                    own = iter(others.columns)
                    yield pa.RecordBatch.from_arrays([(texts if c == text_col else next(own).take(some).combine_chunks()).cast(schema.field(c).type) for c in names], schema=schema)
            lean()

    return with_rows(blocks, gone).select("data", "rows").mapInArrow(run, docs.schema)
