"""Approximate nearest neighbours: stable random projections indexed by a kd-tree, verified until a chi-square test stops.

A vector is scaled to length one and projected on a few Gaussian directions (2-stable: a squared projected distance over the squared
true distance is chi-square with as many degrees of freedom). The top of a kd-tree over the projections, fitted on a bounded
sample, deals all rows to cells; each cell's rows have a tree of their own. A query takes its projected neighbours in order of
projected distance and verifies them by true cosine. It stops at the first whose projected distance a row as near as the worst
result so far would stay below with probability CONFIDENCE: beyond it a better row is that improbable. The same test, with the
worst result among the sample, decides beforehand which cells and leaves a query opens at all.

Scale: rows meet queries by cell, never pairwise, and move once: a cell is cut in slices of SLICE rows, its queries in groups of
GROUP, and each slice meets each group. Equal vectors are one entry with the few smallest ids that a result can need, gathered per
task before the shuffle; equal queries are searched once. The driver sees the sample (at most SAMPLE rows and SAMPLE_BYTES), at most
CELLS cells with their boxes, and nothing that grows with the corpus.

Cases: null, zero or non-finite vectors, those with null components, and those of another than the most frequent length take no part;
components of any size are scaled by a power of two first, so that no square over- or underflows; repeated ids are candidates of one
another only under another id; ties go to smaller ids; null ids take no part; fewer candidates than k give all; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, lean, materialise

DIMENSIONS = 24  # of the projection; even, for the closed form of the chi-square distribution
CONFIDENCE = 0.9
SAMPLE, SAMPLE_BYTES = 16_384, 16 << 20
CELLS, CELL_ROWS = 1024, 4096  # at most so many cells, of so many rows while there are fewer
SLICE, GROUP = 8192, 2000
LEAF = 64


def chi_square(x: float, m: int = DIMENSIONS) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half = min(x / 2, 700.0)
    return 1 - math.exp(-half) * sum(half**j / math.factorial(j) for j in range(m // 2))


def quantile(confidence: float = CONFIDENCE) -> float:
    """Where chi_square reaches the confidence."""
    low, high = 0.0, 1.0
    while chi_square(high) < confidence:
        high *= 2
    for _ in range(100):
        half = (low + high) / 2
        low, high = (half, high) if chi_square(half) < confidence else (low, half)
    return high


def directions(d: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, DIMENSIONS))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def units(x: np.ndarray) -> np.ndarray:
    return x / norms(x)[:, None]


def split_plan(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The axis (-1: a leaf) and the cut of each node of a kd-tree with about `cells` leaves; 1 is the root, 2n and 2n + 1 are n's children."""
    size = 4 << max(1, cells).bit_length()
    axes, cuts, todo = np.full(size, -1), np.zeros(size), [(1, points, cells)]
    while todo:
        node, own, want = todo.pop()
        if want < 2 or len(own) < 2:
            continue
        axis = int(np.argmax(own.max(0) - own.min(0)))
        axes[node], cuts[node] = axis, np.median(own[:, axis])
        left = own[:, axis] < cuts[node]
        todo += [(2 * node, own[left], want // 2), (2 * node + 1, own[~left], want - want // 2)]
    return axes, cuts


def cell_of(points: np.ndarray, plan: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axes, cuts = plan
    node = np.ones(len(points), np.int64)
    while len(live := np.flatnonzero(axes[node] >= 0)):
        at = node[live]
        node[live] = 2 * at + (points[live, axes[at]] >= cuts[at])
    return node


class Tree:
    """A kd-tree's leaves over one slice: rows in leaf order, and each leaf's box."""

    def __init__(self, points: np.ndarray):
        todo, leaves = [np.arange(len(points))], []
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            y = points[own]
            axis = int(np.argmax(y.max(0) - y.min(0)))
            order = np.argpartition(y[:, axis], len(own) // 2)
            todo += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
        self.rows = np.concatenate(leaves)
        self.leaf = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def within(self, q: np.ndarray, reach: float) -> np.ndarray:
        """The rows of the leaves whose boxes are no farther than reach (squared)."""
        return self.rows[(box_distance(self.low, self.high, q) <= reach)[self.leaf]]


def box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1)


def search(x: np.ndarray, count: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the rows (and cosines) among x that can be of its k nearest, and how many rows were verified.

    count is how many ids a row stands for; bounds are squared distances of unit vectors within which k rows are known to lie.
    """
    norm = norms(x)
    points = (x / norm[:, None]) @ p
    tree, stop = Tree(points), quantile()
    square = (points * points).sum(1)
    out = []
    for q, bound in zip(queries, bounds.tolist()):
        qn = math.sqrt(float((q * q).sum()))
        qp = (q / qn) @ p
        reach = bound * stop + 1e-9
        near = tree.within(qp, reach)
        gap = square[near] - 2 * (points[near] @ qp) + float(qp @ qp)
        order = np.argsort(gap, kind="stable")
        near, gap = near[order], gap[order]
        found, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 64
        while at < len(near) and gap[at] <= reach:  # the stopping test, on the next projected neighbour
            some = near[at : at + step]
            at, step = at + len(some), min(2 * step, 512)
            cos = (x[some] * q).sum(1) / (norm[some] * qn)
            found, scores = np.concatenate([found, some]), np.concatenate([scores, cos])
            best = np.argsort(-scores, kind="stable")
            enough = int(np.searchsorted(np.cumsum(count[found[best]]), k))
            if enough < len(best):
                edge = scores[best[enough]]
                keep = scores >= edge
                found, scores = found[keep], scores[keep]
                reach = min(reach, max(0.0, 2 - 2 * float(edge)) * stop + 1e-9)
        out.append((found, scores, at))
    return out


def valid_vectors(vec: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a list column's valid vectors of length dim, and these as float64 rows without negative zeros.

    A row is scaled by the power of two that brings its largest component to [0.5, 1): no cosine changes by that.
    """
    size = np.asarray(vec.value_lengths().fill_null(-1))
    take = np.flatnonzero(size == dim)
    x = np.array(vec.take(pa.array(take)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
    x[x == 0] = 0.0
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[fine]
    if len(x):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return take[fine], x


def distinct_vectors(table: DataFrame, id_col: str, vec_col: str, dim: int, k: int) -> DataFrame:
    """(vec, ids): each distinct valid vector as float64 bytes with its k + 1 smallest ids."""

    def run(batches):
        held: dict[bytes, list[int]] = {}

        def flush():
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sorted(set(held[x]))[: k + 1] for x in keys], pa.list_(pa.int64()))], names=["vec", "ids"])
            held.clear()

        for batch in batches:
            ids = batch["id"].to_pylist()
            take, x = valid_vectors(batch["vec"], dim)
            for i, v in zip(take.tolist(), x):
                own = held.setdefault(v.tobytes(), [])
                own.append(ids[i])
                if len(own) > 4 * (k + 1):
                    own[:] = sorted(set(own))[: k + 1]
            if len(held) > 20_000:
                yield from flush()
        if held:
            yield from flush()
        lean()

    own = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return own.mapInArrow(run, "vec binary, ids array<long>").groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, with_cost: bool = False) -> DataFrame:
    """For each query row its k nearest other rows by cosine: query_id, rank (from 1), vec_id, score; with_cost also how many rows were verified for it."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double" + (", verified long" if with_cost else "")
    lengths = table.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = int(lengths.d) if lengths else 0
    if not dim:
        return spark.createDataFrame([], schema)
    p, stop = directions(dim), quantile()
    known = materialise(distinct_vectors(table, id_col, vec_col, dim, k))
    asked = materialise(distinct_vectors(table.where(is_query), id_col, vec_col, dim, 0).select("vec", F.col("ids")[0].alias("q")))
    n = known.count()
    if not n:
        return spark.createDataFrame([], schema)
    picked = known.orderBy(F.xxhash64("vec")).limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("vec", F.size("ids").alias("n")).toArrow()
    sample = np.stack([np.frombuffer(v) for v in picked["vec"].to_pylist()])
    plan = split_plan(units(sample) @ p, min(CELLS, -(-n // CELL_ROWS)))
    shared = spark.sparkContext.broadcast((units(sample), np.asarray(picked["n"])))  # at most SAMPLE_BYTES

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch["vec"].to_pylist())).reshape(-1, dim)

    def with_cell(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(units(vectors(batch)) @ p, plan))], names=[*batch.schema.names, "cell"])

    sides = [f"{s}{j}" for s in "lh" for j in range(DIMENSIONS)]

    def boxes(batches):
        for batch in batches:
            y, cell = units(vectors(batch)) @ p, np.asarray(batch["cell"])
            some, back = np.unique(cell, return_inverse=True)
            low, high = np.full((len(some), DIMENSIONS), np.inf), np.full((len(some), DIMENSIONS), -np.inf)
            np.minimum.at(low, back, y)
            np.maximum.at(high, back, y)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.bincount(back)), *(pa.array(c.copy()) for side in (low, high) for c in side.T)], names=["cell", "rows", *sides])

    cells = materialise(known.mapInArrow(with_cell, "vec binary, ids array<long>, cell long"))
    summed = cells.mapInArrow(boxes, "cell long, rows long, " + ", ".join(f"{c} double" for c in sides)).groupBy("cell")
    found = summed.agg(F.sum("rows").alias("rows"), *(F.min(c).alias(c) if c[0] == "l" else F.max(c).alias(c) for c in sides)).orderBy("cell").collect()  # at most CELLS rows
    cell_ids, slices = np.array([r.cell for r in found], np.int64), np.array([-(-r["rows"] // SLICE) for r in found], np.int64)
    low, high = (np.array([[r[f"{s}{j}"] for j in range(DIMENSIONS)] for r in found]).reshape(-1, DIMENSIONS) for s in "lh")
    slices_of = F.create_map(*(F.lit(int(v)) for pair in zip(cell_ids, slices) for v in pair))
    groups = max(1, -(-asked.count() // GROUP))

    def route(batches):
        """Each query once for each slice of the cells that the stopping test, with the sample's worst result, leaves open."""
        whole, count = shared.value
        for batch in batches:
            u = units(vectors(batch))
            at, cell, part, bound = [], [], [], []
            for a in range(0, len(u), 32):
                cos = whole @ u[a : a + 32].T
                for i, c in enumerate(cos.T, a):
                    best = np.argsort(-c, kind="stable")[: k + 1]
                    enough = int(np.searchsorted(np.cumsum(count[best]), k + 1))
                    worst = max(0.0, 2 - 2 * float(c[best[enough]])) + 1e-12 if enough < len(best) else 4.0
                    go = np.flatnonzero(box_distance(low, high, u[i] @ p) <= worst * stop + 1e-9)
                    cell.append(np.repeat(cell_ids[go], slices[go]))
                    part += [j for m in slices[go].tolist() for j in range(m)]
                    at += [i] * len(cell[-1])
                    bound += [worst] * len(cell[-1])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(np.concatenate(cell) if cell else np.zeros(0, np.int64)), pa.array(part, pa.int32()), pa.array(bound, pa.float64())], names=[*batch.schema.names, "cell", "part", "bound"])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "vec_id": [], "score": [], "verified": []}
        if left.num_rows and right.num_rows:
            ids = left["ids"].to_pylist()
            count = np.array([len(i) for i in ids])
            for q, (where, score, verified) in zip(right["q"].to_pylist(), search(vectors(left), count, vectors(right), np.asarray(right["bound"]), k + 1, p)):
                best = sorted((-s, i) for w, s in zip(where.tolist(), score.tolist()) for i in ids[w])[: k + 1]
                out["q"] += [q] * (len(best) + 1)
                out["vec_id"] += [i for _, i in best] + [None]  # the last row has the cost alone
                out["score"] += [-s for s, _ in best] + [None]
                out["verified"] += [0] * len(best) + [verified]
        lean()
        return pa.table({"q": pa.array(out["q"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64()), "verified": pa.array(out["verified"], pa.int64())})

    # a row goes to each group of queries, of which there is one for GROUP of them
    rows = cells.select("vec", "ids", "cell", F.pmod(F.xxhash64("vec"), slices_of[F.col("cell")]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    with arrow_rows(spark, TEXT_ROWS):
        sent = materialise(asked.mapInArrow(route, "vec binary, q long, cell long, part int, bound double"))
        sent = sent.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
        hits = materialise(rows.groupBy("cell", "part", "g").cogroup(sent.groupBy("cell", "part", "g")).applyInArrow(look, "q long, vec_id long, score double, verified long"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = hits.where("vec_id IS NOT NULL").withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}").select("q", "vec_id", "score")
    # every query id of an equal vector takes the same list, without itself
    own = query_ids(table.where(is_query), id_col, vec_col, dim).join(asked, "vec").select("query_id", "q")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = own.join(best, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked).cast("int")).where(f"rank <= {k}")
    if with_cost:
        out = out.join(hits.groupBy("q").agg(F.sum("verified").alias("verified")), "q")
    return out.select("query_id", "rank", "vec_id", "score", *(["verified"] if with_cost else []))


def query_ids(table: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(query_id, vec) of the valid query rows, repeated ids once."""

    def run(batches):
        for batch in batches:
            take, x = valid_vectors(batch["vec"], dim)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(take)), pa.array([v.tobytes() for v in x], pa.binary())], names=["query_id", "vec"])

    own = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return own.mapInArrow(run, "query_id long, vec binary").distinct()
