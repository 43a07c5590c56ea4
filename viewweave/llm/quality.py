"""Hierarchical empirical-Bayes quality classifier.

A document's own evidence comes from two logistic heads (low quality, toxic) over words chosen by a binomial test and a few
shape features, fitted on at most MAX_TRAIN labelled documents. Grouped aggregation then gives each host (source) and each
path (source and language) a posterior share of good documents: a path shrinks to its host, a host to the global prior, by
strengths from the spread between sites (method of moments). A site's documents count by their label, those without one by their
evidence. The posterior of a document adds the shift in log-odds of its site, from which its own count is left out, so that
no document speaks for itself twice.

Scale: whole texts are scored and the narrow evidence is stored (texts that are asked for are scored again as they are written); sites are partial sums of narrow rows. The
site table is broadcast only when counted; else adaptive execution splits skewed sites in a sort-merge join (one row a site on its
other side). Only the bounded sample's features and the fitted words reach the driver.

Cases: null and empty texts have shape features of zero and are judged by them and their site; null hosts or paths are sites
of their own; repeated labels of an id count as the worst of them; labels without documents count for nothing; without any
labels every document is kept; rows with the same id are judged alone; the only document of a site has the prior's posterior; an empty
table gives an empty result; all columns of docs are kept under their names, whatever they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import TEXT_ROWS, arrow_rows, chunked_words, flat_bytes, fresh, in_chunks, lean, materialise, sized_join

#: Labelled documents that the heads are fitted on, those of the smallest hashes of their ids: the bound of the sample.
MAX_TRAIN = 12_000
MAX_WORDS = 192
SHAPES = 7


def _shapes(buf: np.ndarray, offs: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: log length, shares of symbols, capitals, bars and digits, of distinct words, and of words that repeat the one before."""
    n = len(offs) - 1
    size = np.maximum(1, np.diff(offs))
    kinds = np.zeros((256, 4), bool)
    kinds[[*b"!#$%&*@^~"], 0] = True
    kinds[65:91, 1] = True
    kinds[ord("|"), 2] = True
    kinds[48:58, 3] = True
    out = np.zeros((n, SHAPES))
    out[:, 0] = np.log1p(np.diff(offs)) / 10
    for k in range(4):
        sums = np.concatenate([[0], np.cumsum(kinds[buf, k])])
        out[:, 1 + k] = (sums[offs[1:]] - sums[offs[:-1]]) / size
    owner = np.repeat(np.arange(n), counts)
    m = np.maximum(1, counts)
    some = _distinct(hashes, owner)
    out[:, 5] = np.bincount(some[1], minlength=n) / m
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, 6] = np.bincount(owner[1:][again], minlength=n) / m
    return out


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


@dataclass(frozen=True)
class Head:
    """Logistic weights over standardised shapes and chosen words."""

    words: np.ndarray
    weights: np.ndarray
    shape_mean: np.ndarray
    shape_scale: np.ndarray
    shape_weights: np.ndarray
    bias: float

    def logit(self, shapes: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = self.bias + ((shapes - self.shape_mean) / self.shape_scale) @ self.shape_weights
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            out = out + np.bincount(owner[hit], self.weights[at[hit]], len(shapes))
        return out


def fit_head(shapes: np.ndarray, hashes: np.ndarray, owner: np.ndarray, y: np.ndarray, with_shapes: bool) -> Head:
    """Chooses words whose share of positives is far from the base rate and fits them, with the shapes, by ridge logistic regression."""
    n = len(y)
    p = float(y.mean())
    some, back = np.unique(hashes, return_inverse=True)
    df = np.bincount(back, minlength=len(some))
    positive = np.bincount(back, y[owner], len(some))
    z = np.where(df >= 4, (positive - df * p) / np.sqrt(np.maximum(df, 1) * max(p * (1 - p), 1e-9)), 0.0)
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:MAX_WORDS])
    chosen = chosen[np.abs(z[chosen]) >= 4.5]
    mean, scale = shapes.mean(0), shapes.std(0) + 1e-6
    slot = np.full(len(some), -1)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((n, 1 + SHAPES + len(chosen)))
    x[:, 0] = 1
    if with_shapes:
        x[:, 1 : 1 + SHAPES] = (shapes - mean) / scale
    hit = slot[back] >= 0
    x[owner[hit], 1 + SHAPES + slot[back][hit]] = 1
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    ridge = np.full(len(w), 0.1)
    ridge[0] = 1e-6
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (q * (1 - q) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - q) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return Head(some[chosen], w[1 + SHAPES :], mean, scale, w[1 : 1 + SHAPES] * with_shapes, float(w[0]))


def _features(texts: pa.Array):
    """For chunks of texts: first row, shapes, and the distinct words with their rows."""
    whole, at = flat_bytes(texts)
    for a, b in in_chunks(at, 1 << 19):
        buf, offs = whole[at[a] : at[b]], at[a : b + 1] - at[a]
        h, c = chunked_words(buf, offs)
        yield a, b, _shapes(buf, offs, h, c), *_distinct(h, np.repeat(np.arange(b - a), c))


def labelled(labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """At most max_train rows (doc_id, quality, toxic), one an id, those of the smallest hashes of ids."""
    worst = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    return worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Head]:
    """The heads for low quality and for toxic, from the documents of labelled(); none without them."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # at most max_train rows

    def run(batches):
        for batch in batches:
            for a, b, shapes, h, o in _features(batch["text"]):
                parts = np.split(h, np.searchsorted(o, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["quality"].slice(a, b - a), batch["toxic"].slice(a, b - a), pa.array([x.tobytes() for x in shapes], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "quality", "toxic", "shapes", "words"])

    found = own.mapInArrow(run, "doc_id long, quality int, toxic int, shapes binary, words binary").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return []
    shapes = np.stack([np.frombuffer(x, np.float64) for x in found["shapes"].to_pylist()])
    lists = [np.frombuffer(x, np.uint64) for x in found["words"].to_pylist()]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    hashes = np.concatenate(lists)
    low = 1.0 - np.array(found["quality"].fill_null(1).to_pylist(), float)
    toxic = np.array(found["toxic"].fill_null(0).to_pylist(), float)
    return [fit_head(shapes, hashes, owner, low, True), fit_head(shapes, hashes, owner, toxic, False)]


def with_evidence(docs: DataFrame, heads: list[Head], text_col: str, name: str, keep_text: bool) -> DataFrame:
    """Adds the log-odds that a document is good: neither of low quality nor toxic. A head has at most MAX_WORDS words."""
    at = docs.columns.index(text_col)
    fields = [f for k, f in enumerate(docs.schema.fields) if keep_text or k != at]

    def run(batches):
        for batch in batches:
            good = np.full(batch.num_rows, 6.0)
            if heads and batch.num_rows:
                for a, b, shapes, h, o in _features(batch.column(at)):
                    fine = np.zeros(b - a)
                    for head in heads:
                        fine -= np.logaddexp(0, head.logit(shapes, h, o))  # log P(not bad)
                    fine = np.clip(fine, -30, -1e-13)
                    good[a:b] = fine - np.log(-np.expm1(fine))
            columns = [c for k, c in enumerate(batch.columns) if keep_text or k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(good)], names=[*(f.name for f in fields), name])
        lean()

    return docs.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))


def strength(n: float, s: float, k: int, ss: float, nn: float) -> float:
    """Pseudo-counts of the prior over k sites: m (1 - m) over the variance between sites, beyond what sampling explains.

    n and s are the sums of documents and of good ones; ss is the sum of s^2 / n over sites, nn that of n^2.
    """
    m = min(max(s / n, 1e-4), 1 - 1e-4)
    spread = n - nn / n
    between = ((ss - n * m * m) - (k - 1) * m * (1 - m)) / spread if spread > 0 else 0.0
    return float(min(1e6, max(1.0, m * (1 - m) / between - 1))) if between > 1e-9 else 1e6


def site_sums(counted: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Stored sums (host, path, n, s, hn, hs) of rows (host, path, p), the global share of good documents, and the strengths of the priors of hosts and of paths."""
    paths = materialise(counted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    spread = lambda n, s: (F.sum(n).alias("n"), F.sum(s).alias("s"), F.count("*").alias("k"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("ss"), F.sum(F.col(n) * F.col(n)).alias("nn"))
    top, low = hosts.agg(*spread("hn", "hs")).first(), paths.agg(*spread("n", "s")).first()
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    if not top.n:
        return both, 0.5, 1.0, 1.0
    return both, min(max(top.s / top.n, 1e-4), 1 - 1e-4), strength(*top), strength(*low)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", site_weight: float = 0.5, threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """All columns of docs (the text only if asked for) and, as the last one, a struct: evidence, host_posterior, path_posterior, posterior, keep.

    It is called verdict, or, where docs has that name, verdict with underscores behind it. Texts are not stored once more: if
    they are asked for, docs is a stored table that is read again, and the evidence is computed again, when the result is.
    """
    names = [c for c in docs.columns if keep_text or c != text_col]
    evidence, site, own, verdict = (fresh(x, docs.columns) for x in ("evidence", "site", "own", "verdict"))
    sample = materialise(labelled(labels))
    heads = fit(docs, sample, id_col, text_col)
    known = sample.select(F.col("doc_id").alias(f"{own}_id"), F.when(F.coalesce("quality", F.lit(1)) < 1, 0.0).when(F.coalesce("toxic", F.lit(0)) > 0, 0.0).otherwise(1.0).alias(f"{own}_label"))
    # all rows carry what their sites are to leave out again
    id_of = docs[f"`{id_col}`"].cast("long") if keep_text or id_col != text_col else F.lit(None)
    carried = docs.select("*", id_of.alias(f"{own}_key"), F.struct(F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path")).alias(site))
    scored = lambda with_text: with_evidence(carried, heads, text_col, evidence, with_text).join(F.broadcast(known), F.col(f"{own}_key") == F.col(f"{own}_id"), "left")  # noqa: E731  at most MAX_TRAIN rows
    p = F.coalesce(F.col(f"{own}_label"), 1 / (1 + F.exp(-F.col(evidence)))) if heads else F.lit(1.0)
    narrow = [site, p.alias(own)] if keep_text else [*(F.col(f"`{c}`") for c in names), site, evidence, p.alias(own)]
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        counted = materialise(scored(False).select(*narrow))
    sums, mean, a, b = site_sums(counted.select(F.col(f"{site}.host").alias("host"), F.col(f"{site}.path").alias("path"), F.col(own).alias("p")))
    sums = materialise(sums.select(F.struct("host", "path").alias(site), F.struct("n", "s", "hn", "hs").alias(f"{own}_sums")))
    joined = sized_join(scored(True).select(*(F.col(f"`{c}`") for c in names), site, evidence, p.alias(own)) if keep_text else counted, sums, [site])
    of = lambda c: F.col(f"{own}_sums.{c}")
    host = (of("hs") - F.col(own) + a * mean) / (of("hn") - 1 + a)
    path = (of("s") - F.col(own) + b * host) / (of("n") - 1 + b)
    safe = F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.log(safe / (1 - safe)) - F.lit(float(np.log(mean / (1 - mean))))
    posterior = 1 / (1 + F.exp(-(F.col(evidence) + F.lit(site_weight if heads else 0.0) * shift)))
    found = F.struct(F.col(evidence).alias("evidence"), host.alias("host_posterior"), path.alias("path_posterior"), posterior.alias("posterior"), (posterior >= threshold).alias("keep"))
    return joined.select(*(F.col(f"`{c}`") for c in names), found.alias(verdict))
