"""Toxicity by non-negative positive-unlabelled learning.

The model is linear over a text's distinct words: a word adds the weights of its hashed features (itself
and its beginnings). Weights are at least zero, so that a long harmless text gathers
no evidence. They are fitted to confirmed toxic texts and unlabelled ones by the risk

    prior * E_P[loss(f, +)]  +  max(0, E_U[loss(f, -)] - prior * E_P[loss(f, -)])

with the logistic loss. Where the corrected negative part falls below zero, the step goes the other way
to undo the overfitting. An L1 penalty keeps harmless features at zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, tidy, written

FEATURE_BITS = 20
#: Texts of the training sample, chosen by a hash of the id: the bound on what fitting gathers.
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
#: A feature counts if at least so many positive texts have it, and more than unlabelled ones let expect by so many standard deviations.
MIN_POSITIVE, MIN_DEVIATIONS = 3, 4.0
#: Words whose weights a task remembers before it starts anew.
WORD_CACHE = 100_000

_WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings of four to six characters."""
    mask = (1 << FEATURE_BITS) - 1
    got = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & mask]
    return got + [zlib.crc32(b"p%d" % n + word[:n].encode("utf-8", "surrogatepass")) & mask for n in (4, 5, 6) if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def featurised(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """(keep..., features array<int>): the features of each distinct word of the whole text, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.array([f for w in words_of(t.as_py()) for f in features(w)], np.int32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(got, pa.list_(pa.int32()))], names=[*keep, "features"])

    kinds = dict(docs.dtypes)
    return docs.select(text_col, *keep).mapInArrow(tidy(run), ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["features array<int>"]))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))


class _Rows:
    """Feature lists of texts, as columns of a sparse matrix over the features that count."""

    def __init__(self, lists: list[np.ndarray], names: np.ndarray):
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.searchsorted(names, flat)
        ok = (at < len(names)) & (names[np.minimum(at, max(0, len(names) - 1))] == flat) if len(names) else np.zeros(len(flat), bool)
        self.n, self.k, self.row, self.col = len(lists), len(names), row[ok], at[ok]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.k)


def gradient(p: _Rows, u: _Rows, w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, float, float]:
    """(by weight, by bias, the corrected negative part) of the risk; of that part reversed where it is below zero."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    fp, fu = p.times(w) + b, u.times(w) + b
    negative = (np.logaddexp(0, fu).mean() if u.n else 0.0) - prior * np.logaddexp(0, fp).mean()
    as_toxic, as_harmless, unlabelled = prior * (sigmoid(fp) - 1) / p.n, prior * sigmoid(fp) / p.n, sigmoid(fu) / max(1, u.n)
    on_p, on_u = (as_toxic - as_harmless, unlabelled) if negative >= 0 else (as_harmless, -unlabelled)
    return p.back(on_p) + u.back(on_u), float(on_p.sum() + on_u.sum()), float(negative)


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], names: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.5, l1: float = 1e-5
) -> Model:
    """Minimises the non-negative risk over the features ``names`` (sorted) by proximal steps with per-weight scaled gradients.

    Without positive texts all scores are the same and low.
    """
    if not positive:
        return Model({}, -3.0)
    p, u = _Rows(positive, names), _Rows(unlabelled, names)
    w, b = np.zeros(len(names)), -2.0
    seen, seen_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        g, gb, _ = gradient(p, u, w, b, prior)
        seen += g * g
        seen_b += gb * gb
        w = np.maximum(0, w - rate / np.sqrt(seen) * (g + l1))
        b -= rate * gb / np.sqrt(seen_b)
    return Model({int(n): float(x) for n, x in zip(names, w) if x > 0}, float(b))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", prior: float | None = None,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """A model from the texts of ``docs`` that ``labels`` marks toxic and from texts of ``docs`` at large, both as bounded samples.

    ``prior`` is the share of toxic texts; by default that among the labelled ids. An id counts as
    toxic if any of its label rows says so. Without positive texts, as in empty tables, every score is the same and low. Rows
    with a null id can't be chosen; null texts count as empty.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(id_col).agg(F.max(toxic_col).alias("t"))
    by_hash = lambda df, n: df.orderBy(F.xxhash64(id_col), id_col).limit(n)
    ids = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    if prior is None:
        prior = known.agg(F.avg(F.col("t").cast("double"))).first()[0] or 0.01
    prior = min(0.9, max(1e-3, prior))
    positive = by_hash(known.where("t = 1").select(id_col).join(ids, id_col, "left_semi"), max_positive).withColumn("positive", F.lit(True))
    mixed = by_hash(ids, max_unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(positive.unionByName(mixed))  # at most max_positive + max_unlabelled ids
    seen = written(featurised(docs.select(id_col, text_col).join(chosen, id_col).select(text_col, "positive"), text_col, "positive"), "nnpu-sample")
    names = telling(seen)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.sort(x[np.isin(x, names)]) for x in (np.asarray(v.values) for v in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["positive", "features"])

    rows = [(bool(r["positive"]), np.array(r["features"], np.int64)) for r in seen.mapInArrow(tidy(only), seen.schema).toArrow().to_pylist()]
    # in one order, so that fitting doesn't depend on which task ended first
    rows.sort(key=lambda r: r[1].tobytes())
    return fit([f for p, f in rows if p], [f for p, f in rows if not p], names, prior)


def telling(sample: DataFrame) -> np.ndarray:
    """The features of ``sample`` that positive texts have beyond chance, sorted; counted on the executors."""
    size = dict(sample.groupBy("positive").count().collect())
    each = sample.select("positive", F.explode(F.array_distinct("features")).alias("f")).groupBy("f")
    n = each.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    expected = F.col("u") * (size.get(True, 0) / max(1, size.get(False, 0)))
    good = n.where((F.col("p") >= MIN_POSITIVE) & (F.col("p") - expected >= MIN_DEVIATIONS * F.sqrt(expected + 0.5)))
    return np.sort(good.select("f").toArrow()["f"].to_numpy()).astype(np.int64)


def score(docs: DataFrame, model: Model, text_col: str = "text", *keep: str) -> DataFrame:
    """(keep..., score double): the probability that each whole text is toxic; null texts count as empty, repeated rows stay, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, float] = {}
        for b in batches:
            sums = []
            for t in b.column(0):
                ws = words_of(t.as_py())
                new = [w for w in ws if w not in known]
                if new:
                    if len(known) + len(new) > WORD_CACHE:
                        known.clear()
                        new = ws
                    known.update((w, m.word(w)) for w in new)
                sums.append(sum(sorted(filter(None, map(known.__getitem__, ws)))))
            z = np.clip(np.array(sums, np.float64) + m.bias, -40, 40)
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(1 / (1 + np.exp(-z)))], names=[*keep, "score"])

    kept = [named(c) for c in keep]
    return docs.select(named(text_col), *kept).mapInArrow(tidy(run), docs.select(*kept).schema.add("score", "double"))
