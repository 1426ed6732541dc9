"""Hard negatives by a full sort of each anchor's scores.

Components are rounded to integers, so scores are exact and the same in any order of summing. Anchors and vectors are dealt to blocks; a pair of blocks
is one task's work. There each anchor's scores are sorted by score and id. A first round reads the nearest rows of the
anchor's own label off the sorted rows, its positives. A second one searches the sorted scores of all other labels for each positive's upper
limit by halving and reads the next rows from there, down to the lower limit. What the blocks found meets in a window of a few rows a block, so
no task ever holds all rows of an anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, written

#: Rows of a block of vectors and of a block of anchors, on average.
VECTOR_BLOCK, ANCHOR_BLOCK = 32_768, 8_192
#: Scores of a task at once.
SCORES = 1 << 21
TOP = (1 << 63) - 1


def grid(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as doubles where products are exact, else as integers of any size."""
    with np.errstate(over="ignore"):
        got = np.floor(scale * x)
    if np.isfinite(got).all() and np.abs(got).max(initial=0) < 1 << 53:
        return got
    exact = [int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(scale * v)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two grids; beyond a long they count as the largest or smallest one."""
    most = [max(abs(v) for v in [0, *g.ravel().tolist()]) if g.dtype == object else float(np.abs(g).max(initial=0)) for g in (q, x)]
    bound = int(most[0]) * int(most[1]) * max(1, q.shape[1])
    if bound < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < TOP:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda g: np.array([int(v) for v in g.ravel().tolist()], object).reshape(g.shape)
    return np.clip(whole(q) @ whole(x).T, -TOP, TOP).astype(np.int64)


def sorted_scores(s: np.ndarray) -> np.ndarray:
    """For each row the columns from the highest score down; columns are in the order of ids, which ties keep."""
    return np.argsort(-s, axis=1, kind="stable")


def usable(vec_col: str, label_col: str) -> Column:
    """A label, a vector, and no component that is null or not finite."""
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False))


def _grids(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return grid(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim), scale)


def _order(*ids: pa.Array) -> list[np.ndarray]:
    """Ranks of ids over several columns, nulls last."""
    rank = pc.rank(pa.concat_arrays(ids), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    return np.split(rank, np.cumsum([len(i) for i in ids])[:-1])


def _blockwise(left: DataFrame, right: DataFrame, found: Callable, schema: str, scale: int) -> DataFrame:
    """``found`` (anchors of a block, same label, same id, scores, sorted columns, ids of the columns) for each pair of blocks, some anchors at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def empty(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = {"k": pa.int32(), "anchor_id": a.schema.field("id").type, "positive_id": b.schema.field("id").type, "negative_id": b.schema.field("id").type}
        return pa.table([pa.array([], kinds.get(n, pa.int64())) for n in names], names=names)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return empty(a, b)
        a, b = a.combine_chunks(), b.combine_chunks()
        col = lambda t, c: t.column(c).chunk(0)
        own, ids = _order(col(a, "id"), col(b, "id"))
        by_id = np.argsort(ids, kind="stable")
        b, ids = b.take(pa.array(by_id)).combine_chunks(), ids[by_id]
        label = pa.concat_arrays([col(a, "label"), col(b, "label")]).dictionary_encode().indices.to_numpy()
        label, labels = label[: len(own)], label[len(own) :]
        dim = a.column("dim")[0].as_py()
        q, x = _grids(col(a, "vector"), dim, scale), _grids(col(b, "vector"), dim, scale)
        step = max(1, SCORES // len(x))
        parts = []
        for at in range(0, len(q), step):
            s = scores(q[at : at + step], x)
            same = label[at : at + step, None] == labels[None, :]
            itself = own[at : at + step, None] == ids[None, :]
            got = found(a.slice(at, step), same, itself, s, sorted_scores(s), col(b, "id"))
            parts.append(pa.table(got, names=names))
        return pa.concat_tables(parts)

    keys = ["dim", "ab", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, vector_block: int = VECTOR_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row of ``vectors`` that ``anchors`` chooses.

    An anchor's positives are its first ``positives`` other rows of the same label. For each the first ``negatives`` rows of other labels are told whose
    score is at least ``low`` and at most ``high`` hundredths of the positive's. A score is the inner product of floor(``scale`` * x); higher
    ones come first, ties by smaller id, a null id last. Beyond a long a score counts as the largest or smallest long.

    Rows without a label or with a component that is null or not finite take no part, nor do rows of the anchor's own id or of
    another number of dimensions for an anchor. Repeated rows are positives and negatives each, a repeated anchor is one anchor; anchors that share an id but not the label and
    vector are told each. Without anchors, positives or negatives there are no rows. Other columns may have any names.
    """
    if min(positives, negatives, low) < 1 or high < low:
        raise ValueError("positives, negatives and low are one or more, high isn't below low")
    element = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # as stored: never more bytes than the table has
    rows = vectors.select(named(id_col).alias("id"), named(label_col).alias("label"), named(vec_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where(usable("vector", "label")).select("id", "label", F.col("vector").cast(f"array<{element}>").alias("vector"), F.size("vector").alias("dim"), "anchor")
    rows = written(rows.withColumn("place", F.xxhash64("id", "vector", F.monotonically_increasing_id())), "hard-rows")
    kinds = dict(rows.dtypes)
    own = written(rows.where("anchor").select("id", "label", "vector", "dim").distinct().withColumn("a", F.xxhash64("id", "label", "vector")), "hard-anchors")
    n_a, n_v = -(-own.count() // anchor_block) or 1, -(-rows.count() // vector_block) or 1
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select("id", "label", "vector", "dim", F.pmod("place", F.lit(n_v)).cast("int").alias("vb")).withColumn("ab", spread(n_a))
    block = F.pmod(F.col("a"), F.lit(n_a)).cast("int").alias("ab")

    def same_label(part, same, itself, s, order, ids):
        good = np.take_along_axis(same & ~itself, order, 1)
        r, c = np.nonzero(good & (np.cumsum(good, axis=1) <= positives))
        at = order[r, c]
        return [part.column("id").take(pa.array(r)), part.column("a").take(pa.array(r)), ids.take(pa.array(at)), pa.array(s[r, at])]

    def other_labels(part, same, itself, s, order, ids):
        got_r, got_k, got_at = [], [], []
        for r, limits in enumerate(part.column("limits").to_pylist()):
            others = order[r][~(same[r] | itself[r])[order[r]]]
            falling = -s[r, others]
            for k, p in enumerate(limits):
                top, least = high * p // 100, -(-low * p // 100)
                start = int(np.searchsorted(falling, -top, "left")) if abs(top) <= TOP else (0 if top > 0 else len(falling))
                for at in others[start : start + negatives]:
                    if s[r, at] < least:
                        break
                    got_r.append(r)
                    got_k.append(k)
                    got_at.append(at)
        take = lambda c, i: c.take(pa.array(i, pa.int64()))
        r = np.array(got_r, np.int64)
        at = np.array(got_at, np.int64)
        return [take(part.column("id"), r), take(part.column("a"), r), pa.array(got_k, pa.int32()), take(ids, at), pa.array(s[r, at])]

    kind = kinds["id"]
    left = own.select("*", block).withColumn("vb", spread(n_v))
    first = _blockwise(left, right, same_label, f"anchor_id {kind}, a long, positive_id {kind}, score long", scale)
    w = Window.partitionBy("anchor_id", "a").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"))
    first = first.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < positives)
    first = written(first.groupBy("a", F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "score"))).alias("p")), "hard-positives")
    held = own.join(first, own.id.eqNullSafe(first.id) & (own.a == first.a)).select(own["*"], "p")
    left = held.select("id", "label", "vector", "dim", "a", F.transform("p", lambda x: x["score"]).alias("limits"), block).withColumn("vb", spread(n_v))
    second = _blockwise(left, right, other_labels, f"anchor_id {kind}, a long, k int, negative_id {kind}, score long", scale)
    w = Window.partitionBy("anchor_id", "a", "k").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"))
    second = second.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    told = first.select(F.col("id").alias("i"), F.col("a").alias("b"), "p")
    both = second.join(told, second.anchor_id.eqNullSafe(told.i) & (second.a == told.b)).withColumn("p", F.get("p", F.col("k")))
    return both.select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
