"""Inner-product search by randomly rotated one-bit codes.

A vector less a centre is scaled to length one and turned by a random rotation; the signs
of its components are its code, packed into bits. With the length and the
code's inner product with the turned vector kept as correction scalars, the inner product
with any query is estimated without bias, and its error is bounded: with the factor
``bound`` (in standard deviations) no more than a vanishing share of estimates stray beyond it.

Vectors lie in cells, each with its centre and radius. A sample gives every query a floor under its k-th best inner
product; a cell whose best possible inner product, by centre and radius, stays below that floor is never met, which loses
nothing. Cells and queries are dealt to blocks; a pair of blocks that meet is one task's work. There the best estimates
are reranked first, which raises the floor, then every vector whose upper bound reaches it, on the original components in
double precision. Whatever has no finite estimate is reranked too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

#: Rows of a block of vectors and of a block of queries, on average.
VECTOR_BLOCK, QUERY_BLOCK = 32_768, 8_192
#: Vectors of the sample from which centres and first floors are taken; every vector is indexed and searched.
CENTRE_SAMPLE = 4_096
#: Cells of a dimension at most; the number grows with the vectors until then.
MAX_CELLS = 256
BOUND = 3.0
#: Pairs of a cell and a block of queries that are broadcast at most; beyond that they are joined.
FEW_PAIRS = 1 << 20


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, without overflow on the way."""
    top = np.abs(x).max(1, initial=0)
    safe = np.where((top > 0) & np.isfinite(top), top, 1)
    return safe * np.sqrt(((x / safe[:, None]) ** 2).sum(1))


def encode(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, lengths, inner products of code and turned vector) of rows less their centres."""
    moved = vectors - centres
    length = lengths(moved)
    turned = (moved / np.where(length > 0, length, 1)[:, None]) @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def usable(vec_col: str):
    """Not null, not empty, not zero, and without null or non-finite components."""
    big = F.lit(float("inf"))
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(sound & F.exists(vec_col, lambda x: x != 0), F.lit(False))


@dataclass
class Cells:
    """By dimension: centres [cell, dim], and the sample's vectors with hashes of their ids."""

    centres: dict[int, np.ndarray]
    sample: dict[int, tuple[np.ndarray, np.ndarray]]


def cell_centres(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """``n`` means of the rows of ``x`` after a few rounds of assignment to the nearest."""
    with np.errstate(all="ignore"):
        got = x[np.linspace(0, len(x) - 1, n).astype(np.int64)]
        for _ in range(rounds if n > 1 else 1):
            at = nearest_centre(x, got)
            got = np.stack([x[at == i].mean(0) if (at == i).any() else got[i] for i in range(n)])
    return np.nan_to_num(got, nan=0.0, posinf=0.0, neginf=0.0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        far = (centres**2).sum(1) - 2 * x @ centres.T
    return np.where(np.isfinite(far), far, np.inf).argmin(1)


def _grid(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block: int = VECTOR_BLOCK) -> tuple[DataFrame, Cells]:
    """(index, cells): (id, dim, cell, vector, code binary, length, fit) per usable row, written to the shared folder.

    Ids may be null, repeated and of any orderable type. Rows of several dimensions are indexed apart.
    """
    kinds = dict(vectors.dtypes)
    kind, element = kinds[id_col], "float" if kinds[vec_col] == "array<float>" else "double"  # as stored: never more bytes than the table has
    rows = vectors.where(usable(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{element}>").alias("vector"))
    sizes = {r.dim: r["count"] for r in rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count")).limit(1024).collect()}
    sample = rows.select(F.size("vector").alias("dim"), "vector", F.xxhash64("vector").alias("h"), F.xxhash64("id").alias("i")).orderBy("h", "i").limit(CENTRE_SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r)
    held = {d: (np.asarray([r.vector for r in v], np.float64), np.asarray([r.i for r in v], np.int64)) for d, v in by_dim.items()}
    cells = Cells({d: cell_centres(x, max(1, min(MAX_CELLS, len(x) // 8, -(-sizes.get(d, 1) // block)))) for d, (x, _) in held.items()}, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(dims):
                part = b.take(pa.array(np.nonzero(dims == dim)[0]))
                x = _grid(part.column(1), dim).astype(np.float64)
                centres = cells.centres.get(int(dim), np.zeros((1, dim)))
                at = nearest_centre(x, centres)
                with np.errstate(all="ignore"):
                    code, length, fit = encode(x, centres[at])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(x), dim, np.int32)), pa.array(at, pa.int32()), part.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(fit)],
                    names=["id", "dim", "cell", "vector", "code", "length", "fit"],
                )

    return written(rows.mapInArrow(tidy(run), f"id {kind}, dim int, cell int, vector array<{element}>, code binary, length double, fit double"), "codes"), cells


def search_block(q: np.ndarray, own: np.ndarray, floor: np.ndarray, x: np.ndarray, order: np.ndarray, code, length, fit, centre, k: int, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, score) of each query's k best of a block, ties to smaller ``order``.

    A vector whose order is the query's ``own`` is passed over; ``floor`` bounds each query's k-th best over all vectors from below.
    """
    dim = x.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    out = []
    with np.errstate(all="ignore"):
        sure = fit > 1e-12
        scale = np.where(sure, length / np.where(sure, fit, 1) / np.sqrt(dim), 0)
        slack = np.where(sure, bound * length * np.sqrt(np.maximum(0, 1 - fit**2)) / np.where(sure, fit, 1) / np.sqrt(max(1, dim - 1)), length)
        step = max(1, min(256, (1 << 22) // max(1, len(x))))  # a few matrices of 32 MB at once
        for at in range(0, len(q), step):
            part = q[at : at + step]
            size = lengths(part)
            unit = part / np.where(size > 0, size, 1)[:, None]
            estimate = ((unit @ rotation(dim)).astype(np.float32) @ signs.T).astype(np.float64) * scale + (unit @ centre)[:, None]
            same = own[at : at + step, None] == order[None, :]
            unknown = ~np.isfinite(estimate) | ~np.isfinite(slack)[None, :]
            estimate[unknown] = np.inf
            estimate[same] = -np.inf
            first = min(len(x), 5 * k)
            lead = np.argpartition(estimate, len(x) - first, axis=1)[:, len(x) - first :]
            exact = (x[lead].astype(np.float64) * part[:, None, :]).sum(-1)
            exact[np.take_along_axis(same, lead, 1)] = -np.inf
            low = floor[at : at + step]
            if first >= k:
                low = np.fmax(low, np.sort(exact, axis=1)[:, -k])
            margin = 1e-5 * (length[None, :] + np.abs(unit @ centre)[:, None])
            reach = ((estimate + slack[None, :] + margin) * size[:, None] >= low[:, None]) | unknown
            reach &= ~same
            row, col = np.nonzero(reach)
            score = np.concatenate([(x[col[i : i + 65536]].astype(np.float64) * part[row[i : i + 65536]]).sum(-1) for i in range(0, len(col), 65536)] or [np.zeros(0)])
            by = np.lexsort((order[col], -score, row))
            row, col, score = row[by], col[by], score[by]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((row[best] + at, col[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _met_cells(queries: DataFrame, cells: Cells, radius: dict[tuple[int, int], float], k: int) -> DataFrame:
    """``queries`` (id, dim, vector, a hash of the id) with their floor, once for each cell that may hold one of their k best."""
    kind = dict(queries.dtypes)
    known: dict[int, list[tuple[int, float]]] = {}
    for (dim, cell), r in radius.items():
        known.setdefault(dim, []).append((cell, r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.nonzero(dims == dim)[0]))
                x = _grid(part.column(2), dim).astype(np.float64)
                own = sorted(known.get(int(dim), []))
                held, ids = cells.sample.get(int(dim), (np.zeros((0, dim)), np.zeros(0, np.int64)))
                with np.errstate(all="ignore"):
                    floor = np.full(len(x), -np.inf)
                    if len(held) >= k:
                        same = part.column(3).to_numpy()[:, None] == ids[None, :]
                        floor = np.sort(np.where(same, -np.inf, x @ held.T), axis=1)[:, -k]
                    size = lengths(x)
                    floor = np.where(np.isfinite(floor), floor - 1e-9 * size * float(lengths(held).max(initial=0)), -np.inf)
                    centres = cells.centres.get(int(dim), np.zeros((1, dim)))
                    most = x @ centres.T
                    for cell, r in own:
                        upper = most[:, cell] + size * r * (1 + 1e-9) + 1e-9 * size
                        keep = np.nonzero(~(upper < floor))[0]
                        if len(keep):
                            got = part.take(pa.array(keep))
                            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(floor[keep]), pa.array(np.full(len(keep), cell, np.int32))], names=[*got.schema.names, "floor", "cell"])

    return queries.mapInArrow(tidy(run), ", ".join(f"{c} {t}" for c, t in kind.items()) + ", floor double, cell int")


def _dealt_queries(queries: DataFrame, block: int) -> DataFrame:
    """``queries`` (id, dim, vector, own) with qb: blocks of ``block`` queries on average, of neighbouring cells, so that a block meets few cells; a crowded cell's are dealt to several."""
    rows, first, room = [], 0, block
    for r in sorted(queries.groupBy("dim", "own").count().collect()):  # MAX_CELLS rows a dimension at most
        if r["count"] > room:
            first, room = first + (room < block), block
        n = -(-r["count"] // block)
        rows.append((r.dim, r.own, first, n))
        if n > 1:
            first, room = first + n, block
        else:
            room -= r["count"]
    places = queries.sparkSession.createDataFrame(rows, "dim int, own int, first int, n int")
    return queries.join(F.broadcast(places), ["dim", "own"]).withColumn("qb", F.col("first") + F.pmod(F.xxhash64("id", "vector"), F.col("n")).cast("int")).drop("own", "first", "n")


def nearest(
    index: DataFrame, queries: DataFrame, cells: Cells, k: int = 20, bound: float = BOUND, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of ``index`` by inner product, rows of its own id excepted.

    queries: rows of that index. Vectors of other dimensions are no candidates; repeated
    queries count once, while rows that share an id but not a vector are queries each; repeated rows are candidates each; ties
    go to the smaller id, a null id last. Fewer candidates than k are all returned; without queries or vectors the result is empty.
    """
    queries = queries.select("id", "dim", "vector", F.col("cell").alias("own")).distinct()
    stats = index.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("length").alias("r")).collect()  # MAX_CELLS rows a dimension at most
    radius = {(s.dim, s.cell): s.r for s in stats}
    queries = _dealt_queries(queries, query_block)
    parts = F.lit(1)
    for s in stats:
        if s.n > vector_block:
            parts = F.when((F.col("dim") == s.dim) & (F.col("cell") == s.cell), F.lit(-(-s.n // vector_block))).otherwise(parts)

    def spread(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    # equal rows spread as well: a row's place in its file is part of the hash
    dealt = F.pmod(F.xxhash64("id", "vector", F.monotonically_increasing_id()), parts).cast("int")
    met = written(_met_cells(queries.select("id", "dim", "vector", F.xxhash64("id").alias("i"), "qb"), cells, radius, k), "code-queries")
    # a vector goes only to the blocks of queries that meet its cell
    pairs = met.groupBy("dim", "cell").agg(F.collect_set("qb").alias("qbs"))
    blocks = met.agg(F.max("qb")).first()[0]
    pairs = F.broadcast(pairs) if ((blocks or 0) + 1) * len(stats) <= FEW_PAIRS else pairs
    vec = index.select("id", "dim", "cell", "vector", "code", "length", "fit", dealt.alias("vb")).join(pairs, ["dim", "cell"]).withColumn("qb", F.explode("qbs")).drop("qbs")
    qs = met.select("id", "dim", "vector", "floor", "cell", "qb").withColumn("vb", spread(parts))
    kind = dict(index.dtypes)["id"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "q", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (left.schema.field("id").type, pa.int64(), right.schema.field("id").type, pa.float64())], names=names)
        left, right = left.combine_chunks(), right.combine_chunks()
        dim, cell = left.column("dim")[0].as_py(), left.column("cell")[0].as_py()
        col = lambda t, c: t.column(c).chunk(0)
        q_ids, ids = col(left, "id"), col(right, "id")
        place = pc.rank(pa.concat_arrays([q_ids, ids]), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        centres = cells.centres.get(dim, np.zeros((1, dim)))
        code = np.frombuffer(b"".join(col(right, "code").to_pylist()), np.uint8).reshape(len(ids), -1)
        row, at, score = search_block(
            _grid(col(left, "vector"), dim).astype(np.float64), place[: len(q_ids)], left.column("floor").to_numpy(), _grid(col(right, "vector"), dim), place[len(q_ids) :],
            code, right.column("length").to_numpy(), right.column("fit").to_numpy(), centres[cell], k, bound,
        )
        return pa.table([q_ids.take(pa.array(row)), left.column("q").take(pa.array(row)), ids.take(pa.array(at)), pa.array(score)], names=names)

    keys = ["dim", "cell", "qb", "vb"]
    left = qs.withColumn("q", F.xxhash64("vector"))
    found = left.groupBy(*keys).cogroup(vec.groupBy(*keys)).applyInArrow(run, f"query_id {kind}, q long, vec_id {kind}, score double")
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
