"""What the corpus operators share: durable intermediate tables, row keys and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="lumentrace-")
    return _OWN_DIRS[app]


#: Rows that go to Python at once, at most: documents are long.
BATCH_ROWS = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: a lost executor costs no recomputation.

    Lowers the session's Arrow batches to ``BATCH_ROWS`` where they are larger.
    """
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCHES)) <= BATCH_ROWS:
        spark.conf.set(_BATCHES, str(BATCH_ROWS))
    path = f"{shared_dir(spark)}/{_SCOPE[-1] if scope is None else scope}lumentrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


_SCOPE = [""]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What ``written`` writes inside goes into a folder of its own, which is removed at the end; gives the scope outside."""
    folder = f"lumentrace-scratch-{uuid.uuid4().hex}/"
    _SCOPE.append(folder)
    try:
        yield _SCOPE[-2]
    finally:
        _SCOPE.pop()
        _remove(spark, f"{shared_dir(spark)}/{folder}")


def forget(df: DataFrame) -> None:
    """Removes the files of a table from ``written`` that nothing reads any more."""
    _remove(df.sparkSession, df._written_to)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: log2 of the bits of a bitmap.
BITMAP_BITS = 24


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose 64-bit ``key`` may be among ``keys.k``, and those whose key isn't.

    The first are all that are and, as the bitmap fills, some that aren't: they are joined exactly afterwards; the others need no
    shuffle. The bitmap has 2**BITMAP_BITS bits in words of 64: a few megabytes to broadcast at most, whatever the corpus.
    """
    slot = lambda h: F.shiftrightunsigned(h, 64 - BITMAP_BITS)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), (slot(h) % 64).cast("int"))
    word = lambda h: F.shiftright(slot(h), 6)
    marks = keys.groupBy(word(F.col("k")).alias("_bitmap_word")).agg(F.bit_or(bit(F.col("k"))).alias("_bitmap_bits"))
    met = df.withColumn("_bitmap_key", key).withColumn("_bitmap_at", word(F.col("_bitmap_key"))).join(F.broadcast(marks), F.col("_bitmap_at") == F.col("_bitmap_word"), "left")
    may = F.coalesce(F.col("_bitmap_bits").bitwiseAND(bit(F.col("_bitmap_key"))) != 0, F.lit(False))
    own = [named(c) for c in df.columns]
    return met.where(may).select(*own), met.where(~may).select(*own)


def passing(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The first part of ``parted``."""
    return parted(df, key, keys)[0]


_held: dict[str, object] = {}


def worker_cache(owner: str, make: Callable[[], object]) -> object:
    """``owner``'s cache in this Python worker, made by ``make`` where there is none; those of other owners go.

    A worker serves one stage after another, so it holds one stage's cache at a time.
    """
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


def tidy(run: Callable[[Iterator], Iterator], caches: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after whose last batch the worker gives free memory back; without ``caches`` it holds none of other stages."""

    def wrapped(batches: Iterator) -> Iterator:
        if not caches:
            _held.clear()
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def named(name: str) -> Column:
    """The column of that very name, whatever dots and backticks it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame, names: list[str] | None = None) -> Column:
    """All columns of ``df`` (or ``names``) as one struct, "row", whose fields are numbered: it can travel where their names couldn't."""
    return F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(df.columns if names is None else names)]).alias("row")


def field(df: DataFrame, name: str, names: list[str] | None = None) -> Column:
    """A column of ``df`` out of its ``whole`` row."""
    return F.col("row").getField(f"c{(df.columns if names is None else names).index(name)}").alias(name)


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's content: tells rows apart that share an id; equal rows share it.

    The operators pair it with the id and give equal rows equal results.
    """
    return F.xxhash64(*[F.coalesce(named(c).cast("string"), F.lit("\u0000null")) for c in cols])


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Alternating large-star and small-star rounds over ``edges`` (src, dst long).

    Returns (node, component), component being the least node id reachable; only
    nodes that have edges appear. Each round is written to the shared folder, so
    lineage stays short; a hub's edges meet only in a join that AQE can split.
    """
    stars = written(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(), name
    )
    before = None
    for _ in range(max_rounds):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.*")
            .where("hi <> lo")
            .distinct()
        )
        last, stars = stars, written(small, name)
        forget(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    ).distinct()
