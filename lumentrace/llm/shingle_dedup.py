"""The verified banding of ``simhash_dedup``: near-duplicate classes by the Jaccard similarity of word shingles.

A text is the set of its shingles' 64-bit hashes; equal sets are one node. Two SimHash fingerprints of texts at similarity 0.8
differ in ten of 64 bits on average, which segments with one error each can't reach; so nodes meet by their Golay keys
where fingerprints lie within two bits, and by MinHash bands beyond that:
with ``BANDS`` bands of ``ROWS`` rows a pair at similarity 0.8 meets but for 3 in 1,000,000, and more similar
ones more surely. Every pair that meets is checked on the sets themselves.

A band's nodes are first compared with its least node only. Pairs that are then in one component already need no
check of their own, so a group of near copies isn't compared with itself all over. Of all other pairs of the band those are
that could have the similarity by what both share with anyone, part by part of the hashes: texts that stem from one and were edited apart each have
shingles of their own, which rules most of their pairs out without a look at the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, named, passing, row_key, tidy, written
from .simhash_dedup import links, majority

SHINGLE = 5
BANDS, ROWS = 24, 4
_random = np.random.default_rng(42)
_FLIP = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
#: Parts of the hashes that a pair's shared shingles are bounded by.
PARTS = 64
#: Shingles hashed at once.
BLOCK = 1 << 10


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of word shingles, of all words where they are fewer; words are those of ``simhash_dedup``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at : at + BLOCK, None] ^ _FLIP
        h ^= h >> np.uint64(32)
        h *= _TIMES
        least = np.minimum(least, h.min(0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sets(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, rk, node, fp, bands, hashes): one row per input row; rk tells rows that share an id apart, fp is the fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                got = [shingles(t.as_py(), width) for t in b.column(2)]
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in got], np.uint64).view(np.int64)
                fp = np.array([majority(h) for h in got], np.uint64).view(np.int64)
                ends = np.cumsum([0] + [len(h) for h in got])
                bands = [band_keys(h) for h in got]
                tops = np.cumsum([0] + [len(k) for k in bands])
                lists = lambda e, v: pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *v])))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(node), pa.array(fp), lists(tops, bands), lists(ends, [h.view(np.int64) for h in got])], names=["id", "rk", "node", "fp", "bands", "hashes"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(named(id_col).alias("id"), row_key(*docs.columns).alias("rk"), named(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, rk long, node long, fp long, bands array<long>, hashes array<long>")


def _similar(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose sets have the similarity; only sets that some pair asks for are shuffled."""
    some = written(pairs.select(F.explode(F.array("src", "dst")).alias("k")).distinct(), "shingle-some")
    asked = passing(rows.select("node", F.size("hashes").alias("size"), "hashes"), F.xxhash64("node"), some.select(F.xxhash64("k").alias("k")))
    held = written(asked.dropDuplicates(["node"]), "shingle-sets")
    sizes = held.select("node", "size")
    a, b = sizes.toDF("src", "m"), sizes.toDF("dst", "n")
    can = F.least("m", "n") >= similarity * F.greatest("m", "n")  # else the smaller set is too small
    near = written(pairs.join(a, "src").join(b, "dst").where(can).select("src", "dst"), "shingle-near")
    a, b = held.select(F.col("node").alias("src"), F.col("hashes").alias("a")), held.select(F.col("node").alias("dst"), F.col("hashes").alias("b"))
    both = near.join(a, "src").join(b, "dst").select("src", "dst", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("m"))
    return both.where(F.col("n") >= similarity * (F.col("m") - F.col("n"))).select("src", "dst")


def _shared_sizes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, size, common, parts): shingles of each of ``nodes``, those of them that another of ``nodes`` has too, and these by PARTS parts of the hashes.

    Two nodes share in each part no more than the one with fewer has there, which is a closer bound than that of all at once.
    """
    asked = passing(rows.select("node", "hashes"), F.xxhash64("node"), nodes.select(F.xxhash64("node").alias("k"))).dropDuplicates(["node"])
    held = written(asked.join(nodes, "node", "left_semi").select("node", F.explode("hashes").alias("h")), "shingle-held")
    part = F.pmod("h", F.lit(PARTS))
    each = lambda: F.array(*[F.count_if(part == i) for i in range(PARTS)])
    alone = held.groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"), each().alias("q"))
    sizes = held.groupBy("node").agg(F.count("*").alias("size"), each().alias("p"))
    parts = F.when(F.col("q").isNull(), F.col("p")).otherwise(F.zip_with("p", "q", lambda p, q: p - q))
    return sizes.join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"), parts.alias("parts"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: float = 0.8) -> DataFrame:
    """(id, rk, component): one row per input row; rows of a component are linked by pairs of at least ``similarity``.

    Texts without words are one class. rk is ``row_key`` of all columns of ``docs``. An empty table gives an empty result.
    """
    rows = written(sets(docs, id_col, text_col, width), "shingle-rows")
    index = rows.select("node", F.explode("bands").alias("key"))
    least = written(index.groupBy("key").agg(F.min("node").alias("src"), F.max("node").alias("hi")).where("src <> hi").select("key", "src"), "shingle-least")
    # most keys have one node only
    some = passing(index, F.col("key"), least.select(F.col("key").alias("k")))
    shared = written(some.distinct().join(least, "key"), "shingle-shared")
    first = shared.where("node <> src").select("src", F.col("node").alias("dst"))
    first = written(first.unionByName(_by_fingerprint(rows)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "shingle-pairs")
    found = written(_similar(first, rows, similarity), "shingle-links")
    comps = connected_components(found, "shingle-stars")
    named = written(shared.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "shingle-named")
    mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    open_ = written(named.join(mixed, "key", "left_semi"), "shingle-open")
    open_ = open_.join(_shared_sizes(open_.select("node").distinct(), rows), "node")
    left = open_.select("key", F.col("node").alias("src"), "component", F.col("size").alias("m"), F.col("common").alias("c"), F.col("parts").alias("p"))
    right = open_.select("key", F.col("node").alias("dst"), F.col("component").alias("other"), F.col("size").alias("n"), F.col("common").alias("d"), F.col("parts").alias("q"))
    most = F.least("c", "d")  # no pair shares more
    enough = lambda k: k >= similarity * (F.col("m") + F.col("n") - k)
    can = enough(most) & enough(F.aggregate(F.zip_with("p", "q", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x))
    more = left.join(right, (left.key == right.key) & (left.src < right.dst) & (left.component != right.other) & can).select("src", "dst").distinct()
    more = written(more.join(first, ["src", "dst"], "left_anti"), "shingle-more")
    if not more.isEmpty():
        comps = connected_components(found.unionByName(_similar(more, rows, similarity)), "shingle-stars")
    return rows.select("id", "rk", "node").join(comps, "node", "left").select("id", "rk", F.coalesce("component", "node").alias("component"))


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (src, dst) of nodes whose fingerprints meet by Golay keys: a fingerprint's least node with its others and with those of near fingerprints."""
    prints = written(rows.select("fp", "node").distinct(), "shingle-prints")
    least = written(prints.groupBy("fp").agg(F.min("node").alias("src")), "shingle-print-least")
    same = prints.join(least, "fp").where("src <> node").select("src", F.col("node").alias("dst"))
    near = links(least.select("fp")).toDF("a", "b")
    met = near.join(least.toDF("a", "src"), "a").join(least.toDF("b", "dst"), "b").select("src", "dst")
    return same.unionByName(met)
