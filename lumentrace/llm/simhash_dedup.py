"""SimHash near-duplicate classes by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded with
zeros to 23. The binary Golay code [23,12,7] is perfect: every word lies within three
bits of exactly one codeword. A segment's keys are the index of that codeword and, if it
lies at distance three, of the five codewords at distance four. For two segments
that differ in at most one bit, the nearest codeword of either is among the keys
of the other.

Pigeonhole: of two errors over three segments in a cycle, some segment is free
of errors while the next one has at most one. Joining on (the exact segment, a codeword
of the next segment) therefore meets every pair of fingerprints within two bits;
the join condition verifies each pair on the full 64 bits. Equal fingerprints are one
node before the join, so groups of copies cost nothing there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, tidy, worker_cache, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
MAX_BITS = 2  # what the three cyclic segment pairs guarantee
#: Indexed fingerprints of a key beyond which finer keys take its place.
CROWDED = 2000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of XXH64 (seed 42) bits over word shingles, repeats included; 0 without words.

    Only A-Z are lower-cased and only ASCII white space separates words, which is
    what ``bytes.lower`` and ``bytes.split`` do.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long): one row per input row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["id", "fp"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"id {kind}, fp long").withColumnRenamed("id", id_col)


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the upper 11 and of the lower 12 bits, nearest error pattern by syndrome, the distance-four patterns).

    The generator polynomial is x^11+x^9+x^7+x^6+x^5+x+1; a codeword's index is
    its quotient's 12 message bits, here its upper 12 bits in systematic form. A word's syndrome is the sum of its parts'.
    """
    gen = 0b101011100011

    def remainder(words: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            words = np.where(words >> bit & 1, words ^ (gen << (bit - 11)), words)
        return words

    high, low = remainder(np.arange(1 << 11, dtype=np.int64) << 12), remainder(np.arange(1 << 12, dtype=np.int64))
    leader = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)])
        leader[high[words >> 12] ^ low[words & 4095]] = words
    words = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), 4)])
    four: list[list[int]] = [[] for _ in range(2048)]
    for word, s in zip(words.tolist(), (high[words >> 12] ^ low[words & 4095]).tolist()):
        if int(leader[s]).bit_count() == 3:
            four[s].append(word)
    wide = np.full((2048, 5), -1, np.int64)
    for s, found in enumerate(four):
        wide[s, : len(found)] = found
    return high, low, leader, wide


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword index of each 23-bit word, and an [n, 6] array of all its keys (-1: none)."""
    high, low, leader, wide = worker_cache("golay", golay_tables)
    s = high[words >> 12] ^ low[words & 4095]
    near = (words ^ leader[s]) >> 11
    more = np.where(wide[s] < 0, -1, (words[:, None] ^ wide[s]) >> 11)
    return near, np.concatenate([near[:, None], more], axis=1)


def _keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) rows: a key packs the exact segment's number and bits with a codeword index of the next segment."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    keys, owners = [], []
    for i in range(3):
        near, every = golay_keys(seg[(i + 1) % 3])
        base = (i << 34) | (seg[i] << 12)
        if probe:
            k = np.where(every < 0, -1, base[:, None] | every).reshape(-1)
            o = np.repeat(fps, every.shape[1])
            keys.append(k[k >= 0])
            owners.append(o[k >= 0])
        else:
            keys.append(base | near)
            owners.append(fps)
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(fps: DataFrame, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k, o = _keys(b.column(0).to_numpy(zero_copy_only=False), probe)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(o)], names=["key", "fp"])

    return fps.mapInArrow(tidy(run, caches=True), "key long, fp long")


def _finer(rows: DataFrame) -> DataFrame:
    """(key, fp): for rows of a crowded key, keys of 43 bits or more of the fingerprint itself.

    The key's exact segment stays. Of the other two either the next is exact too, and a third of the last, as two errors
    leave one of three parts whole; or each has one error at most, which leaves one half of each whole.
    """
    lo, width = (F.array(*[F.lit(s[n]) for s in SEGMENTS]) for n in (0, 1))
    i = F.shiftrightunsigned("key", 34).cast("int")

    def bits(segment, start: int, n: int | None):
        at = F.get(lo, segment) + start
        size = F.get(width, segment) - start if n is None else F.lit(n)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1
        return F.call_function("shiftrightunsigned", F.col("fp"), at).bitwiseAND(mask)

    j, k = (i + 1) % 3, (i + 2) % 3
    thirds = [F.struct(F.lit(n).alias("kind"), bits(j, 0, None).alias("a"), bits(k, 7 * n, 7 if n < 2 else None).alias("b")) for n in range(3)]
    halves = [F.struct(F.lit(3 + 2 * m + n).alias("kind"), bits(j, 11 * m, 11 if m == 0 else None).alias("a"), bits(k, 11 * n, 11 if n == 0 else None).alias("b")) for m in (0, 1) for n in (0, 1)]
    parts = rows.select("fp", F.shiftrightunsigned("key", 12).alias("exact"), F.explode(F.array(*thirds, *halves)).alias("p"))
    return parts.select(F.struct("exact", "p.kind", "p.a", "p.b").alias("key"), "fp").distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """Pairs (src < dst) of distinct values of ``fps.fp`` at ``max_bits`` (at most 2) or fewer differing bits.

    Keys with more than ``crowded`` indexed fingerprints, as a large group of near copies makes them, are left to
    finer keys that miss no pair either, so that no group is compared with itself all over.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    probe, index = _key_rows(fps, True), written(_key_rows(fps, False), "simhash-index")
    hot = written(index.groupBy("key").count().where(F.col("count") > crowded).select("key"), "simhash-crowded")
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(F.col("key").alias("ikey"), F.col("fp").alias("dst"))
        return left.withColumnRenamed("fp", "src").join(right, (F.col("key") == F.col("ikey")) & near).select("src", "dst")

    if hot.isEmpty():
        return met(probe, index).distinct()
    cool = met(probe.join(hot, "key", "left_anti"), index.join(hot, "key", "left_anti"))
    finer = met(_finer(probe.join(hot, "key", "left_semi")), _finer(index.join(hot, "key", "left_semi")))
    return cool.unionByName(finer).distinct()


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (the least id reachable over links).

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows stay repeated; rows that share an id but not a text have one row each. An
    empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    least = written(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-distinct")
    comps = connected_components(links(least.select("fp"), max_bits), "simhash-stars")
    named = least.join(comps, least.fp == comps.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least_id")
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, rk, component): classes over links of at least ``similarity`` between sets of shingles, one row per input row.

    Fingerprints within two bits meet by their Golay keys, all others by the verified banding of ``shingle_dedup``, which
    tells why keys of single errors don't reach that far.
    """
    from .shingle_dedup import near_duplicate_classes as banded

    return banded(docs, id_col, text_col, shingle, similarity)
