"""Benchmark decontamination by winnowing.

Windows of 13 words count as shared. Both sides hash every 7-gram of words and keep,
in each run of seven consecutive 7-grams (13 words), the least hash, the rightmost of
equals. Whether a 7-gram is kept depends on the run alone, so a shared window
gives both sides the same fingerprint at the same place in it: none is missed. An item of
fewer words is one window and is looked up as one n-gram of its own length.

Of the fingerprints of documents, those that a fixed-size bitmap of benchmark
fingerprints can't rule out are joined with the benchmark's, compared word for word
and extended up to six words either way; a match of 13 words or more is a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, tidy, worker_cache, written

WINDOW = 13
GRAM = 7
#: log2 of the bitmap's bits: 2 MB, however many fingerprints the benchmark has.
BITMAP_BITS = 24
#: Bytes of words and hashes that a worker remembers before it starts anew.
CACHE_BYTES = 24 << 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CAND = "struct<kind:int,h:bigint,pos:int,core:string,l:array<string>,r:array<string>>"
_ARROW_CAND = pa.struct(
    [("kind", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("core", pa.string()), ("l", pa.list_(pa.string())), ("r", pa.list_(pa.string()))]
)


class _WordHashes(dict):
    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + 170  # the word, the hash and their place in the table
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive word hashes."""
    if len(h) < n:
        return h[:0]
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the rightmost of equals, in each full window of ``window`` hashes."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    best = np.arange(len(h) - window + 1)
    for i in range(1, window):
        other = np.arange(i, len(h) - window + 1 + i)
        best = np.where(h[other] <= h[best], other, best)
    return np.unique(best)


def _picked(words: list[bytes], kinds: tuple[int, ...], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, hashes, places): kind 0 for winnowed grams, n for every n-gram."""
    h = np.fromiter(map(worker_cache("word-hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    for kind in kinds:
        if kind:
            g = gram_hashes(h, kind)
            yield kind, g, np.arange(len(g))
        elif len(words) >= window:
            g = gram_hashes(h, gram)
            at = winnow(g, window - gram + 1)
            yield 0, g[at], at


def _candidate(words: list[bytes], kind: int, h: int, p: int, window: int, gram: int) -> dict:
    n, around = (kind, 0) if kind else (gram, window - gram)
    text = lambda ws: [w.decode("utf-8", "replace") for w in ws]
    return {
        "kind": kind, "h": h, "pos": p, "core": " ".join(text(words[p : p + n])),
        "l": text(words[max(0, p - around) : p][::-1]), "r": text(words[p + n : p + n + around]),
    }


def _fingerprinted(df: DataFrame, id_col: str, text_col: str, kinds, bitmap, window: int, gram: int) -> DataFrame:
    """(id, rk, n_words, cands): cands of all winnowed fingerprints, or of those that ``bitmap`` lets pass.

    With ``kinds`` None an item of fewer than ``window`` words gives one n-gram of its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for b in batches:
            n_words, cands = [], []
            for t in b.column(2):
                ws = words_of(t.as_py())
                n_words.append(len(ws))
                own = kinds if kinds is not None else (0,) if len(ws) >= window else (len(ws),) if ws else ()
                out = []
                for kind, g, at in _picked(ws, own, window, gram):
                    if bits is not None:
                        keep = bits[(g >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                        g, at = g[keep], at[keep]
                    out += [_candidate(ws, kind, h, p, window, gram) for h, p in zip(g.view(np.int64).tolist(), at.tolist())]
                cands.append(out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(cands, pa.list_(_ARROW_CAND))], names=["id", "rk", "n_words", "cands"]
            )

    kind = dict(df.select(id_col).dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), row_key(text_col).alias("rk"), F.col(text_col))
    return rows.mapInArrow(tidy(run, caches=True), f"id {kind}, rk long, n_words long, cands array<{_CAND}>")


def _bitmap(prints: DataFrame) -> bytes:
    """A bit for the upper BITMAP_BITS bits of each hash; built on the executors, its size doesn't depend on the benchmark's."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    rows = prints.groupBy((slot / 64).cast("long").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) % 64 as int))")).alias("v"))
    got = rows.toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[got["w"].to_numpy()] = got["v"].to_numpy()
    return bits.tobytes()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """(documents, hits).

    documents: (id, rk, n_words), one row per input row, rk telling rows apart that share an
    id. hits: (id, rk, item, first, last): word ranges of the document that lie in occurrences of
    windows of the item. Null and empty texts have no words and no hits; equal rows
    have equal hits; empty tables give empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    item = _fingerprinted(benchmark, item_id, item_text, None, None, window, gram).select(F.col("id").alias("item"), F.explode("cands").alias("c"))
    item = written(item.select("item", "c.kind", "c.h", "c.core", "c.l", "c.r").distinct(), "winnow-items")
    kinds = tuple(sorted(r.kind for r in item.select("kind").distinct().collect()))  # at most ``window`` values
    seen = written(_fingerprinted(docs, doc_id, doc_text, kinds, spark.sparkContext.broadcast(_bitmap(item)), window, gram), "winnow-docs")
    cand = seen.where(F.size("cands") > 0).select("id", "rk", F.explode("cands").alias("c")).select("id", "rk", "c.*")
    it = item.select("item", "kind", "h", "core", F.col("l").alias("il"), F.col("r").alias("ir"))

    def run_length(a: str, b: str):
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        miss = F.array_position(same, F.lit(False))
        return F.when(miss > 0, miss - 1).otherwise(F.size(same)).cast("int")

    met = cand.join(it, ["kind", "h", "core"]).withColumns({"a": run_length("l", "il"), "b": run_length("r", "ir")})
    length = F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.lit(gram))
    hits = met.where((F.col("kind") > 0) | (F.col("a") + F.col("b") + gram >= window)).select(
        "id", "rk", "item", (F.col("pos") - F.col("a")).alias("first"), (F.col("pos") + length - 1 + F.col("b")).alias("last")
    )
    return seen.select("id", "rk", "n_words"), hits


def judged(documents: DataFrame, hits: DataFrame, share: int = 20) -> DataFrame:
    """Per document row: id, rk, n_words, n_hit, items (sorted as strings), contaminated (hit words are at least 1/share of all)."""
    hits = written(hits.distinct(), "winnow-hits")
    reach = F.max("last").over(Window.partitionBy("id", "rk").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("id", "rk", "first", "last").distinct()
    covered = spans.withColumn("from", F.greatest("first", F.coalesce(reach + 1, "first"))).groupBy("id", "rk")
    n_hit = covered.agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.col("from") + 1)).alias("n_hit"))
    items = hits.groupBy("id", "rk").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    found = n_hit.join(items, ["id", "rk"])
    same = documents.id.eqNullSafe(found.id) & (documents.rk == found.rk)
    n = F.coalesce(found.n_hit, F.lit(0)).cast("long")
    return documents.join(found, same, "left").select(
        documents.id, documents.rk, "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n > 0) & (share * n >= F.col("n_words"))).alias("contaminated"),
    )
