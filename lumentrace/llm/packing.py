"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by hash to
shards of bounded size; each shard is packed by several islands, which start from
best-fit orders of their own. A crossover injects whole well-filled bins of a donor into a
receiver, drops the receiver's bins that hold the same pieces and best-fits the pieces
displaced by that. After each epoch an island's elite migrates to all islands of its shard. A
shard stops once it meets a lower bound on the number of bins, which plain best fit often does already. Pieces in
poorly filled bins go on to the next level's fewer shards, so that the waste of shards meets.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, named, tidy, whole, worker_cache, written

CAPACITY = 4096
#: Pieces in a shard, on average; they are dealt by hash, so that no key makes a shard larger.
SHARD = 8192
ISLANDS = 2
EPOCHS = 3
POPULATION = 6
GENERATIONS = 8
#: Levels at most; what the last one leaves poorly filled stays so.
LEVELS = 6
#: Bins filled less than this go to the next level.
WELL_FILLED = 0.98
#: Bytes of words and ids that a worker remembers: half of them words met of late, half those met before.
CACHE_BYTES = 48 << 20


class _Tokens:
    """Ids of a text as little-endian 32-bit bytes, exactly those of the tokenizer.

    Where the tokenizer lower-cases, splits by the given pattern and then
    encodes each word by itself, and the text has only characters on whose class and case all
    Unicode versions agree, words are encoded once and remembered. Any other text
    goes through the tokenizer as a whole.
    """

    #: The split pattern for which the shortcut is known to be exact.
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    UNSAFE = re.compile(r"[^\t-\r -~¡-ÿ]|<\|")
    #: SPLIT over the lower-cased characters that are left.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")

    def __init__(self, spec: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        d = json.loads(spec)
        steps = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [n.get("type") for n in (d.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": self.SPLIT} and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True and norms == ["NFC", "Replace", "Lowercase"] and d["model"].get("dropout") is None and not d.get("post_processor")
        )
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.model = self.tokenizer.model
        self.known = _WordIds(self._model_ids if self.by_word and steps[1:] == [bytewise] else self._ids)

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _model_ids(self, word: str) -> list[int]:
        """The same for a word that is split and lower-cased already: only the model is left to run, on the bytes' characters."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(_BYTE_CHARS.__getitem__, word.encode())))]

    def __call__(self, text: str) -> bytes:
        if not self.by_word or self.UNSAFE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, self.WORDS.findall(text.lower())))


#: The character that stands for each byte: itself if it can be seen, else the next from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SEEN}))}


class _WordIds(dict):
    """A word's ids as bytes, encoded where first met. Once full, words that aren't met again go."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before, self.size = encode, {}, 0

    def __missing__(self, word: str) -> bytes:
        got = self.before.pop(word, None)
        if got is None:
            ids = self.encode(word)
            got = struct.pack(f"<{len(ids)}I", *ids)
        self.size += len(word) + len(got) + 180  # the word, its ids and their place in the table
        if self.size > CACHE_BYTES // 2:
            self.before = dict(self)
            self.clear()
            self.size = 0
        self[word] = got
        return got


def _tokens(spec: str) -> _Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(f"tokens-{zlib.crc32(spec.encode())}", lambda: _Tokens(spec))


def pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = True
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) per piece of each row's ids followed by ``end_id``.

    A null text counts as empty: one piece with ``end_id`` alone. Repeated rows give
    repeated pieces; other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokens(spec.value)
        for b in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                got = encode(t.as_py() or "") + end
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[at : at + 4 * capacity]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run, caches=True), schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins needed at least: for each threshold k, pieces above capacity-k share no bin with those of k or more."""
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    k = np.arange(capacity // 2 + 1)
    large = count[-1] - count[capacity - k + 1]
    half = capacity // 2 + 1
    middle = count[capacity - k + 1] - count[half]
    middle_mass = mass[capacity - k + 1] - mass[half]
    small_mass = mass[half] - mass[k]
    extra = np.maximum(0, -(-(small_mass - (middle * capacity - middle_mass)) // capacity))
    return int((large + middle + extra).max())


def best_fit(lengths: list[int], order: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Puts the pieces of ``order``, in turn, into the fullest bin that has room; the rooms are a bit set."""
    bins = [list(b) for b in bins or []]
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, b in enumerate(bins):
        room = capacity - sum(lengths[x] for x in b)
        by_room[room].append(i)
        rooms |= 1 << room
    for x in order:
        need = lengths[x]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            own = by_room[room]
            at = own.pop()
            if not own:
                rooms ^= 1 << room
            bins[at].append(x)
        else:
            at, room = len(bins), capacity
            bins.append([x])
        by_room[room - need].append(at)
        rooms |= 1 << (room - need)
    return bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among as many bins, unequal fills."""
    return -len(bins), sum((sum(lengths[x] for x in b) / capacity) ** 2 for b in bins)


def crossover(receiver: list[list[int]], donor: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A share of the donor's well-filled bins, the receiver's bins without pieces of these, and the rest best-fitted.

    Of the receiver's poorly filled bins the emptiest are dealt anew too (mutation). The displaced go by falling
    length, more or less strictly: strictly they would meet in the same bins again.
    """
    fill = lambda b: sum(lengths[x] for x in b)
    well = WELL_FILLED * capacity
    share, again, loose = rng.choice((0.3, 0.6, 0.9)), rng.choice((0.05, 0.1, 0.25)), rng.choice((0.0, 0.2, 0.5))
    injected = [b for b in donor if fill(b) >= well and rng.random() < share]
    taken = {x for b in injected for x in b}
    free = [b for b in receiver if taken.isdisjoint(b)]
    poor = sorted((i for i, b in enumerate(free) if fill(b) < well), key=lambda i: fill(free[i]))[: 1 + int(len(free) * again)]
    displaced = [x for b in receiver if not taken.isdisjoint(b) for x in b if x not in taken] + [x for i in poor for x in free[i]]
    anew = set(poor)
    kept = [b for i, b in enumerate(free) if i not in anew]
    return best_fit(lengths, sorted(displaced, key=lambda x: -lengths[x] * rng.uniform(1 - loose, 1 + loose)), capacity, injected + kept)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[int]], generations: int, population: int) -> tuple[list[int], int]:
    """(the best assignment found: a bin number for each piece, generations that ran), from ``elites`` or from best-fit starts; lengths fall.

    Best fit in falling order is among the starts, so no result is worse.
    """
    rng = random.Random(seed)
    floor = lower_bound(np.asarray(lengths, np.int64), capacity)
    key = lambda bins: fitness(bins, lengths, capacity)
    people: list[list[list[int]]] = []
    for genes in elites:
        bins: list[list[int]] = [[] for _ in range(max(genes, default=-1) + 1)]
        for x, at in enumerate(genes):
            bins[at].append(x)
        people.append(bins)
    if not people:
        people.append(best_fit(lengths, list(range(len(lengths))), capacity))
    ran = 0
    if max(map(len, people), default=0) > floor:
        while len(people) < population:
            noisy = sorted(range(len(lengths)), key=lambda x: -lengths[x] * rng.uniform(0.8, 1.2))
            people.append(best_fit(lengths, noisy, capacity))
        people.sort(key=key, reverse=True)
        while ran < generations and len(people[0]) > floor:
            a, b = rng.sample(people, 2)
            children = [crossover(people[0], b, lengths, capacity, rng), crossover(a, people[0], lengths, capacity, rng)]
            people, ran = sorted(people + children, key=key, reverse=True)[:population], ran + 1
    best = people[0] if ran else max(people, key=key)
    genes = [0] * len(lengths)
    for at, b in enumerate(best):
        for x in b:
            genes[x] = at
    return genes, ran


def _epoch(shards: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """(shard, island, n_bins, floor, generations, genes) from rows (shard, island, lengths, elites)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = [evolve(r["lengths"], capacity, r["shard"] * 1009 + r["island"] * 31 + epoch, r["elites"], GENERATIONS, POPULATION) for r in rows]
            floor = [lower_bound(np.asarray(r["lengths"], np.int64), capacity) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([max(g) + 1 for g, _ in out], pa.int32()), pa.array(floor, pa.int32()), pa.array([n for _, n in out], pa.int32()), pa.array([g for g, _ in out], pa.list_(pa.int32()))],
                names=["shard", "island", "n_bins", "floor", "generations", "genes"],
            )

    return shards.select("shard", "island", "lengths", "elites").mapInArrow(tidy(run), "shard long, island int, n_bins int, floor int, generations int, genes array<int>")


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length", shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, told: list[DataFrame] | None = None) -> DataFrame:
    """``rows`` with sequence_id and offset: rows of one sequence lie gapless from 0 and end at ``capacity`` at most.

    Every row is packed once, repeated rows each by itself; lengths must be from 0 to
    ``capacity``. Columns must be orderable and may have any names but sequence_id and offset. An empty table gives an empty result.
    ``told`` gets, by level, a table (level, shard, best_fit, n_bins, floor, generations, migrations): bins of the first
    epoch's plain best fit, of the result, of the lower bound, and the work of all islands on it.
    """
    rest, done, level, before = rows.select(whole(rows), named(length_col).cast("int").alias("length")), [], 0, None
    while True:
        n = -(-rest.count() // shard)
        if n == 0 and done:
            break
        n = max(1, n)
        last = n == 1 or n == before or level == LEVELS - 1
        # equal rows would all meet in one shard: their number within a task spreads them
        dealt = F.pmod(F.xxhash64("row", F.lit(level)) + F.monotonically_increasing_id(), F.lit(n))
        shards = written(
            rest.select(dealt.alias("shard"), F.struct((-F.col("length")).alias("neg"), "row").alias("item")).groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items")), "pack-shards"
        ).repartition(min(n, 2000), "shard")
        lengths = F.transform("items", lambda x: (-x["neg"]).cast("int")).alias("lengths")
        lots = shards.select("shard", lengths).select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "lengths")
        state, solved, work = lots.withColumn("elites", F.array().cast("array<array<int>>")), [], []
        for epoch in range(epochs):
            got = written(_epoch(state.repartition(min(n * islands, 2000), "shard", "island"), capacity, epoch), "pack-elites")
            best = got.groupBy("shard").agg(F.min_by("genes", F.struct("n_bins", "island")).alias("genes"), F.min("n_bins").alias("n_bins"), F.max("floor").alias("floor"))
            work.append(got.select("shard", F.lit(epoch).alias("epoch"), "island", "n_bins", "floor", "generations"))
            open_ = best.where("n_bins > floor").select("shard")
            if epoch + 1 == epochs or open_.isEmpty():
                solved.append(best)
                break
            solved.append(best.where("n_bins <= floor"))
            elites = got.join(open_, "shard", "left_semi").groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_bins", "island", "genes"))), lambda x: x["genes"]).alias("elites"))
            state = lots.join(elites, "shard")
        if told is not None:
            told.append(_told(_all(work), shards.select("shard", lengths), level, capacity))
        packed = shards.join(_all(solved).select("shard", "genes"), "shard").select("shard", F.explode(F.arrays_zip("items", "genes")).alias("z"))
        packed = packed.select("shard", F.col("z.genes").alias("bin"), F.col("z.items.row").alias("row"), (-F.col("z.items.neg")).alias("length"))
        packed = written(_offsets(packed, level), "pack-level")
        if last:
            done.append(packed)
            break
        full = F.col("fill") >= int(WELL_FILLED * capacity)
        done.append(packed.where(full))
        rest, level, before = packed.where(~full).select("row", "length"), level + 1, n
    return _all(done).select(*[field(rows, c) for c in rows.columns], "sequence_id", "offset")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _told(work: DataFrame, shards: DataFrame, level: int, capacity: int) -> DataFrame:
    """What each shard's islands did; plain best fit is worked out again for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(best_fit(x, list(range(len(x))), capacity)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["shard", "best_fit"])

    least = F.min_by("n_bins", F.struct(-F.col("epoch"), "n_bins"))
    ran = work.groupBy("shard").agg(least.alias("n_bins"), F.max("floor").alias("floor"), F.sum("generations").alias("generations"), F.max("epoch").alias("migrations"))
    return ran.join(shards.mapInArrow(tidy(run), "shard long, best_fit int"), "shard").select(F.lit(level).alias("level"), "shard", "best_fit", "n_bins", "floor", "generations", "migrations")


def _offsets(packed: DataFrame, level: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("shard", "bin")
    order = w.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select(
        "row", "length",
        (F.lit(level) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin")).cast("long").alias("sequence_id"),
        F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"),
        F.sum("length").over(w).cast("long").alias("fill"),
    )
