"""Spelling variants: all pairs of words one edit apart, by merging the subtrees of an errata trie, and the form that each word goes back to.

The words' trie is cut into heavy paths: of each node's children one, its heavy child, goes on the node's path and the others are
light. A light subtree is merged into its neighbours with one character in error: each of its words goes once more, with the
character at the node replaced by the heavy child's, once with it skipped, and once with the heavy child's put before it. Two
words are one edit apart exactly where such words coincide with a word of the trie or, replaced, with each other. Only light subtrees are merged, never heavy ones,
and a word lies in at most log2 of all words light subtrees, so that is how often it is written at most, whatever its length.

The sorted words are cut at splitters into blocks, one task's work each. A node that splitters pass through takes the child with
most of them for its heavy one, so all blocks agree; any other node lies in one block.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named, tidy, written

#: Words of a block, on average, and splitters at most: beyond BLOCK * SPLITTERS words the blocks grow.
BLOCK, SPLITTERS = 8_192, 1 << 16
#: Splitters are taken of a sample so many times as large, for even blocks.
SAMPLE_TIMES = 8
#: Distinct words gathered in a task before their counts go on; rows of a batch of results.
HELD_WORDS, BATCH = 200_000, 50_000
#: Runs of letters, after A to Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, typo_every: int | None = None) -> DataFrame:
    """(word, n): letter runs of all whole texts, A to Z lower-cased, of ``min_length`` code points and ``min_count`` occurrences at least.

    With ``typo_every`` one in so many (document, run) loses a code point first, chosen by the crc32 of ``<id>:<run>``; a null id
    counts as empty. A null or empty text has no words; every row counts, repeated ones too; an empty table has no words. Counts
    are summed within tasks before they are shuffled.
    """
    rows = docs.select(named(id_col).cast("string").alias("id"), named(text_col).alias("text"))
    runs = re.compile(LETTERS)

    def told(held: Counter) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                found = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))
                if typo_every:
                    start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), start)
                        if h % typo_every == 0:
                            cut = h % len(w)
                            w = w[:cut] + w[cut + 1 :]
                        if len(w) >= min_length:
                            held[w] += n
                else:
                    held.update({w: n for w, n in found.items() if len(w) >= min_length})
                if len(held) > HELD_WORDS:
                    yield from told(held)
                    held.clear()
        yield from told(held)

    counts = rows.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def common(a: str, b: str) -> int:
    """Characters that two words have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class SplitterPath:
    """The heavy children along a splitter: that of most splitters below each node, the least character where they are as many."""

    def __init__(self, at: int, splitters: list[str]):
        self.word = splitters[at]
        self.other: dict[int, str] = {}
        lo, hi, depth = 0, len(splitters), 0
        while depth < len(self.word) and hi - lo > 1:
            longer = [s[depth] for s in splitters[lo:hi] if len(s) > depth]
            most = Counter(longer)
            best = min(most, key=lambda c: (-most[c], c))
            if best != self.word[depth]:
                self.other[depth] = best
            depth += 1
            step = self.word[:depth]
            below = [i for i in range(lo, hi) if splitters[i].startswith(step)]
            lo, hi = below[0], below[-1] + 1

    def heavy(self, depth: int) -> str | None:
        return self.other.get(depth, self.word[depth]) if depth < len(self.word) else None


def light_edges(words: list[str], paths: list[SplitterPath]) -> Iterator[tuple[int, int, int, str]]:
    """(first, end, depth, heavy character) of the light subtrees of a block's sorted distinct words: ranges of words with their node's depth.

    A word that ends at a node with children is a light subtree of its own there.
    """
    lcp = [0] + [common(a, b) for a, b in zip(words, words[1:])]
    reach = [[common(w, p.word) for w in words] for p in paths]

    def given(i: int, depth: int) -> str | None:
        """The heavy character at word ``i``'s node of a depth where splitters pass through it."""
        for p, far in zip(paths, reach):
            if far[i] >= depth and depth < len(p.word):
                return p.heavy(depth)
        return None

    stack = [(0, len(words), 0)] if words else []
    while stack:
        lo, hi, top = stack.pop()
        low = min(lcp[lo + 1 : hi]) if hi - lo > 1 else len(words[lo])
        far = max([-1, *(r[lo] for r in reach)])
        for depth in range(top, min(low, far + 1)):  # nodes with one child here
            heavy = given(lo, depth)
            if heavy is not None and heavy != words[lo][depth]:
                yield lo, hi, depth, heavy
        cuts = [lo, *(i for i in range(lo + 1, hi) if lcp[i] == low), hi]
        heavy = given(lo, low)
        parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if len(words[a]) > low]
        if heavy is None and parts:
            a, _ = max(parts, key=lambda p: p[1] - p[0])
            heavy = words[a][low]
        if heavy is None:
            continue
        if len(words[lo]) == low:
            yield lo, lo + 1, low, heavy
        for a, b in parts:
            if words[a][low] != heavy:
                yield a, b, low, heavy
            stack.append((a, b, low + 1))


def _merged_words(word: str, depth: int, heavy: str) -> Iterator[tuple[str, int]]:
    """(word with one error, depth where a character was replaced or else -1) of a light subtree's word; of equal neighbours the last is skipped."""
    head, tail = word[:depth], word[depth:]
    yield head + heavy + tail, -1
    if tail:
        rest = tail[1:]
        yield head + heavy + rest, depth
        if not rest or rest[0] != tail[0]:
            yield head + rest, -1


def merged(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(target, at, word, n): every word of a light subtree with one character replaced (at its place ``at``), skipped or put before (-1).

    words: (word, n), distinct, of a written table.
    """
    total = words.count()
    size = max(block, -(-total // SPLITTERS))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(size)) < min(SAMPLE_TIMES, size)).select("word").collect() if total > size else []
    splitters = sorted(r.word for r in sample)[SAMPLE_TIMES - 1 :: SAMPLE_TIMES]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(splitters, w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=["word", "n", "block"])

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("word")
        own, counts, at = table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("block")[0].as_py()
        paths = [SplitterPath(i, splitters) for i in (at - 1, at) if 0 <= i < len(splitters)]
        held: list[tuple[str, int, str, int]] = []
        for lo, hi, depth, heavy in light_edges(own, paths):
            for i in range(lo, hi):
                held += [(t, place, own[i], counts[i]) for t, place in _merged_words(own[i], depth, heavy)]
            if len(held) >= BATCH:
                yield _batch(held)
                held = []
        yield _batch(held)

    dealt = words.select("word", "n").mapInArrow(tidy(deal), "word string, n long, block int")

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(table))

    return dealt.groupBy("block").applyInArrow(whole, "target string, at int, word string, n long")


def _batch(rows: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["target", "at", "word", "n"])


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best struct(less = -n, word)): how many words are one edit away, and the most frequent of them; words with one at least.

    words: (word, n), distinct, of a written table. Words that share all but one character in the same place are told to each other as a group, of an alphabet's size at
    most, so no pairs of a group are made.
    """
    keys = written(merged(words, block), "errata-merged")
    rank = lambda n, w: F.struct((-F.col(n)).alias("less"), F.col(w).alias("word"))
    known = words.select(F.col("word").alias("target"), F.col("n").alias("m"))
    groups = keys.where("at >= 0").groupBy("target", "at").agg(F.collect_list(rank("n", "word")).alias("own"))
    groups = groups.join(known, "target", "left")
    heavy = F.when(F.col("m").isNotNull(), F.array(F.struct((-F.col("m")).alias("less"), F.col("target").alias("word")))).otherwise(F.array().cast("array<struct<less:bigint,word:string>>"))
    groups = groups.select(F.array_sort(F.concat("own", heavy)).alias("g")).where(F.size("g") > 1)
    replaced = groups.select(F.explode("g").alias("x"), F.col("g")[0].alias("a"), F.col("g")[1].alias("b"), (F.size("g") - 1).cast("long").alias("k"))
    replaced = replaced.select(F.col("x.word").alias("word"), "k", F.when(F.col("x.word") == F.col("a.word"), F.col("b")).otherwise(F.col("a")).alias("best"))
    met = keys.where("at < 0").select("target", "word", "n").join(known, "target")
    ends = F.explode(F.array(F.struct(F.col("word"), rank("m", "target").alias("best")), F.struct(F.col("target").alias("word"), rank("n", "word").alias("best")))).alias("e")
    longer = met.select(ends).select("e.word", F.lit(1).cast("long").alias("k"), "e.best")
    return replaced.unionByName(longer).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. A form is at least twice as frequent, so chains are short and have an end; steps double every round."""
    now = written(forms.select("word", F.col("form").alias("root")), "errata-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "errata-roots")
        now = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the near word that it is a variant of, if any.

    words: (word, n); a word that stands in several rows counts with their sum. Near are two words one inserted, deleted or replaced
    code point apart. The form is the near word of the largest n, on ties the first by code points, if that n is ``ratio`` times the word's own at least, else
    null; the root is where forms lead. Without near words n_near is 0, without words the result is empty; null words take no part.
    """
    if ratio < 2:
        raise ValueError("forms could lead in circles")
    words = written(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "errata-words")
    told = words.join(near(words, block), "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    told = written(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "errata-forms"
    )
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def members(told: DataFrame) -> DataFrame:
    """(root, n_words, n, variants): each group of two words or more, its variants by frequency; a root's group is as large as its variants are many."""
    w = Window.partitionBy("root")
    rows = told.withColumn("n_words", F.count("*").over(w)).where("n_words > 1")
    return rows.groupBy("root").agg(F.max("n_words").alias("n_words"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("g")).select(
        "root", "n_words", "n", F.transform("g", lambda x: x["word"]).alias("variants")
    )
