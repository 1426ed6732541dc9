"""Frequent grams of any number of texts without a shuffle of all grams: bounded counters that merge, then exact counts of what they leave (SRC-11, LNG-06)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counters of a task and of the whole.
COUNTERS = 50_000
_WORDS, _LETTERS = re.compile(r"[a-z0-9']+"), re.compile(r"(?=([a-z]{2}))")


def word_pairs(text: str) -> Iterable[str]:
    """Neighbouring words of letters, digits and apostrophes, joined by a blank."""
    t = _WORDS.findall(text.lower())
    return map(" ".join, zip(t, t[1:]))


def letter_pairs(text: str) -> Iterable[str]:
    """Neighbouring letters of a to z."""
    return _LETTERS.findall(text.lower())


def lessen(held: Counter, most: int) -> int:
    """Leaves at most ``most`` counters: all lose what the next one has. Returns what they lost, by which no count is too small by more."""
    if len(held) <= most:
        return 0
    least = sorted(held.values(), reverse=True)[most]
    for gram in [g for g, n in held.items() if n <= least]:
        del held[gram]
    for gram in held:
        held[gram] -= least
    return least


def _counted(df: DataFrame, text_col: str, grams: Callable[[str], Iterable[str]], most: int) -> DataFrame:
    """(gram, n, total) by task: ``most`` counters at most, and once, for gram null, the number of all grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        total = 0
        for b in batches:
            for t in b.column(0):
                held.update(grams(t.as_py() or ""))
                if len(held) > 2 * most:
                    lost = held.total()
                    lessen(held, most)
                    total += lost - held.total()
        lost = held.total()
        lessen(held, most)
        total += lost
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), total], pa.int64())], names=["gram", "n"])

    return df.select(text_col).mapInArrow(run, "gram string, n long")


def frequent(df: DataFrame, text_col: str, share: int = 1_000, grams: Callable[[str], Iterable[str]] = word_pairs, counters: int = COUNTERS) -> DataFrame:
    """(gram, n): exactly the grams of which more than one in ``share`` is, with their exact counts.

    Each task keeps ``counters`` counters at most (no fewer than twice ``share``), so that is all that is shuffled; what they leave is counted anew. All counters
    together lose no more than one in ``counters`` of all grams, so what is left of a frequent gram is more than one in 2 * ``share``: it is among
    the largest ``counters`` ones. Null texts have no grams; an empty table gives an empty result.
    """
    if counters < 2 * share:
        raise ValueError("twice as many counters as one in so many grams has")
    summed = _counted(df, text_col, grams, counters).groupBy("gram").agg(F.sum("n").alias("n"))
    total = summed.where("gram is null").select("n").first()
    total = 0 if total is None else total.n
    left = summed.where("gram is not null").orderBy(F.desc("n"), "gram").limit(counters)
    names = frozenset(left.toArrow()["gram"].to_pylist())
    held = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                got.update(g for g in grams(t.as_py() or "") if g in held.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["gram", "n"])

    exact = df.select(text_col).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return exact.where(F.col("n") * share > total)


def glossary(entries: DataFrame, most: int = 5) -> DataFrame:
    """(word, meaning): entries (word, meaning, popularity) merged, the ``most`` most popular meanings of a word joined by semicolons.

    Equal meanings of a word count once, with their highest popularity; ties go by text. Meanings are cut to ``most`` before they are gathered, so a
    word with very many entries gathers no more than these. Null words and meanings take no part.
    """
    best = entries.where("word is not null and meaning is not null").groupBy("word", "meaning").agg(F.max("popularity").alias("p"))
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(F.desc_nulls_last("p"), "meaning"))).where(F.col("k") <= most)
    return ranked.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "meaning"))), lambda x: x["meaning"]), "; ").alias("meaning"))
