"""Letter statistics for cryptanalysis (CRK-04..06, CRK-11), none of which leaves its row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import let

#: Share of each letter in English, in per cent.
LETTER_SHARE = dict(
    zip(
        "abcdefghijklmnopqrstuvwxyz",
        (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074),
    )
)
#: English digraphs per 10,000, in falling order but for the last two.
DIGRAPH_SHARE = {
    "th": 307, "he": 269, "in": 225, "er": 204, "an": 197, "re": 171, "on": 159, "at": 147, "en": 144, "nd": 139, "ti": 138, "es": 134, "or": 131,
    "te": 128, "of": 125, "ed": 120, "is": 116, "it": 113, "al": 110, "ar": 108, "st": 105, "to": 104, "nt": 102, "ng": 99, "se": 98, "ha": 98,
    "as": 96, "ou": 94, "io": 91, "le": 89, "ve": 87, "co": 86, "me": 84, "de": 82, "hi": 80, "ri": 79, "ro": 79, "ic": 78, "ne": 76, "ea": 74,
    "ra": 73, "ce": 72, "li": 71, "ch": 69, "ll": 68, "be": 67, "ma": 66, "si": 65, "om": 64, "ur": 63, "ca": 62, "el": 61, "ta": 60, "la": 59,
    "ns": 58, "di": 58, "fo": 58, "ho": 57, "pe": 57, "ec": 56, "pr": 56, "no": 55, "ct": 55, "us": 55, "ac": 52, "od": 51, "cc": 51, "tr": 50,
    "il": 50, "ly": 50, "nc": 49, "ut": 49, "ru": 48, "em": 48, "lu": 47, "bo": 47, "yo": 46, "so": 46, "op": 45, "na": 43, "pa": 42, "do": 41,
    "im": 40, "ba": 40, "wa": 39, "ge": 39, "sa": 38, "sl": 38, "cr": 37, "su": 37, "sp": 37, "fi": 35, "cl": 35, "ft": 33, "oi": 33, "am": 32,
    "ry": 31, "mt": 29, "tt": 29, "wh": 29, "id": 28, "wn": 27, "ke": 27, "da": 27, "rd": 26, "pl": 26, "fe": 25, "ds": 25, "pi": 25, "gr": 25,
    "ck": 25, "wr": 25, "nf": 25, "mp": 24, "po": 24, "um": 24, "mu": 24, "ap": 24, "ay": 24, "gh": 24, "gl": 23, "ia": 23, "ty": 23, "ss": 23,
    "ad": 22, "lo": 22, "sh": 22, "vi": 22, "ko": 21, "mo": 44, "wo": 43,
}
FLOOR_SHARE, FEW_PAIRS, NO_SCORE = 0.8, 8, 1e9


def letter_counts(text: Column) -> Column:
    """Counts of a to z, in either case, as an array."""
    only = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return let(only, lambda t: F.array(*[F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in LETTER_SHARE]))


def chi_squared(text: Column) -> Column:
    """Distance of the letters from English ones; 1e9 without letters (CRK-04)."""
    shares = F.array(*[F.lit(v) for v in LETTER_SHARE.values()])

    def distance(c: Column) -> Column:
        part = lambda o, e: F.pow(o - e / 100 * c["n"], F.lit(2)) / (e / 100 * c["n"])
        return F.when(c["n"] > 0, F.aggregate(F.zip_with(c["k"], shares, part), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(NO_SCORE))

    return let(let(letter_counts(text), lambda k: F.struct(k.alias("k"), F.aggregate(k, F.lit(0), lambda s, x: s + x).alias("n"))), distance)


def index_of_coincidence(text: Column) -> Column:
    """Chance that two letters of the text are equal (CRK-05)."""

    def chance(k: Column) -> Column:
        n = F.aggregate(k, F.lit(0).cast("long"), lambda s, x: s + x)
        same = F.aggregate(k, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * (x - 1))
        return F.when(n > 1, same / (n * (n - 1))).otherwise(F.lit(0.0))

    return let(letter_counts(text), chance)


_SHARES = np.array([DIGRAPH_SHARE.get(a + b, FLOOR_SHARE) for a in LETTER_SHARE for b in LETTER_SHARE])


def _numbers(low: str) -> np.ndarray:
    """Characters of a lower-cased text from 0 for a; what isn't a to z lies outside 0 to 25."""
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) - 97


def _digraph_distance(low: str | None) -> float:
    at = _numbers(low or "")
    good = (at >= 0) & (at < 26)
    both = good[:-1] & good[1:]
    counts = np.bincount((at[:-1] * 26 + at[1:])[both], minlength=676)
    n = int(counts.sum())
    if n < FEW_PAIRS:
        return NO_SCORE
    expected = _SHARES / 10000 * n
    return float(((counts - expected) ** 2 / expected)[counts > 0].sum())


def digraph_chi_squared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, score): distance of the letter pairs from English ones over those that occur; 1e9 for fewer than eight (CRK-11). Pairs are counted in the row, in Arrow batches."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return s.map(_digraph_distance).astype("float64")

    return df.select(F.col(id_col), score(F.lower(F.col(text_col))).alias("score"))


def _period(low: str | None, longest: int) -> int | None:
    at = _numbers(low or "")
    at = at[(at >= 0) & (at < 26)]
    if len(at) < 100:
        return None
    ic = {}
    for n in range(2, longest + 1):
        k = np.bincount(np.arange(len(at)) % n * 26 + at, minlength=26 * n).reshape(n, 26)
        m = k.sum(1)
        ic[n] = float((((k * (k - 1)).sum(1))[m > 1] / (m * (m - 1))[m > 1]).sum()) / n
    top = max(ic, key=ic.get)
    if ic[top] < 0.058 or ic[top] - sum(ic.values()) / len(ic) < 0.01:
        return None
    return next((n for n in range(2, top) if top % n == 0 and ic[n] >= 0.85 * ic[top]), top)


def key_length(df: DataFrame, id_col: str, text_col: str, longest: int = 12) -> DataFrame:
    """(id, key_length or null): the period at which columns of letters look like a language (CRK-06), worked out in the row.

    Needs 100 letters, a mean coincidence of 0.058 and 0.01 above the mean over all periods; the least divisor that reaches 0.85 of the best wins.
    """

    @F.pandas_udf("int")
    def period(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _period(t, longest)).astype("Int32")

    return df.select(F.col(id_col), period(F.lower(F.col(text_col))).alias("key_length"))
