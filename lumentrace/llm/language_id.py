"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with single spaces for everything between them, as UTF-16 units. Four-grams are
counted per language over all training texts; the lower orders are the counts of their distinct
continuations. Each order's table is held in a sorted array of the grams themselves, which fit into
64 bits, so no two grams share a count and a table grows with the distinct grams of the corpus. For every gram that any language
has, the interpolated probabilities of all languages are worked out beforehand; a gram that
none has takes its context's back-off weight and the next shorter gram.

The language of the lowest cross-entropy per character wins. Rejection is calibrated on texts whose grams aren't counted, one in
``CALIBRATION_MOD`` by a hash of id and text: a text is marked rejected if its cross-entropy lies above
that of all but ``REJECT`` of them in the language, with some room for few texts; ``score`` is the probability among the languages at a fixed temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

ORDER = 4
#: One in so many texts calibrates rejection and isn't counted, but where a language would be left without counts; their number grows with the corpus.
CALIBRATION_MOD = 32
#: Share of a language's own texts that calibration lets be rejected, and nats added to its limit.
REJECT, ROOM = 0.005, 0.1
#: Characters that the softmax counts as independent.
TEMPERATURE = 20.0
#: Characters of texts worked on at once.
CHUNK = 1 << 20

_letters: tuple[np.ndarray, np.ndarray] | None = None


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and whether it belongs to a word, as marks do too."""
    global _letters
    if _letters is None:
        import unicodedata

        kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        _letters = np.array([k == "L" for k in kinds]), np.array([k in "LM" for k in kinds])
    return _letters


def units(text: str | None) -> np.ndarray:
    """The text's units: letters and marks, one space for each run of others, ORDER - 1 spaces before and one after; empty without letters."""
    low = (text or "").lower()
    raw = np.frombuffer(low.encode("utf-16-le", "surrogatepass"), "<u2")
    letters, words = _letter_tables()
    half = (raw >= 0xD800) & (raw < 0xE000)
    ok = words[raw]
    if not half.any():
        if not letters[raw].any():
            return np.zeros(0, np.uint64)
    else:
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
        if not letters[points].any():
            return np.zeros(0, np.uint64)
        ok = np.repeat(words[points], np.where(points > 0xFFFF, 2, 1))
    body = np.where(ok, raw, 32)
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    pad = np.full(ORDER - 1, 32, np.uint64)
    body = body[keep].astype(np.uint64)
    return np.concatenate([pad, body] + [pad[:1]] * bool(body[-1] != 32))


def _packed(u: np.ndarray) -> np.ndarray:
    """Each place's four-gram as one integer, 16 bits a unit, the last unit lowest."""
    n = len(u) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    k = np.zeros(n, np.uint64)
    for i in range(ORDER):
        k = k << np.uint64(16) | u[i : i + n]
    return k


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, k long, c long): four-gram counts over the whole texts of all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: str) -> None:
            k, c = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in sums:
                k0, c0 = sums[lang]
                k, at = np.unique(np.concatenate([k0, k]), return_inverse=True)
                c = np.bincount(at, np.concatenate([c0, c]), len(k)).astype(np.int64)
            sums[lang] = k, c

        def rows(lang: str) -> pa.RecordBatch:
            k, c = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "k", "c"])

        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist()):
                k = _packed(units(t.as_py()))
                if len(k):
                    held.setdefault(lang, []).append(k)
                    if sum(map(len, held[lang])) > CHUNK or len(held[lang]) > 4096:
                        fold(lang)
                        if len(sums[lang][0]) > 4 * CHUNK:
                            yield rows(lang)
        for lang in list(held):
            fold(lang)
        for lang in list(sums):
            yield rows(lang)

    got = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(tidy(run), "lang string, k long, c long")
    return got.groupBy("lang", "k").agg(F.sum("c").alias("c"))


@dataclass
class Tables:
    """Sorted grams with natural logarithms [entry, language]: probabilities by order, back-off weights by context length."""

    langs: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    backoff: dict[int, tuple[np.ndarray, np.ndarray]]
    limits: np.ndarray


def _counted(table: DataFrame, langs: list[str]):
    """Counts of one order's grams, and its contexts' totals and kinds."""
    grams = table.select("lang", "k", "c").toArrow()
    contexts = table.groupBy("lang", F.shiftrightunsigned("k", 16).alias("x")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()

    def grid(t: pa.Table, at: str, *cols: str):
        where, inv = np.unique(t[at].to_numpy().view(np.uint64), return_inverse=True)
        lang = np.zeros(len(inv), np.int64)
        for i, name in enumerate(langs):
            lang[pc.equal(t["lang"], name).to_numpy()] = i
        out = []
        for c in cols:
            m = np.zeros((len(where), len(langs)))
            m[inv, lang] = t[c].to_numpy()
            out.append(m)
        return where, out

    key, (c,) = grid(grams, "k", "c")
    x, (total, kinds) = grid(contexts, "x", "c", "n")
    return c, key, x, total, kinds


def _at(where: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(where, wanted), max(0, len(where) - 1))
    return i, (where[i] == wanted) if len(where) else np.zeros(len(wanted), bool)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tables:
    """Tables from the whole texts of all rows whose language is not null, but those that calibrate; without any, tables of no language.

    Languages of which every text would calibrate are counted all the same and reject nothing, as do those whose
    calibrating texts are all taken for others. Null texts and texts without letters count nothing.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col), F.col(text_col), F.col(lang_col).cast("string").alias("lang"))
    aside = F.pmod(F.xxhash64(id_col, text_col), F.lit(CALIBRATION_MOD)) == 0
    spread = [r.lang for r in known.groupBy("lang").agg(F.count_if(~aside).alias("n")).where("n > 0").collect()]
    aside = aside & F.col("lang").isin(spread)
    calibrating = known.where(aside)
    counts = written(count_grams(known.where(~aside), text_col, "lang"), "lm-4")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    tables, lower = {ORDER: counts}, counts
    for n in range(ORDER - 1, 0, -1):
        lower = lower.groupBy("lang", F.col("k").bitwiseAND((1 << 16 * n) - 1).alias("k")).agg(F.count("*").alias("c"))
        lower = tables[n] = written(lower, f"lm-{n}")
    out = Tables(langs, {}, {}, np.full(len(langs), np.inf))
    if not langs:
        return out
    below = None
    for n in range(1, ORDER + 1):
        c, key, x, total, kinds = _counted(tables[n], langs)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5)
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        i, ok = _at(x, key >> np.uint64(16))
        tot, lam = np.where(ok[:, None], total[i], 0), np.where(ok[:, None], weight[i], 1.0)
        if n == 1:
            base = np.full(c.shape, 1.0 / (1 << 16))
        else:
            base = np.exp(_log_p(out, key & np.uint64((1 << 16 * (n - 1)) - 1), n - 1))
        p = np.maximum(c - d, 0) / np.maximum(tot, 1) + lam * base
        out.grams[n] = key, np.log(p).astype(np.float32)
        out.backoff[n] = x, np.log(np.clip(weight, 1e-12, None)).astype(np.float32)
    limit = F.percentile_approx("cross_entropy", 1 - REJECT, 10_000)
    for r in predict(calibrating, out, text_col, "lang").where("lang_pred = lang").groupBy("lang").agg(limit.alias("m")).collect():
        out.limits[langs.index(r.lang)] = r.m + ROOM
    return out


def _log_p(t: Tables, k: np.ndarray, n: int) -> np.ndarray:
    """Natural logarithms [gram, language] of the interpolated probabilities of grams of n units."""
    s, logs = t.grams[n]
    i, ok = _at(s, k)
    got = logs[i]
    miss = np.nonzero(~ok)[0]
    if len(miss):
        left = k[miss]
        x, weights = t.backoff[n]
        j, seen = _at(x, left >> np.uint64(16))
        lam = np.where(seen[:, None], weights[j], np.float32(0))
        below = _log_p(t, left & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) if n > 1 else np.full((len(left), len(t.langs)), -np.log(1 << 16), np.float32)
        got[miss] = lam + below
    return got


def predict(docs: DataFrame, tables: Tables, text_col: str = "text", *keep: str) -> DataFrame:
    """(keep..., lang_pred, score, cross_entropy, rejected) of whole texts.

    A text that is null or has no letter gets ``und``, score 0, a null cross-entropy, and counts as
    rejected. Repeated rows stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        n_lang = len(t.langs)
        for b in batches:
            sums, sizes = np.zeros((b.num_rows, n_lang)), np.zeros(b.num_rows, np.int64)
            held: list[tuple[int, np.ndarray]] = []

            def add() -> None:
                if held:
                    rows = np.repeat([r for r, _ in held], [len(k) for _, k in held])
                    logs = _log_p(t, np.concatenate([k for _, k in held]), ORDER)
                    for lang in range(n_lang):
                        sums[:, lang] += np.bincount(rows, logs[:, lang], b.num_rows)
                    held.clear()

            for r, text in enumerate(b.column(0)):
                k = _packed(units(text.as_py())) if n_lang else ()
                sizes[r] = len(k)
                for at in range(0, len(k), CHUNK):
                    held.append((r, k[at : at + CHUNK]))
                    if sum(len(x) for _, x in held) >= CHUNK // 4:
                        add()
            add()
            some = sizes > 0
            entropy = -sums / np.maximum(1, sizes)[:, None]
            best = entropy.argmin(1) if n_lang else np.zeros(b.num_rows, np.int64)
            lowest = entropy.min(1) if n_lang else np.zeros(b.num_rows)
            odds = np.exp(-(entropy - lowest[:, None]) * TEMPERATURE)
            score = np.where(some, 1 / np.maximum(1, odds.sum(1)), 0.0)
            limit = t.limits[best] if n_lang else np.zeros(b.num_rows)
            names = [t.langs[i] if ok else "und" for i, ok in zip(best, some)]
            yield pa.RecordBatch.from_arrays(
                b.columns[1:] + [pa.array(names), pa.array(score), pa.array(lowest, mask=~some), pa.array(~some | (lowest > limit))],
                names=[*keep, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    kinds = dict(docs.dtypes)
    schema = [f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string, score double, cross_entropy double, rejected boolean"]
    return docs.select(F.col(text_col), *keep).mapInArrow(tidy(run), ", ".join(schema))
