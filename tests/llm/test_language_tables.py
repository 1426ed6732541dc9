"""The language tables keep every gram's own count."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from lumentrace.llm import language_id


def test_grams_dont_share_counts_in_full_tables(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n, lang in enumerate(("aa", "bb")):
        letters = [chr(c) for c in range(0x4E00 + 8000 * n, 0x4E00 + 8000 * n + 3000)]
        rows += [(i + 1000 * n, "".join(rng.choice(letters, 4000)), lang) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows = counted(spark, docs, rows)
    t = language_id.train(docs)
    grams = {lang: set() for lang in t.langs}
    for _, text, lang in rows:
        grams[lang].update(language_id._packed(language_id.units(text)).tolist())
    assert len(t.grams[language_id.ORDER][0]) == len(grams["aa"] | grams["bb"]) > 1 << 20
    for k, logs in t.grams.values():
        assert (np.diff(k) > 0).all() and (logs <= 1e-6).all()


def counted(spark, docs, rows):
    """The rows that don't calibrate."""
    from pyspark.sql import functions as F

    kept = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(language_id.CALIBRATION_MOD)) != 0).collect()}
    return [r for r in rows if r[0] in kept]


def brute(texts, history, unit):
    """P(unit | history) of one language by interpolated Kneser-Ney, gram by gram, from counts in dictionaries."""
    counts = {4: Counter()}
    for t in texts:
        u = "   " + t + " "
        for i in range(3, len(u)):
            counts[4][u[i - 3 : i + 1]] += 1
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p = 1 / 65536
    for n in (1, 2, 3, 4):
        c, h = counts[n], history[len(history) - n + 1 :]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once else 0.5
        own = {g: v for g, v in c.items() if g[:-1] == h}
        total = sum(own.values())
        if total:
            p = max(c.get(h + unit, 0) - d, 0) / total + d * len(own) / total * p
    return p


def test_probabilities_are_those_of_brute_force(spark):
    rng = random.Random(4)
    langs = {"aa": "abcde", "bb": "cdefg"}
    rows = [(i, " ".join("".join(rng.choice(langs[k]) for _ in range(rng.randrange(1, 6))) for _ in range(8)), k) for i, k in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    t = language_id.train(docs)
    by = defaultdict(list)
    for _, text, k in counted(spark, docs, rows):
        by[k].append(text)
    for _ in range(150):
        h, u = "".join(rng.choice("abcdefg z") for _ in range(3)), rng.choice("abcdefg z")
        k = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(h + u))], np.uint64)
        got = language_id._log_p(t, k, 4)[0]
        for i, lang in enumerate(t.langs):
            assert math.isclose(math.exp(got[i]), brute(by[lang], h, u), rel_tol=1e-4)


def test_texts_without_letters_are_of_no_language(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 3, "en") for i in range(9)] + [(20 + i, "el perro y la casa " * 3, "es") for i in range(9)], "doc_id long, text string, lang string")
    t = language_id.train(docs)
    odd = ["\U0001f600\U0001f680", "\u0301\u0302", "12 34", "", None, "\ud7ff\u00b2", "\U0001d400", "\u00e9", "\U0001f600 the"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), t, "text", "doc_id").collect()
    assert [r.lang_pred == "und" for r in sorted(got)] == [True] * 6 + [False] * 3
    assert all((r.score == 0 and r.rejected) == (r.lang_pred == "und") for r in got if r.doc_id < 6)


def test_rejection_is_calibrated(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    t = language_id.train(docs.where("doc_id % 2 = 0"))
    own = language_id.predict(docs.where("doc_id % 2 = 1"), t, "text", "doc_id").where("cross_entropy is not null").collect()
    assert sum(r.rejected for r in own) / len(own) < 0.05
    foreign = spark.createDataFrame([(i, "Вчера вечером мы долго говорили о погоде " * 3) for i in range(3)] + [(9, "xq zzkw vvv qqj wkx " * 9)], "doc_id long, text string")
    assert all(r.rejected for r in language_id.predict(foreign, t, "text", "doc_id").collect())
