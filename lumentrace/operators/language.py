"""Stopword language detection, n-grams and glosses (LNG-01..12, SRC-10, SRC-11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regex import let
from ..functions.tables import STOPWORDS

PROFILES = dict(STOPWORDS)
FLOOR = 0.08
_TRIM = "^[.,!?;:\"']+|[.,!?;:\"']+$"


def tokens(text: Column) -> Column:
    """Runs of letters of the lower-cased text (LNG-01)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}]+"), F.lit(0))


def _hits(t: Column, words: list[str]) -> Column:
    return F.size(F.filter(t, lambda w: w.isin(words)))


def language_scores(text: Column) -> Column:
    """map<language, share of tokens that are stopwords> (LNG-02); the tokens are taken once."""
    share = lambda t: F.array(*[F.when(F.size(t) > 0, _hits(t, ws) / F.size(t)).otherwise(F.lit(0.0)) for _, ws in PROFILES.values()])
    return F.map_from_arrays(F.array(*map(F.lit, PROFILES)), let(tokens(text), share))


def known(text: Column) -> Column:
    """Whether any language's share reaches the floor; false for null text."""
    return F.coalesce(let(tokens(text), lambda t: (F.size(t) > 0) & (F.greatest(*[_hits(t, ws) for _, ws in PROFILES.values()]) / F.greatest(F.size(t), F.lit(1)) >= FLOOR)), F.lit(False))


def detect(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with language, language_name, confidence and tokens_checked; ties go to the earlier profile, a best score below 0.08 to none (LNG-03)."""
    scored = df.withColumn("_t", tokens(F.col(text_col)))
    n = F.size("_t")
    for code, (_, words) in PROFILES.items():
        scored = scored.withColumn(f"_s_{code}", F.when(n > 0, _hits(F.col("_t"), words) / n).otherwise(F.lit(0.0)))
    best = F.greatest(*[F.col(f"_s_{c}") for c in PROFILES])
    code = F.lit(None).cast("string")
    for c in reversed(PROFILES):
        code = F.when(F.col(f"_s_{c}") == best, c).otherwise(code)
    known = best >= FLOOR
    names = F.create_map(*[F.lit(x) for c, (name, _) in PROFILES.items() for x in (c, name)])
    told = scored.withColumn("language", F.when(known, code)).withColumns(
        {"language_name": F.element_at(names, F.col("language")), "confidence": F.coalesce(best, F.lit(0.0)), "tokens_checked": F.greatest(n, F.lit(0)).cast("long")}
    )
    return told.drop("_t", *[f"_s_{c}" for c in PROFILES])


def word_pairs(text: Column) -> Column:
    """Neighbouring tokens of letters, digits and apostrophes, joined by a blank."""
    return let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), _neighbours)


def _neighbours(t: Column) -> Column:
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def bigram_plausibility(df: DataFrame, id_col: str, text_col: str, bigrams: DataFrame) -> DataFrame:
    """(id, score): share of neighbouring pairs that ``bigrams.text`` knows; 0 for fewer than two tokens or no data (LNG-04)."""
    known = bigrams.select(F.lower("text").alias("pair")).distinct().withColumn("known", F.lit(1))
    pairs = df.select(F.col(id_col), F.explode_outer(word_pairs(F.col(text_col))).alias("pair"))
    return pairs.join(known, "pair", "left").groupBy(id_col).agg(F.coalesce(F.sum("known") / F.count("pair"), F.lit(0.0)).alias("score"))


def derive_bigrams(df: DataFrame, text_col: str, least: int = 2, top: int = 5000) -> DataFrame:
    """(text, popularity): pairs seen at least ``least`` times, the ``top`` most frequent, ties by text (SRC-11)."""
    n = df.select(F.explode(word_pairs(F.col(text_col))).alias("text")).groupBy("text").agg(F.count("*").alias("popularity"))
    return n.where(F.col("popularity") >= least).orderBy(F.desc("popularity"), "text").limit(top)


def dedup_by_popularity(rows: DataFrame, text_col: str = "text", popularity_col: str = "popularity") -> DataFrame:
    """One row per lower-cased text, the most popular, of equals the first in text order (LNG-06)."""
    w = Window.partitionBy(F.lower(text_col)).orderBy(F.desc(popularity_col), text_col)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(df: DataFrame, key_col: str, table: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` with what ``table`` knows of their word, regardless of case (LNG-05)."""
    return df.join(table.withColumn("_key", F.lower(text_col)), F.lower(key_col) == F.col("_key"), "left").drop("_key")


def sentence_parts(df: DataFrame, id_col: str, text_col: str, words: DataFrame, pairs: bool = False) -> DataFrame:
    """(id, position, text) of a sentence's words that ``words`` knows; with ``pairs`` of its known bigrams, which aren't trimmed (LNG-07)."""
    fields = F.filter(F.split(F.lower(text_col), "\\s+"), lambda w: w != "")
    if pairs:
        parts = let(fields, _neighbours)
    else:
        parts = F.transform(fields, lambda w: F.regexp_replace(w, _TRIM, ""))
    rows = df.select(F.col(id_col), F.posexplode(parts).alias("position", "text"))
    return rows.join(words.select(F.lower("text").alias("text")).distinct(), "text", "left_semi").select(id_col, "position", "text")


def segment_cjk(text: Column, words: list[str]) -> Column:
    """Longest known word of two to eight characters at each place, else one character (LNG-08)."""
    known = frozenset(w.lower() for w in words)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            out, i = [], 0
            while i < len(t):
                n = next((n for n in range(min(8, len(t) - i), 1, -1) if t[i : i + n].lower() in known), 1)
                out.append(t[i : i + n])
                i += n
            return out

        return s.map(one)

    return cut(text)


def gloss(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, lang: str = "", by_rune: bool = False, segmented: Column | None = None) -> DataFrame:
    """(id, language, tokens, found, coverage, rough): each token's first definition in ``dictionary`` (text, definition) (LNG-09).

    Tokens are blank-separated words trimmed of punctuation; ``by_rune`` takes characters, ``segmented`` an array of one's own.
    """
    if segmented is not None:
        parts = segmented
    elif by_rune:
        parts = F.filter(F.split(text_col, ""), lambda c: ~c.rlike("^\\s*$"))
    else:
        parts = F.filter(F.split(F.col(text_col), "\\s+"), lambda w: w != "")
    trimmed = F.filter(F.transform(parts, lambda w: F.regexp_replace(w, _TRIM, "")), lambda w: w != "")
    rows = df.select(F.col(id_col), F.posexplode_outer(trimmed).alias("pos", "token"))
    meaning = dictionary.select(F.lower("text").alias("_key"), F.col("definition").alias("_d")).groupBy("_key").agg(F.min("_d").alias("_d"))
    met = rows.join(meaning, F.lower("token") == F.col("_key"), "left")
    clause = F.trim(F.left(F.regexp_extract("_d", "^[^;,(]*", 0), F.lit(40)))
    told = F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce(clause, F.col("token")).alias("g")))))
    return met.groupBy(id_col).agg(
        F.lit(lang).alias("language"), F.count("token").alias("tokens"), F.count("_d").alias("found"),
        F.round(F.coalesce(100 * F.count("_d") / F.nullif(F.count("token"), F.lit(0)), F.lit(0.0)), 6).alias("coverage"),
        F.array_join(F.transform(told, lambda x: x["g"]), " ").alias("rough"),
    )


def script_bonus(text: Column, lang: str) -> Column:
    """1 where the text has the script of the language: kana for Japanese, Han without kana for Chinese (LNG-11)."""
    kana, han = text.rlike("[\\x{3040}-\\x{30FF}]"), text.rlike("[\\x{4E00}-\\x{9FFF}]")
    return {"ja": kana.cast("int"), "zh": (han & ~kana).cast("int")}.get(lang, F.lit(0))


def auto_gloss(df: DataFrame, id_col: str, text_col: str, dictionaries: dict[str, DataFrame], floor: float = 50.0) -> DataFrame:
    """The best gloss of each text by coverage, number of tokens, script and code; below ``floor`` per cent there is none (LNG-10)."""
    every = None
    for lang, d in dictionaries.items():
        got = gloss(df, id_col, text_col, d, lang, by_rune=lang in ("ja", "zh")).join(df.select(F.col(id_col), script_bonus(F.col(text_col), lang).alias("_b")), id_col)
        every = got if every is None else every.unionByName(got)
    w = Window.partitionBy(id_col).orderBy(F.desc("coverage"), F.desc("tokens"), F.desc("_b"), "language")
    return every.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("coverage") >= floor)).drop("_n", "_b")


def load_language_data(spark: SparkSession, folder: str, code: str) -> dict[str, DataFrame]:
    """words, bigrams and sentences of ``folder``/``code`` (CSV: text, popularity, then what follows) and its dictionary.json, each possibly absent (SRC-10)."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    out: dict[str, DataFrame] = {}
    for kind in ("words", "bigrams", "sentences"):
        try:
            raw = spark.read.csv(f"{folder}/{code}/{kind}.csv", header=True)
        except (AnalysisException, Py4JError):
            continue
        text, *rest = raw.columns
        pop = F.expr(f"try_cast(`{rest[0]}` as bigint)") if rest else F.lit(0).cast("long")
        meaning = [c for c in rest if c.startswith("meaning")]
        out[kind] = dedup_by_popularity(raw.select(F.col(f"`{text}`").alias("text"), F.coalesce(pop, F.lit(0)).alias("popularity"), F.array_compact(F.array(*[F.col(c) for c in meaning])).cast("array<string>").alias("definitions")))
    try:
        raw = spark.read.text(f"{folder}/{code}/dictionary.json", wholetext=True)
        out["dictionary"] = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("text", "definitions"))
    except (AnalysisException, Py4JError):
        pass
    return out
