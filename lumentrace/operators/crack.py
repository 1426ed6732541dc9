"""Keyless cryptanalysis: one Arrow UDF on the texts that need it (CRK-01..18).

Scores come from stopword profiles, letter and digraph statistics and, for transpositions, a word list; without
words a transposition is never accepted and without bigrams that gate is skipped.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ciphers as C
from ..functions.automaton import WordList
from ..functions.regex import let
from ..functions.severity import FINDING, finding
from ..functions.statistics import DIGRAPH_SHARE, FEW_PAIRS, FLOOR_SHARE, LETTER_SHARE, NO_SCORE
from ..functions.text import truncated
from . import pii_scan
from .language import FLOOR, PROFILES
from .pii_scan import decode_score

SURE, PLAUSIBLE_BIGRAMS = 0.20, 0.12
#: Share of an accepted simple cipher's digraph distance that a polyalphabetic plain text must stay under.
NEARER = 0.9
_LETTERS = re.compile(r"[^\W\d_]+")
_SETS = {c: frozenset(w) for c, (_, w) in PROFILES.items()}
#: Keywords tried on columnar transpositions, before all orders of two to five columns.
COLUMNAR_WORDS = "KEY CODE SECRET PASSWORD CRYPTO ENCRYPT ALPHA ZEBRA ROYAL MATRIX CIPHER SIMPLE ABCD XYZ CBA".split()


_STOP = {w: tuple(c for c in _SETS if w in _SETS[c]) for c in _SETS for w in _SETS[c]}
#: Letters whose lower case has a letter of a to z that they aren't.
_ODD = re.compile("[\u0130\u212a]")


def _shifted_stopwords() -> dict[str, list[tuple[int, str]]]:
    """Word -> (trial, language) wherever the word is a stopword's cipher text: trials 1 to 25 by Caesar's shift, 0 by mirrored letters."""
    got = defaultdict(list)
    for w, langs in _STOP.items():
        for trial in range(26):
            coded = C.caesar(w, trial) if trial else C.encode("atbash", w)
            got[coded] += [(trial, c) for c in langs]
    return dict(got)


_CODED = _shifted_stopwords()


def likely_shifts(text: str, floor: float) -> list[int]:
    """Trials whose plain text's best stopword score reaches ``floor``: the text is split into words once and the stopwords are shifted instead."""
    if _ODD.search(text):
        return list(range(26))
    words = Counter(_LETTERS.findall(text.lower()))
    sums: Counter[tuple[int, str]] = Counter()
    for w, k in words.items():
        for at in _CODED.get(w, ()):
            sums[at] += k
    n = words.total()
    return sorted({trial for (trial, _), k in sums.items() if k / n >= floor})


@dataclass(frozen=True)
class LanguageData:
    """Words for transpositions, as a ``WordList`` or a set, and, by language, known bigrams; both may be empty."""

    words: WordList | frozenset[str] = frozenset()
    bigrams: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self):
        if not isinstance(self.words, WordList):
            object.__setattr__(self, "words", WordList.of(self.words))


def language(text: str) -> tuple[str, float, float]:
    """(language or "", its confidence, best score of any)."""
    tokens = _LETTERS.findall(text.lower())
    scores = {c: sum(t in ws for t in tokens) / len(tokens) if tokens else 0.0 for c, ws in _SETS.items()}
    best = max(scores, key=scores.get)
    return (best, scores[best], scores[best]) if scores[best] >= FLOOR else ("", scores[best], scores[best])


def sentence_like(text: str) -> bool:
    words = text.split()
    clean = [w for w in (t.rstrip(".,!?;:'\"") for t in words) if len(w.encode()) >= 2 and w.isalpha()]
    return len(words) >= 4 and len(clean) / len(words) >= 0.7


def meaningful(data: bytes) -> bool:
    if len(data.strip(b"\t\n\v\f\r ")) < 4 or 0 in data:
        return False
    ratio = sum(b in (9, 10, 13) or 32 <= b < 127 for b in data) / len(data)
    if ratio > 0.85:
        return True
    try:
        return ratio > 0.60 and "�" not in data.decode()
    except UnicodeDecodeError:
        return False


def accepted(text: str, data: LanguageData) -> tuple[str, float] | None:
    """Language and confidence of a plausible plain text (CRK-03)."""
    lang, sure, _ = language(text)
    if not lang or sure < SURE or not sentence_like(text):
        return None
    known = data.bigrams.get(lang)
    if known:
        t = re.findall(r"[a-z0-9']+", text.lower())
        if len(t) < 2 or sum(f"{a} {b}" in known for a, b in zip(t, t[1:])) / (len(t) - 1) < PLAUSIBLE_BIGRAMS:
            return None
    return lang, sure


def _chi(counts: list[int]) -> float:
    n = sum(counts)
    return sum((o - e / 100 * n) ** 2 / (e / 100 * n) for o, e in zip(counts, LETTER_SHARE.values())) if n else NO_SCORE


def _numbers(text: str) -> list[int]:
    return [ord(c) - 97 for c in text.lower() if "a" <= c <= "z"]


def _coincidence(column: list[int]) -> float:
    n = len(column)
    return sum(k * (k - 1) for k in Counter(column).values()) / (n * (n - 1)) if n > 1 else 0.0


def key_length(letters: list[int]) -> int | None:
    """The period of a polyalphabetic key (CRK-06)."""
    if len(letters) < 100:
        return None
    ic = {n: sum(_coincidence(letters[i::n]) for i in range(n)) / n for n in range(2, 13)}
    top = max(ic, key=ic.get)
    if ic[top] < 0.058 or ic[top] - sum(ic.values()) / len(ic) < 0.01:
        return None
    return next((d for d in range(2, top) if top % d == 0 and ic[d] >= 0.85 * ic[top]), top)


def _column_key(column: list[int], plain: Callable[[int, int], int]) -> int:
    counts = Counter(column)
    shifted = lambda k: [counts[plain(k, x)] for x in range(26)]
    return min(range(26), key=lambda k: _chi(shifted(k)))


def vigenere_key(text: str) -> str | None:
    """Each column by the shift nearest English letters, the least of equals (CRK-07)."""
    letters = _numbers(text)
    n = key_length(letters)
    return n and "".join(chr(65 + _column_key(letters[i::n], lambda k, x: (x + k) % 26)) for i in range(n))


def beaufort_key(text: str) -> str | None:
    """Mirrored columns, then a climb over single letters by the best stopword score (CRK-08)."""
    letters = _numbers(text)
    n = key_length(letters)
    if not n:
        return None
    key = [_column_key(letters[i::n], lambda k, x: (k - x) % 26) for i in range(n)]
    words = _PlacedWords(text, n, key)
    moved = True
    while moved:
        moved = False
        for i in range(n):
            scores = words.scores(i)
            if max(scores) > words.best:
                words.change(i, scores.index(max(scores)))
                moved = True
    return "".join(chr(65 + x) for x in words.key)


@lru_cache(maxsize=16)
def _gapped(n: int) -> dict[str, list[tuple[str, tuple[str, ...]]]]:
    """Stopwords with every n-th letter, from each of the first n on, left out: pattern -> (letters left out, languages)."""
    got = defaultdict(list)
    for w, langs in _STOP.items():
        at = [k for k, c in enumerate(w) if "a" <= c <= "z"]
        for r in range(min(n, len(at))):
            out = at[r::n]
            got["".join("?" if k in out else c for k, c in enumerate(w))].append(("".join(w[k] for k in out), langs))
    return dict(got)


class _PlacedWords:
    """A text's words with the places of their letters under a key of ``n``, and the stopword score of the plain text.

    For one place of the key all 26 letters are scored at once: a word whose other letters fit a stopword tells which letter it wants.
    Words of equal letters at equal places are counted once.
    """

    def __init__(self, text: str, n: int, key: list[int]):
        at, kinds = 0, Counter()
        for w in _LETTERS.findall(text.lower()):
            kinds[w, at % n] += 1
            at += sum("a" <= c <= "z" for c in w)
        self.n, self.key, self.total = n, list(key), kinds.total()
        self.words, self.gaps = list(kinds.items()), _gapped(n)
        self.meets: list[list[int]] = [[] for _ in range(n)]
        for j, ((w, start), _) in enumerate(self.words):
            for k in range(min(n, sum("a" <= c <= "z" for c in w))):
                self.meets[(start + k) % n].append(j)
        self.hits = [_STOP.get(self._plain(j)[0], ()) for j in range(len(self.words))]
        self.sums = Counter()
        for j in range(len(self.words)):
            self._count(self.sums, j, 1)
        self.best = self._score(self.sums)

    def _plain(self, j: int, gap: int | None = None) -> tuple[str, str]:
        """A word's plain text with letters at the key's place ``gap`` left out, and their cipher letters."""
        (w, at), out, left = self.words[j][0], [], []
        for c in w:
            if "a" <= c <= "z":
                i = at % self.n
                if i == gap:
                    left.append(c)
                    c = "?"
                else:
                    c = chr(97 + (self.key[i] - ord(c) + 97) % 26)
                at += 1
            out.append(c)
        return "".join(out), "".join(left)

    def _count(self, sums: dict[str, int], j: int, sign: int) -> None:
        for c in self.hits[j]:
            sums[c] = sums.get(c, 0) + sign * self.words[j][1]

    def _score(self, sums: dict[str, int]) -> float:
        return max(sums.get(c, 0) for c in _SETS) / self.total if self.total else 0.0

    def scores(self, i: int) -> list[float]:
        """The score with each letter at the key's place ``i``."""
        rest, gains = dict(self.sums), [Counter() for _ in range(26)]
        for j in self.meets[i]:
            self._count(rest, j, -1)
            pattern, coded = self._plain(j, i)
            for letters, langs in self.gaps.get(pattern, ()):
                wanted = {(ord(p) + ord(c) - 194) % 26 for p, c in zip(letters, coded)}
                if len(wanted) == 1:
                    for lang in langs:
                        gains[min(wanted)][lang] += self.words[j][1]
        return [self._score({c: rest.get(c, 0) + g[c] for c in _SETS}) for g in gains]

    def change(self, i: int, letter: int) -> None:
        self.key[i] = letter
        for j in self.meets[i]:
            self._count(self.sums, j, -1)
            self.hits[j] = _STOP.get(self._plain(j)[0], ())
            self._count(self.sums, j, 1)
        self.best = self._score(self.sums)


def digraph_distance(text: str) -> float:
    low = text.lower()
    pairs = Counter(p for p in map("".join, zip(low, low[1:])) if "a" <= p[0] <= "z" and "a" <= p[1] <= "z")
    n = pairs.total()
    if n < FEW_PAIRS:
        return NO_SCORE
    expected = {p: DIGRAPH_SHARE.get(p, FLOOR_SHARE) / 10000 * n for p in pairs}
    return sum((pairs[p] - e) ** 2 / e for p, e in sorted(expected.items()))


def coverage(text: str, words: WordList) -> float:
    """Largest share of letters that words of 4 to 12 letters can tile (CRK-12)."""
    return words.coverage(C.cleaned(text).lower())


def transposition(text: str, method: str, keys: list[str], undo: Callable[[str, str], str], words: WordList) -> dict | None:
    """The candidate of a cluster near the least digraph distance that words cover best, if it stands out (CRK-11..15)."""
    cands = [(digraph_distance(p), -coverage(p, words), k, p) for k in keys if (p := undo(text, k)).strip()]
    if len(cands) < 2:
        return None
    cands.sort(key=lambda c: c[0])
    near = [c for i, c in enumerate(cands) if i == 0 or c[0] < 1.5 * cands[0][0]]
    score, cover, key, plain = min(near, key=lambda c: c[1])
    mean = (sum(c[0] for c in cands) - score) / (len(cands) - 1)
    middle = sorted(-c[1] for c in cands)[len(cands) // 2]
    if len(C.cleaned(plain)) < 20 or score > 0.9 * mean or mean <= score or -cover < 0.25 or (middle > 0 and -cover < 2 * middle):
        return None
    return {"method": method, "key": key, "plaintext": plain, "language": None, "confidence": min(1.0, max(0.05, (mean / score - 1) / 3))}


def _orders() -> list[str]:
    return COLUMNAR_WORDS + ["".join(p) for n in range(2, 6) for p in permutations("12345"[:n])]


def transpositions(text: str, words: WordList) -> Iterator[dict]:
    if not words:  # without words no candidate can reach the coverage that is asked for
        return
    n = min(20, len(C.cleaned(text)))
    for method, keys, undo in (
        ("railfence", [str(r) for r in range(2, 21)], lambda t, k: C.railfence(t, int(k), True)),
        ("scytale", [str(d) for d in range(2, n + 1)], lambda t, k: C.scytale(t, int(k), True)),
        ("columnar", _orders(), lambda t, k: C.columnar(t, k, True)),
    ):
        if found := transposition(text, method, keys, undo, words):
            yield found


def refits(poly: dict, simple: dict, words: int) -> bool:
    """Whether a polyalphabetic key only refits a text of ``words`` that a Caesar shift or mirrored letters explain.

    A climb over a key's letters makes stopwords by chance. Each letter but the key's commonest is a free choice: their number is less than that of the
    words they win, and the digraphs come nearer to language too, or else the simple cipher stands.
    """
    free = len(poly["key"]) - max(Counter(poly["key"]).values())
    won = round((poly["confidence"] - simple["confidence"]) * words)
    return won <= free or digraph_distance(poly["plaintext"]) >= NEARER * digraph_distance(simple["plaintext"])


def candidates(text: str, data: LanguageData = LanguageData()) -> list[dict]:
    """Plausible plain texts of all methods, in the order of trial (CRK-16); polyalphabetic ones that only refit an accepted simple cipher are left out."""
    likely = likely_shifts(text, SURE)
    trials: list[tuple[str, str, str]] = [("caesar", str(n), C.caesar(text, -n)) for n in likely if n]
    if 0 in likely:
        trials.append(("atbash", "", C.decode("atbash", text)))
    if k := vigenere_key(text):
        trials.append(("vigenere", k, C.vigenere(text, k, -1)))
    if k := beaufort_key(text):
        trials.append(("beaufort", k, C.beaufort(text, k)))
    found = []
    for method, key, plain in trials:
        if ok := accepted(plain, data):
            found.append({"method": method, "key": key, "plaintext": plain, "language": ok[0], "confidence": ok[1]})
    if simple := max((f for f in found if f["method"] in ("caesar", "atbash")), key=lambda f: f["confidence"], default=None):
        words = len(_LETTERS.findall(text.lower()))
        found = [f for f in found if f["method"] in ("caesar", "atbash") or not refits(f, simple, words)]
    return [*found, *transpositions(text, data.words)]


def crack(text: str, data: LanguageData = LanguageData()) -> dict | None:
    """The most confident of ``candidates`` by language alone, the earlier of equals."""
    return max(candidates(text, data), key=lambda f: min(0.99, f["confidence"]), default=None)


def only(text: str, method: str) -> dict | None:
    """Vigenère or Beaufort alone: the best guess, with ok telling whether its language is sure (CRK-09)."""
    key = vigenere_key(text) if method == "vigenere" else beaufort_key(text)
    if not key:
        return None
    plain = C.vigenere(text, key, -1) if method == "vigenere" else C.beaufort(text, key)
    lang, sure, _ = language(plain)
    return {"method": method, "key": key, "plaintext": plain, "language": lang or None, "confidence": sure, "ok": bool(lang) and sure >= SURE}


_PRINTED = np.array([[b ^ key in (9, 10, 13) or 32 <= b ^ key < 127 for b in range(256)] for key in range(256)], np.float64)


def crack_xor(text: str, data: LanguageData = LanguageData()) -> dict | None:
    """Hexadecimal XORed with one byte: the key whose plain text is most sure, the least of equals (CRK-10).

    The counts of its bytes tell under which keys a text has enough printable ones and no zero; only these are tried.
    """
    try:
        raw = bytes.fromhex(text)
    except ValueError:
        return None
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    best = None
    for key in np.nonzero((_PRINTED @ counts > 0.60 * len(raw)) & (counts == 0))[0].tolist():
        if key:
            plain = bytes(b ^ key for b in raw)
            if meaningful(plain) and sentence_like(t := plain.decode("utf-8", "replace")) and (ok := accepted(t, data)) and (best is None or ok[1] > best["confidence"]):
                best = {"method": "xor", "key": str(key), "plaintext": t, "language": ok[0], "confidence": ok[1]}
    return best


def xor_pieces(pieces: Column, data: LanguageData = LanguageData()) -> Column:
    """array<struct<key, plaintext>> of an array of hexadecimal pieces, each null where nothing was found; a null array stays null."""

    @F.pandas_udf("array<struct<key:string,plaintext:string>>")
    def apply(s: pd.Series) -> pd.Series:
        told = lambda t: None if t is None or not (r := crack_xor(t, data)) else {"key": r["key"], "plaintext": r["plaintext"]}
        return s.map(lambda ts: None if ts is None else [told(t) for t in ts])

    return apply(pieces)


_RESULT = "method string, key string, plaintext string, language string, confidence double"
_FIELDS = [f.split()[0] for f in _RESULT.split(", ")]


def _column(text: Column, run: Callable[[str], dict | None]) -> Column:
    @F.pandas_udf(_RESULT)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [(run(t) or {}) if t is not None else {} for t in s]
            yield pd.DataFrame({f: pd.Series([g.get(f) for g in got], dtype="float64" if f == "confidence" else object) for f in _FIELDS})

    return apply(text)


def candidates_column(text: Column, data: LanguageData = LanguageData()) -> Column:
    """array<struct<method, key, plaintext, language, confidence>> of ``candidates``; null text has none."""

    @F.pandas_udf("array<struct<" + _RESULT.replace(" ", ":").replace(",:", ",") + ">>")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else candidates(t, data))

    return apply(text)


def winner(found: Column) -> Column:
    """The most confident of ``candidates_column``, the earlier of equals, all fields null without any (CRK-16).

    A candidate whose plain text holds personal data gains by its rules' score (PII-12), which stays within 0.99.
    """
    scored = F.transform(found, lambda c, i: F.struct(F.least(F.lit(0.99), F.greatest(F.lit(0.0), c["confidence"] + decode_score(c["plaintext"]))).alias("confidence"), (-i).alias("turn"), c.alias("c")))
    field = lambda b: F.struct(b["c"]["method"].alias("method"), b["c"]["key"].alias("key"), b["c"]["plaintext"].alias("plaintext"), b["c"]["language"].alias("language"), b["confidence"].alias("confidence"))
    return let(F.array_max(scored), field)


def crack_column(text: Column, data: LanguageData = LanguageData()) -> Column:
    """struct<method, key, plaintext, language, confidence>, all null where nothing was found: Python gives the candidates, the rules score them natively."""
    return winner(candidates_column(text, data))


def only_column(text: Column, method: str) -> Column:
    """The same of one polyalphabetic method alone, its best guess even where its language isn't sure (CRK-09)."""
    return _column(text, lambda t: only(t, method))


def xor_hex(text: Column, data: LanguageData = LanguageData()) -> Column:
    return _column(text, lambda t: crack_xor(t, data))


def caesar_candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shift, language, confidence, rank) of the 25 shifts of each text with words, by confidence and shift (CRK-01).

    The stopwords are shifted instead of the text, which is split into words once, in its row.
    """
    codes, result = list(PROFILES), "array<struct<shift:int,language:string,confidence:double>>"

    def told(text: str | None) -> list[dict]:
        words = Counter(_LETTERS.findall(text or ""))
        n = words.total()
        sums: Counter[tuple[int, str]] = Counter()
        for w, k in words.items():
            for at in _CODED.get(w, ()):
                sums[at] += k
        out = []
        for shift in range(1, 26) if n else ():
            best = max(codes, key=lambda c: sums[shift, c])
            sure = sums[shift, best] / n
            out.append({"shift": shift, "language": best if sure >= FLOOR else None, "confidence": sure})
        return sorted(out, key=lambda c: -c["confidence"])

    @F.pandas_udf(result)
    def run(s: pd.Series) -> pd.Series:
        return s.map(told)

    rows = df.select(F.col(id_col), F.posexplode(run(F.lower(F.col(text_col)))).alias("rank", "c"))
    return rows.select(id_col, "c.shift", "c.language", "c.confidence", (F.col("rank") + 1).alias("rank"))


def suspect(text: Column, language_known: Column) -> Column:
    """Texts of more than 40 bytes without a known language, else null: only these are cracked."""
    return F.when(~language_known & (F.octet_length(F.trim(text)) > 40), text)


def finding_array(text: Column, r: Column, location: Column, rules: list[str] | None = None, inner: bool = True) -> Column:
    """What cracking a ``suspect`` text gave, as an array of findings (CRK-18); ``r`` is its ``winner`` as a column.

    The plain text goes through the PII rules once more, with a note of the method; not without ``inner``.
    """
    hit = r["method"].isNotNull()
    own = finding(
        "storage", F.when(hit, F.concat(F.lit("cipher_cracked_"), r["method"])).otherwise("unrecognized_language"),
        F.when(hit, F.concat(F.lit("Cipher cracked: "), r["method"])).otherwise("Unrecognized language"), F.when(hit, "high").otherwise("medium"),
        F.when(hit, F.concat(F.lit("Plaintext: "), truncated(r["plaintext"], 500))).otherwise("No known language and no cipher that gives one"), location,
        language=r["language"], evidence=F.create_map(F.lit("key"), r["key"], F.lit("confidence"), F.round(r["confidence"], 6).cast("string")), tags=["cipher"],
    )
    kind = "array<" + FINDING.simpleString() + ">"
    out = F.array(F.struct(*own)).cast(kind)
    if inner:
        out = F.concat(out, pii_scan.finding_array(F.when(hit, r["plaintext"]), location, rules, note=F.concat(F.lit("decoded via "), r["method"])).cast(kind))
    return F.when(text.isNotNull(), out).otherwise(F.array().cast(kind))


def findings(df: DataFrame, id_col: str, text_col: str, language_col: str, data: LanguageData = LanguageData(), rules: list[str] | None = None, inner: bool = True) -> DataFrame:
    """Texts of more than 40 bytes without a known language: cracked or unrecognised, and the personal data in plain texts (CRK-18); only these reach Python."""
    todo = df.select(F.col(id_col), suspect(F.col(text_col), F.col(language_col).isNotNull()).alias("_t")).where("_t is not null")
    rows = todo.select(F.col(id_col), F.col("_t"), candidates_column(F.col("_t"), data).alias("_c")).withColumn("_r", winner(F.col("_c")))
    return rows.select(F.explode(finding_array(F.col("_t"), F.col("_r"), F.col(id_col), rules, inner)).alias("f")).select("f.*")


def analyze(df: DataFrame, id_col: str, text_col: str, data: LanguageData = LanguageData(), dictionaries: dict[str, DataFrame] | None = None, language_code: str | None = None) -> DataFrame:
    """(id, language, confidence, pii, crack, encodings) of each text (CRK-17): cracking only where no language is known.

    With ``dictionaries`` also gloss, gloss_language and coverage (LNG-12): by the dictionary of ``language_code`` if given, else of the text's
    language, else by the best of all, and that only where nothing was cracked.
    """
    from ..functions.pii import all_matches
    from .encodings import detect as encodings_of
    from .language import detect

    known = detect(df.select(F.col(id_col), F.col(text_col)), text_col)
    base = known.select(id_col, "language", "confidence", F.size(all_matches(F.col(text_col))).alias("pii"))
    cracked = known.where("language is null").select(id_col, crack_column(F.col(text_col), data).alias("crack"))
    found = encodings_of(df, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("encodings"))
    told = base.join(cracked, id_col, "left").join(found, id_col, "left").fillna(0, ["encodings"])
    return told if not dictionaries else _glossed(told, df, id_col, text_col, dictionaries, language_code)


def _glossed(told: DataFrame, df: DataFrame, id_col: str, text_col: str, dictionaries: dict[str, DataFrame], language_code: str | None) -> DataFrame:
    from .language import auto_gloss, gloss

    texts = df.select(F.col(id_col), F.col(text_col)).join(told.select(id_col, "language", F.col("crack.method").alias("_method")), id_col)
    own = F.lit(language_code) if language_code else F.col("language")
    parts = [gloss(texts.where(own == lang), id_col, text_col, d, lang, by_rune=lang in ("ja", "zh")) for lang, d in dictionaries.items() if language_code in (None, lang)]
    if not language_code:
        parts.append(auto_gloss(texts.where("language is null and _method is null"), id_col, text_col, dictionaries))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return told.join(every.select(id_col, F.col("rough").alias("gloss"), F.col("language").alias("gloss_language"), "coverage"), id_col, "left")
