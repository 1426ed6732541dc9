"""Finding encoded pieces in texts and what they hold (ENC-09..12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native_ciphers as N
from ..functions.regex import match_all
from ..functions.severity import finding
from ..functions.text import looks_meaningful, truncated
from . import crack

MOST, SHOWN = 30, 200
#: What a piece of each encoding looks like, in the order of search.
CANDIDATES = {
    "base64": r"[A-Za-z0-9+/_-]{16,}={0,2}",
    "hex": r"\b[0-9A-Fa-f]{16,}\b",
    "base32": r"\b[A-Z2-7]{16,}={0,6}\b",
    "binary": r"\b(?:[01]{8}[ ]?){3,}\b",
    "url_encoded": r"(?:%[0-9A-Fa-f]{2}){3,}",
    "morse": r"(?:[.\-]{1,6}[ /]){2,}[.\-]{1,6}",
    "octal": r"\b(?:[0-7]{2,4}[ ]){3,}[0-7]{2,4}\b",
    "decimal": r"\b(?:\d{2,3}[ ]){3,}\d{2,3}\b",
}
ONLY_MEANINGFUL = ("morse", "octal", "decimal")


def _decoded(kind: str, raw: Column) -> Column:
    return {
        "base64": N.base64_decode, "hex": N.hex_decode, "binary": lambda c: N.number_groups_decode(c, 2), "octal": lambda c: N.number_groups_decode(c, 8),
        "decimal": lambda c: N.number_groups_decode(c, 10), "url_encoded": lambda c: F.encode(N.url_decode(c), "UTF-8"), "morse": lambda c: F.encode(N.morse_decode(c), "UTF-8"),
        "base32": lambda c: base32(c),
    }[kind](raw)


def base32(text: Column) -> Column:
    """Bytes of padded base32, by bits: five of each character (ENC-03); null if it doesn't fit."""
    t = F.upper(text)
    body = F.regexp_replace(t, "=+$", "")
    ok = t.rlike("^[A-Z2-7]*=*$") & (F.length(t) % 8 == 0) & (F.length(body) % 8).isin(0, 2, 4, 5, 7)
    value = lambda c: F.instr(F.lit(N.UPPER + "234567"), c) - 1
    bits = F.array_join(F.transform(F.split(body, ""), lambda c: F.lpad(F.bin(F.instr(F.lit(N.UPPER + "234567"), c).cast("long") - 1), 5, "0")), "")
    whole = F.floor(F.length(bits) / 8).cast("int")
    octets = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))).otherwise(F.array().cast("array<string>"))
    return F.when(ok & (body != ""), F.unhex(F.array_join(octets, "")))


def _told(kind: str, i: int, shown: int | None, cracked: Column | None = None):
    """What a match of a kind is told as; ``cracked`` has what XOR cracking found for pieces of hex that don't read as text, null where it found nothing."""
    plain = lambda t: t if shown is None else truncated(t, shown)

    def told(m: Column, n: Column) -> Column:
        out = _decoded(kind, m["value"])
        text, name, key = F.when(out.isNotNull(), F.make_valid_utf8(out.cast("string"))), F.lit(kind), F.lit(None).cast("string")
        decodable, meaningful = out.isNotNull(), looks_meaningful(out)
        if cracked is not None:
            c = F.get(cracked, n)
            hit = c["key"].isNotNull()
            text, name, key = F.when(hit, c["plaintext"]).otherwise(text), F.when(hit, kind + "_xor").otherwise(name), c["key"]
            decodable, meaningful = decodable | hit, meaningful | hit
        return F.struct(
            F.lit(i).alias("ord"), name.alias("kind"), m["pos"].alias("pos"), truncated(m["value"], 60).alias("sample"), decodable.alias("decodable"),
            meaningful.alias("meaningful"), plain(text).alias("decoded"), key.alias("key"),
        )

    return told


def _some(text: Column, kind: str, most: int | None) -> Column:
    found = match_all(text, CANDIDATES[kind])
    return found if most is None else F.slice(found, 1, most)


def cracked_hex(text: Column, most: int | None = MOST, data: crack.LanguageData = crack.LanguageData()) -> Column:
    """array<struct<key, plaintext>> for the pieces of hex in ``text``, by their turn: null where they read as text as they are or no XOR with one byte does."""
    values = F.transform(_some(text, "hex", most), lambda m: F.when(~looks_meaningful(_decoded("hex", m["value"])), m["value"]))
    return crack.xor_pieces(F.when(F.exists(values, lambda v: v.isNotNull()), values), data)


def pieces(text: Column, cracked: Column | None, kinds: list[str] | None = None, most: int | None = MOST, shown: int | None = SHOWN) -> Column:
    """array<struct<ord, kind, pos, sample, decodable, meaningful, decoded, key>> of a text; ``cracked`` is its ``cracked_hex`` as a column."""
    arrays = []
    for i, kind in enumerate(kinds or CANDIDATES):
        got = F.transform(_some(text, kind, most), _told(kind, i, shown, cracked if kind == "hex" else None))
        arrays.append(F.filter(got, lambda x: x["meaningful"]) if kind in ONLY_MEANINGFUL else got)
    total = F.concat(*arrays)
    return total if most is None else F.filter(total, lambda x, i: (i < most) | x["kind"].startswith("hex"))


def detect(df: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None, most: int | None = MOST, shown: int | None = SHOWN, data: crack.LanguageData = crack.LanguageData()) -> DataFrame:
    """(id, kind, pos, sample, decodable, meaningful, decoded, key) in the order of search (ENC-10).

    Each kind gives at most ``most`` pieces of a text, and every kind but hex stops once so many are gathered in all; ``decoded`` is
    cut after ``shown`` bytes. These are the method's own limits; with None there are none. Pieces of hex that don't read as text are tried
    under XOR with each byte (CRK-10): what that gives is of kind hex_xor, with its key.
    """
    rows = df.select(F.col(id_col), F.col(text_col))
    cracked = None
    if kinds is None or "hex" in kinds:
        rows, cracked = rows.withColumn("_cracked", cracked_hex(F.col(text_col), most, data)), F.col("_cracked")
    return rows.select(F.col(id_col), F.explode(pieces(F.col(text_col), cracked, kinds, most, shown)).alias("m")).select(id_col, "m.*").drop("ord")


def findings(found: DataFrame, id_col: str) -> DataFrame:
    """Pieces as findings: medium if they read as text, else info (ENC-12); ``decoded`` can go through the PII scan again."""
    return found.select(*finding_columns(F.col, F.col(id_col)))


def finding_columns(m, location: Column) -> list[Column]:
    """The columns of a piece's finding; ``m`` gives a field of the piece by name."""
    return finding(
        "storage", F.concat(F.lit("encoded_content_"), m("kind")), F.concat(F.lit("Encoded content: "), m("kind")), F.when(m("meaningful"), "medium").otherwise("info"),
        F.concat(F.lit("Sample: "), m("sample")), location,
        evidence=F.create_map(F.lit("position"), m("pos").cast("string"), F.lit("decodable"), m("decodable").cast("string"), F.lit("decoded"), m("decoded"), F.lit("key"), m("key")), tags=["encoding"],
    )
