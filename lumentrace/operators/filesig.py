"""File signatures against claimed extensions (SIG-01..04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import finding
from ..functions.tables import FILE_SIGNATURES, TYPE_NAMES


def matches(content: Column, checkpoints: list[tuple[int, str, list[str]]]) -> Column:
    """All checkpoints hold: the bytes at an offset equal a hexadecimal string, or one byte is among alternatives; short contents fail (SIG-01)."""
    ok = F.lit(True)
    for offset, want, any_of in checkpoints:
        if any_of:
            ok = ok & F.hex(F.substring(content, offset + 1, 1)).isin([x.upper() for x in any_of])
        else:
            ok = ok & (F.hex(F.substring(content, offset + 1, len(want) // 2)) == want.upper())
    return F.coalesce(ok, F.lit(False))


def verdict(content: Column, extension: Column, signatures=FILE_SIGNATURES) -> Column:
    """struct<claimed_ext, known_ext, matched, heuristic_matched, actual_type, actual_description, header_hex> (SIG-02, SIG-03).

    An extension is known if it has a reliable signature. Where no signature of it fits, the reliable
    one of another extension with the least id tells the actual type. Rules fold into one expression: no join, no shuffle.
    """
    ext = F.lower(F.regexp_replace(extension, "^\\.", ""))
    reliable, heuristic = F.lit(False), F.lit(False)
    actual = F.lit(None).cast("string")
    for _, e, sure, cps in signatures:
        hit = (ext == e) & matches(content, cps)
        reliable, heuristic = (reliable | hit, heuristic) if sure else (reliable, heuristic | hit)
    for _, e, sure, cps in sorted(signatures, reverse=True):
        if sure:
            actual = F.when((ext != e) & matches(content, cps), e).otherwise(actual)
    known = ext.isin(sorted({e for _, e, sure, _ in signatures if sure}))
    actual = F.when(~reliable, actual)
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.struct(
        ext.alias("claimed_ext"), known.alias("known_ext"), reliable.alias("matched"), heuristic.alias("heuristic_matched"), actual.alias("actual_type"), F.try_element_at(names, actual).alias("actual_description"),
        F.hex(F.substring(content, 1, 16)).alias("header_hex"),
    )


def check(df: DataFrame, id_col: str, content_col: str, ext_col: str, signatures=FILE_SIGNATURES) -> DataFrame:
    """(id, claimed_ext, known_ext, matched, heuristic_matched, actual_type, actual_description, header_hex): each row's ``verdict``."""
    return df.select(F.col(id_col), verdict(F.col(content_col), F.col(ext_col), signatures).alias("_v")).select(id_col, "_v.*")


def mismatch(told: Column, location: Column) -> Column:
    """The finding of a known extension whose content fits no signature of its own, else null (SIG-04); ``told`` is a ``verdict``."""
    actual = F.coalesce(F.concat(told["actual_type"], F.lit(" ("), told["actual_description"], F.lit(")")), told["actual_type"], F.lit("none of the known types"))
    columns = finding(
        "storage", "file_signature_mismatch", "File signature mismatch", "high", F.concat(F.lit("Claimed ."), told["claimed_ext"], F.lit(", content looks like "), actual), location,
        evidence=F.create_map(F.lit("actual_type"), told["actual_type"], F.lit("actual_description"), told["actual_description"], F.lit("header_hex"), told["header_hex"]), tags=["file_signature"],
    )
    return F.when(told["known_ext"] & ~told["matched"] & ~told["heuristic_matched"], F.struct(*columns))


def mismatches(checked: DataFrame, id_col: str) -> DataFrame:
    """Such rows of ``check`` as findings."""
    told = F.struct(*[c for c in checked.columns if c != id_col])
    return checked.select(F.col(id_col), told.alias("_v")).select(mismatch(F.col("_v"), F.col(id_col)).alias("f")).where("f is not null").select("f.*")
