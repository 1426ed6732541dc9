"""RE2-like matching with Java's engine: ASCII word boundaries and white space, byte offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once: inside a higher-order function Spark would repeat it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java_pattern(pattern: str) -> str:
    """``pattern`` with ``\\b`` and ``\\s`` limited to ASCII as RE2 has them."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b" and not in_class:
            out.append(_BOUNDARY)
        elif two == "\\s":
            out.append("\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]")
        elif pattern[i] == "\\":
            out.append(two)
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return "".join(out)


def match_all(text: Column, pattern: str, needs: str = "") -> Column:
    """array<struct<pos long, value string>>: all matches in turn, pos in UTF-8 bytes from 0; null text has none.

    A text without the literal ``needs``, or without any match of the pattern less its word boundaries, can have
    none; that is tried first, as boundaries are what costs time in a long text.
    """
    p = java_pattern(pattern)
    possible = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    if "\\b" in pattern:
        possible = possible & text.rlike(java_pattern(pattern.replace("\\b", "")))
    none = F.array().cast("array<struct<pos:bigint,value:string>>")

    def places(found: Column) -> Column:
        """Each match stands after the pieces and matches before it: one pass that carries the bytes so far."""
        parts = F.zip_with(F.slice(F.split(text, p, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        size = lambda c: F.octet_length(c).cast("long")
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        step = lambda s, x: F.struct(
            (s["at"] + size(x["gap"]) + size(x["m"])).alias("at"), F.array_append(s["out"], F.struct((s["at"] + size(x["gap"])).alias("pos"), x["m"].alias("value"))).alias("out")
        )
        return F.aggregate(parts, start, step, lambda s: s["out"])

    found = F.when(possible, F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.coalesce(let(found, lambda f: F.when(F.size(f) > 0, places(f)).otherwise(none)), none)
