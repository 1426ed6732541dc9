"""PII rules as expressions: checksums, context, redaction (PII-01..08, PII-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import match_all
from .severity import step
from .tables import PII_RULES

RULES = {r["id"]: r for r in PII_RULES}
CONTEXT_BYTES = 40
#: Literals without which a rule can't match.
NEEDS = {"EMAIL": "@", "PRIVATE_KEY_BLOCK": "PRIVATE KEY-----"}
MATCH = "array<struct<ord:int,rule_id:string,label:string,pos:bigint,raw:string,value:string,base_severity:string,severity:string,importance:int,checksum_passed:boolean,context_matched:string>>"


def luhn_valid(digits: Column) -> Column:
    """Luhn check of a string of digits; fewer than two are invalid (PII-04)."""
    return (F.length(digits) >= 2) & F.call_function("luhn_check", F.when(F.length(digits) >= 2, digits).otherwise(F.lit("1")))


def ssn_valid(digits: Column) -> Column:
    """Nine digits whose area isn't 000, 666 or 9xx, group not 00 and serial not 0000 (PII-05)."""
    area = F.substring(digits, 1, 3)
    return (
        (F.length(digits) == 9) & ~area.isin("000", "666") & (F.substring(digits, 1, 1) != "9")
        & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    )


def checksum(kind: str, value: Column, low: int = 0, high: int = 0) -> Column:
    """Tri-state: null where a rule has no checksum, true for kinds unknown here (PII-03)."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind in ("", "none"):
        return F.lit(None).cast("boolean")
    if kind == "luhn":
        enough = F.lit(True)
        if low:
            enough = enough & (F.length(digits) >= low)
        if high:
            enough = enough & (F.length(digits) <= high)
        return enough & luhn_valid(digits)
    return ssn_valid(digits) if kind == "ssn_us" else F.lit(True)


def redact(rule_id: str, value: Column) -> Column:
    """What a report may show of a match (PII-08)."""
    n = F.octet_length(value)
    if rule_id in ("CREDIT_CARD", "SSN_US", "SIN_CA"):
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.length(digits) >= 4, F.concat(F.repeat(F.lit("*"), F.length(digits) - 4), F.right(digits, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))
    if rule_id == "EMAIL":
        at = F.instr(value, "@")
        return F.when(at > 2, F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), at - 2), F.substring(value, at, F.length(value)))).otherwise(value)
    return F.when(n > 6, F.concat(F.left(value, F.lit(3)), F.repeat(F.lit("*"), n - 3))).otherwise(F.repeat(F.lit("*"), n))


def context(lower_bytes: Column, pos: Column, value: Column, keywords: dict[str, list[str]]) -> Column:
    """``lang:keyword`` of the first keyword (by language, then order) within 40 bytes of a match, else null (PII-07)."""
    start = F.greatest(pos - CONTEXT_BYTES, F.lit(0))
    stop = F.least(pos + F.octet_length(value) + CONTEXT_BYTES, F.octet_length(lower_bytes))
    window = F.substring(lower_bytes, (start + 1).cast("int"), (stop - start).cast("int"))
    out = F.lit(None).cast("string")
    for lang, word in reversed([(lang, w) for lang in sorted(keywords) for w in keywords[lang]]):
        out = F.when(F.contains(window, F.encode(F.lit(word.lower()), "UTF-8")), f"{lang}:{word}").otherwise(out)
    return out


def rule_matches(text: Column, rule_id: str, order: int = 0) -> Column:
    """All matches of one rule (PII-01): position, redacted value, severities, checksum and context."""
    r = RULES[rule_id]
    low = F.encode(F.lower(text), "UTF-8")

    def told(m: Column) -> Column:
        passed = checksum(r["checksum"], m["value"], r["min_digits"], r["max_digits"])
        near = context(low, m["pos"], m["value"], r["context_keywords"])
        base = F.lit(r["severity"])
        checked = F.when(passed == False, step(base, -1)).otherwise(base)  # noqa: E712
        severity = F.when(near.isNotNull(), step(checked, 1)).otherwise(checked)
        return F.struct(
            F.lit(order).alias("ord"), F.lit(rule_id).alias("rule_id"), F.lit(r["label"]).alias("label"), m["pos"].alias("pos"), m["value"].alias("raw"),
            redact(rule_id, m["value"]).alias("value"), base.alias("base_severity"), severity.alias("severity"),
            F.lit(r["importance_score"]).alias("importance"), passed.alias("checksum_passed"), near.alias("context_matched"),
        )

    return F.transform(match_all(text, r["pattern"], NEEDS.get(rule_id, "")), told).cast(MATCH)


def all_matches(text: Column, rules: list[str] | None = None) -> Column:
    """Matches of the chosen rules (all by default), in rule order, then by position; rules left out cost nothing (FIL-06)."""
    chosen = [i for i in RULES if rules is None or i in rules]
    if not chosen:
        return F.array().cast(MATCH)
    return F.concat(*[rule_matches(text, i, list(RULES).index(i)) for i in chosen])
