"""PII over a table of texts: matches, names, scores and findings (PII-09..13, SEA-01..04)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import all_matches
from ..functions.regex import let, match_all
from ..functions.severity import finding
from .names import FORENAMES, SURNAMES

NAME_PATTERN = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"


def scan(df: DataFrame, id_col: str, text_col: str, rules: list[str] | None = None) -> DataFrame:
    """One row per match; all rules share one scan of the text."""
    return df.select(F.col(id_col), F.explode(all_matches(F.col(text_col), rules)).alias("m")).select(id_col, "m.*")


def person_names(df: DataFrame, id_col: str, text_col: str, forenames: list[str] | DataFrame | None = None, surnames: list[str] | DataFrame | None = None) -> DataFrame:
    """(id, pos, forename, surname): neighbouring capitalised words, both in the name lists (PII-09).

    Lists come as literals or as tables with a ``name`` column, compared in lower case.
    """
    rows = df.select(F.col(id_col), F.explode(match_all(F.col(text_col), NAME_PATTERN)).alias("m"))
    rows = rows.select(id_col, F.col("m.pos").alias("pos"), F.split("m.value", " ")[0].alias("forename"), F.split("m.value", " ")[1].alias("surname"))
    for col, names in (("forename", FORENAMES if forenames is None else forenames), ("surname", SURNAMES if surnames is None else surnames)):
        if isinstance(names, DataFrame):
            rows = rows.join(names.select(F.lower("name").alias("_name")).distinct(), F.lower(col) == F.col("_name"), "left_semi")
        else:
            rows = rows.where(F.lower(col).isin([n.lower() for n in names]))
    return rows


def known_names(text: Column) -> Column:
    """array<struct<pos, value>> of neighbouring capitalised words of which both are in the short name lists (PII-09)."""
    part = lambda n, i: F.get(F.split(n["value"], " "), F.lit(i))
    known = lambda n: F.lower(part(n, 0)).isin([x.lower() for x in FORENAMES]) & F.lower(part(n, 1)).isin([x.lower() for x in SURNAMES])
    return F.filter(match_all(text, NAME_PATTERN), known)


def merged(df: DataFrame, id_col: str, text_col: str, rules: list[str] | None = None) -> DataFrame:
    """Rule matches and names of each text by position, rules first (PII-10, PII-11); ``rank`` counts from 1."""
    told = lambda pos, order, rule, value, severity, importance: F.struct(
        pos.alias("pos"), order.alias("ord"), value.alias("value"), rule.alias("rule_id"), severity.alias("severity"), importance.alias("importance")
    )
    found = F.transform(all_matches(F.col(text_col), rules), lambda m: told(m["pos"], m["ord"], m["rule_id"], m["value"], m["severity"], m["importance"]))
    if rules is None or "PERSON_NAME" in rules:
        names = F.transform(known_names(F.col(text_col)), lambda n: told(n["pos"], F.lit(99), F.lit("PERSON_NAME"), n["value"], F.lit("high"), F.lit(80)))
        found = F.concat(found, names)
    # a text's matches are sorted in its row: nothing is shuffled
    rows = df.select(F.col(id_col), F.posexplode(F.array_sort(found)).alias("rank", "m"))
    return rows.select(id_col, "m.pos", "m.ord", "m.rule_id", "m.value", "m.severity", "m.importance", (F.col("rank") + 1).alias("rank"))


def document_score(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of each text."""
    return df.select(F.col(id_col), decode_score(F.col(text_col)).alias("score"))


def decode_score(text: Column) -> Column:
    """How much a text looks like one with personal data, 0 to 0.15 (PII-12, AGG-02): each rule's first match counts once."""
    m = all_matches(text)
    both = known_names(text)
    first = let(m, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["rule_id"] != x["rule_id"])))
    weight = lambda x: (
        x["importance"] * F.when(x["context_matched"].isNotNull(), 1.3).otherwise(1.0)
        * F.when(F.coalesce(x["checksum_passed"], F.lit(False)) & (x["base_severity"] == "critical"), 1.2).otherwise(1.0)
    )
    total = F.aggregate(first, F.lit(0.0), lambda s, x: s + weight(x)) + 60.0 * F.size(both)
    return F.coalesce(F.least(total, F.lit(150.0)) / 1000, F.lit(0.0))


def _match_finding(m, location: Column, note: Column | str = "") -> list[Column]:
    """The columns of a match's finding; ``m`` gives a field of the match by name."""
    shown = ("base_severity", "checksum_passed", "context_matched", "position", "rule_id", "value")
    return finding(
        "storage", F.concat(F.lit("pii_"), F.lower(m("rule_id"))), F.concat(m("label"), F.lit(" detected"), _suffix(note)), m("severity"),
        F.concat(F.lit("Matched value (redacted): "), m("value")), location,
        evidence=F.map_from_arrays(F.array(*map(F.lit, shown)), F.array(m("base_severity"), m("checksum_passed").cast("string"), m("context_matched"), m("pos").cast("string"), m("rule_id"), m("value"))),
        tags=["pii"],
    )


def _name_finding(pos: Column, forename: Column, surname: Column, location: Column, note: Column | str = "") -> list[Column]:
    hidden = F.concat(forename, F.lit(" "), F.left(surname, F.lit(1)), F.lit("****"))
    return finding("storage", "pii_person_name", F.concat(F.lit("Person name detected"), _suffix(note)), "medium", F.concat(F.lit("Possible name: "), hidden), location, evidence=F.create_map(F.lit("position"), pos.cast("string")), tags=["pii"])


def _suffix(note: Column | str) -> Column:
    """Where a text came from, if it isn't the source itself."""
    return F.lit(f" [{note}]" if note else "") if isinstance(note, str) else F.concat(F.lit(" ["), note, F.lit("]"))


def findings(df: DataFrame, id_col: str, text_col: str, rules: list[str] | None = None, note: str = "") -> DataFrame:
    """PII matches as findings (PII-13); names show the surname's first letter only."""
    rows = scan(df, id_col, text_col, rules).select(*_match_finding(F.col, F.col(id_col), note))
    if rules is not None and "PERSON_NAME" not in rules:
        return rows
    names = person_names(df, id_col, text_col).select(*_name_finding(F.col("pos"), F.col("forename"), F.col("surname"), F.col(id_col), note))
    return rows.unionByName(names)


def finding_array(text: Column, location: Column, rules: list[str] | None = None, note: Column | str = "") -> Column:
    """The same findings of one text as an array of structs, for plans that can't afford another pass over what made the text."""
    out = F.transform(all_matches(text, rules), lambda m: F.struct(*_match_finding(m.getItem, location, note)))
    if rules is not None and "PERSON_NAME" not in rules:
        return out
    part = lambda n, i: F.get(F.split(n["value"], " "), F.lit(i))
    return F.concat(out, F.transform(known_names(text), lambda n: F.struct(*_name_finding(n["pos"], part(n, 0), part(n, 1), location, note))))


@dataclass(frozen=True)
class Variant:
    label: str
    text: str
    confidence: str


def name_variants(first: str = "", middle: str = "", last: str = "") -> list[Variant]:
    """The ways a name may be written, surest first (SEA-01); needs a first or a last name."""
    first, middle, last = first.strip(), middle.strip(), last.strip()
    if not first and not last:
        raise ValueError("a first or a last name is needed")
    f, m = first[:1], middle[:1]
    forms: list[tuple[str, str, str]] = []
    if first and last:
        if middle:
            forms += [
                ("First Middle Last", f"{first} {middle} {last}", "high"), ("First M. Last", f"{first} {m}. {last}", "high"),
                ("Last, First Middle", f"{last}, {first} {middle}", "high"), ("Last, First M.", f"{last}, {first} {m}.", "high"),
            ]
        forms += [
            ("First Last", f"{first} {last}", "high"), ("Last, First", f"{last}, {first}", "high"), ("F. Last", f"{f}. {last}", "medium"),
            ("Last, F.", f"{last}, {f}.", "medium"), ("First L.", f"{first} {last[:1]}.", "low"),
        ]
    else:
        forms.append(("First only", first, "low") if first else ("Last only", last, "low"))
    seen: dict[str, Variant] = {}
    for label, text, confidence in forms:
        seen.setdefault(text, Variant(label, text, confidence))
    return list(seen.values())


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_ ,])", r"\\\1", text)


def variant_matches(text: Column, variants: list[Variant]) -> Column:
    """array<struct<pos, less, i, value, label, confidence>> of a text, by place: sorted, the first at each place is the one that counts."""

    def told(v: Variant, i: int):
        return lambda m: F.struct(m["pos"].alias("pos"), (-F.octet_length(m["value"])).alias("less"), F.lit(i).alias("i"), m["value"].alias("value"), F.lit(v.label).alias("label"), F.lit(v.confidence).alias("confidence"))

    arrays = [F.transform(match_all(text, rf"(?i)\b{_quoted(v.text)}\b"), told(v, i)) for i, v in enumerate(variants)]
    return let(F.array_sort(F.concat(*arrays)), lambda a: F.filter(a, lambda x, n: (n == 0) | (F.get(a, n - 1)["pos"] != x["pos"])))


def search_variants(df: DataFrame, id_col: str, text_col: str, variants: list[Variant]) -> DataFrame:
    """(id, pos, value, label, confidence): the longest match at each place, the earlier variant of equals (SEA-02)."""
    return df.select(F.col(id_col), F.explode(variant_matches(F.col(text_col), variants)).alias("m")).select(id_col, F.col("m.pos").alias("pos"), F.col("m.value").alias("value"), F.col("m.label").alias("label"), F.col("m.confidence").alias("confidence"))


def search_term(df: DataFrame, id_col: str, text_col: str, term: str, is_regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(id, pos, value) of a term."""
    return df.select(F.col(id_col), F.explode(term_matches(F.col(text_col), term, is_regex, case_sensitive)).alias("m")).select(id_col, "m.*")


def term_matches(text: Column, term: str, is_regex: bool = False, case_sensitive: bool = False) -> Column:
    """array<struct<pos, value>> of a literal or a pattern; a pattern that doesn't compile raises ValueError (SEA-03)."""
    pattern = term if is_regex else _quoted(term)
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {term!r}: {e}") from e
    return match_all(text, pattern if case_sensitive else "(?i)" + pattern)


def search_finding_array(text: Column, location: Column, names: list[tuple[str, str, str]] = (), terms: list[dict] = ()) -> Column | None:
    """Custom searches of one text as an array of findings (SEA-04): names at their variant's tier, terms at medium; None without any."""

    def found(subtype: str, title, severity):
        return lambda m: F.struct(
            *finding("storage", subtype, title(m), severity(m), F.concat(F.lit("Matched: "), m["value"]), location, evidence=F.create_map(F.lit("position"), m["pos"].cast("string")), tags=["custom_search"])
        )

    by_name = found("custom_name_search", lambda m: F.concat(F.lit("Name match: "), m["label"]), lambda m: m["confidence"])
    by_term = found("custom_term_search", lambda m: F.lit("Custom term match"), lambda m: F.lit("medium"))
    arrays = [F.transform(variant_matches(text, name_variants(*n)), by_name) for n in names] + [F.transform(term_matches(text, **t), by_term) for t in terms]
    return F.concat(*arrays) if arrays else None


def search_findings(df: DataFrame, id_col: str, text_col: str, names: list[tuple[str, str, str]] = (), terms: list[dict] = ()) -> DataFrame | None:
    """The same as rows."""
    every = search_finding_array(F.col(text_col), F.col(id_col), names, terms)
    return None if every is None else df.select(F.explode(every).alias("f")).select("f.*")
