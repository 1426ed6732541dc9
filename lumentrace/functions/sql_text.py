"""Detectors as SQL functions: columns of built-in functions written out as SQL and registered by name, for queries in SQL alone (section 2.15 of the survey)."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .pii import MATCH, all_matches, luhn_valid, ssn_valid
from .severity import is_flagged, severity_rank
from .text import hidden_path, looks_meaningful, real_domain, sentence_like

#: Functions whose names are signs or key words: Spark knows them by these names, in backticks.
_HEAD = re.compile(r"(?<![\w`'])(<=>|>=|<=|==|!=|[=<>+\-*/%!&|^~]|and|or|not|in)\(")


def sql_text(column: Column) -> str:
    """The SQL of a column that has only built-in functions; what it reads are names of columns or of a function's parameters."""
    told = column._jc.node().sql()
    parts = re.split(r"('(?:[^'\\]|\\.)*')", told, flags=re.S)
    return "".join(p if i % 2 else _HEAD.sub(r"`\1`(", p) for i, p in enumerate(parts))


def _name_matches(text: Column) -> Column:
    from ..operators.pii_scan import known_names

    told = lambda n: F.struct(
        F.lit(99).alias("ord"), F.lit("PERSON_NAME").alias("rule_id"), F.lit("Person name").alias("label"), n["pos"].alias("pos"), n["value"].alias("raw"), n["value"].alias("value"), F.lit("high").alias("base_severity"),
        F.lit("high").alias("severity"), F.lit(80).alias("importance"), F.lit(None).cast("boolean").alias("checksum_passed"), F.lit(None).cast("string").alias("context_matched"),
    )
    return F.transform(known_names(text), told).cast(MATCH)


def functions() -> dict[str, tuple[str, Column]]:
    """Name -> (result type, column over the parameter ``input``) of the functions of one text."""
    t = F.col("input")
    return {
        "detect_pii": (MATCH, F.concat(all_matches(t), _name_matches(t))), "is_luhn": ("boolean", luhn_valid(t)), "is_ssn": ("boolean", ssn_valid(t)), "is_hidden_path": ("boolean", hidden_path(t)),
        "is_sentence": ("boolean", sentence_like(t)), "is_real_domain": ("boolean", real_domain(t)), "severity_rank": ("int", severity_rank(t)), "is_flagged": ("boolean", is_flagged(t)),
        "reads_as_text": ("boolean", looks_meaningful(t.cast("binary"))),
    }


def register(spark: SparkSession, prefix: str = "lumentrace_") -> list[str]:
    """Registers the functions for the session's SQL, and the table function ``lumentrace_pii`` that gives a text's matches as rows, for use in LATERAL; returns their names."""
    names = []
    for name, (kind, column) in functions().items():
        spark.sql(f"create or replace temporary function {prefix}{name}(input string) returns {kind} return {sql_text(column)}")
        names.append(prefix + name)
    fields = [f.split(":") for f in MATCH.removeprefix("array<struct<").removesuffix(">>").split(",")]
    columns = ", ".join(f"{n} {k}" for n, k in fields)
    spark.sql(f"create or replace temporary function {prefix}pii(input string) returns table({columns}) return select {', '.join(f'm.{n}' for n, _ in fields)} from (select explode(found) as m from (select {prefix}detect_pii(input) as found))")
    return [*names, prefix + "pii"]
