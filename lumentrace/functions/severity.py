"""Severities, categories and the finding record (FIL-01..03, PII-06, section 1 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = ["software", "hardware", "storage", "network", "users"]
SEVERITIES = ["clean", "info", "low", "medium", "high", "critical"]
#: What a failed checksum lowers and a context hit raises by one step.
STEPS = ["info", "low", "medium", "high", "critical"]

FINDING = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("category", "subtype", "title", "severity", "detail", "source", "location", "language")]
    + [T.StructField("evidence", T.MapType(T.StringType(), T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))]
)


def severity_rank(severity: Column) -> Column:
    """0 for clean, info and unknown words, then 1 to 4 (FIL-01)."""
    rank = F.lit(0)
    for i, s in enumerate(["low", "medium", "high", "critical"], 1):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def is_flagged(severity: Column) -> Column:
    """Whether a severity ranks above zero (FIL-03)."""
    return F.coalesce(severity.isin("low", "medium", "high", "critical"), F.lit(False))


def step(severity: Column, by: int) -> Column:
    """One step up (1) or down (-1), saturating; words outside the order stay (PII-06)."""
    out = severity
    for i, s in enumerate(STEPS):
        out = F.when(severity == s, F.lit(STEPS[min(len(STEPS) - 1, max(0, i + by))])).otherwise(out)
    return out


def min_severity(findings: DataFrame, least: str | None) -> DataFrame:
    """Findings that rank at least as high; an unknown word or one of rank zero filters nothing (FIL-02)."""
    rank = {"low": 1, "medium": 2, "high": 3, "critical": 4}.get(least or "", 0)
    return findings.where(severity_rank(F.col("severity")) >= rank) if rank else findings


def finding(
    category: str, subtype: Column | str, title: Column | str, severity: Column | str, detail: Column | str, location: Column,
    source: str = "storage_scan", language: Column | None = None, evidence: Column | None = None, tags: list[str] | None = None,
) -> list[Column]:
    """The columns of a finding; strings are literals."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [
        F.lit(category).alias("category"), lit(subtype).alias("subtype"), lit(title).alias("title"), lit(severity).alias("severity"),
        lit(detail).alias("detail"), F.lit(source).alias("source"), location.cast("string").alias("location"),
        (language if language is not None else F.lit(None).cast("string")).alias("language"),
        (evidence if evidence is not None else F.create_map().cast("map<string,string>")).alias("evidence"),
        F.array(*[F.lit(t) for t in tags or []]).cast("array<string>").alias("tags"),
    ]
