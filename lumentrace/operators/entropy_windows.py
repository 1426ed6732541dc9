"""Entropy by fixed windows of bytes, and sudden rises (ENT-04..07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import band, entropy, high_entropy, profile
from ..functions.regex import let
from ..functions.severity import finding

WINDOW, LEAST_WINDOW, LEAST_FILE = 4096, 64, 16 * 1024


def windows(df: DataFrame, id_col: str, content_col: str, size: int = WINDOW) -> DataFrame:
    """(id, offset, entropy) per window; a last piece of fewer than 64 bytes is left out (ENT-04)."""
    n = F.octet_length(content_col)
    starts = F.when(n >= LEAST_WINDOW, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = df.select(F.col(id_col), F.col(content_col), F.explode(starts).alias("offset"))
    rows = rows.select(id_col, "offset", F.substring(F.col(content_col), F.col("offset") + 1, F.lit(size)).alias("_w")).where(F.octet_length("_w") >= LEAST_WINDOW)
    return rows.select(id_col, F.col("offset").cast("long").alias("offset"), entropy(F.col("_w")).alias("entropy"))


def spike(windows: Column) -> Column:
    """struct<offset, before, after> of a text's windows array<struct<offset, entropy>>, else null: of four windows or more, the first of the later half
    that is 1.5 bits above the upper median of the earlier half, compressed or encrypted in kind, over a median below 7 (ENT-05).
    """
    half = F.floor(F.size(windows) / 2).cast("int")
    early = F.array_sort(F.transform(F.slice(windows, F.lit(1), half), lambda x: x["entropy"]))
    late = F.slice(windows, half + 1, F.greatest(F.size(windows), F.lit(1)))

    def told(before: Column) -> Column:
        first = F.get(F.filter(late, lambda x: (x["entropy"] - before >= 1.5) & band(x["entropy"]).isin("compressed", "encrypted")), F.lit(0))
        return F.when((before < 7) & first.isNotNull(), F.struct(first["offset"].alias("offset"), before.alias("before"), first["entropy"].alias("after")))

    return F.when(F.size(windows) >= 4, let(F.get(early, F.floor(half / 2).cast("int")), told))


def spikes(found: DataFrame, id_col: str) -> DataFrame:
    """(id, offset, before, after) from ``windows``: each row's ``spike``, where it has one."""
    rows = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("offset", "entropy"))).alias("w"))
    return rows.select(id_col, spike(F.col("w")).alias("s")).where("s is not null").select(id_col, "s.*")


def finding_array(content: Column, profile: Column, location: Column) -> Column:
    """Whole-content entropy and a spike of contents of 16 KiB or more as an array of findings (ENT-06, ENT-07); ``profile`` is the content's as a column."""
    bits = profile["bits"]
    whole = finding(
        "storage", "high_entropy_content", "High-entropy content", "low", F.concat(F.format_number(bits, 2), F.lit(" bits/byte ("), band(bits), F.lit(")")), location,
        evidence=F.create_map(F.lit("entropy"), F.round(bits, 6).cast("string"), F.lit("band"), band(bits)), tags=["entropy"],
    )
    at = F.transform(profile["windows"], lambda e, i: F.struct((i * WINDOW).cast("long").alias("offset"), e.alias("entropy")))

    def rise(s: Column) -> Column:
        told = finding(
            "storage", "entropy_spike", "Entropy spike", "high",
            F.concat(F.lit("From "), F.format_number(s["before"], 2), F.lit(" to "), F.format_number(s["after"], 2), F.lit(" bits/byte at byte "), s["offset"].cast("string")), location,
            evidence=F.create_map(F.lit("offset"), s["offset"].cast("string")), tags=["entropy"],
        )
        return F.when(s.isNotNull(), F.struct(*told))

    return F.array_compact(F.array(F.when(high_entropy(content, bits), F.struct(*whole)), let(spike(at), rise)))


def findings(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """The same as rows."""
    rows = df.select(F.col(id_col), F.col(content_col), profile(F.col(content_col), LEAST_FILE, WINDOW, LEAST_WINDOW).alias("_p"))
    return rows.select(F.explode(finding_array(F.col(content_col), F.col("_p"), F.col(id_col))).alias("f")).select("f.*")
