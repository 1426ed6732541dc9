"""Byte entropy: Arrow for throughput, and a form in built-in functions (ENT-01..03)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon(data: bytes) -> float:
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum()) + 0.0


def entropy(content: Column) -> Column:
    """Bits per byte of a binary column; 0 for no bytes, null for null (ENT-01)."""

    @F.pandas_udf("double")
    def bits(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else shannon(b)).astype("float64")

    return bits(content)


def profile(content: Column, least: int, size: int, least_window: int) -> Column:
    """struct<bits, windows array<double>>: bits per byte of a content and, from ``least`` bytes on, of its windows of ``size``, a last one of fewer than ``least_window`` left out."""

    def told(b: bytes) -> list[float]:
        return [shannon(b[i : i + size]) for i in range(0, len(b), size) if len(b) - i >= least_window] if len(b) >= least else []

    @F.pandas_udf("bits double, windows array<double>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"bits": s.map(lambda b: None if b is None else shannon(b)).astype("float64"), "windows": s.map(lambda b: [] if b is None else told(b))})

    return run(content)


def band(bits: Column) -> Column:
    """What so many bits per byte are typical of (ENT-03)."""
    return F.when(bits < 4, "low").when(bits < 5.5, "plaintext").when(bits < 7, "executable").when(bits < 7.9, "compressed").otherwise("encrypted")


def high_entropy(content: Column, bits: Column) -> Column:
    """24 bytes or more at 4.6 bits or more (ENT-02)."""
    return (F.octet_length(content) >= 24) & (bits >= 4.6)
