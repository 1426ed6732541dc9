"""Files of any size by ranges of bytes, each a row and a task's work: windows and whole entropy of contents that no binary cell holds (ENT-04, ENT-05)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import shannon
from ..operators.entropy_windows import LEAST_WINDOW, WINDOW, spike
from .walk import file_range

#: Bytes of a range: a whole number of windows, so that none lies in two ranges.
RANGE = 16 << 20


def byte_ranges(walked: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, start, stop) of all readable files of ``walk``, cut every ``size`` bytes; empty files have none."""
    rows = walked.where("error is null and length > 0")
    return rows.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start")).select("path", "start", F.least(F.col("start") + size, "length").alias("stop"))


def profiles(walked: DataFrame, target: str, size: int = RANGE, window: int = WINDOW, tasks: int | None = None) -> DataFrame:
    """(path, start, windows array<struct<offset, entropy>>, counts array<long>): entropy by windows and counts of bytes of each range.

    A file's last window of fewer than 64 bytes is left out. Ranges are dealt anew, so one large file is many tasks. What can't be read any more has no row.
    """
    if size % window:
        raise ValueError("a range is a whole number of windows")
    ranges = byte_ranges(walked, size)
    ranges = ranges.repartition(tasks, "path", "start") if tasks else ranges.repartition("path", "start")
    kind = "path string, start long, windows array<struct<offset:bigint,entropy:double>>, counts array<bigint>"
    pair = pa.struct([("offset", pa.int64()), ("entropy", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stop in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    data = file_range(target, path, start, stop)
                except OSError:
                    continue
                found = [{"offset": start + at, "entropy": shannon(data[at : at + window])} for at in range(0, len(data), window) if len(data) - at >= LEAST_WINDOW]
                counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([found], pa.list_(pair)), pa.array([counts], pa.list_(pa.int64()))], names=["path", "start", "windows", "counts"])

    return ranges.mapInArrow(run, kind)


def windows(profiled: DataFrame) -> DataFrame:
    """(path, offset, entropy): the windows of whole files, as ``entropy_windows.windows`` gives them of contents in one cell."""
    return profiled.select("path", F.explode("windows").alias("w")).select("path", "w.*")


def whole_entropy(profiled: DataFrame) -> DataFrame:
    """(path, length, bits): bits per byte of whole files, from the counts of their ranges."""
    counts = profiled.select("path", F.posexplode("counts").alias("byte", "n")).groupBy("path", "byte").agg(F.sum("n").alias("n"))
    total = counts.groupBy("path").agg(F.sum("n").alias("length"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")).otherwise(0.0)).alias("s"))
    return total.select("path", "length", F.greatest(F.log2("length") - F.col("s") / F.col("length"), F.lit(0.0)).alias("bits"))


def spikes(profiled: DataFrame) -> DataFrame:
    """(path, offset, before, after) of files with a sudden rise; a file's entropies, sixteen bytes a window, meet in one row."""
    rows = profiled.groupBy("path").agg(F.sort_array(F.flatten(F.collect_list("windows"))).alias("w"))
    return rows.select("path", spike(F.col("w")).alias("s")).where("s is not null").select("path", "s.*")
