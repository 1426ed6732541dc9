"""The stateless detectors over a stream, and windowed counts of what they find."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as (path, text, seen_at)."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.current_timestamp().alias("seen_at"))


def pii_stream(texts: DataFrame, id_col: str = "path", text_col: str = "text", time_col: str = "seen_at") -> DataFrame:
    """(id, time, rule_id, pos, value, severity) of a stream of texts: the batch operator's expressions."""
    from ..functions.pii import all_matches

    return texts.select(F.col(id_col), F.col(time_col), F.explode(all_matches(F.col(text_col))).alias("m")).select(id_col, time_col, "m.rule_id", "m.pos", "m.value", "m.severity")


def changed_files(texts: DataFrame, path_col: str = "path", text_col: str = "text", time_col: str = "seen_at") -> DataFrame:
    """(path, text, time) of files that are new or whose text has changed, each version once.

    The state of a path is its last version's digest and time, however often it is seen again. A version that arrives late, after a
    newer one of its path, is passed over; versions within one batch are taken in the order of their times. Null texts count as empty.
    """
    rows = texts.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(time_col).alias("seen_at"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).where("path is not null and seen_at is not null")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, last = state.get if state.exists else (None, None)
        out = []
        for part in sorted((r for p in parts for r in p.itertuples(index=False)), key=lambda r: (r.seen_at, r.digest)):
            if last is None or part.seen_at >= last:
                if part.digest != digest:
                    out.append((key[0], part.text, part.seen_at))
                digest, last = part.digest, part.seen_at
        if last is not None:
            state.update((digest, last))
        yield pd.DataFrame(out, columns=["path", "text", "seen_at"])

    return rows.groupBy("path").applyInPandasWithState(step, "path string, text string, seen_at timestamp", "digest string, seen_at timestamp", "append", GroupStateTimeout.NoTimeout)


def changed_findings(texts: DataFrame, path_col: str = "path", text_col: str = "text", time_col: str = "seen_at") -> DataFrame:
    """The PII matches of ``changed_files``: of each version of a file once."""
    return pii_stream(changed_files(texts, path_col, text_col, time_col), "path", "text", "seen_at")


def severity_counts(matches: DataFrame, time_col: str = "seen_at", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and severity; rows later than the watermark are dropped, as it says."""
    return matches.withWatermark(time_col, late).groupBy(F.window(time_col, window), "severity").agg(F.count("*").alias("n")).select("window.start", "window.end", "severity", "n")


def write_findings(matches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends matches as JSON; the checkpoint makes a restart go on where it ended."""
    return matches.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


