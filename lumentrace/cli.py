"""Command line: scan a target, filter by severity, write JSON (SNK-01, SNK-02)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.severity import min_severity
from .operators.report import flagged_only, write_json
from .plans.scan import scan_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumentrace", description="Scan files for personal data, encodings, ciphers and mismatched types.")
    p.add_argument("--target", required=True, help="file or folder")
    p.add_argument("--output", help="folder for findings and summary; standard output without it")
    p.add_argument("--min-severity", default="", help="least severity shown; overrides --flagged-only")
    p.add_argument("--flagged-only", action="store_true", help="only findings above info")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lumentrace").getOrCreate()
    found = scan_files(spark, a.target)
    if a.min_severity:
        found = min_severity(found, a.min_severity)
    elif a.flagged_only:
        found = flagged_only(found)
    if a.output:
        write_json(found, a.output)
    else:
        for row in found.toJSON().toLocalIterator():
            sys.stdout.write(row + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
