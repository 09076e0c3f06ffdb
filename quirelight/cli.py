"""python -m quirelight.cli issues|verify ORIGINAL_DIR TRANSLATED_DIR [REPORT]: the two audits of a folder of chapters against its translation."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import chapters as C
from .operators import checks as K
from .plans import reports as R
from .sources.files import read_chapters


def main(argv: list[str] | None = None) -> int:
    """0, or 1 where a folder is missing."""
    parser = argparse.ArgumentParser(prog="quirelight", description=__doc__)
    parser.add_argument("audit", choices=["issues", "verify"])
    parser.add_argument("original")
    parser.add_argument("translated")
    parser.add_argument("report", nargs="?")
    args = parser.parse_args(argv)
    for label, folder in (("Original", args.original), ("Translated", args.translated)):
        if not Path(folder).is_dir():
            print(f"Error: {label} directory not found: {folder}", file=sys.stderr)
            return 1
    spark = SparkSession.builder.getOrCreate()
    original, translated = read_chapters(spark, args.original), read_chapters(spark, args.translated)
    now = datetime.datetime.now().isoformat()
    if args.audit == "issues":
        paired = C.pairs(original, translated)
        issues = K.all_issues(paired)
        text, path = R.issue_report(issues, paired, now), args.report or "quality_report.md"
        total = R.issue_summary(issues, paired).first()
    else:
        results = K.all_results(original, translated)
        text, path = R.verification_report(results, now), args.report or "detailed_verification_report.md"
        total = R.verification_summary(results).first()
    Path(path).write_text(text, encoding="utf-8")
    print(f"{path}: " + ", ".join(f"{k} {v}" for k, v in total.asDict().items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
