"""spark-submit folioscan/cli.py verify|convert|meta FOLDER [--profile a_1b] [--out FOLDER]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str]) -> int:
    """verify: a line for each file, and the totals; the exit code is 1 if any file isn't valid. convert: writes the
    mended files as rows of content to --out."""
    from folioscan.operators.convert import convert
    from folioscan.operators.results import summary
    from folioscan.operators.rules import verify
    from folioscan.plans.catalog import profiles
    from folioscan.sources.pdf import files_meta, read_files

    p = argparse.ArgumentParser()
    p.add_argument("command", choices=["verify", "convert", "meta"])
    p.add_argument("folder")
    p.add_argument("--profile", default="a_1b", choices=sorted(profiles()))
    p.add_argument("--out")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("folioscan").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    files = read_files(spark, a.folder)
    if a.command == "meta":
        meta = files_meta(files).drop("xmp")
        if a.out:
            meta.write.mode("overwrite").parquet(a.out)
        for r in meta.toLocalIterator():
            print(f"{r.file_id} {r.version} {r.pages} pages, part {r.part}{r.conformance or ''} {dict(r.info or {})}")
        return 0
    if a.command == "verify":
        issues, results = verify(files, a.profile)
        report = results.join(files.select("file_id", "path"), "file_id").join(summary(issues), "file_id", "left").orderBy("path")
    else:
        mended, results, issues = convert(files, a.profile)
        if a.out:
            mended.write.mode("overwrite").parquet(a.out)
        report = results.join(files.select("file_id", "path"), "file_id").join(summary(issues), "file_id", "left").orderBy("path")
    if a.out and a.command == "verify":
        report.write.mode("overwrite").parquet(a.out)
    totals = results.agg(F.count(F.lit(1)).alias("files"), F.count_if("valid").alias("valid"), F.sum("n_issues").alias("issues")).first()
    for r in report.toLocalIterator():  # a partition at a time
        print(f"{'PASS' if r.valid else 'FAIL'} {r.path}" + (f"\n{r.report}" if r.report else ""))
    print(f"{totals.files} files, {totals.valid} valid, {totals.issues or 0} issues")
    return int(totals.valid != totals.files)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
