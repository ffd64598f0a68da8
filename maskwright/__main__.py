"""Redacts documents on a cluster: spark-submit maskwright/__main__.py IN -o OUT, or python -m maskwright."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright", description="Replaces personal data by consistent fakes.")
    p.add_argument("source", help="a folder of .docx files, or a table of doc_id and text as Parquet")
    p.add_argument("-o", "--output", required=True, help="a new folder for what is redacted")
    p.add_argument("--mode", choices=("regex", "hybrid"), default="hybrid")
    p.add_argument("--skip", nargs="*", default=[], metavar="LABEL", help="labels that stay as they are")
    p.add_argument("--seed", default="maskwright")
    p.add_argument("--no-images", action="store_true")
    p.add_argument("--audit", metavar="FOLDER", help="also write all changes as JSON; originals stay out without --with-originals")
    p.add_argument("--with-originals", action="store_true")
    p.add_argument("--docx", action="store_true", help="the source is a folder of .docx files")
    p.add_argument("--most-bytes", type=int, help="skip larger .docx files")
    return p


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    from pyspark.sql import SparkSession

    from maskwright.deploy import Stages
    from maskwright.operators.detect import Policy
    from maskwright.operators.redact import counts, redact
    from maskwright.sources import docx, json_files

    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    policy = Policy(mode=args.mode, skip_labels=frozenset(args.skip), seed=args.seed, images=not args.no_images)
    with Stages(spark, "cli") as stages:
        if args.docx:
            files, audited, pictures = docx.redact_docx(docx.read_docx(spark, args.source, args.most_bytes), policy, stages=stages)
            written = stages.write(docx.write_docx(files, args.output))
            for label, n in counts(audited).collect():  # a row for each label
                print(f"{label}\t{n}")
            print(f"pictures\t{pictures.count()}\nfiles\t{written.where('error is null').count()}\nfailed\t{written.where('error is not null').count()}")
            if args.audit:
                json_files.write_audit(audited, args.audit, args.with_originals)
        else:
            if args.audit:
                raise SystemExit("--audit goes with --docx")
            redact(spark.read.parquet(args.source), policy, stages=stages).write.parquet(args.output)
    return 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    raise SystemExit(main())
