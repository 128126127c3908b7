"""Command line: ``python -m millrace.plans.cli preprocess|evaluate|augment ...``."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from millrace.operators import augment
from millrace.plans import evaluate, preprocess
from millrace.session import table
from millrace.sources import writers


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("preprocess", "evaluate", "augment"):
        p = sub.add_parser(name)
        p.add_argument("tables", help="folder of the parquet tables")
        p.add_argument("out", help="folder to write to")
        p.add_argument("--force", action="store_true", help="write again where the folder exists")
        p.add_argument("--threshold", type=float, default=0.85, help="similarity of near-duplicates")
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--detector", help="module:function of (session, folder of the tables) that gives a function adding the column detected to the records")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "preprocess":
        module, _, name = (args.detector or "").partition(":")
        detector = getattr(importlib.import_module(module), name)(spark, args.tables) if name else None
        out, audited = preprocess.run(table(spark, args.tables, "instruction_records"), args.threshold, detector=detector)
        print(writers.report("Categories of the records kept", audited.orderBy("category")))
    elif args.command == "evaluate":
        out = evaluate.scored(table(spark, args.tables, "model_responses"), table(spark, args.tables, "eval_prompts"))
    else:
        df = table(spark, args.tables, "instruction_records").where("winner_prompt IS NOT NULL")
        out = augment.threefold(df, augment.lexical_rows(df, "winner_prompt", "added_constraint", {}, seed=args.seed))
    print(writers.once(out, args.out, args.force))


if __name__ == "__main__":
    main()
