"""python -m surveyloom QUERY SF_DIR: runs a query of the catalogue; with --list, names them."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="surveyloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query and show or write its rows")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out")
    summarize = sub.add_parser("summarize", help="summary of a cohort's CSV, as JSON")
    summarize.add_argument("cohort")
    profiles = sub.add_parser("profiles", help="sample profiles from a summary")
    profiles.add_argument("summary")
    profiles.add_argument("out")
    profiles.add_argument("--n", type=int, required=True)
    profiles.add_argument("--seed", type=int, default=42)
    profiles.add_argument("--independent", action="store_true")
    evaluate = sub.add_parser("evaluate", help="fidelity and proximity of a synthetic table")
    evaluate.add_argument("cohort")
    evaluate.add_argument("synthetic")
    args = parser.parse_args(argv)
    from surveyloom.plans.catalogue import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("surveyloom").getOrCreate()
    try:
        return execute(spark, args)
    except ValueError as e:
        print(f"surveyloom: {e}", file=sys.stderr)
        return 2


def execute(spark, args) -> int:
    import json

    from surveyloom.operators import copula, summaries
    from surveyloom.plans import matrix
    from surveyloom.plans.catalogue import QUERIES
    from surveyloom.sources import tables

    if args.command == "run":
        if args.query not in QUERIES:
            raise ValueError(f"no query {args.query}")
        rows = QUERIES[args.query](spark, args.tables)
        tables.write_new(rows, args.out) if args.out else rows.show(truncate=False)
    elif args.command == "summarize":
        print(json.dumps(summaries.cohort_summary(tables.read_cohort(spark, args.cohort)), indent=1))
    elif args.command == "profiles":
        made = copula.profiles(spark, tables.read_documents(args.summary), args.n, args.seed, dependence="independent" if args.independent else "copula")
        tables.write_new(made, args.out, "json")
    else:
        matrix.evaluation(tables.read_cohort(spark, args.cohort), {"run": tables.read_responses(spark, args.synthetic)}).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
