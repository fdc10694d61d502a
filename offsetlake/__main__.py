"""python -m offsetlake: list and run queries, show a benchmark's result files."""

from __future__ import annotations

import argparse

from offsetlake.operators.benchmarks import best_against_baseline, text_table
from offsetlake.plans import catalog
from offsetlake.session import local_session, ship
from offsetlake.sources.artifacts import read_results


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="offsetlake", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names and what they compute")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet there instead of showing the first rows")
    report = commands.add_parser("report", help="results of a benchmark, and the best runs against the best baseline")
    report.add_argument("artifact")
    args = parser.parse_args(argv)
    if args.command == "queries":
        for name, f in sorted(catalog.QUERIES.items()):
            print(f"{name}: {f.__doc__.strip().splitlines()[0]}")
        return 0
    spark = ship(local_session())
    if args.command == "run":
        found = catalog.QUERIES[args.name](spark, args.folder)
        found.write.parquet(args.out) if args.out else found.show(truncate=False)
    else:
        results = read_results(spark, args.artifact).drop("artifact", "observations")
        print(text_table(results.orderBy("seq")))
        print(text_table(best_against_baseline(results).orderBy("workload", "ordering", "mode")))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
