"""Command line: ``python -m cuewright.cli run NAME DIR [--out PATH]`` and ``python -m cuewright.cli list``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cuewright.plans import registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cuewright", description="Run a query of the library over a folder of Parquet tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query; without --out, show its first rows")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("directory")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=("parquet", "json", "csv", "text"))
    args = parser.parse_args(argv)
    if args.command == "list":
        print(*sorted(registry.QUERIES), sep="\n")
        return 0
    rows = registry.QUERIES[args.name](SparkSession.builder.getOrCreate(), args.directory)
    if args.out:
        rows.write.format(args.format).save(args.out)
    else:
        rows.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
