"""Command line: query, ingest, tail, compact, validate."""

from __future__ import annotations

import argparse
import sys
import time
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from sawmill.config import load_config, validate_config
from sawmill.functions.fields import render
from sawmill.operators.compact import compact
from sawmill.plans.view import Registry, open_logs
from sawmill.streaming.ingest import REGISTRY, ingest, ingest_streams, registered


def session() -> SparkSession:
    return SparkSession.builder.appName("sawmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def shown(df: DataFrame) -> DataFrame:
    """``df`` with a column of fields as text, if it has one."""
    return df.withColumn("Fields", render("Fields")) if "Fields" in df.columns else df


def write_table(df: DataFrame, rows: int = 1000) -> None:
    """All rows, aligned by blocks of ``rows``; they pass the driver a partition at a time."""
    found = ([("NULL" if v is None else str(v)) for v in r] for r in df.toLocalIterator())
    block = list(islice(found, rows))
    while True:
        widths = [max(map(len, column)) for column in zip(df.columns, *block)]
        for row in [df.columns, ["-" * w for w in widths], *block]:
            print(" | ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip())
        if not (block := list(islice(found, rows))):
            return


def write_result(df: DataFrame, output: str) -> None:
    if output == "table":
        write_table(shown(df))
    elif output == "json":
        print("[" + ",\n ".join(row for row in df.toJSON().toLocalIterator()) + "]")
    else:
        import csv

        writer = csv.writer(sys.stdout)
        df = shown(df)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])


def run_query(spark: SparkSession, sql: str, output: str) -> int:
    began = time.time()
    try:
        write_result(spark.sql(sql), output)
    except Exception as e:  # shown to the user, who sees a failed exit too
        print(f"error after {(time.time() - began) * 1000:.0f} ms: {e}", file=sys.stderr)
        return 1
    print(f"{(time.time() - began) * 1000:.0f} ms", file=sys.stderr)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sawmill")
    commands = parser.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run SQL over logs; without SQL, read statements from the input")
    q.add_argument("--data", "--data-path", required=True)
    q.add_argument("--db", "--database-path", help="folder of the field registry")
    q.add_argument("--output", choices=("table", "json", "csv"), default="table")
    q.add_argument("sql", nargs="?")
    for name in ("ingest", "validate", "tail"):
        c = commands.add_parser(name)
        c.add_argument("--config", required=True)
        if name == "tail":
            c.add_argument("--checkpoint", required=True)
    c = commands.add_parser("compact")
    c.add_argument("--data", "--data-path", required=True)
    c.add_argument("--compact-older-than", type=float, default=3600, help="seconds")
    got = parser.parse_args(args)
    if got.command == "compact":
        print("\n".join(compact(session(), got.data, got.compact_older_than)))
        return 0
    if got.command == "query":
        spark = session()
        open_logs(spark, got.data, Registry.load(spark, got.db or f"{got.data}/{REGISTRY}"))
        if got.sql:
            return run_query(spark, got.sql, got.output)
        return max([run_query(spark, line, got.output) for line in sys.stdin if line.strip()], default=0)
    settings = load_config(got.config)
    wrong = validate_config(settings)
    print("\n".join(wrong), file=sys.stderr)
    if wrong or got.command == "validate":
        return int(bool(wrong))
    spark = session()
    registry, _, conflicts = registered(spark, settings.plugins, settings.data_path)
    for name in conflicts:
        print(f"field {name!r} has another type already; {registry.types[name]} stays, other values are kept as text", file=sys.stderr)
    if got.command == "ingest":
        print(", ".join(f"{n} {kind.lower()}" for kind, n in ingest(spark, settings).items()), file=sys.stderr)
        return 0
    ingest_streams(spark, settings, got.checkpoint)
    spark.streams.awaitAnyTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
