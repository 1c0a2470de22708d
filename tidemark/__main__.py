"""Command line: ``python -m tidemark list | run QUERY | time QUERY ... | build-store | ask``; see ``--help`` of each."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import time

from pyspark.sql import SparkSession

from .plans import registry, similarity
from .operators.serving import PrecedentStore
from .session import get_spark
from .sources import reports


def timings(spark: SparkSession, names: list[str], data: str, runs: int) -> list[dict]:
    """Median and 95th percentile of the seconds that queries take, each run to its end."""
    out = []
    for name in names:
        seconds = []
        for _ in range(runs):
            began = time.perf_counter()
            registry.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        seconds.sort()
        out.append({"query": name, "runs": runs, "median_s": round(seconds[len(seconds) // 2], 3), "p95_s": round(seconds[min(runs - 1, int(0.95 * runs))], 3)})
    first = out[0]["median_s"] if out else 0.0
    return [row | {"speedup": round(first / row["median_s"], 2) if row["median_s"] else None} for row in out]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("--master", help="where Spark runs; by default as the environment says")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(registry.QUERIES), metavar="QUERY")
    clock = commands.add_parser("time", help="time queries; the speedup is against the first")
    clock.add_argument("queries", nargs="+", choices=sorted(registry.QUERIES), metavar="QUERY")
    clock.add_argument("--runs", type=int, default=3)
    build = commands.add_parser("build-store", help="write the pattern index")
    build.add_argument("store")
    ask = commands.add_parser("ask", help="ask the pattern index about a symbol and a day")
    ask.add_argument("store")
    ask.add_argument("symbol")
    ask.add_argument("date", type=dt.date.fromisoformat)
    ask.add_argument("--neighbours", type=int, default=None)
    for command in (run, clock, build):
        command.add_argument("--data", required=True, help="folder of the tables")
    for command in (run, ask):
        command.add_argument("--out", help="write there instead of showing")
        command.add_argument("--format", choices=reports.FORMATS, default="csv")
        command.add_argument("--rows", type=int, default=20, help="rows to show")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = get_spark("tidemark", args.master)
    if args.command == "time":
        print(json.dumps(timings(spark, args.queries, args.data, args.runs)))
        return 0
    if args.command == "build-store":
        similarity.build_store(spark, args.data, args.store)
        return 0
    if args.command == "run":
        found = registry.QUERIES[args.query](spark, args.data)
    else:
        store = PrecedentStore.open(spark, args.store)
        kind = dict(store.patterns().dtypes)["symbol"]
        question = spark.createDataFrame([(args.symbol, args.date)], "symbol string, query_date date").selectExpr(f"CAST(symbol AS {kind}) AS symbol", "query_date")
        found = store.ask(question, args.neighbours)
    if args.out:
        reports.write_report(found, args.out, args.format)
    else:
        found.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
