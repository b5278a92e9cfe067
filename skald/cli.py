"""python -m skald.cli start LOG [STATE] [--once] | init [NAME]"""

from __future__ import annotations

import argparse
import os


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skald", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    start = commands.add_parser("start", help="follow a log and keep the state tables up")
    start.add_argument("log", nargs="?", default="./conversation.jsonl")
    start.add_argument("state", nargs="?", default="./skald-state")
    start.add_argument("--session", default="default")
    start.add_argument("--once", action="store_true", help="stop at the log's present end")
    init = commands.add_parser("init", help="create an empty log")
    init.add_argument("name", nargs="?", default="conversation")
    args = parser.parse_args(argv)
    if args.command == "init":
        path = f"./{args.name}.jsonl"
        if not os.path.exists(path):
            open(path, "x").close()
        print(path)
        return 0
    from pyspark.sql import SparkSession

    from .streaming.pipeline import follow

    spark = SparkSession.builder.appName("skald").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    follow(spark, os.path.abspath(args.log), os.path.abspath(args.state), args.session, mode="catchup" if args.once else "live").awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
