"""Command line: ``python -m tarnlake.cli index ...`` and ``python -m tarnlake.cli search ...``."""

from __future__ import annotations

import argparse

from . import api
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnlake")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("--mode", choices=("batch", "tail"), default="batch")
    index.add_argument("--dir", required=True)
    index.add_argument("--format", choices=("text",), default="text")
    index.add_argument("--index_interval", type=int, default=1024, help="MB a group holds at least")
    index.add_argument("--compaction_interval", type=int, default=20_480, help="MB a split holds at least")
    index.add_argument("--index_name", required=True)
    index.add_argument("--prefix_bytes", type=int, default=0)
    index.add_argument("--prefix_format", default=None)
    index.add_argument("--tail-interval", type=int, default=10, help="seconds between polls")
    index.add_argument("--row_group", type=int, default=100_000)
    index.add_argument("--overwrite", action="store_true")
    index.add_argument("--resume", action="store_true", help="write only the splits a broken run did not commit")
    find = commands.add_parser("search")
    find.add_argument("--index_path", required=True)
    find.add_argument("--query", required=True)
    find.add_argument("--limit", type=int, default=100)
    find.add_argument("--mode", choices=("literal", "regex"), default="literal")
    find.add_argument("--distinct", action="store_true")
    find.add_argument("--output", default="search_result.parquet")
    find.add_argument("--overwrite", action="store_true", help="replace an existing output")
    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "search":
        found = api.search(spark, args.index_path, args.query, args.limit, args.mode, args.distinct)
        found.write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.output)
        return 0
    if args.mode == "batch":
        api.index_logs(spark, args.dir, args.index_name, args.index_interval, args.compaction_interval, args.prefix_bytes, args.prefix_format, args.row_group, overwrite=args.overwrite, resume=args.resume)
        return 0
    from .streaming.tail import settle, start_tail

    inbox = f"{args.index_name}/_inbox"
    settle(spark, args.dir, inbox)
    query = start_tail(spark, inbox, args.index_name, args.index_interval << 20, args.prefix_bytes, args.prefix_format, f"{args.tail_interval} seconds", args.row_group, compaction_bytes=args.compaction_interval << 20)
    while not query.awaitTermination(args.tail_interval):
        settle(spark, args.dir, inbox)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
