"""Command line: create, drop, index, merge, vacuum, search."""

from __future__ import annotations

import argparse
from pathlib import Path

from brindle.operators.catalog import Catalog
from brindle.session import local_session
from brindle.sources.connect import connect, stdin_batches
from brindle.streaming.ingest import ingest


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="brindle")
    parser.add_argument("--catalog", required=True, help="folder of the catalog, in any store that Spark reads")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("create").add_argument("config", help="YAML file")
    for verb in ("drop", "merge", "vacuum", "index", "search"):
        verbs.add_parser(verb).add_argument("name")
    index, search = verbs.choices["index"], verbs.choices["search"]
    index.add_argument("input", nargs="?", help="path or kafka://servers/topic; standard input if left out")
    index.add_argument("--stream", action="store_true")
    index.add_argument("--commit-interval", default="30s")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=1)
    args = parser.parse_args(argv)

    spark = local_session()
    catalog = Catalog(spark, args.catalog)
    if args.verb == "create":
        catalog.create(Path(args.config).read_text())
    elif args.verb == "drop":
        catalog.drop(args.name)
    elif args.verb == "merge":
        catalog.merge(args.name)
    elif args.verb == "vacuum":
        catalog.vacuum(args.name)
    elif args.verb == "search":
        for row in catalog.search(args.name, args.query, args.limit).toLocalIterator():
            print(row.json)
    elif args.input is None:
        for lines in stdin_batches(spark):
            catalog.index(args.name, lines)
    elif args.stream:
        ingest(catalog, args.name, connect(spark, args.input, True), args.commit_interval).awaitTermination()
    else:
        catalog.index(args.name, connect(spark, args.input))


if __name__ == "__main__":
    main()
