"""Command line: rebuild, search, status, seed. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import sys

from webloom.operators import retrieval
from webloom.plans import rebuild
from webloom.session import local_session
from webloom.sources import csvs
from webloom.sources.config import Config, load


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="webloom")
    p.add_argument("--config", help="TOML file")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"rebuild": ["archive", "out"], "search": ["out", "query"], "status": ["out"], "seed": ["list"]}.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if name == "search":
            c.add_argument("--page", type=int, default=0)
            c.add_argument("--size", type=int, default=10)
    a = p.parse_args(argv)
    try:
        config = Config()
        if a.config:
            with open(a.config) as f:
                config = load(f.read())
        spark = local_session()
        if a.command == "rebuild":
            print(rebuild.rebuild(spark, a.archive, a.out, config))
            return 0
        if a.command == "search":
            df = retrieval.search(rebuild.searchable(spark, rebuild.current(a.out)), a.query, a.size, a.page, config.rank.weight)
        elif a.command == "status":
            df = rebuild.status(spark, rebuild.current(a.out))
        else:
            df = csvs.seeds(spark, a.list)
        for line in df.toJSON().toLocalIterator():
            print(line)
        return 0
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
