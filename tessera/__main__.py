"""python -m tessera list | run NAME DIR [--rows N] | explain NAME DIR: the named queries from a shell."""

from __future__ import annotations

import argparse

from .plans import catalogue
from .session import local_session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for what in ("run", "explain"):
        x = sub.add_parser(what)
        x.add_argument("name", choices=sorted(catalogue.queries()))
        x.add_argument("dir")
        x.add_argument("--rows", type=int, default=20)
    a = p.parse_args(args)
    if a.what == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    df = catalogue.queries()[a.name](local_session(), a.dir)
    if a.what == "run":
        df.show(a.rows, truncate=60)
    else:
        df.explain("formatted")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
