"""Command line: ``python -m keyfold --store PATH put|get|delete|scan|compact|snapshot ...``."""

from __future__ import annotations

import argparse
import sys

from .client import Client, Cmd, Command, Node, Region, Request, Router, bound_text
from .operators.regions import DEFAULT_REGIONS
from .session import build_session
from .store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyfold")
    p.add_argument("--store", required=True, help="folder of the store, on a file system that all executors share")
    p.add_argument("--id", type=int, default=1, help="number of this node")
    p.add_argument("--cluster", type=int, default=0, help="number of the cluster that requests must name")
    p.add_argument("--master", default=None, help="Spark master; by default that of the installation")
    p.add_argument("--cf", default="default", help="column family")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name, args in (("get", ["key"]), ("put", ["key", "value"]), ("delete", ["key"]), ("scan", ["start"]), ("compact", []), ("regions", [])):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if name == "scan":
            c.add_argument("--limit", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = build_session("keyfold", a.master)
    store = Store(spark, a.store)
    regions = [Region(i, lo.encode(), hi.encode(), (a.id,), a.id) for i, lo, hi in DEFAULT_REGIONS]
    if a.cmd == "compact":
        print("merged level", store.compact(force=True))
        return 0
    if a.cmd == "regions":
        for r in regions:
            print(r.region_id, bound_text(r.start_key), bound_text(r.end_key, end=True))
        return 0
    client = Client({a.id: Node(store, Router(regions), a.id, a.cluster).propose})
    command = {
        "get": lambda: Command(Cmd.GET, a.cf, a.key.encode()),
        "put": lambda: Command(Cmd.PUT, a.cf, a.key.encode(), a.value.encode()),
        "delete": lambda: Command(Cmd.DELETE, a.cf, a.key.encode()),
        "scan": lambda: Command(Cmd.SCAN, a.cf, start_key=a.start.encode(), limit=a.limit),
    }[a.cmd]()
    answer = client.propose(Request((command,), a.cluster))
    if not answer.success:
        print(answer.error, file=sys.stderr)
        return 1
    if a.cmd == "get":
        print(answer.results[0].decode(errors="replace"))
    elif a.cmd == "scan":
        for row in answer.results[0].toLocalIterator():
            print(bytes(row.key).decode(errors="replace"), bytes(row.value).decode(errors="replace"), sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
