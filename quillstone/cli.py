"""The store's verbs on the command line: python -m quillstone.cli --store PATH VERB ... ; answers are JSON."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import SparkSession

from .operators import filters as fl
from .plans.tools import Tools
from .sources.project import detect_project
from .sources.store import LIMIT, Store


def human_bytes(n: int) -> str:
    """A size with one decimal, in units of 1024."""
    size, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillstone")
    out.add_argument("--store", required=True)
    out.add_argument("--project")
    out.add_argument("--log")
    verbs = out.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("remember")
    one.add_argument("content")
    one.add_argument("--entity", action="append", default=[])
    one.add_argument("--supersedes", action="append", default=[])
    one.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    one = verbs.add_parser("recall")
    one.add_argument("query")
    one.add_argument("--limit", type=int, default=LIMIT)
    one.add_argument("--agent")
    one.add_argument("--filter", action="append", default=[], help="k=v, k=low..high, k>=n, k<=n")
    one.add_argument("--all", action="store_true", help="every project")
    one.add_argument("--related", action="store_true")
    one.add_argument("--recency", action="store_true")
    for verb in ("related", "forget"):
        verbs.add_parser(verb).add_argument("id")
    for verb in ("stats", "vacuum"):
        verbs.add_parser(verb)
    return out


def _size(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def run(spark: SparkSession, argv: list[str]) -> tuple[int, dict[str, Any]]:
    """(exit code, answer) of a command line."""
    a = parser().parse_args(argv)
    store = Store(spark, a.store)
    tools = Tools(store, a.project or detect_project(os.getcwd()), "cli", a.log)
    if a.verb == "vacuum":
        store.vacuum()
        return 0, {"size": human_bytes(_size(a.store))}
    if a.verb == "recall":
        try:
            wanted = fl.parse_filters(a.filter)
        except ValueError as e:
            return 1, {"isError": True, "error": str(e)}
        filters = {k: f.value if isinstance(f, fl.Eq) else {n: v for n, v in (("min", f.low), ("max", f.high)) if v is not None} for k, f in wanted.items()}
        args: dict[str, Any] = {"query": a.query, "limit": a.limit, "filters": filters, "expand_related": a.related, "recency": a.recency} | ({"scope": "all"} if a.all else {}) | ({"agent": a.agent} if a.agent is not None else {})
    elif a.verb == "remember":
        meta = {k: fl.parse_scalar(v) for k, _, v in (m.partition("=") for m in a.meta)}
        args = {"content": a.content, "entities": a.entity, "supersedes": a.supersedes, "metadata": meta}
    else:
        args = {"id": a.id} if a.verb in ("related", "forget") else {}
    answer = tools.call(a.verb, args)
    if a.verb == "stats":
        answer["size"] = human_bytes(_size(a.store))
    return int(answer["isError"]), answer


if __name__ == "__main__":
    code, told = run(SparkSession.builder.appName("quillstone").getOrCreate(), sys.argv[1:])
    print(json.dumps(told, ensure_ascii=False))
    sys.exit(code)
