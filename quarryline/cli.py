"""The engine from a shell: python -m quarryline.cli sync|search|status|list|clear|init|config|version."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable

from .config import EngineConfig, first_set
from .sources import stores
from .sources.tree import find_root

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarryline")
    out.add_argument("command", choices=("sync", "search", "status", "list", "clear", "init", "config", "version"))
    out.add_argument("words", nargs="*")
    out.add_argument("--root", default=".")
    out.add_argument("--id", default="")
    out.add_argument("--index-root", default="")
    out.add_argument("--top-k", type=int, default=10)
    out.add_argument("--format", choices=("plain", "text"), default="plain")
    out.add_argument("--no-sync", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_intermixed_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    root = find_root(args.root)
    if args.command == "init":
        settings = {"codebase_id": args.id or (args.words[0] if args.words else stores.derived_id(root)), "base_url": ""}
        stores.save_settings(os.path.join(root, EngineConfig().tool_dir, "config.json"), settings)
        print(settings["codebase_id"])
        return 0
    machine = os.path.expanduser("~/.config/quarryline/config.json")
    if args.command == "config":
        if args.words:
            stores.save_settings(machine, {"base_url": args.words[0]})
        print(stores.machine_base_url(machine))
        return 0
    settings = stores.load_project(root)
    where = first_set(args.index_root, os.environ.get("QUARRYLINE_INDEX_ROOT"), settings.get("base_url"), stores.machine_base_url(machine), default=EngineConfig().index_root)
    codebase = args.id or settings["codebase_id"]
    from pyspark.sql import SparkSession

    from .plans.engine import Engine

    engine = Engine(SparkSession.builder.appName("quarryline").getOrCreate(), EngineConfig.load({"index_root": where}))
    return run(engine, args, root, codebase)


def progress_line(done: int, total: int, seconds: float, width: int = 30) -> str:
    """A bar, the share that is done, the counts and the time that the rest takes at the pace so far."""
    share = min(1.0, done / total) if total else 1.0
    left = int(seconds * (1 - share) / share) if share else None
    return f"[{'=' * int(width * share):<{width}}] {share:4.0%} {done}/{total}" + ("" if left is None else f" {left // 60}m{left % 60:02d}s left")


def shown_progress(stream=None) -> Callable[[int, int], None] | None:
    """Rewrites one line of a terminal at each call; None where the stream is none."""
    stream = stream or sys.stderr
    if not stream.isatty():
        return None
    start = time.monotonic()

    def show(done: int, total: int) -> None:
        stream.write("\r" + progress_line(done, total, time.monotonic() - start) + ("\n" if done >= total else ""))
        stream.flush()

    return show


def run(engine, args: argparse.Namespace, root: str, codebase: str) -> int:
    if args.command == "sync":
        report = engine.sync(root, codebase, progress=shown_progress())
        print(report["report"], report["upsert"], f"deleted {report['chunks_deleted']}")
    elif args.command == "search":
        if not args.words:
            print("a query is needed", file=sys.stderr)
            return 2
        if not args.no_sync:
            try:
                engine.sync(root, codebase, progress=shown_progress())
            except Exception as error:
                print(f"sync failed, searching anyway: {error}", file=sys.stderr)
        query = " ".join(args.words)
        if args.format == "text":
            print(engine.search_text(codebase, query, args.top_k), end="")
        else:
            from pyspark.sql import functions as F

            from .functions.formatting import preview

            for r in engine.search(codebase, query, args.top_k).withColumn("line", preview(F.col("content"))).orderBy("rank").collect():
                print(f"{r.score:.3f} {r.relative_path}:{r.start_line}-{r.end_line} {r.line}")
    elif args.command == "status":
        print(f"{codebase} {engine.collection(codebase)} {engine.chunks(codebase).count()} chunks")
    elif args.command == "list":
        for r in engine.list_indexes().orderBy("collection").collect():
            print(r.collection, r.codebase_id, r.num_chunks, r.languages or {})
    else:
        engine.clear(codebase)
        print(f"cleared {codebase}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
