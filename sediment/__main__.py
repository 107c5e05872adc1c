"""Command line: python -m sediment --root DIR COMMAND ... Results are printed as JSON lines."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from sediment.api import Memory
from sediment.session import build_session, ship_package
from sediment.sources import archive


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="sediment")
    p.add_argument("--root", required=True)
    p.add_argument("--scope", default="global")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {
        "ingest": ["path"], "recall": ["query"], "history": ["name"], "entity": ["name"], "consolidate": [], "compress": ["budget"], "stats": [], "usage": [], "check": [],
        "retain": ["path", "before"], "restore": ["path"], "list": ["action"],
    }.items():
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(o)
        s.add_argument("--limit", type=int, default=20)
        s.add_argument("--apply", action="store_true")
    a = p.parse_args(args)
    spark = build_session("sediment")
    ship_package(spark)
    m, now, out = Memory(spark, a.root, a.scope), time.time(), None
    if a.command == "ingest":
        files = archive.read_folder(spark, a.path)
        m.remember(files.select(F.sha2(F.concat_ws("|", "path", "content"), 256).alias("id"), F.lit(now).alias("timestamp"), F.lit("user").alias("role"), "content", "session_id", F.lit(None).cast("string").alias("metadata")))
        out = m.stats()
    elif a.command == "recall":
        out = m.recall(spark.createDataFrame([(1, a.query)], "qid int, text string"), now, a.limit).orderBy("pos")
    elif a.command == "history":
        out = m.history(a.name)
    elif a.command == "entity":
        out = m.entity_context(a.name)["current"]
    elif a.command == "consolidate":
        m.consolidate(now)
        out = m.stats()
    elif a.command == "compress":
        out = m.compress(int(a.budget))
    elif a.command == "retain":
        out = m.retain(a.path, before=float(a.before), apply=a.apply)
    elif a.command == "restore":
        m.restore(a.path)
        out = m.usage()
    elif a.command == "list":
        out = m.cleanup(a.action)
    else:
        out = getattr(m, a.command)()
    for line in out.limit(a.limit).toJSON().collect():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
