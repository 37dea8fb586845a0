"""Commands: index, indexall, daemon, search, expandcidr, compact, version."""

from __future__ import annotations

import argparse
import sys
import threading

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ipquarry import __version__
from ipquarry.functions.filenames import expand_glob
from ipquarry.functions.ips import format_ip
from ipquarry.operators.store import Store, said
from ipquarry.plans.engine import Engine, load_config
from ipquarry.plans.http import serve

#: The indexer of a store that is used without a configuration.
OWN = "flows"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("ipquarry", description="Which log files mention an address?")
    top.add_argument("--dbpath", default="flows.db", help="folder of the store")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index files")
    index.add_argument("--backend", "-b", default="bro")
    index.add_argument("globs", nargs="*")
    for name in ("indexall", "daemon"):
        commands.add_parser(name).add_argument("--config", "-c", default="config.json")
    commands.add_parser("search", help="files that mention an address or a block").add_argument("query")
    commands.add_parser("expandcidr", help="addresses seen in a block").add_argument("query")
    commands.add_parser("compact", help="rewrite the store")
    commands.add_parser("version")
    return top


def session() -> SparkSession:
    return SparkSession.builder.appName("ipquarry").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args, out = parser().parse_args(arguments), out or sys.stdout
    say = lambda text: print(text, file=out)
    if args.command == "version":
        say(__version__)
        return 0
    spark = spark or session()
    try:
        if args.command in ("indexall", "daemon"):
            engine = Engine(spark, load_config(args.config))
            if args.command == "daemon":
                threading.Thread(target=serve(engine).serve_forever, daemon=True).start()
                engine.daemon()
                return 0
            failed = False
            for name, result in engine.index_all().items():
                if isinstance(result, Exception):
                    failed = True
                    say(f"{name}: {result}")
                else:
                    for one in result:
                        failed |= one.status.startswith(("error", "damaged"))
                        say(f"{name}: {one.filename}: {one.status}")
            return int(failed)
        store = Store(spark, args.dbpath)
        if args.command == "index":
            paths = [p for g in args.globs for p in expand_glob(g)]
            results = store.index(OWN, args.backend, paths)
            for one in results:
                say(f"{one.filename}: {one.status}")
            return int(any(r.status.startswith(("error", "damaged")) for r in results))
        if args.command == "search":
            for row in store.search(OWN, args.query).select("filename").toLocalIterator():
                say(row[0])
        elif args.command == "expandcidr":
            for row in store.expand(OWN, args.query).select(format_ip("ip")).toLocalIterator():
                say(row[0])
        else:
            store.compact(OWN)
    except (ValueError, OSError, PySparkException, Py4JJavaError) as error:
        print(said(error), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
