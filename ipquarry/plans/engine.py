"""The engine: named indexers over one store, as a configuration describes them."""

from __future__ import annotations

import datetime
import json
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ipquarry.functions.filenames import expand_glob, parse_bucket, recent_globs
from ipquarry.functions.ips import query_range
from ipquarry.operators import stats
from ipquarry.operators.store import Indexed, Store, database_of, time_of
from ipquarry.sources import lines, readers
from ipquarry.streaming.ingest import log, poll, settled


@dataclass
class IndexerConfig:
    """Keys of one indexer; `indexer` is accepted and unused, `store` has one kind."""

    name: str
    backend: str
    file_glob: str = ""
    recent_file_glob: str = ""
    indexer: str = ""
    store: str = "leveldb"
    filename_to_database_regex: str = ""
    filename_to_time_regex: str = ""
    database_root: str = ""
    database_path: str = ""


@dataclass
class Config:
    indexers: list[IndexerConfig] = field(default_factory=list)
    bind: str = ":8080"


def parse_config(text: str | bytes) -> Config:
    found = json.loads(text)
    known = IndexerConfig.__dataclass_fields__
    out = []
    for entry in found.get("indexers") or []:
        one = IndexerConfig(**{k: v for k, v in entry.items() if k in known})
        one.store = one.store or "leveldb"
        if one.store != "leveldb":
            raise ValueError("Invalid store type")
        re.compile(one.filename_to_time_regex)
        re.compile(one.filename_to_database_regex)
        out.append(one)
    return Config(out, (found.get("http") or {}).get("bind") or ":8080")


def load_config(path: str) -> Config:
    with open(path) as source:
        return parse_config(source.read())


class Engine:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.by_name = {c.name: c for c in config.indexers}

    def indexers(self) -> list[str]:
        return sorted(self.by_name)

    def get(self, name: str) -> IndexerConfig:
        if name not in self.by_name:
            raise KeyError(f'Indexer "{name}" not found')
        return self.by_name[name]

    def store(self, name: str) -> Store:
        return Store(self.spark, self.get(name).database_root or "flows")

    # indexing

    def list_logs(self, name: str) -> list[str]:
        return expand_glob(self.get(name).file_glob)

    def list_recent(self, name: str, now: datetime.datetime | None = None) -> list[str]:
        """Yesterday's and today's files; all of them where no recent glob is given."""
        own = self.get(name)
        return recent_globs(own.recent_file_glob, now or datetime.datetime.now()) if own.recent_file_glob else self.list_logs(name)

    def index(self, name: str, paths: list[str]) -> list[Indexed]:
        """New files of paths; one that can't be opened or named is reported and doesn't stop the others."""
        own = self.get(name)
        db_of = database_of(own.filename_to_database_regex, own.database_path) if own.filename_to_database_regex else (lambda _: own.database_path or "flows.db")
        return self.store(name).index(name, own.backend, paths, db_of, time_of(own.filename_to_time_regex or None))

    def index_all(self) -> dict[str, list[Indexed] | Exception]:
        """Every indexer's files, indexers side by side; an indexer's error is its result."""
        return self._each(lambda name: self.index(name, self.list_logs(name)))

    def index_recent(self) -> dict[str, list[Indexed] | Exception]:
        return self._each(lambda name: self.index(name, settled(self.list_recent(name))))

    def _each(self, run) -> dict:
        def safe(name: str):
            try:
                return run(name)
            except Exception as error:
                return error

        names = self.indexers()
        if not names:
            return {}
        with ThreadPoolExecutor(len(names)) as pool:
            return dict(zip(names, pool.map(safe, names)))

    def daemon(self, passes: int | None = None, wait: float = 60.0) -> None:
        """Indexes recent files of all indexers every minute."""
        names = self.indexers()
        if not names:
            return

        def index(name: str, paths: list[str]) -> None:
            for one in self.index(name, paths):
                if one.status.startswith(("error", "damaged")):
                    log.warning("%s: %s: %s", name, one.filename, one.status)

        # a pass that raises is logged by poll, so an indexer's loop goes on whatever happens
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(lambda n: poll(lambda paths: index(n, paths), lambda: self.list_recent(n), passes, wait), names))

    # questions

    def search(self, name: str, query: str) -> DataFrame:
        return self.store(name).search(name, query)

    def expand(self, name: str, block: str) -> DataFrame:
        return self.store(name).expand(name, block)

    def stats(self, name: str, query: str, bucket: str = "") -> dict:
        groupby, count = parse_bucket(bucket)
        return stats.report(self.search(name, query).select("filename"), self.get(name).filename_to_time_regex or None, groupby, count)

    def dump(self, name: str, query: str, mode: str = "ip", missing: list[str] | None = None) -> DataFrame:
        """(path, value): matching records, read from the files that the index names and no others.

        Files that are gone are left out and added to missing, or, without that list, raise FileNotFoundError. Damaged
        ones are read as far as they can be.
        """
        own, block = self.get(name), query_range(query)
        hits = self.search(name, query).join(self.store(name).documents(name).select("db", "doc_id", "error"), ["db", "doc_id"]).collect()
        with ThreadPoolExecutor(32) as pool:
            there = dict(zip((r["filename"] for r in hits), pool.map(lambda r: self.store(name).exists(r["filename"]), hits), strict=True))
        gone = sorted(p for p, found in there.items() if not found)
        if gone and missing is None:
            raise FileNotFoundError(f"indexed files are gone: {', '.join(gone)}")
        if gone:
            missing += gone
        damaged = {r["filename"] for r in hits if r["error"] and not lines.remote(r["filename"])}
        whole = [p for p in there if there[p] and p not in damaged]
        rows = readers.records(self.spark, own.backend, whole)
        if cut := [p for p in there if there[p] and p in damaged]:
            rows = rows.unionByName(readers.records(self.spark, own.backend, cut, salvage=True))
        return readers.dump(rows, own.backend, query, block, mode).select("path", F.col("value"))

    def compact(self, name: str) -> None:
        self.store(name).compact(name)
