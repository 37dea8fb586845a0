"""The index: two Parquet tables.

postings(indexer, db, family, batch_id, doc_id, ip, n), partitioned by (indexer, db, family) and sorted by
ip within files, so that a range of addresses prunes partitions and row groups; rows of family 0 have no
address and hold a file's number of records, or of those that can't be read.

documents(indexer, v, db, batch_id, doc_id, filename, doc_time, records, n_ips, size, mtime, error) is the
commit log: postings count only with a document of their batch, so a failed attempt leaves nothing that
is ever read. Of an indexer's versions v only the highest counts; a new one appears by one rename. One
writer per indexer at a time.
"""

from __future__ import annotations

import datetime
import os
import re
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ipquarry.functions.filenames import to_database, to_time
from ipquarry.functions.ips import Range, cidr_bounds, family, query_range
from ipquarry.sources import lines, readers

DOCUMENTS = "batch_id string, doc_id long, filename string, doc_time timestamp, records long, n_ips long, size long, mtime timestamp, error string, indexer string, db string"
POSTINGS = "batch_id string, doc_id long, ip binary, n long, indexer string, db string, family int"
#: Files of one commit; what a commit broadcasts has a row for each of them.
MOST_FILES = 20_000


#: Fixed by Spark: characters that it writes as %XX in names of partition folders.
ESCAPED = "\"#%'*/:=?\\{}[]^\x7f" + "".join(map(chr, range(1, 32)))


def partition_name(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


@dataclass
class Indexed:
    """What became of a path: "indexed", "known", "damaged: ..." (indexed as far as it can be read) or "error: ..."."""

    filename: str
    status: str


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # tables

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, at = self._path(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _version(self, indexer: str) -> int | None:
        """The version of an indexer's documents that counts."""
        fs, at = self._path(f"documents/indexer={partition_name(indexer)}")
        if not fs.exists(at):
            return None
        return max((int(found[1]) for x in fs.listStatus(at) if (found := re.fullmatch(r"v=(\d+)", x.getPath().getName()))), default=None)

    def documents(self, indexer: str) -> DataFrame:
        version = self._version(indexer)
        if version is None:
            return self.spark.createDataFrame([], DOCUMENTS)
        own = self.spark.read.schema(DOCUMENTS).option("basePath", f"{self.root}/documents").parquet(f"{self._folder('documents', indexer)}/v={version}")
        return own.select(*(name.split()[0] for name in DOCUMENTS.split(", ")))

    def postings(self, indexer: str | None = None) -> DataFrame:
        out = self._table("postings", POSTINGS).where("family <> 0")
        return out if indexer is None else out.where(F.col("indexer") == indexer)

    def databases(self, indexer: str) -> list[str]:
        return [r["db"] for r in self.documents(indexer).select("db").distinct().orderBy("db").collect()]

    def list_documents(self, indexer: str) -> DataFrame:
        return self.documents(indexer).orderBy("db", "doc_id")

    def has(self, indexer: str, filename: str) -> bool:
        return not self.documents(indexer).where(F.col("filename") == filename).isEmpty()

    def missing(self, indexer: str, paths: DataFrame) -> DataFrame:
        """(filename) rows that aren't indexed yet, each once."""
        return paths.select("filename").distinct().join(self.documents(indexer).select("filename"), "filename", "left_anti")

    # writing

    def index(self, indexer: str, backend: str, paths: Iterable[str], db_of=None, time_of=None) -> list[Indexed]:
        """Indexes the paths that are new. db_of and time_of map a filename; one that raises is an error of that file."""
        spark = self.spark
        own = readers.reader(backend)
        own.check()
        paths = list(dict.fromkeys(paths))
        if not paths:
            return []
        new = {r["filename"] for r in self.missing(indexer, spark.createDataFrame([(p,) for p in paths], "filename string")).collect()}
        out = {p: Indexed(p, "known") for p in paths}

        def described(p: str):
            try:
                size, mtime = self._stat(p)
                db = db_of(p) if db_of else "flows.db"
            except (OSError, ValueError, Py4JJavaError) as error:
                return Indexed(p, f"error: {said(error)}")
            try:
                at = time_of(p) if time_of else None
            except ValueError:
                at = None
            return p, db, at, size, mtime

        rows = []
        with ThreadPoolExecutor(32) as pool:
            for p, got in zip(sorted(new), pool.map(described, sorted(new)), strict=True):
                if isinstance(got, Indexed):
                    out[p] = got
                else:
                    rows.append(got)
        for at in range(0, len(rows), MOST_FILES):
            self._commits(indexer, backend, rows[at : at + MOST_FILES], out)
        return list(out.values())

    def _commits(self, indexer: str, backend: str, rows: list[tuple], out: dict) -> None:
        """Commits files; one that fails the job is found and committed by itself, as far as it can be read."""
        todo = [rows] if rows else []
        while todo:
            some = todo.pop()
            try:
                again = self._commit(indexer, backend, some, out)
                if again:  # files that can't be read in one pass
                    self._commit(indexer, backend, again, out, once=False)
            except (PySparkException, Py4JJavaError) as error:
                if not _of_a_file(error):  # the store, say; halving wouldn't help
                    raise
                left = [r for r in some if out[r[0]].status == "known"]
                named = _named(error, [r[0] for r in left])
                if len(left) == 1 or named:
                    for r in left:
                        if r[0] in named or len(left) == 1:
                            self._salvage(indexer, backend, r, out, said(error))
                    rest = [r for r in left if r[0] not in named] if len(left) > 1 else []
                    todo += [rest] if rest else []
                else:
                    todo += [left[len(left) // 2 :], left[: len(left) // 2]]

    def _salvage(self, indexer: str, backend: str, row: tuple, out: dict, why: str) -> None:
        """Commits one damaged file, with its records before the damage where a task can open it."""
        path = row[0]
        try:
            if not lines.remote(path):
                why = next((r["error"] for r in lines.errors(self.spark, [path], readers.reader(backend).rows).collect()), why)
            self._commit(indexer, backend, [row], out, once=False, salvage=True, why=why)
            out[path] = Indexed(path, f"damaged: {why}")
        except (PySparkException, Py4JJavaError) as error:
            out[path] = Indexed(path, f"error: {said(error)}")

    def exists(self, path: str) -> bool:
        try:
            self._stat(path)
        except (OSError, Py4JJavaError):
            return False
        return True

    def _stat(self, path: str):
        if "://" in path and not path.startswith("file://"):
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            status = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
            return status.getLen(), datetime.datetime.fromtimestamp(status.getModificationTime() / 1000, datetime.timezone.utc)
        found = os.stat(path.removeprefix("file://"))
        with open(path.removeprefix("file://"), "rb"):
            return found.st_size, datetime.datetime.fromtimestamp(found.st_mtime, datetime.timezone.utc)

    def _commit(self, indexer: str, backend: str, rows: list[tuple], out: dict, once: bool = True, salvage: bool = False, why: str | None = None) -> list[tuple]:
        """Commits files in one pass over them; returns those with odd rows, which aren't committed.

        What is counted of the files, a row per file and address, is kept until it's written and added up.
        """
        spark, batch, own = self.spark, uuid.uuid4().hex, readers.reader(backend)
        files = spark.createDataFrame(rows, "filename string, db string, doc_time timestamp, size long, mtime timestamp")
        last = self.documents(indexer).groupBy("db").agg(F.max("doc_id").alias("last"))
        number = F.row_number().over(Window.partitionBy("db").orderBy("filename")) - 1
        files = files.join(last, "db", "left").select("filename", "db", "doc_time", "size", "mtime", (number + F.coalesce(F.col("last") + 1, F.lit(0))).alias("doc_id"))
        files = spark.createDataFrame(files.collect(), files.schema)  # as many rows as paths were given
        paths = [r[0] for r in rows]
        if salvage and lines.remote(paths[0]):
            records = spark.createDataFrame([], readers.RECORDS)
        elif once and own.once:
            records = own.once(spark, paths)
        else:
            records = readers.records(spark, backend, paths, salvage)
        found = readers.counted(records, own.bad() if own.bad else None, own.odd() if once and own.odd else None)
        found = found.join(F.broadcast(files).select(F.col("filename").alias("path"), "db", "doc_id"), "path").select("db", "doc_id", "ip", "n", F.coalesce(family("ip"), F.lit(0)).cast("int").alias("family"))
        found = found.persist()
        try:
            plain = F.col("family") == 0
            of = lambda test, name: F.sum(F.when(plain & test, F.col("n"))).alias(name)
            counts = found.groupBy("db", "doc_id").agg(of(F.col("ip").isNull(), "records"), of(F.col("ip") == F.lit(bytearray(readers.BAD)), "bad"), of(F.col("ip") == F.lit(bytearray(readers.ODD)), "odd"), F.count_if(~plain).alias("n_ips"))
            done = files.join(counts, ["db", "doc_id"], "left").collect()  # as many rows as paths were given
            odd = {r["filename"] for r in done if r["odd"]}
            if odd:  # the others take their numbers
                kept = [r for r in rows if r[0] not in odd]
                if kept:
                    self._commit(indexer, backend, kept, out)
                return [r for r in rows if r[0] in odd]
            self._write(indexer, found.select(F.lit(batch).alias("batch_id"), "doc_id", "ip", "n", F.lit(indexer).alias("indexer"), "db", "family"))
        finally:
            found.unpersist()
        wrong = lambda r: "; ".join(filter(None, [why, f"{r['bad']} records can't be read" if r["bad"] else None])) or None
        log = [(batch, r["doc_id"], r["filename"], r["doc_time"], r["records"] or 0, r["n_ips"] or 0, r["size"], r["mtime"], wrong(r), r["db"]) for r in done]
        names = DOCUMENTS.replace("indexer string, ", "")
        log = spark.createDataFrame(log, names).coalesce(1)
        log.write.partitionBy("db").mode("append").parquet(f"{self._folder('documents', indexer)}/v={self._version(indexer) or 0}")
        for r in rows:
            out[r[0]] = Indexed(r[0], "indexed")
        return []

    def _folder(self, table: str, indexer: str) -> str:
        """An indexer's own folder of a table, so that indexers can write side by side."""
        return f"{self.root}/{table}/indexer={partition_name(indexer)}"

    def _write(self, indexer: str, postings: DataFrame) -> None:
        ranged = postings.drop("indexer").repartitionByRange("db", "family", "ip").sortWithinPartitions("db", "family", "ip")
        ranged.write.partitionBy("db", "family").option("parquet.bloom.filter.enabled#ip", "true").mode("append").parquet(self._folder("postings", indexer))

    def compact(self, indexer: str) -> None:
        """Rewrites an indexer's postings and documents in fewer sorted files, without what failed attempts left.

        The new postings are a batch of their own that nothing refers to until the new version of the documents
        appears by one rename. Before that rename the old version counts, after it the new one; whatever step it's
        stopped at, answers are the same, and a later call removes what is left over. Readers that began before may
        miss files that are removed at the end.
        """
        fs, at = self._path(f"postings/indexer={partition_name(indexer)}")
        version = self._version(indexer)
        if version is None:
            return
        old = self._files(fs, at) if fs.exists(at) else []
        docs = self.documents(indexer)
        batch = uuid.uuid4().hex
        if old:
            live = docs.select("db", "batch_id", "doc_id")
            own = self._table("postings", POSTINGS).where(F.col("indexer") == indexer)
            kept = own.join(live, ["db", "batch_id", "doc_id"], "left_semi").withColumn("batch_id", F.lit(batch))
            self._write(indexer, kept.select(*own.columns))
        folder = self._folder("documents", indexer)
        fs, made = self._path(f"documents/indexer={partition_name(indexer)}/.v-{batch}")
        # a file for each database
        docs.drop("indexer").withColumn("batch_id", F.lit(batch)).repartition("db").sortWithinPartitions("db", "doc_id").write.partitionBy("db").parquet(f"{folder}/.v-{batch}")
        _, new = self._path(f"documents/indexer={partition_name(indexer)}/v={version + 1}")
        if not fs.rename(made, new):
            raise OSError(f"{made.toString()} can't be renamed to {new.toString()}")
        for path in old:
            fs.delete(path, False)
        _, top = self._path(f"documents/indexer={partition_name(indexer)}")
        for x in fs.listStatus(top):
            if x.getPath().getName() != f"v={version + 1}":
                fs.delete(x.getPath(), True)

    def _files(self, fs, at) -> list:
        """The files below a folder, without markers."""
        found, each = [], fs.listFiles(at, True)
        while each.hasNext():
            path = each.next().getPath()
            if not path.getName().startswith(("_", ".")):
                found.append(path)
        return found

    # questions

    def _hits(self, indexer: str, block: Range, dbs: Iterable[str] | None = None) -> DataFrame:
        """Committed postings in a range, by partition, pushed-down bounds and a join with their documents."""
        found = self.postings(indexer).where((F.col("family") == block.family) & block.contains("ip"))
        docs = self.documents(indexer)
        if dbs is not None:
            found, docs = found.where(F.col("db").isin(list(dbs))), docs.where(F.col("db").isin(list(dbs)))
        return found.select("db", "batch_id", "doc_id", "ip").join(docs.select("db", "batch_id", "doc_id", "filename"), ["db", "batch_id", "doc_id"])

    def search(self, indexer: str, query: str, dbs: Iterable[str] | None = None) -> DataFrame:
        """(db, doc_id, filename) of files that mention an address or any of a block, in order of database and insertion."""
        hits = self._hits(indexer, query_range(query), dbs)
        return hits.select("db", "doc_id", "filename").distinct().orderBy("db", "doc_id")

    def expand(self, indexer: str, block: str, dbs: Iterable[str] | None = None) -> DataFrame:
        """(ip) seen in a block, each once, in order."""
        return self._hits(indexer, cidr_bounds(block), dbs).select("ip").distinct().orderBy("ip")

    def posting_lists(self, indexer: str) -> DataFrame:
        """(db, ip, doc_ids): addresses with their sorted documents."""
        live = self.documents(indexer).select("db", "batch_id", "doc_id")
        rows = self.postings(indexer).join(live, ["db", "batch_id", "doc_id"], "left_semi")
        return rows.groupBy("db", "ip").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))

    def unique_ips(self, indexer: str) -> DataFrame:
        """(db, filename, n_ips) of each file."""
        return self.documents(indexer).select("db", "filename", "n_ips")


def database_of(regex: str, template: str):
    return lambda filename: to_database(filename, regex, template)


def time_of(regex: str | None):
    return lambda filename: to_time(filename, regex)


def said(error: Exception) -> str:
    """What an error says, in a line: the cause that a task or a store gave, without the driver's stack."""
    text = str(getattr(error, "java_exception", None) or error)
    causes = re.findall(r"(?m)^(?:Caused by: )?(?:[\w.$]+\.)?(\w*(?:Exception|Error)): (.+)$", text)
    return " ".join((": ".join(causes[-1]) if causes else text.strip().split("\n")[0]).split())[:500]


def _of_a_file(error: Exception) -> bool:
    """Whether an error is one of reading a file, not of writing or of the cluster."""
    text = f"{type(error).__name__}: {getattr(error, 'java_exception', None) or error}"
    elsewhere = r"TASK_WRITE_FAILED|No space left|OutOfMemory|ConnectException|AccessControl|SafeMode"
    return bool(re.search(r"FAILED_READ_FILE|PythonException|PYTHON_EXCEPTION|EOFException|ZipException|IOException", text)) and not re.search(elsewhere, text)


def _named(error: Exception, paths: list[str]) -> set[str]:
    """Those of paths that an error's text names as files that can't be read."""
    text = str(getattr(error, "java_exception", None) or error)
    found = set(re.findall(r"(?:reading file|File) (\S.*?)(?:\.\s|\s+(?:does not exist|SQLSTATE)|$)", text, re.MULTILINE))
    found = {x.removeprefix("file:").replace("//", "/") for x in found} | found
    return {p for p in paths if p in found or "/" + p.removeprefix("file:").lstrip("/") in found}
