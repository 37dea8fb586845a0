"""Lines of log files as (path, value).

Spark's text reader takes plain, gzip, bzip2 and zstandard files in stores it can read. Two kinds of
files it can't: names with a colon on the default local file system, and xz, which it would pass on
compressed without an error. Those are opened by the tasks, one file at a time, line by line.

A damaged file, such as a compressed one that is cut off, fails the job that reads it. Read again with
salvage, by a task of its own, it gives the lines before the damage, and errors() says what the damage is.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
import re
import shutil
import subprocess
import tempfile
import threading
import zlib
from collections.abc import Callable, Iterable
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "path string, value string"
_ROWS = 8192
#: What opening and reading a damaged file raises.
DAMAGE = (OSError, EOFError, ValueError, RuntimeError, zlib.error, lzma.LZMAError, subprocess.SubprocessError)


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path


def remote(path: str) -> bool:
    """Whether a file is in a store that only Spark's readers open."""
    return "://" in path and not path.startswith("file://")


def by_task(path: str) -> bool:
    """Whether a file has to be opened by a task rather than by Spark's reader."""
    scheme, found, rest = path.partition("://")
    return ":" in (rest if found else path) or path.endswith(".xz")


def open_file(path: str):
    """A file's bytes, decompressed by its extension."""
    path = _local(path)
    for end, opener in ((".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)):
        if path.endswith(end):
            return opener(path, "rb")
    if path.endswith(".zst"):
        import zstandard

        return zstandard.open(path, "rb")
    return open(path, "rb")


def paths_frame(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path) rows, dealt out one to a task."""
    paths = list(paths)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4096)), "path")


def batched(path: str, rows, names: tuple[str, ...], kinds, salvage: bool):
    """Arrow batches of rows, tuples of the columns after path; with salvage damage ends them."""
    held: list[tuple] = []

    def batch():
        columns = [pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), *columns], ["path", *names])

    try:
        for row in rows:
            held.append(row)
            if len(held) == _ROWS:
                yield batch()
                held = []
    except DAMAGE:
        if not salvage:
            raise
    if held:
        yield batch()


def by_line(open_lines: Callable, salvage: bool = False, keep_tail: bool = True):
    """For mapInArrow over paths: the lines that open_lines(path) gives, as LINES rows."""

    def rows(path):
        for line in open_lines(path):
            if keep_tail or line.endswith(b"\n"):
                yield (line.removesuffix(b"\n").decode("utf-8", "replace"),)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from batched(path, rows(path), ("value",), (pa.string(),), salvage)

    return run


def file_lines(path: str):
    with open_file(path) as lines:
        yield from lines


def errors(spark: SparkSession, paths: Iterable[str], rows: Callable) -> DataFrame:
    """(path, error): what reading rows(path) to its end raises; no row for a file that can be read."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    for _ in rows(path):
                        pass
                except DAMAGE as error:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{type(error).__name__}: {error}"])], ["path", "error"])

    return paths_frame(spark, paths).mapInArrow(run, "path string, error string")


def by_spark(spark: SparkSession, paths: list[str], whole: bool = False) -> DataFrame:
    """(path, value) by Spark's reader; path is as it was given."""
    df = spark.read.text(paths, wholetext=whole, lineSep=None if whole else "\n")
    given = {_resolved(p): p for p in paths}
    names = {}  # as a row's file is called, without the local scheme -> as it was given
    for uri in df.inputFiles():
        key = uri if remote(uri) else re.sub("^file:/+", "/", uri)
        names[key] = given.get(unquote(key), unquote(key))
    at = F.col("_metadata.file_path")
    at = F.when(at.startswith("file:///"), F.substr(at, F.lit(8))).when(at.startswith("file:/"), F.substr(at, F.lit(6))).otherwise(at)
    if all(key == path for key, path in names.items()):
        return df.select(at.alias("path"), "value")
    # a row for each file
    found = F.broadcast(spark.createDataFrame(list(names.items()), "_found string, _given string"))
    return df.select(at.alias("_at"), "value").join(found, F.col("_at") == F.col("_found"), "left").select(F.coalesce("_given", "_at").alias("path"), "value")


def _resolved(path: str) -> str:
    if remote(path):
        return path
    return os.path.abspath(_local(path))


def read(spark: SparkSession, paths: Iterable[str], drop_partial_tail: bool = False, salvage: bool = False) -> DataFrame:
    """(path, value): every line of every file; an unterminated last line counts unless it's to be dropped.

    With salvage tasks open all files, which have to be local ones, and damage ends a file.
    """
    paths = list(dict.fromkeys(paths))
    own = [p for p in paths if by_task(p) or drop_partial_tail or salvage]
    rest = [p for p in paths if p not in set(own)]
    out = by_spark(spark, rest) if rest else None
    if own:
        opened = paths_frame(spark, own).mapInArrow(by_line(file_lines, salvage, not drop_partial_tail), LINES)
        out = opened if out is None else out.unionByName(opened)
    return spark.createDataFrame([], LINES) if out is None else out


def program_lines(command: list[str]):
    """path -> the lines that a program prints when a file's decompressed bytes are piped into it.

    A program that ends with another status than 0 raises RuntimeError after its lines, with the end of what it said.
    """

    def lines(path: str):
        with open_file(path) as source, tempfile.TemporaryFile() as said, subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=said) as program:
            damage: list[Exception] = []

            def feed():
                try:
                    shutil.copyfileobj(source, program.stdin)
                except BrokenPipeError:  # it has read enough
                    pass
                except DAMAGE as error:
                    damage.append(error)
                finally:
                    try:
                        program.stdin.close()
                    except BrokenPipeError:
                        pass

            feeder = threading.Thread(target=feed)
            feeder.start()
            try:
                yield from program.stdout
                feeder.join()
            except GeneratorExit:
                program.kill()
                raise
            if damage:
                raise damage[0]
            if status := program.wait():
                said.seek(max(0, said.seek(0, os.SEEK_END) - 500))
                raise RuntimeError(f"{command[0]} ended with status {status}: {said.read().decode('utf-8', 'replace').strip()}".removesuffix(": "))

    return lines


def piped(spark: SparkSession, paths: Iterable[str], command: list[str], salvage: bool = False) -> DataFrame:
    """(path, value): lines that a program prints when a file's decompressed bytes are piped into it."""
    return paths_frame(spark, paths).mapInArrow(by_line(program_lines(command), salvage), LINES)
