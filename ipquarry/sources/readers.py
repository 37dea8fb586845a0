"""Log formats. A reader turns files into (path, value, texts): one row per record.

`texts` is an array of what stands where addresses are expected. They are parsed after equal ones of a
file have become one, so parsing costs as much as there are distinct addresses, not records. What comes
after, counting records, distinct addresses of a file, filtering by a query, is the same for all formats.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ipquarry.functions.ips import Range, parse_ip, parse_ipv4
from ipquarry.sources import lines, pcap

#: Fixed value: the delimited forms of addresses in free text. One delimiter on either side is part of a
#: match, so two addresses with one character between them give one match.
TEXT_FORMS = (
    r"(?:[^0-9](?:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})[^0-9])"
    r"|(?:[^0-9A-Fa-f](?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})[^0-9A-Fa-f])"
    r"|(?:[^0-9A-Fa-f](?:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)[^0-9A-Fa-f])"
    r"|(?:[^0-9A-Fa-f](?:(?:[0-9A-Fa-f]{1,4}:){6,6}[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)[^0-9A-Fa-f])"
    r"|(?:[^0-9A-Fa-f](?:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}:)*[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)[^0-9A-Fa-f])"
)
#: The first of them alone.
IPV4_FORM = TEXT_FORMS[: TEXT_FORMS.index("|")]
#: The address fields of JSON records.
JSON_FIELDS = ("id.orig_h", "id.resp_h", "src", "dst")
#: Files up to so many have the places of their columns broadcast, a row each.
FEW = 50_000
TSV_FIELDS = ("id.orig_h", "id.resp_h")

RECORDS = "path string, value string, texts array<string>"


@dataclass(frozen=True)
class Reader:
    """How a format is read.

    read: files -> RECORDS rows; with salvage, damaged local files give what comes before the damage.
    rows: what a task goes through to find a file's damage. literal: the predicate of a literal dump.
    bad: the test of a record that can't be read. once: as read, in one pass over the files, where some of
    the rows may be odd: files that have one have to be read again by read.
    """

    name: str
    read: Callable[[SparkSession, list[str], bool], DataFrame]
    literal: Callable[[Column, str], Column] | None
    check: Callable[[], None] = lambda: None
    bad: Callable[[], Column] | None = None
    rows: Callable[[str], Iterable] = lines.file_lines
    once: Callable[[SparkSession, list[str]], DataFrame] | None = None
    odd: Callable[[], Column] | None = None


READERS: dict[str, Reader] = {}


def register(reader: Reader) -> Reader:
    READERS[reader.name] = reader
    return reader


def reader(name: str) -> Reader:
    if name not in READERS:
        raise ValueError(f"Unknown backend: {name}")
    return READERS[name]


# free text


def text_forms(value: Column | str) -> Column:
    """What looks like an address in a line of free text.

    Four of the five forms hold `::` or six groups that colons end; a line without either is searched for
    the first form only, which gives the same matches.
    """
    c = F.col(value) if isinstance(value, str) else value
    line = F.concat(c, F.lit("\n"))
    every = c.contains("::") | (c.contains(":") & c.rlike(r"(?:[0-9A-Fa-f]{1,4}:){6}"))
    found = F.when(every, F.regexp_extract_all(line, F.lit(TEXT_FORMS), F.lit(0))).otherwise(F.regexp_extract_all(line, F.lit(IPV4_FORM), F.lit(0)))
    return F.transform(found, lambda m: F.substr(m, F.lit(2), F.length(m) - 2))


def from_text(rows: DataFrame) -> DataFrame:
    return rows.select("path", "value", text_forms("value").alias("texts"))


# tab-separated with a header line


def _places(header: Column | str) -> list[Column]:
    """Places of the address columns, from 1, in a header line's names; null where there is none."""
    names = F.slice(F.split(header, "\t"), 2, 1 << 20)
    return [F.nullif(F.array_position(names, n), F.lit(0)).cast("int").alias(f"at_{i}") for i, n in enumerate(TSV_FIELDS)]


def _cells() -> Column:
    last = F.coalesce(F.greatest(*(F.col(f"at_{i}") for i in range(len(TSV_FIELDS)))), F.lit(0))
    cells = F.split("value", "\t", last + 1)  # what comes after the last address stays in one piece
    return F.array(*(F.when(F.col(f"at_{i}").isNotNull(), F.try_element_at(cells, F.col(f"at_{i}"))) for i in range(len(TSV_FIELDS))))


def headers(rows: DataFrame) -> DataFrame:
    """(path, header): the different header lines of each file."""
    return rows.where(F.col("value").startswith("#fields")).select("path", F.col("value").alias("header")).distinct()


def from_tsv(rows: DataFrame, heads: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """Records of rows whose files have one header each at most; it's found wherever it stands."""
    places = (headers(rows) if heads is None else heads).select("path", *_places("header"))
    if files is not None and files <= FEW:
        places = F.broadcast(places)
    data = rows.where(~F.col("value").startswith("#"))
    return data.join(places, "path", "left").select("path", "value", _cells().alias("texts"))


def from_tsv_whole(files: DataFrame) -> DataFrame:
    """Records of (path, value) rows that hold a whole file each: a header counts until the next one."""
    placed = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "value"))
    header = F.last(F.when(F.col("value").startswith("#fields"), F.col("value")), ignorenulls=True).over(Window.partitionBy("path").orderBy("at"))
    return _with_header(placed.withColumn("header", header).where(~F.col("value").startswith("#")))


def _with_header(rows: DataFrame) -> DataFrame:
    return rows.select("path", "value", *_places("header")).select("path", "value", _cells().alias("texts"))


def first_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, header) of files that begin with a header, among lines that begin with #; only those lines are read."""

    def of(source):
        for raw in source:
            line = raw.removesuffix(b"\n").decode("utf-8", "replace")
            if line.startswith("#fields"):
                return line
            if not line.startswith("#"):
                return None
        return None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with lines.open_file(path) as source:
                        header = of(source)
                except lines.DAMAGE:  # reading the file shows it
                    continue
                if header is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([header])], ["path", "header"])

    def remote(path):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        stream = at.getFileSystem(conf).open(at)
        try:
            source = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            return of(x.encode() for x in iter(source.readLine, None))
        finally:
            stream.close()

    far = [p for p in paths if lines.remote(p)]
    near = [p for p in paths if not lines.remote(p)]
    out = lines.paths_frame(spark, near).mapInArrow(run, "path string, header string") if near else spark.createDataFrame([], "path string, header string")
    if far:
        with ThreadPoolExecutor(16) as pool:
            found = [(p, h) for p, h in zip(far, pool.map(remote, far), strict=True) if h is not None]
        out = out.unionByName(spark.createDataFrame(found, out.schema))
    return out


def _tsv_once(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records by the header that each file begins with, and a row for every other header."""
    rows = lines.read(spark, paths)
    rows = rows.where(~F.col("value").startswith("#") | _is_header())
    rows = _joined(rows, first_headers(spark, paths), len(paths)).where(~F.col("value").eqNullSafe(F.col("header")))
    return rows.select("path", "value", F.when(~_is_header(), _cells()).alias("texts"))


def _joined(rows: DataFrame, heads: DataFrame, files: int) -> DataFrame:
    places = heads.select("path", "header", *_places("header"))
    return rows.join(F.broadcast(places) if files <= FEW else places, "path", "left")


def _is_header() -> Column:
    return F.col("value").startswith("#fields")


def _read_tsv(spark: SparkSession, paths: list[str], salvage: bool = False) -> DataFrame:
    """Records by the last header before each.

    A pass over the files finds those with more than the header that they begin with; only they are read in order,
    local ones line by line by a task, those in a store that only Spark reads as one row each.
    """
    if salvage:
        return _ordered(spark, [p for p in paths if not lines.remote(p)], salvage)
    heads = _joined(lines.read(spark, paths).where(_is_header()), first_headers(spark, paths), len(paths))
    odd = {r["path"] for r in heads.where(~F.col("value").eqNullSafe(F.col("header"))).select("path").distinct().collect()}  # files at most
    near, far = ([p for p in paths if p in odd and lines.remote(p) == x] for x in (False, True))
    parts = [_tsv_once(spark, even)] if (even := [p for p in paths if p not in odd]) else []
    if near:
        parts.append(_ordered(spark, near))
    if far:
        parts.append(from_tsv_whole(lines.by_spark(spark, far, whole=True)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _ordered(spark: SparkSession, paths: list[str], salvage: bool = False) -> DataFrame:
    """Records of files that a task reads in order."""
    import pyarrow as pa

    def headed(path):
        header = None
        for raw in lines.file_lines(path):
            line = raw.removesuffix(b"\n").decode("utf-8", "replace")
            if line.startswith("#fields"):
                header = line
            elif not line.startswith("#"):
                yield line, header

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from lines.batched(path, headed(path), ("value", "header"), (pa.string(), pa.string()), salvage)

    return _with_header(lines.paths_frame(spark, paths).mapInArrow(run, "path string, value string, header string"))


# JSON lines


def from_json(rows: DataFrame) -> DataFrame:
    """The address fields of JSON records: names in any case, the last of repeated ones that isn't null."""
    pairs = rows.select("path", "value", F.map_entries(F.from_json("value", "map<string,string>")).alias("_pairs"))
    own = pairs.withColumn("_pairs", F.filter("_pairs", lambda e: F.lower(e["key"]).isin(*JSON_FIELDS) & e["value"].isNotNull()))
    pick = lambda name: F.try_element_at(F.filter("_pairs", lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]
    return own.select("path", "value", F.array(*(pick(n) for n in JSON_FIELDS)).alias("texts"))


# exported flow records


def from_csv6(rows: DataFrame) -> DataFrame:
    """Comma-separated flow records; only lines with six parts or more are records, addresses are the fourth and fifth."""
    cells = F.split("value", ",", 6)
    return rows.where(F.size(cells) == 6).select("path", "value", F.array(F.get(cells, 3), F.get(cells, 4)).alias("texts"))


def from_pairs(rows: DataFrame) -> DataFrame:
    """Lines of two addresses with white space between."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    return rows.where(F.size(words) > 0).select("path", "value", words.alias("texts"))


def _tool(command: list[str], parse: Callable[[DataFrame], DataFrame], export: tuple[str, ...]):
    """read and rows of a Reader: through a program, or, for files with an export's extension, the exported text itself."""
    exported = lambda path: path.removesuffix(".gz").endswith(export)

    def read(spark: SparkSession, paths: list[str], salvage: bool = False) -> DataFrame:
        text, raw = [p for p in paths if exported(p)], [p for p in paths if not exported(p)]
        rows = lines.read(spark, text, salvage=salvage)
        return parse(rows.unionByName(lines.piped(spark, raw, command, salvage)) if raw else rows)

    return read, lambda path: lines.file_lines(path) if exported(path) else lines.program_lines(command)(path)


def _needs(program: str, arguments: list[str], says: str = "") -> Callable[[], None]:
    def check() -> None:
        if not shutil.which(program):
            raise FileNotFoundError(f"{program} isn't installed")
        out = subprocess.run([program, *arguments], capture_output=True, text=True, check=False)
        if says and says not in out.stdout + out.stderr:
            raise RuntimeError(f"{program} doesn't say {says!r}")

    return check


def _no_address() -> Column:
    return F.exists("texts", lambda t: parse_ip(t).isNull())


def _no_json() -> Column:
    return (F.trim("value") != "") & F.from_json("value", "map<string,string>").isNull()


def _lines_of(parse: Callable[[DataFrame], DataFrame]):
    return lambda spark, paths, salvage=False: parse(lines.read(spark, paths, salvage=salvage))


def _register_tool(name: str, command: list[str], parse, export: tuple[str, ...], check: Callable[[], None]) -> None:
    read, rows = _tool(command, parse, export)
    register(Reader(name, read, None, check, _no_address, rows))


register(Reader("syslog", _lines_of(from_text), lambda v, q: v.contains(q)))
register(Reader("bro", _read_tsv, lambda v, q: v.contains(f"\t{q}\t"), once=_tsv_once, odd=_is_header))
register(Reader("bro_json", _lines_of(from_json), lambda v, q: v.contains(f'"{q}"'), bad=_no_json))
_register_tool("nfdump", ["nfdump", "-qr", "-", "-o", "fmt:%sa %da", "-6"], from_pairs, (".txt",), _needs("nfdump", ["-V"]))
_register_tool("nfdump-csv", ["nfdump", "-qr", "-", "-o", "csv6"], from_csv6, (".csv", ".txt"), _needs("nfdump", ["-V"]))
_register_tool("argus", ["ra", "-r", "-", "-s", "saddr,daddr", "-c", " ", "-L", "-1"], from_pairs, (".txt",), _needs("ra", ["-h"], "Ra Version"))
register(Reader("pcap", pcap.read, None, rows=pcap.rows))


# what all formats share


def records(spark: SparkSession, name: str, paths: Iterable[str], salvage: bool = False) -> DataFrame:
    paths = list(dict.fromkeys(paths))
    return reader(name).read(spark, paths, salvage) if paths else spark.createDataFrame([], RECORDS)


#: Stand among addresses for records that can't be read, and for odd rows.
BAD, ODD = b"", b"\x00"


def counted(rows: DataFrame, bad: Column | None = None, odd: Column | None = None) -> DataFrame:
    """(path, ip, n): one row per file and address; a null ip has the number of records, BAD that of bad ones, ODD of odd rows.

    One pass over the records; each adds a mark to its texts. What is shuffled are partial counts of
    (file, text), and after parsing, of (file, address), which differ for other spellings only.
    """
    own = F.transform(F.array_distinct(F.filter("texts", lambda t: t.isNotNull())), lambda t: F.concat(F.lit("t"), t))
    marks = [F.array(F.lit("n"))]
    if bad is not None:
        marks.append(F.when(bad, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")))
    every = F.concat(*marks, own)
    if odd is not None:
        every = F.when(odd, F.array(F.lit("o"))).otherwise(every)
    texts = rows.select("path", F.explode(every).alias("text")).groupBy("path", "text").agg(F.count("*").alias("n"))
    text, kind = F.substr("text", F.lit(2)), F.substring("text", 1, 1)
    found = texts.select("path", kind.alias("kind"), F.when(kind == "t", parse_ip(text)).when(kind == "b", F.lit(bytearray(BAD))).when(kind == "o", F.lit(bytearray(ODD))).alias("ip"), "n")
    # texts that are no address add nothing; a filter would be pushed down and parse them twice
    counts = F.sum(F.when((F.col("kind") != "t") | F.col("ip").isNotNull(), F.col("n")))
    return found.groupBy("path", "ip").agg(counts.alias("n"))


def extract(rows: DataFrame) -> DataFrame:
    """(path, ip): the distinct addresses of each file; equal texts become one before they are parsed."""
    texts = rows.select("path", F.explode("texts").alias("text")).where("text is not null").distinct()
    return texts.select("path", parse_ip("text").alias("ip")).where("ip is not null").distinct()


def record_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count("*").alias("records"))


def dump(rows: DataFrame, name: str, query: str, block: Range, mode: str = "ip") -> DataFrame:
    """Records that match: by their addresses, or, where the format has one, by its literal test."""
    if mode not in ("ip", "literal"):
        raise ValueError(f"unknown mode {mode}")
    test = reader(name).literal
    if mode == "literal" and test is not None:
        return rows.where(test(F.col("value"), query))
    found = lambda parse, t: F.coalesce(block.contains(parse(t)), F.lit(False))
    # a mapped IPv4 address is written as IPv6
    test = (lambda t: found(parse_ipv4, t) | (t.contains(":") & found(parse_ip, t))) if block.family == 4 else (lambda t: found(parse_ip, t))
    return rows.where(F.exists("texts", test))
