import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from ipquarry.functions import filenames, ips, postings

GOOD = ["1.2.3.4", "1.0.3.4", "255.255.255.255", "0.0.0.0", "2600::1", "::", "::1", "1::", "fe80::a21e:13ff:ab31:3d60", "102:304::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "ABCD::EF01", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "0:0:1::", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7::", "2001:db8:0:1:1:1:1:1", "1:0:0:2:0:0:3:4"]
BAD = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "010.1.1.1", "999.1.1.1", "a.b.c.d", "-", "1:2:3", ":::", "1::2::3", "12345::", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8:9", "g::", "::1.2.3.400", "1.2.3.4::", ":1", "1:", "1:2:3:4:5:6:7:8::", "::01.2.3.4", None]


def test_addresses_as_columns(spark):
    rng = random.Random(1)
    more = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(50)]
    more += [":".join(rng.choice(["0", "0", f"{rng.getrandbits(16):x}"]) for _ in range(8)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in GOOD + BAD + more], "t string").select("t", ips.parse_ip("t").alias("ip"))
    for r in rows.select("t", "ip", ips.format_ip("ip").alias("back"), ips.family("ip").alias("family"), ips.ipv4_number("ip").alias("number")).collect():
        if r["t"] in BAD:
            assert r["ip"] is None and r["back"] is None, r
            continue
        want = ips.parse_address(r["t"])
        assert bytes(r["ip"]) == want, r
        assert ipaddress.ip_address(r["back"]).packed == want
        if len(want) == 4 or not r["back"].endswith("."):
            assert r["back"] == str(ipaddress.ip_address(want)), r
        assert r["family"] == (4 if len(want) == 4 else 6)
        assert r["number"] == (int.from_bytes(want, "big") if len(want) == 4 else None)


@pytest.mark.parametrize(
    ("text", "lo", "hi"),
    [("1.2.3.4/16", "01020000", "0102ffff"), ("1.2.3.4/24", "01020300", "010203ff"), ("fe80::a21e:13ff:ab31:3d60/64", "fe80" + "0" * 28, "fe80" + "0" * 12 + "f" * 16), ("1.2.3.4/32", "01020304", "01020304"), ("0.0.0.0/0", "0" * 8, "f" * 8)],
)
def test_cidr_bounds(text, lo, hi):
    assert ips.cidr_bounds(text) == ips.Range(bytes.fromhex(lo), bytes.fromhex(hi))


@pytest.mark.parametrize("text", ["1.2.3.4", "1.2.3.4/33", "1.2.3.0/255.255.255.0", "x/8", "fe80::1%a/64", "/8", "1.2.3.4/"])
def test_bad_blocks(text):
    with pytest.raises(ValueError, match="invalid CIDR"):
        ips.cidr_bounds(text)


def test_bad_address():
    with pytest.raises(ValueError, match='Invalid IP Address "nope"'):
        ips.query_range("nope")


NAME = "/bro/logs/2015-01-01/conn.blah.doesntmatter.log.gz"
TIMED = r"logs/(?P<year>\d\d\d\d)-(?P<month>\d\d)-(?P<day>\d\d)/\w+\.(?P<hour>\d\d):(?P<minute>\d\d)"


@pytest.mark.parametrize(("regex", "want"), [(r"logs/(?P<db>\d+)-\d+-\d+", "2015.db"), (r"logs/(?P<db>\d+-\d+)-\d+", "2015-01.db"), (r"logs/(?P<db>\d+-\d+-\d+)", "2015-01-01.db")])
def test_database_of_a_name(spark, regex, want):
    assert filenames.to_database(NAME, regex, "$db.db") == want
    got = spark.createDataFrame([(NAME,), ("other",)], "f string").select(filenames.database_column("f", regex, "$db.db")).collect()
    assert [r[0] for r in got] == [want, None]
    with pytest.raises(ValueError, match="did not match"):
        filenames.to_database("other", regex, "$db.db")


def test_templates(spark):
    regex, name = r"(?P<year>\d{4})-(?P<month>\d\d)", "a 2015-03"
    for template, want in [("$year$month.db", "201503.db"), ("${year}_x", "2015_x"), ("$$-$1-$2", "$-2015-03"), ("$yearx$nope.y", ".y")]:
        assert filenames.to_database(name, regex, template) == want
        assert spark.createDataFrame([(name,)], "f string").select(filenames.database_column("f", regex, template)).first()[0] == want
    with pytest.raises(ValueError, match="no database"):
        filenames.to_database(name, regex, "$nope")


def test_time_of_a_name(spark):
    utc = datetime.timezone.utc
    cases = [("/bro/logs/2016-01-01/conn.10:15:00-11:00:00.log.gz", (2016, 1, 1, 10, 15)), ("logs/2016-00-00/c.01:02", (2015, 11, 30, 1, 2)), ("logs/2016-13-32/c.25:61", (2017, 2, 2, 2, 1)), ("nothing", None)]
    rows = spark.createDataFrame([(n,) for n, _ in cases], "f string").select("f", filenames.time_column("f", TIMED).cast("long").alias("t")).collect()
    for r, (name, want) in zip(rows, cases):
        if want is None:
            assert r["t"] is None
            with pytest.raises(ValueError, match=f'did not match "{name}"'):
                filenames.to_time(name, TIMED)
        else:
            assert filenames.to_time(name, TIMED) == datetime.datetime(*want, tzinfo=utc)
            assert r["t"] == int(datetime.datetime(*want, tzinfo=utc).timestamp())


def test_buckets(spark):
    day = spark.sql("select timestamp'2016-02-03 10:15:00' as t")
    for unit, want in [("minute", "2016-02-03T10:15:00"), ("hour", "2016-02-03T10"), ("day", "2016-02-03"), ("month", "2016-02"), ("year", "2016")]:
        assert day.select(filenames.bucket("t", unit)).first()[0] == want
    with pytest.raises(ValueError, match="Invalid truncation period: week"):
        filenames.bucket("t", "week")
    for text, want in [("", ("month", "day")), ("year", ("year", "month")), ("month", ("month", "day")), ("day", ("day", "hour")), ("month/hour", ("month", "hour")), ("year/minute", ("year", "minute")), ("hour", ("hour", ""))]:
        assert filenames.parse_bucket(text) == want
    with pytest.raises(ValueError):
        filenames.parse_bucket("a/b/c")


def test_posting_forms(spark):
    df = spark.createDataFrame([([1, 2, 3, 5, 8, 13, 21],), ([],), ([7],)], "a array<long>").select("a", postings.delta_encode("a").alias("d"))
    got = df.select("a", "d", postings.delta_decode("d").alias("b")).collect()
    assert got[0]["d"] == [1, 1, 1, 2, 3, 5, 8]
    assert all(r["a"] == r["b"] for r in got)
    rows = spark.createDataFrame([("x", i) for i in (1, 5, 5, 40000)] + [("y", 2)], "k string, v long")
    union = postings.bitmap_union(postings.bitmaps(rows, "k", "v"), "k").collect()
    assert {r["k"]: r["n"] for r in union} == {"x": 3, "y": 1}
    deltas = postings.delta_encode_rows(rows.distinct(), "k", "v").where(F.col("k") == "x").orderBy("v").collect()
    assert [r["delta"] for r in deltas] == [1, 4, 39995]


def test_globs(tmp_path):
    for day in ("2020-01-01", "2020-01-02"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "a.log").write_text("")
    now = datetime.datetime(2020, 1, 2, 5)
    assert filenames.recent_globs(f"{tmp_path}/%Y-%m-%d/*.log", now) == [f"{tmp_path}/2020-01-01/a.log", f"{tmp_path}/2020-01-02/a.log"]
    assert filenames.recent_globs(f"{tmp_path}/2020-01-01/*.log", now) == [f"{tmp_path}/2020-01-01/a.log"]
    assert filenames.expand_glob(f"{tmp_path}/none*") == []


def test_msgpack_form(spark):
    def encoded(values):
        out = bytearray([0x90 + len(values)] if len(values) < 16 else b"\xdc" + len(values).to_bytes(2, "big") if len(values) < 65536 else b"\xdd" + len(values).to_bytes(4, "big"))
        for x in values:
            size = next(n for n, most in ((0, 1 << 7), (1, 1 << 8), (2, 1 << 16), (4, 1 << 32), (8, 1 << 64)) if x < most)
            out += bytes([x]) if not size else {1: b"\xcc", 2: b"\xcd", 4: b"\xce", 8: b"\xcf"}[size] + x.to_bytes(size, "big")
        return bytes(out)

    lists = [[], [0], [1, 2, 3, 5, 8, 13, 21], [127, 128, 255, 256, 65535, 65536, 4294967295, 4294967296, 2**62], list(range(15)), list(range(16)), list(range(300)), list(range(70000))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, a array<long>").select("i", postings.msgpack_encode("a").alias("b")).collect()
    assert {r["i"]: bytes(r["b"]) for r in rows} == {i: encoded(x) for i, x in enumerate(lists)}
