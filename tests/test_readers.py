import ipaddress
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from ipquarry.functions.ips import parse_ip, query_range
from ipquarry.sources import generators, readers
from tests import logs


def found(spark, name, *paths):
    rows = readers.records(spark, name, paths)
    out = defaultdict(set)
    for r in readers.extract(rows).collect():
        out[r["path"]].add(str(ipaddress.ip_address(bytes(r["ip"]))))
    counts = {r["path"]: r["records"] for r in readers.record_counts(rows).collect()}
    return dict(out), counts


def test_tab_separated(spark, tmp_path):
    pairs = [("1.2.3.4", "5.6.7.8"), ("2600::1", "5.6.7.8"), ("-", "999.1.1.1")]
    want = {"1.2.3.4", "5.6.7.8", "2600::1"}
    names = ["a.log", "b.log.gz", "c.log.xz", "d.log.bz2", "conn.10:15:00-11:00:00.log", "e f+g%20.log"]
    paths = [logs.write(tmp_path / n, logs.tsv(pairs)) for n in names]
    ips, counts = found(spark, "bro", *paths)
    assert ips == {p: want for p in paths} and counts == {p: 3 for p in paths}


def test_headers_change_within_a_file(spark, tmp_path):
    second = "#fields\tid.resp_h\tts\tid.orig_h"
    text = logs.tsv([("1.1.1.1", "2.2.2.2")]) + second + "\n3.3.3.3\tx\t4.4.4.4\nshort\n\n9.9.9.9\tx"
    odd = logs.write(tmp_path / "odd.log", text)
    bare = logs.write(tmp_path / "bare.log", "1\tC\t1.2.3.4\t1\t2.3.4.5\n")
    last = logs.write(tmp_path / "last.log", "#fields\tid.orig_h\tid.resp_h\n7.7.7.7\t8.8.8.8")
    ips, counts = found(spark, "bro", odd, bare, last)
    assert ips == {odd: {"1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4", "9.9.9.9"}, last: {"7.7.7.7", "8.8.8.8"}}
    assert counts == {odd: 5, bare: 1, last: 1}


def test_extended_fields(spark, tmp_path):
    fields = "#fields\t_path\t_write_ts\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tsrc\tdst"
    path = logs.write(tmp_path / "x.log", fields + "\nconn\t1\t2\tC\t192.168.1.145\t5\t192.168.1.1\t3.3.3.3\t4.4.4.4\n")
    assert found(spark, "bro", path) == ({path: {"192.168.1.145", "192.168.1.1"}}, {path: 1})


def test_json(spark, tmp_path):
    rows = [
        {"id.orig_h": "1.1.1.1", "id.resp_h": "2.2.2.2"}, {"ID.Orig_H": "3.3.3.3", "Src": "4.4.4.4", "dst": None}, {"src": "5.5.5.5", "n": {"dst": "9.9.9.9"}},
        '{"src":"6.6.6.6","src":"7.7.7.7"}', "broken {", {"src": 5, "dst": "2600::1"}, {},
    ]
    path = logs.write(tmp_path / "j.log.gz", logs.json_lines(rows))
    ips, counts = found(spark, "bro_json", path)
    assert ips[path] == {"1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4", "5.5.5.5", "7.7.7.7", "2600::1"}
    assert counts == {path: 7}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("a 1.2.3.4 b", ["1.2.3.4"]), ("from 2600::1 to x", ["2600::1"]), ("std::vector", ["d::"]), ("x ::1 ::2", ["::1"]), ("x ::ffff:1.2.3.4", ["::ffff:1"]), ("1.2.3.4 x", []),
        ("[1.2.3.4] [5.6.7.8]", ["1.2.3.4", "5.6.7.8"]), ("a 1.2.3.4 5.6.7.8", ["1.2.3.4"]), ("a 999.2.3.4 b", []), ("é1.2.3.4🎉", ["1.2.3.4"]), ("x 1:2:3:4:5:6:7:8", ["1:2:3:4:5:6:7:8"]), ("x=1.2.3.4", ["1.2.3.4"]), ("", []),
    ],
)
def test_free_text(spark, line, want):
    rows = readers.from_text(spark.createDataFrame([("f", line)], "path string, value string")).select("value", F.transform("texts", parse_ip).alias("found"))
    assert [ipaddress.ip_address(bytes(a)) for a in rows.first()["found"] if a is not None] == [ipaddress.ip_address(w) for w in want]


def test_exported_flows(spark, tmp_path):
    csv = logs.write(tmp_path / "a.csv", "t,d,p,1.2.3.4,5.6.7.8,80,x\nshort,line\nt,d,p,bad,9.9.9.9,1\nt,d,p,2600::1,::ffff:7.7.7.7,1,2,3\n")
    assert found(spark, "nfdump-csv", csv) == ({csv: {"1.2.3.4", "5.6.7.8", "9.9.9.9", "2600::1", "7.7.7.7"}}, {csv: 3})
    text = logs.write(tmp_path / "b.txt.gz", "  1.2.3.4   5.6.7.8 \n\n2600::1 1.1.1.1\n")
    for name in ("nfdump", "argus"):
        assert found(spark, name, text) == ({text: {"1.2.3.4", "5.6.7.8", "2600::1", "1.1.1.1"}}, {text: 2})


def test_programs(spark, tmp_path, monkeypatch):
    from ipquarry.sources import lines

    path = logs.write(tmp_path / "x.gz", "1.2.3.4 5.6.7.8\n" * 3)
    assert [r["value"] for r in lines.piped(spark, [path], ["cat"]).collect()] == ["1.2.3.4 5.6.7.8"] * 3
    monkeypatch.setenv("PATH", str(tmp_path))
    for name in ("nfdump", "nfdump-csv", "argus"):
        with pytest.raises(FileNotFoundError):
            readers.reader(name).check()
    for name in ("bro", "bro_json", "syslog", "pcap"):
        readers.reader(name).check()


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True), (">", True)])
def test_captures(spark, tmp_path, order, nano):
    packets = [
        logs.packet("1.1.1.1", "2.2.2.2"), logs.packet("3.3.3.3", "4.4.4.4", 1), logs.packet("5.5.5.5", "6.6.6.6", 2), logs.packet("2600::1", "2600::2"),
        logs.packet("7.7.7.7", "8.8.8.8", inner=("10.0.0.1", "10.0.0.2")), b"\x01" * 12 + b"\x08\x06" + b"\0" * 28, b"short",
    ]
    path = logs.write(tmp_path / "p.pcap.gz", logs.pcap(packets, order, nano) + b"cut")
    ips, counts = found(spark, "pcap", path)
    assert ips[path] == {"1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4", "5.5.5.5", "6.6.6.6", "2600::1", "2600::2", "7.7.7.7", "8.8.8.8", "10.0.0.1", "10.0.0.2"}
    assert counts == {path: 7}
    hits = readers.dump(readers.records(spark, "pcap", [path]), "pcap", "5.5.5.0/24", query_range("5.5.5.0/24")).collect()
    assert [r["value"].split(" ", 1)[1] for r in hits] == ["5.5.5.5 > 6.6.6.6"]


def test_dump_modes(spark, tmp_path):
    path = logs.write(tmp_path / "a.log", logs.tsv([("1.2.3.4", "5.6.7.8"), ("11.2.3.45", "1.2.3.9")]))
    rows = readers.records(spark, "bro", [path])
    size = lambda q, mode: readers.dump(rows, "bro", q, query_range(q), mode).count()
    assert (size("1.2.3.4", "ip"), size("1.2.3.0/24", "ip"), size("1.2.3.4", "literal"), size("1.2.3.0/24", "literal")) == (1, 2, 1, 0)
    text = readers.records(spark, "syslog", [path])
    assert readers.dump(text, "syslog", "1.2.3.4", query_range("1.2.3.4"), "literal").count() == 2
    with pytest.raises(ValueError):
        readers.dump(rows, "bro", "1.2.3.4", query_range("1.2.3.4"), "other")


def test_partial_tail(spark, tmp_path):
    from ipquarry.sources import lines

    path = logs.write(tmp_path / "a.txt", "one\n\ntwo\r\nthree")
    assert [r["value"] for r in lines.read(spark, [path]).collect()] == ["one", "", "two\r", "three"]
    assert [r["value"] for r in lines.read(spark, [path], drop_partial_tail=True).collect()] == ["one", "", "two\r"]
    assert lines.read(spark, []).count() == 0


def test_registry(spark):
    assert sorted(readers.READERS) == ["argus", "bro", "bro_json", "nfdump", "nfdump-csv", "pcap", "syslog"]
    with pytest.raises(ValueError, match="Unknown backend: x"):
        readers.reader("x")
    assert readers.records(spark, "bro", []).count() == 0


def test_generated_logs(spark, tmp_path):
    lines = [r["value"] for r in generators.tsv_lines(spark, 50, 3, 2).collect()]
    path = logs.write(tmp_path / "g.log", "\n".join([generators.HEADER, *lines]) + "\n")
    ips, counts = found(spark, "bro", path)
    assert counts == {path: 50} and len(ips[path]) == len({c for line in lines for c in (line.split("\t")[2], line.split("\t")[4])})
    assert all(i.startswith("10.20.") for i in ips[path])
    path = logs.write(tmp_path / "g.json", "\n".join(r["value"] for r in generators.json_lines(spark, 20).collect()) + "\n")
    assert found(spark, "bro_json", path)[1] == {path: 20}
