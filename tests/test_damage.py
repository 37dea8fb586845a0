"""Damaged and vanished files, failing programs, and attempts that stop half way."""

import gzip
import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from ipquarry.operators.store import Store
from ipquarry.plans import cli
from ipquarry.plans.engine import Engine, parse_config
from ipquarry.plans.http import serve
from ipquarry.sources import lines, readers
from ipquarry.streaming import ingest
from tests import logs
from tests.test_store import ips, names


def cut_off(path, text, share=0.5):
    """A gzip file that ends early; random text, so that it has some lines before the damage."""
    data = gzip.compress(text.encode())
    path.write_bytes(data[: int(len(data) * share)])
    return str(path)


def many(n, start=0):
    import random

    rng = random.Random(n + start)
    return [(f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", f"11.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}") for _ in range(n)]


def documents(store, indexer):
    return {os.path.basename(r["filename"]): r for r in store.list_documents(indexer).collect()}


def test_damaged_files_of_each_format(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    good = [logs.write(tmp_path / f"good{i}.log.gz", logs.tsv([("1.1.1.1", f"2.2.2.{i}")])) for i in range(3)]
    bad = cut_off(tmp_path / "cut.log.gz", logs.tsv(many(3000)))
    noise = tmp_path / "noise.log.gz"
    noise.write_bytes(b"this isn't gzip")
    got = {os.path.basename(r.filename): r.status for r in store.index("c", "bro", [*good, bad, str(noise)])}
    assert [got[f"good{i}.log.gz"] for i in range(3)] == ["indexed"] * 3
    assert got["cut.log.gz"].startswith("damaged: EOFError") and got["noise.log.gz"].startswith("damaged: ")
    rows = documents(store, "c")
    assert 500 < rows["cut.log.gz"]["records"] < 2500 and rows["cut.log.gz"]["n_ips"] > 500 and "EOFError" in rows["cut.log.gz"]["error"]
    assert rows["noise.log.gz"]["records"] == 0 and rows["noise.log.gz"]["error"] and rows["good1.log.gz"]["error"] is None
    assert names(store.search("c", "2.2.2.0/24")) == [f"good{i}.log.gz" for i in range(3)]
    assert names(store.search("c", "10.0.0.0/8")) == ["cut.log.gz"]
    assert sorted(r["doc_id"] for r in rows.values()) == list(range(5))
    assert {r.status for r in store.index("c", "bro", [*good, bad, str(noise)])} == {"known"}

    capture = logs.pcap([logs.packet("1.1.1.1", "2.2.2.2")] * 5)
    one, two = logs.write(tmp_path / "a.pcap", capture), logs.write(tmp_path / "b.pcap", b"\0" * 50)
    assert [r.status.split(":")[0] for r in store.index("p", "pcap", [one, two])] == ["indexed", "damaged"]
    assert "not a pcap file" in documents(store, "p")["b.pcap"]["error"]

    whole = logs.write(tmp_path / "x.json.gz", logs.json_lines([{"src": "1.1.1.1"}]))
    cut = cut_off(tmp_path / "y.json.gz", logs.json_lines([{"src": a, "dst": b} for a, b in many(2000, 5)]))
    assert [r.status.split(":")[0] for r in store.index("j", "bro_json", [whole, cut])] == ["indexed", "damaged"]
    assert documents(store, "j")["y.json.gz"]["records"] > 200


def test_headers_that_change_are_found_while_indexing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    odd = logs.write(tmp_path / "odd.log", logs.tsv([("1.1.1.1", "2.2.2.2")]) + "#fields\tid.resp_h\tts\tid.orig_h\n3.3.3.3\tx\t4.4.4.4\n")
    late = logs.write(tmp_path / "late.log", "x\ty\tz\n#fields\tid.resp_h\n5.5.5.5\n")
    same = logs.write(tmp_path / "same.log", logs.tsv([("6.6.6.6", "7.7.7.7")]) * 2)
    bare = logs.write(tmp_path / "bare.log", "1\tC\t1.2.3.4\t1\t2.3.4.5\n")
    assert {r.status for r in store.index("c", "bro", [odd, late, same, bare])} == {"indexed"}
    assert ips(store.expand("c", "0.0.0.0/0")) == ["1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4", "5.5.5.5", "6.6.6.6", "7.7.7.7"]
    rows = documents(store, "c")
    assert [rows[f"{n}.log"]["records"] for n in ("odd", "late", "same", "bare")] == [2, 2, 2, 1]
    assert sorted(r["doc_id"] for r in rows.values()) == [0, 1, 2, 3]


def test_status_of_programs(spark, tmp_path, monkeypatch):
    path, other = logs.write(tmp_path / "x", "1.2.3.4 5.6.7.8\n"), logs.write(tmp_path / "y.gz", "9.9.9.9 8.8.8.8\n")
    fails = ["sh", "-c", "cat; if [ $(date +%s) -gt 0 ]; then echo sorry >&2; exit 3; fi"]
    with pytest.raises(Exception, match="ended with status 3"):
        lines.piped(spark, [path], fails).collect()
    assert [r["value"] for r in lines.piped(spark, [path], fails, salvage=True).collect()] == ["1.2.3.4 5.6.7.8"]
    assert [r["error"] for r in lines.errors(spark, [path], lines.program_lines(fails)).collect()] == ["RuntimeError: sh ended with status 3: sorry"]
    # a program that fails for one of two files
    only = tmp_path / "nfdump"
    only.write_text("#!/bin/sh\nif grep 9.9.9.9; then exit 0; else echo 1.2.3.4 5.6.7.8; exit 4; fi\n")
    only.chmod(0o755)
    monkeypatch.setattr(readers, "READERS", dict(readers.READERS))
    read, rows = readers._tool([str(only)], readers.from_pairs, (".txt",))
    readers.register(readers.Reader("nfdump", read, None, bad=readers._no_address, rows=rows))
    store = Store(spark, str(tmp_path / "store"))
    got = store.index("n", "nfdump", [path, other])
    assert got[0].status.startswith("damaged: RuntimeError: ") and "status 4" in got[0].status and got[1].status == "indexed"
    assert ips(store.expand("n", "0.0.0.0/0")) == ["1.2.3.4", "5.6.7.8", "8.8.8.8", "9.9.9.9"]


def test_vanished_files(spark, tmp_path):
    paths = [logs.write(tmp_path / "logs" / f"{i}.log", logs.tsv([("1.1.1.1", f"2.2.2.{i}")])) for i in range(3)]
    paths.append(cut_off(tmp_path / "logs" / "cut.log.gz", logs.tsv([("1.1.1.1", "9.9.9.9"), *many(2000)])))
    engine = Engine(spark, parse_config(json.dumps({"indexers": [{"name": "c", "backend": "bro", "file_glob": f"{tmp_path}/logs/*", "database_root": f"{tmp_path}/db"}]})))
    assert sorted(r.status.split(":")[0] for r in engine.index_all()["c"]) == ["damaged", "indexed", "indexed", "indexed"]
    os.remove(paths[1])
    with pytest.raises(FileNotFoundError, match="1.log"):
        engine.dump("c", "1.1.1.1")
    gone = []
    assert engine.dump("c", "1.1.1.1", missing=gone).count() == 3 and gone == [paths[1]]
    assert engine.dump("c", "9.9.9.9").count() == 1  # of the damaged file
    server = serve(engine, "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}", timeout=60) as answer:
                return answer.status, answer.read().decode(), answer.headers
        except urllib.error.HTTPError as error:
            return error.code, error.read().decode(), error.headers

    try:
        status, body, head = get("/dump?i=c&q=1.1.1.1")
        assert (status, len(body.splitlines()), head["X-Missing-Files"]) == (200, 3, paths[1])
        status, body, _ = get("/dump?i=c&q=2.2.2.1")
        assert status == 500 and "1.log" in body
        # a Spark error is an answer too
        os.remove(paths[0])
        engine.store("c").exists.__func__  # noqa: B018
        real, Store.exists = Store.exists, lambda self, path: True
        try:
            status, body, _ = get("/dump?i=c&q=2.2.2.0")
        finally:
            Store.exists = real
        assert status == 500 and body.strip()
    finally:
        server.shutdown()


def test_commands_say_errors(spark, tmp_path, capsys):
    bad = cut_off(tmp_path / "a.log.gz", logs.tsv(many(500)))
    import io

    out = io.StringIO()
    assert cli.main(["--dbpath", str(tmp_path / "db"), "index", bad], spark, out) == 1 and "damaged" in out.getvalue()
    (tmp_path / "db" / "documents" / "indexer=flows" / "v=0" / "db=flows.db" / "part-x.parquet").write_bytes(b"nothing of the kind")
    assert cli.main(["--dbpath", str(tmp_path / "db"), "search", "1.1.1.1"], spark, out) == 1
    assert capsys.readouterr().err.strip()


def test_daemon_goes_on(spark, tmp_path, monkeypatch):
    logs.write(tmp_path / "b" / "x.txt", "x 1.1.1.1 y\n")
    os.utime(tmp_path / "b" / "x.txt", (0, 0))
    engine = Engine(spark, parse_config(json.dumps({"indexers": [{"name": n, "backend": "syslog", "file_glob": f"{tmp_path}/{n}/*", "database_root": f"{tmp_path}/db"} for n in "ab"]})))
    passes, real = [], Engine.index

    def index(self, name, paths):
        passes.append(name)
        if name == "a":
            raise RuntimeError("always")
        return real(self, name, paths)

    monkeypatch.setattr(Engine, "index", index)
    engine.daemon(passes=3, wait=0.01)
    assert passes.count("a") == 3 and passes.count("b") == 3
    assert names(engine.search("b", "1.1.1.1")) == ["x.txt"]
    seen = []
    ingest.poll(lambda p: seen.append(p) or 1 / 0, lambda: [], passes=2, wait=0)
    assert len(seen) == 2


def test_nothing_stays_in_memory(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    held = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()
    for i in range(4):
        store.index("c", "bro", [logs.write(tmp_path / f"{i}.log", logs.tsv([("1.1.1.1", f"2.2.2.{i}")]))])
    assert held() == before and len(names(store.search("c", "1.1.1.1"))) == 4


STEPS = ["postings", "documents", "rename", "first file", "old version"]


@pytest.mark.parametrize("step", STEPS)
def test_compaction_may_stop_anywhere(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path / "store"))
    files = [logs.write(tmp_path / f"{i}.txt", f"x 10.0.0.{i} y\nx 2600::{i} y\n") for i in range(1, 4)]
    for f in files:
        store.index("i", "syslog", [f])

    def answers():
        return [
            names(store.search("i", "10.0.0.0/8")), names(store.search("i", "2600::2")), ips(store.expand("i", "0.0.0.0/0")), ips(store.expand("i", "2600::/16")),
            [(r["doc_id"], r["filename"], r["records"], r["n_ips"]) for r in store.list_documents("i").collect()], store.postings("i").count() >= 6,
        ]

    before = answers()

    class Stopped(Exception):
        pass

    def stops(*_):
        raise Stopped

    write = Store._write
    real_path = Store._path

    class Files:
        """A file system that stops at a step."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *args):
            if step == "documents":
                raise Stopped
            done = self.fs.rename(*args)
            if step == "rename":
                raise Stopped
            return done

        def delete(self, path, deep):
            if step == "old version" and deep:
                raise Stopped
            done = self.fs.delete(path, deep)
            if step == "first file":
                raise Stopped
            return done

    with monkeypatch.context() as patch:
        if step == "postings":
            patch.setattr(Store, "_write", lambda self, *a: (write(self, *a), stops()))
        patch.setattr(Store, "_path", lambda self, name: (lambda fs, at: (Files(fs), at))(*real_path(self, name)))
        with pytest.raises(Stopped):
            store.compact("i")
    assert answers() == before
    assert {r.status for r in store.index("i", "syslog", files)} == {"known"}
    more = logs.write(tmp_path / "more.txt", "x 10.0.0.9 y\n")
    store.index("i", "syslog", [more])
    assert names(store.search("i", "10.0.0.9")) == ["more.txt"]
    store.compact("i")
    store.compact("i")
    after = answers()
    assert after[0] == ["1.txt", "2.txt", "3.txt", "more.txt"] and after[1:2] == before[1:2] and [x[0] for x in after[4]] == [0, 1, 2, 3]
    parts = [p for p in (tmp_path / "store" / "documents").rglob("*.parquet")]
    assert len(parts) == 1 and store.postings("i").select("batch_id").distinct().count() == 1
