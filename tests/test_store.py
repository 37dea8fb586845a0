import datetime
import io
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from ipquarry.functions.ips import format_ip, parse_ip
from ipquarry.operators import stats
from ipquarry.operators.cidr_join import blocks_frame, join_blocks
from ipquarry.operators.store import Store, database_of, time_of
from ipquarry.plans import cli
from ipquarry.plans.engine import Engine, load_config, parse_config
from ipquarry.plans.http import serve
from ipquarry.streaming import ingest
from tests import logs

TIMED = r"logs/(?P<year>\d\d\d\d)-(?P<month>\d\d)-(?P<day>\d\d)/\w+\.(?P<hour>\d\d):(?P<minute>\d\d)"


def names(df):
    return [r["filename"].rsplit("/", 1)[1] for r in df.collect()]


def ips(df):
    return [r[0] for r in df.select(format_ip("ip")).collect()]


@pytest.fixture
def small(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = ["1.2.3.1", "1.2.3.2", "1.2.3.3", "1.2.3.4", "1.2.3.255"]
    files = {"1.txt": first, "2.txt": [*first, "2.0.0.2", "2.0.0.3"], "3.txt": ["102:304::1"]}
    paths = [logs.write(tmp_path / "log" / n, "".join(f"x {ip} y\n" for ip in v)) for n, v in files.items()]
    assert [r.status for r in store.index("i", "syslog", paths)] == ["indexed"] * 3
    return store, tmp_path


@pytest.mark.parametrize(
    ("query", "want"),
    [("1.2.3.4/24", ["1.txt", "2.txt"]), ("1.2.3.3/32", ["1.txt", "2.txt"]), ("1.2.3.3", ["1.txt", "2.txt"]), ("2.0.0.0/8", ["2.txt"]), ("102:304::1", ["3.txt"]), ("102:304::/16", ["3.txt"]), ("9.9.9.9", []), ("::ffff:1.2.3.0/120", [])],
)
def test_search(small, query, want):
    assert names(small[0].search("i", query)) == want


@pytest.mark.parametrize(
    ("query", "want"),
    [("1.2.3.0/24", ["1.2.3.1", "1.2.3.2", "1.2.3.3", "1.2.3.4", "1.2.3.255"]), ("1.0.0.0/8", ["1.2.3.1", "1.2.3.2", "1.2.3.3", "1.2.3.4", "1.2.3.255"]), ("2.0.0.0/8", ["2.0.0.2", "2.0.0.3"]), ("102:304::/8", ["102:304::1"]), ("100.111.99.0/24", []), ("47.108.111.0/24", []), ("109.97.120.0/24", [])],
)
def test_expand(small, query, want):
    assert ips(small[0].expand("i", query)) == want


def test_bad_queries(small):
    with pytest.raises(ValueError, match='Invalid IP Address "1.2.3"'):
        small[0].search("i", "1.2.3")
    with pytest.raises(ValueError, match="invalid CIDR"):
        small[0].expand("i", "1.2.3.4")


def test_indexing_again_and_more(small):
    store, tmp = small
    known = [r["filename"] for r in store.list_documents("i").collect()]
    special = logs.write(tmp / "log" / "special.txt", "x 100.111.99.58 y\nx 646f:633a::1 y\n")
    empty = logs.write(tmp / "log" / "zero.txt", "")
    got = store.index("i", "syslog", [*known, special, special, empty, str(tmp / "none.txt")])
    assert [r.status.split(":")[0] for r in got] == ["known"] * 3 + ["indexed"] * 2 + ["error"]
    assert names(store.search("i", "100.111.99.0/24")) == names(store.search("i", "646f:633a::/64")) == ["special.txt"]
    rows = {r["filename"].rsplit("/", 1)[1]: r for r in store.list_documents("i").collect()}
    assert [rows[n]["doc_id"] for n in ("1.txt", "2.txt", "3.txt", "special.txt", "zero.txt")] == [0, 1, 2, 3, 4]
    assert (rows["2.txt"]["records"], rows["2.txt"]["n_ips"], rows["zero.txt"]["records"], rows["zero.txt"]["n_ips"]) == (7, 7, 0, 0)
    assert store.has("i", empty) and not store.has("i", "nope") and not store.has("other", empty)
    lists = {r[0]: r["doc_ids"] for r in store.posting_lists("i").select(format_ip("ip"), "doc_ids").collect()}
    assert lists["1.2.3.4"] == [0, 1] and lists["102:304::1"] == [2]
    assert {r["n_ips"] for r in store.unique_ips("i").collect()} == {5, 7, 1, 2, 0}


def test_failed_attempts_leave_nothing(small):
    store, tmp = small
    lost = store.spark.createDataFrame([("lost", 0, bytearray(b"\x09\x09\x09\x09"), 1, "i", "flows.db", 4)], "batch_id string, doc_id long, ip binary, n long, indexer string, db string, family int")
    store._write("i", lost)
    assert names(store.search("i", "9.9.9.9")) == [] and ips(store.expand("i", "9.0.0.0/8")) == []
    assert store.postings("i").where("batch_id = 'lost'").count() == 1
    before = ips(store.expand("i", "0.0.0.0/0"))
    store.compact("i")
    assert store.postings("i").where("batch_id = 'lost'").count() == 0
    assert ips(store.expand("i", "0.0.0.0/0")) == before and names(store.search("i", "102:304::1")) == ["3.txt"]
    Store(store.spark, str(tmp / "empty")).compact("i")


def test_bounds_and_partitions_reach_the_scan(small):
    plan = small[0].search("i", "1.2.3.0/24")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ip" in plan and "LessThanOrEqual(ip" in plan
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "GreaterThanOrEqual(ip" in x)
    filters = scan.split("PartitionFilters")[1]
    assert "indexer#" in filters and "family#" in filters


def test_many_databases(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    paths = [logs.write(tmp_path / "logs" / day / "conn.10:15:00-11:00:00.log.gz", logs.tsv([("1.1.1.1", b)])) for day, b in (("2016-02-01", "2.2.2.2"), ("2015-01-01", "3.3.3.3"), ("2015-01-02", "2.2.2.2"))]
    other = logs.write(tmp_path / "elsewhere.log", "")
    got = store.index("c", "bro", [*paths, other], database_of(r"logs/(?P<y>\d+)-(?P<m>\d+)", "$y$m.db"), time_of(TIMED))
    assert [r.status.split(":")[0] for r in got] == ["indexed"] * 3 + ["error"]
    assert store.databases("c") == ["201501.db", "201602.db"]
    found = store.search("c", "2.2.2.2").collect()
    assert [(r["db"], r["doc_id"]) for r in found] == [("201501.db", 1), ("201602.db", 0)]
    assert ips(store.expand("c", "0.0.0.0/0")) == ["1.1.1.1", "2.2.2.2", "3.3.3.3"]
    assert len(store.search("c", "1.1.1.1", ["201501.db"]).collect()) == 2
    assert store.documents("c").where(F.col("doc_time") == F.to_timestamp(F.lit("2016-02-01 10:15:00"))).count() == 1


GOOD = [f"/bro/logs/{x}.log.gz" for x in ("2015-04-08/conn.10:00:00-11:00:00", "2015-04-08/conn.11:00:00-12:00:00", "2016-05-04/conn.17:00:00-18:00:00", "2016-05-04/conn.18:00:00-19:00:00", "2016-05-05/conn.03:00:00-04:00:00", "2016-05-05/conn.05:00:00-06:00:00")]
WRONG = "/bro/logs/2016-05-04/this.was.a.broken.filename.gz"


def report(spark, files, groupby, count):
    return stats.report(spark.createDataFrame([(f,) for f in files], "filename string"), TIMED, groupby, count)


def test_statistics(spark):
    got = report(spark, GOOD, "month", "hour")
    assert (got["hits"], got["first"], got["last"], got["first_time"], got["last_time"]) == (6, GOOD[0], GOOD[5], "2015-04-08T10:00:00Z", "2016-05-05T05:00:00Z")
    assert got["buckets"] == [{"bucket": "2015-04", "hits": 2}, {"bucket": "2016-05", "hits": 4}] and got["errors"] is None
    assert report(spark, GOOD, "month", "day")["buckets"] == [{"bucket": "2015-04", "hits": 1}, {"bucket": "2016-05", "hits": 2}]
    bad = report(spark, [*GOOD[:2], WRONG, *GOOD[3:]], "month", "day")
    assert bad["hits"] == 6 and bad["errors"] == [f'filename_to_time_regex did not match "{WRONG}"']
    back = [f"/{x}/logs/{d}-01/c.10:00" for x, d in (("a", "2016-05"), ("b", "2015-04"), ("c", "2016-05"))]
    assert [b["bucket"] for b in report(spark, back, "month", "day")["buckets"]] == ["2016-05", "2015-04", "2016-05"]
    last = report(spark, [GOOD[0], "/z"], "month", "day")
    assert last["last"] == "/z" and last["last_time"] == stats.NO_TIME and last["buckets"] == [{"bucket": "2015-04", "hits": 1}]
    none = report(spark, [], "nonsense", "")
    assert none == {"hits": 0, "first": "", "last": "", "first_time": stats.NO_TIME, "last_time": stats.NO_TIME, "buckets": None, "errors": None}
    with pytest.raises(ValueError, match="Invalid truncation period"):
        report(spark, GOOD, "hour", "")


def test_block_join(spark):
    addresses = ["1.2.3.4", "1.2.200.1", "10.0.0.1", "2600::1", "2600:1::1", "255.255.255.255"]
    blocks = ["1.2.3.0/24", "1.2.0.0/16", "1.2.3.4/32", "0.0.0.0/0", "10.0.0.0/9", "2600::/32", "2600::/13", "::/0"]
    got = join_blocks(spark.createDataFrame([(a, 1) for a in addresses], "t string, x int").withColumn("ip", parse_ip("t")), blocks_frame(spark, blocks))
    import ipaddress

    want = {(a, b) for a in addresses for b in blocks if ipaddress.ip_address(a) in ipaddress.ip_network(b)}
    rows = got.collect()
    assert {(r["t"], r["block"]) for r in rows} == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert join_blocks(spark.createDataFrame([], "ip binary"), blocks_frame(spark, blocks)).count() == 0


def configuration(tmp_path):
    one = {"backend": "bro", "file_glob": f"{tmp_path}/logs/*/conn.*", "filename_to_database_regex": r"logs/(?P<year>\d+)-(?P<month>\d+)", "filename_to_time_regex": TIMED, "database_root": f"{tmp_path}/dbs", "database_path": "$year$month.db"}
    return {"http": {"bind": "127.0.0.1:0"}, "indexers": [{"name": "conn"} | one, {"name": "text", "backend": "syslog", "file_glob": f"{tmp_path}/none*", "database_root": f"{tmp_path}/dbs", "store": ""}]}


@pytest.fixture
def engine(spark, tmp_path):
    for day, b in (("2015-04-08", "2.2.2.2"), ("2016-05-04", "3.3.3.3"), ("2016-05-05", "2.2.2.2")):
        logs.write(tmp_path / "logs" / day / "conn.10:15:00-11:00:00.log.gz", logs.tsv([("1.1.1.1", b), ("2600::1", "4.4.4.4")]))
    engine = Engine(spark, parse_config(json.dumps(configuration(tmp_path))))
    results = engine.index_all()
    assert [r.status for r in results["conn"]] == ["indexed"] * 3 and results["text"] == []
    return engine


def test_engine(engine):
    assert engine.indexers() == ["conn", "text"]
    assert len(engine.search("conn", "2.2.2.0/24").collect()) == 2
    assert ips(engine.expand("conn", "0.0.0.0/0")) == ["1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4"]
    assert engine.stats("conn", "2.2.2.2", "year")["buckets"] == [{"bucket": "2015", "hits": 1}, {"bucket": "2016", "hits": 1}]
    rows = engine.dump("conn", "2.2.2.0/24").collect()
    assert len(rows) == 2 and all("\t2.2.2.2\t" in r["value"] for r in rows)
    assert engine.dump("conn", "2.2.2.0/24", "literal").count() == 0 and engine.dump("conn", "9.9.9.9").count() == 0
    engine.daemon(passes=1)
    assert len(engine.list_recent("conn")) == 3
    engine.compact("conn")
    assert len(engine.search("conn", "1.1.1.1").collect()) == 3
    with pytest.raises(KeyError, match="not found"):
        engine.search("nope", "1.1.1.1")


def test_indexers_side_by_side(spark, tmp_path):
    names = ["a", "b:c/d", "x=y z%", "ü"]
    for i, _ in enumerate(names):
        for j in range(3):
            logs.write(tmp_path / f"in{i}" / f"{j}.txt", f"x 10.0.{i}.{j} y\n")
    text = {"indexers": [{"name": n, "backend": "syslog", "file_glob": f"{tmp_path}/in{i}/*", "database_root": f"{tmp_path}/db"} for i, n in enumerate(names)]}
    engine = Engine(spark, parse_config(json.dumps(text)))
    assert [[r.status for r in v] for v in engine.index_all().values()] == [["indexed"] * 3] * 4
    for i, n in enumerate(names):
        assert ips(engine.expand(n, "10.0.0.0/8")) == [f"10.0.{i}.{j}" for j in range(3)]
        assert len(engine.search(n, f"10.0.{i}.1").collect()) == 1
    engine.compact(names[1])
    assert len(engine.search(names[1], "10.0.1.0/24").collect()) == 3


def test_errors_stay_with_their_indexer(spark, tmp_path):
    text = configuration(tmp_path)
    text["indexers"][0]["backend"] = "nope"
    logs.write(tmp_path / "logs" / "2015-04-08" / "conn.1", "")
    results = Engine(spark, parse_config(json.dumps(text))).index_all()
    assert isinstance(results["conn"], ValueError) and results["text"] == []
    with pytest.raises(ValueError, match="Invalid store type"):
        parse_config('{"indexers": [{"name": "a", "backend": "bro", "store": "other"}]}')


def test_http(engine):
    server = serve(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path):
        try:
            with urllib.request.urlopen(base + path, timeout=60) as answer:
                return answer.status, answer.read().decode()
        except urllib.error.HTTPError as error:
            return error.code, error.read().decode()

    try:
        assert get("/indexers") == (200, '["conn", "text"]\n') == get("/v1/indexers")
        status, body = get("/search?i=conn&q=2.2.2.0/24")
        assert status == 200 and len(body.splitlines()) == 2
        assert get("/v1/search?i=conn&q=9.9.9.9") == (200, "")
        assert get("/expandcidr?i=conn&q=2600::/16") == (200, "2600::1\n")
        assert json.loads(get("/stats?i=conn&q=1.1.1.1&bucket=month/day")[1])["hits"] == 3
        assert len(get("/dump?i=conn&q=2.2.2.2")[1].splitlines()) == 2
        assert get("/search?q=1.1.1.1") == (400, "Missing parameter: i\n")
        assert get("/search?i=conn") == (400, "Missing parameter: q\n")
        assert get("/search?i=x&q=1.1.1.1") == (500, 'Indexer "x" not found\n')
        assert get("/search?i=conn&q=x") == (500, 'Invalid IP Address "x"\n')
        assert get("/stats?i=conn&q=1.1.1.1&bucket=a/b/c")[0] == 500 and get("/nope")[0] == 404
    finally:
        server.shutdown()


def test_commands(spark, tmp_path):
    def run(*arguments):
        out = io.StringIO()
        return cli.main(["--dbpath", str(tmp_path / "db"), *arguments], spark, out), out.getvalue()

    path = logs.write(tmp_path / "a.log", logs.tsv([("1.2.3.4", "5.6.7.8")]))
    assert run("version")[0] == 0
    assert run("index", f"{tmp_path}/*.log", "nothing*") == (0, f"{path}: indexed\n")
    assert run("index", f"{tmp_path}/*.log") == (0, f"{path}: known\n")
    assert run("search", "5.6.7.0/24") == (0, f"{path}\n") and run("expandcidr", "1.0.0.0/8") == (0, "1.2.3.4\n")
    assert run("compact") == (0, "") and run("search", "5.6.7.8") == (0, f"{path}\n")
    assert run("search", "x")[0] == 1
    logs.write(tmp_path / "logs" / "2015-04-08" / "conn.10:15", logs.tsv([("1.1.1.1", "2.2.2.2")]))
    (tmp_path / "c.json").write_text(json.dumps(configuration(tmp_path)))
    assert load_config(str(tmp_path / "c.json")).bind == "127.0.0.1:0"
    code, said = run("indexall", "-c", str(tmp_path / "c.json"))
    assert code == 0 and "indexed" in said


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    index = lambda paths: store.index("s", "syslog", paths)

    def run():
        query = ingest.stream(spark, str(tmp_path / "in"), "*.txt", index, str(tmp_path / "checkpoint"), seconds=None)
        assert query.awaitTermination(120)

    logs.write(tmp_path / "in" / "a.txt", "x 1.1.1.1 y\n")
    logs.write(tmp_path / "in" / "b.other", "x 1.1.1.1 y\n")
    run()
    assert names(store.search("s", "1.1.1.1")) == ["a.txt"]
    logs.write(tmp_path / "in" / "sub" / "c d.txt", "x 1.1.1.1 y\n")
    run()
    run()
    assert names(store.search("s", "1.1.1.1")) == ["a.txt", "c d.txt"]


def test_growing_files(tmp_path):
    path = logs.write(tmp_path / "a", "x")
    now = datetime.datetime.now().timestamp()
    assert ingest.settled([path, str(tmp_path / "gone")], 2, now) == [] and ingest.settled([path], 2, now + 10) == [path]
    assert not ingest.is_growing(path, 2, 0.01)


def test_json_errors_are_counted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = logs.write(tmp_path / "j.log", logs.json_lines([{"src": "1.1.1.1"}, "broken {", {"dst": "2.2.2.2"}]))
    store.index("j", "bro_json", [path])
    row = store.list_documents("j").first()
    assert (row["records"], row["n_ips"], row["error"]) == (3, 2, "1 records can't be read")
