"""The pipeline against brute force, stage by stage and as a whole, on a small corpus."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ipquarry.llm import packing, quality, secrets
from tests.llm.test_duplicates import normal, oracle
from tests.llm.test_secrets import ACCESS, ASSIGN, HEX

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage made, written and read again."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    keep = [r for r in rows(stages[0]) if model.score(pa.array([r[1]]))[0] >= 0.3]
    assert rows(stages[1]) == keep and 0 < len(keep) < stages[0].count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r[0] for r in keep}
    assert all(i in kept for i, y in labels.items() if y == 1)


def test_exact(stages):
    first = {}
    for r in rows(stages[1]):
        text = normal(r[1])
        if text not in first or r[0] < first[text][0]:
            first[text] = r
    assert rows(stages[2]) == sorted(first.values(), key=repr)


def test_near(stages):
    own = rows(stages[2])
    classes = oracle([(r[0], r[1]) for r in own], 5, 80, 100)
    assert rows(stages[3]) == [r for r, (i, _, least) in zip(own, classes) if i == least]


def redacted(text, found):
    text = ASSIGN.sub(lambda m: secrets.MARK if len(m[2]) >= 6 else m[0], text)
    text = ACCESS.sub(lambda m: secrets.MARK if len(m[0]) >= 20 else m[0], text)
    text = HEX.sub(lambda m: secrets.MARK if len(m[0]) >= 24 else m[0], text)
    for token in found:
        text = re.sub(rf"(?<![A-Za-z0-9+/_=-]){re.escape(token)}(?![A-Za-z0-9+/_=-])", secrets.MARK, text)
    return text


def test_secrets(stages):
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(stages[3]).collect()}
    want = []
    for r in rows(stages[3]):
        text = redacted(r[1], [r[1][a:b] for kind, a, b in spans[r[0]] if kind == "random"])
        want.append((r[0], text, r[2], r[3], len(text)))
    assert rows(stages[4]) == sorted(want, key=repr)


def pieces(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for r in docs:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, packing.END]
        at = packing.cuts(len(ids), 1024)
        out += [(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    return sorted(out)


def held(packed):
    filled = defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_packing(stages):
    assert held(stages[5].collect()) == pieces(rows(stages[4]))


def test_run(spark, stages):
    assert held(corpus_pipeline.run(spark, SMALL).collect()) == pieces(rows(stages[4]))


def test_only_what_is_needed_stays(spark):
    import glob
    import os

    from ipquarry.llm.common import shared_dir

    held_before = len(spark.sparkContext._jsc.getPersistentRDDs())
    at = f"{shared_dir(spark).removeprefix('file://')}/ipquarry-{spark.sparkContext.applicationId}/*"
    before = set(glob.glob(at))
    corpus_pipeline.run(spark, SMALL)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in set(glob.glob(at)) - before}
    assert left == {"secret_scans", "pieces", "piece_counts"}
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held_before


def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, tmp_path):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", None, 0), (9003, "tiny", None, "s", 4), (9003, "tiny", None, "s", 4), (9004, "long words here " * 20000, "en", "s", 320000)], base.schema)
    extra = base.unionByName(odd).selectExpr("*", "1 as digest", "'x' as own_1", "2 as gone", "3 as held_out", "4 as other_id", "5 as parts", "6 as hits")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, SMALL)
        assert extra.columns[:5] == base.columns
    assert len(held(corpus_pipeline.STAGES[-1][1](spark, extra, SMALL).where("doc_id is not null").collect())) > 0
