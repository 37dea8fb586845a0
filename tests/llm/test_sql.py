import pytest

import __spark_entry__
from ipquarry.llm import queries
from tests.compare import check


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert check(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


def test_wordhash_against_split():
    import random
    import re

    import numpy as np
    import pyarrow as pa

    from ipquarry.llm.wordhash import buffer, slices, words

    rng = random.Random(1)
    texts = ["", None, "A b  c", " x", "yé\x0bz ", "aaa aaa", "x" * 300] + ["".join(rng.choice("ab C\té\n") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    column = pa.array(texts)
    want = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    seen = {}
    for window in (1 << 20, 16, 7, 1):
        hashes, _, upto = words(*buffer(column), window)
        assert np.diff(upto).tolist() == [len(w) for w in want]
        for word, h in zip((w for ws in want for w in ws), hashes.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    part = column.slice(3, 50)
    assert words(*buffer(part))[0].tolist() == words(*buffer(column))[0][sum(map(len, want[:3])) : sum(map(len, want[:53]))].tolist()
    assert sum(n for _, n in slices(column, 50)) == len(texts)
