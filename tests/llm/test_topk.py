"""Top-k search against SQL and brute force: ties, repeated ids, odd vectors, several blocks of queries."""

import duckdb
import numpy as np
import pytest
from conftest import SF

from pagewright.llm import topk_search
from pagewright.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string"


def test_sql(compare):
    compare(lambda s, d: topk_search.embedding_top_k(table(s, d, "embeddings")), topk_search.ORACLE)


def odd_rows():
    rnd = np.random.default_rng(2)
    out = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [9.0, 9.0]), (5, [2.0, 2.0])]
    out += [(0, [1.0, 2.0]), (20, [-1.0, 5.0]), (5, [2.0, 3.0]), (40, []), (60, [0.5]), (7, [1.0, 1.0, 1.0])]
    # Many ties across the 20th rank, and one vector in a third of the rows.
    out += [(100 + i, [float(x) for x in rnd.integers(-1, 2, 3)]) for i in range(60)] + [(200 + i, [1.0, 1.0, 0.0]) for i in range(60)]
    return out


@pytest.mark.parametrize("queries", [3, 32_768])
def test_odd_rows(queries, spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERIES", queries)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in odd_rows()], SCHEMA)
    got = sorted(map(tuple, topk_search.embedding_top_k(docs).collect()))
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", odd_rows())
    assert got == sorted(con.execute(topk_search.ORACLE).fetchall())
    least = {}
    for i, v in odd_rows():
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            least[i] = min(least.get(i, [64 * x for x in v]), [64 * x for x in v])
    for q in (i for i in least if i % 20 == 0):
        scored = sorted((-int(sum(a * b for a, b in zip(least[q], v, strict=False))), i) for i, v in least.items() if i != q)[:20]
        assert [(-s, i) for s, i in scored] == [(s, i) for x, _, i, s in got if x == q]
    assert topk_search.embedding_top_k(docs.limit(0)).count() == 0 and topk_search.embedding_top_k(docs.where("vec_id = 5")).count() == 0


def test_pruning_is_exact_and_prunes():
    rnd = np.random.default_rng(4)
    rows = np.sort(rnd.integers(-40, 40, (900, 8)), axis=0)
    q, ids, own = rnd.integers(-40, 40, (7, 8)), np.arange(900), np.arange(7)
    for floor in (None, np.array([np.sort(np.delete(rows @ q[i], i))[-9] for i in range(7)])):
        search = topk_search.Search(own, q, 5, floor, 32)
        for at in (0, 400):
            search.chunk(ids[at : at + 400] if not at else ids[400:], rows[at : at + 400] if not at else rows[400:])
        a, b, s = search.results()
        assert search.opened < 0.7 * search.blocks
        for i in range(7):
            want = sorted((-int(q[i] @ rows[j]), j) for j in range(900) if j != i)[:5]
            assert [(-x, y) for x, y in zip(s[a == i].tolist(), b[a == i].tolist(), strict=True)] == want
