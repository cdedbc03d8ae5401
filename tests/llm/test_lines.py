"""Dropped lines against SQL and brute force: rows that share a doc_id, hot keys, odd rows."""

import collections
import hashlib

import duckdb
import pytest
from conftest import SF

from pagewright.llm import line_dedup
from pagewright.llm.common import table

LONG = [f"Boilerplate number {k} that is long enough to count everywhere." for k in range(4)]
SCHEMA = "doc_id long, text string, n_chars long, row string, bits string, text_hash long, h1 int"


def rows():
    out = [(i, "\n".join([LONG[0], f"own line {i}", "  " + LONG[i % 4].upper() + "\t"])) for i in range(30)]
    out += [(2, "first own line of a second text\nsecond own line"), (2, f"{LONG[1]}\nthird text"), (29, f"{LONG[0]}\nanother text of the keeper"), (5, None), (40, None), (41, ""), (42, "\n\n")]
    out += [(50 + i, "\n".join([f"only in four documents, so it has to stay, {i // 4}", LONG[3]] * 70)) for i in range(8)]  # beyond 64 lines
    return [*out, out[3], (None, LONG[0]), (None, LONG[0]), (None, None), (60, f"{LONG[0]}x" + "y" * 1_200_000)]


def brute(docs, least=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    ids = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                ids[key(line)].add(i)
    out = collections.Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(ids[key(x)]) < min_docs or i == max(ids[key(x)])]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [1, 10, 2000])
def test_rows_that_share_an_id(spark, hot, monkeypatch):
    """The same lines go whichever keys are hot."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    docs = spark.createDataFrame([(i, t, None, "r", "b", 1, 2) for i, t in rows()], SCHEMA)
    want = brute(rows())
    assert want == collections.Counter(tuple(r) for r in line_dedup.line_digest(docs).collect())
    assert sum(k[2] for k in want) > 300
    out = line_dedup.dedupe_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    texts = [r.text for r in out.collect() if r.doc_id == 2]
    assert "first own line of a second text\nsecond own line" in texts and "third text" in texts
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows())
    assert want == collections.Counter(con.execute(line_dedup.ORACLE).fetchall())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert line_dedup.line_digest(docs).count() == 0 and line_dedup.dedupe_lines(docs).columns == docs.columns


def test_one_sort_decides(spark):
    """The window takes the order of the range partitions; nothing is dealt out between."""
    docs = table(spark, SF, "documents")
    seen = line_dedup.occurrences(docs, 40)
    ranked = line_dedup.ranked(seen, line_dedup.hot_keys(seen))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(h1" not in plan[: plan.index("rangepartitioning")] and plan[: plan.index("rangepartitioning")].count("Sort [") == 1
