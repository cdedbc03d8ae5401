import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def compare(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        got = [tuple(r[n] for n in names) for r in df.collect()]
        cur = duck.execute(sql)
        have = [x[0] for x in cur.description]
        assert sorted(have) == names
        at = [have.index(n) for n in names]
        norm = lambda rows: sorted((tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows), key=repr)
        want = [tuple(r[i] for i in at) for r in cur.fetchall()]
        a, b = norm(got), norm(want)
        assert len(a) == len(b) and a == b, next(((x, y) for x, y in zip(a, b) if x != y), (len(a), len(b)))
        assert a

    return check
