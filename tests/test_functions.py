"""Literal expectations for text, tokens, guards and streams."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import tokens as K
from pagewright.sources import fixtures as S
from pagewright.streaming import page_log


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,clean", [("This is an exam-\nple of hyphenation.", "This is an example of hyphenation."), ("Hello\r\n\n  world\t!", "Hello world!"), (None, ""), ("ﬁn a", "fin a")])
def test_clean(spark, raw, clean):
    assert value(spark, T.clean_text(F.lit(raw).cast("string"))) == clean


def test_tokens(spark):
    src = F.lit("Figure 9-59 uses API_KEY and 10 kg.")
    text, mapping = K.protect_entities(src, "b001_s001")
    assert "ZXQENT" in value(spark, text) and value(spark, K.restore(text, mapping)) == "Figure 9-59 uses API_KEY and 10 kg."
    text, mapping = K.protect_terms(F.lit("Hello world"), {"world": "mundo"}, "GLOS")
    assert value(spark, K.restore(text, mapping)) == "Hello mundo"


def test_postprocess(spark):
    assert value(spark, T.postprocess(F.lit("Hello ,world!This is a test ."), F.lit("x y"))) == "Hello, world! This is a test."


@pytest.mark.parametrize("a,b,why", [("Torque 12 N·m", "Torque 12 N·m", []), ("Torque 12 N·m", "Torque 14 N·m", ["numbers_units_changed"]), ("See Fig. 3-2", "See Fig. 3-3", ["numbers_units_changed", "references_changed"])])
def test_guard(spark, a, b, why):
    assert value(spark, T.guard(F.lit(a), F.lit(b))) == why


def test_streaming_counts_equal_batch(spark, tmp_path):
    batch = page_log.failures(S.attempts(spark, SF)).agg(F.sum("attempts"), F.sum("failures")).first()
    S.attempts(spark, SF).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(S.attempts(spark, SF).schema).parquet(str(tmp_path / "in"))
    q = page_log.failures(stream).writeStream.outputMode("complete").format("memory").queryName("failures").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("failures").agg(F.sum("attempts"), F.sum("failures")).first() == batch


def test_streaming_memory(spark, tmp_path):
    m = S.memory(spark, SF)
    m.write.parquet(str(tmp_path / "in"))
    q = page_log.upsert_memory(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert page_log.current(spark.read.parquet(str(tmp_path / "out"))).count() == m.count()


def test_many_terms(spark):
    """A long glossary is one fold; unused and empty terms change nothing."""
    terms = {f"term{i}": f"termo{i}" for i in range(120)} | {" ": "x", "a.b": "c"}
    text, mapping = K.protect_terms(F.col("t"), terms, "GLOS")
    df = spark.createDataFrame([("term7 and term70 or a.b axb",), ("none",), ("",), (None,)], "t string").select(K.restore(text, mapping).alias("r"))
    assert [r.r for r in df.collect()] == ["termo7 and termo70 or c axb", "none", "", None]
    assert spark.createDataFrame([("a",)], "t string").select(K.protect_terms(F.col("t"), {}, "GLOS")[0].alias("r")).first().r == "a"
