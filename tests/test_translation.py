"""The chain for one text."""

from pyspark.sql import functions as F

from pagewright.operators import translation


def test_translate_one(spark):
    names = "n int, provider string, source_lang string, target_lang string, text_hash string, src_text string"
    texts = ["The API pump weighs 12 kg .", "known text", "  ", None, "The API pump weighs 12 kg .", "API  ZERO"]
    rows = spark.createDataFrame([(i, "p", "en", "es", f"h{t}", t) for i, t in enumerate(texts)], names)
    memory = spark.createDataFrame([("p", "en", "es", "hknown text", "texto"), ("p", "en", "es", "hAPI  ZERO", "ZXQENTX0000ZXQ")], "provider string, source_lang string, target_lang string, text_hash string, translated_text string")
    work = lambda x: F.regexp_replace(F.regexp_replace(x, "weighs", "pesa"), "(API|12|pump)", "WRONG")
    out = {r.n: r.translated_text for r in translation.translate_one(rows, memory, work, glossary={"pump": "bomba"}, terms=["API"]).collect()}
    assert out == {0: "The API bomba pesa 12 kg.", 1: "texto", 2: "", 3: "", 4: "The API bomba pesa 12 kg.", 5: "API ZERO"}
