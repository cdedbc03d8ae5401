"""The translation memory: lookup, upsert, and doing each distinct text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C

KEY = ["provider", "source_lang", "target_lang", "text_hash"]


def usable(memory: DataFrame) -> DataFrame:
    """Without entries that hold placeholders."""
    return memory.where(~F.col("translated_text").rlike(C.BAD_MEMORY))


def lookup(texts: DataFrame, memory: DataFrame) -> DataFrame:
    """texts with translated_text, null where the memory has none; a null text is never found."""
    return texts.join(usable(memory).select(*KEY, "translated_text"), KEY, "left")


def missing(texts: DataFrame, memory: DataFrame) -> DataFrame:
    return texts.join(usable(memory).select(*KEY), KEY, "left_anti")


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """The newer row wins on the key."""
    both = memory.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    return both.withColumn("r", F.row_number().over(W.partitionBy(*KEY).orderBy("age", "translated_text"))).where("r = 1").drop("r", "age")


def once_each(df: DataFrame, text: str, out: str, work: Callable[[Column], Column]) -> DataFrame:
    """work() on the distinct texts only, joined back to all rows by the text's hash; a null text is a text of its own."""
    key = F.sha2(F.concat(F.col(text).isNull().cast("string"), F.coalesce(F.col(text), F.lit(""))), 256)
    keyed = df.withColumn("_pw_key", key)
    done = keyed.select("_pw_key", text).distinct().select("_pw_key", work(F.col(text)).alias(out))
    return keyed.join(done, "_pw_key").drop("_pw_key")


def translate_many(texts: DataFrame, memory: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """texts (KEY and src_text): from the memory, or else from work() on the distinct rest."""
    found = lookup(texts, memory)
    todo = missing(texts.select(*KEY, "src_text").distinct(), memory)
    made = work(todo).select(*KEY, F.col("translated_text").alias("made"))
    return found.join(made, KEY, "left").withColumn("translated_text", F.coalesce("translated_text", "made")).drop("made")
