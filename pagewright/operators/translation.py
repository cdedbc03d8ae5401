"""One text at a time: protect, cut, translate, restore and tidy, with the memory before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from .memory import KEY, translate_many

Work = Callable[[Column], Column]


def translated(rows: DataFrame, work: Work, limit: int = 1200, glossary: dict[str, str] | None = None, terms: list[str] | None = None, mode: str = "default") -> DataFrame:
    """rows (KEY and src_text) with translated_text. work() turns one chunk into its translation.

    Fixed terms, then glossary terms, then entities become tokens, and come back in the opposite order."""
    text, fixed = K.protect_terms(T.strip(F.col("src_text")), {t: t for t in terms or []}, "ENT", "T")
    df = rows.select("*", text.alias("_pw_a"), fixed.alias("_pw_fixed"))
    text, meant = K.protect_terms(F.col("_pw_a"), glossary or {}, "GLOS")
    df = df.select("*", text.alias("_pw_b"), meant.alias("_pw_meant"))
    text, entities = K.protect_entities(F.col("_pw_b"), "E", mode)
    df = df.select("*", text.alias("_pw_c"), entities.alias("_pw_entities"))
    chunks = F.filter(T.chunk_text(F.col("_pw_c"), limit), lambda x: T.strip(x) != "")
    out = T.strip(F.array_join(F.transform(chunks, work), " "))
    for name in ("_pw_entities", "_pw_meant", "_pw_fixed"):
        df = df.withColumn("_pw_out", K.restore(out, F.col(name)))
        out = F.col("_pw_out")
    df = df.withColumn("_pw_out", T.postprocess(out, T.strip(F.col("src_text"))))
    done = F.when(F.col("target_lang") == "pb", T.ptbr(F.col("_pw_out"))).otherwise(F.col("_pw_out"))
    return df.select(*rows.columns, done.alias("translated_text"))


def translate_one(rows: DataFrame, memory: DataFrame, work: Work, **options) -> DataFrame:
    """rows with translated_text from the memory, else made once for each distinct text. A null or blank text is empty."""
    blank = F.coalesce(T.strip(F.col("src_text")), F.lit("")) == ""
    empty = rows.where(blank).withColumn("translated_text", F.lit(""))
    return translate_many(rows.where(~blank), memory, lambda todo: translated(todo.select(*KEY, "src_text"), work, **options)).unionByName(empty)
