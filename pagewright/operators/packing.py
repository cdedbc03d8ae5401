"""Greedy batches of segments under a size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def batch_enabled(provider: Column, mode: Column) -> Column:
    """Whether segments go in batches: as the mode says, else (null, auto, anything) only with the one provider that keeps separators."""
    word = F.lower(F.btrim(mode, F.lit(" \t\r\n")))
    return F.when(word.isin("0", "false", "off", "no"), False).when(word.isin("1", "true", "on", "yes"), True).otherwise(provider == "libretranslate")


def batches(segments: DataFrame, keys: list[str], order: list[str], text: str, limit: int = 1200) -> DataFrame:
    """keys, order and batch (from 0): a batch ends where the next text and a separator don't fit.

    A group is one conversation or page, packed as one array; the first batch counts a separator, later ones begin without."""
    g = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.char_length(text).alias("len")))).alias("items"))
    folded = F.expr(f"""aggregate(items, struct(cast(0 as int) as n, cast(0 as int) as size, cast(array() as array<int>) as b),
        (a, s) -> case when a.size > 0 and a.size + s.len + 21 > {limit} then struct(a.n + 1 as n, s.len as size, array_append(a.b, a.n + 1) as b)
                       else struct(a.n as n, a.size + s.len + 21 as size, array_append(a.b, a.n) as b) end, a -> a.b)""")
    return g.select(*keys, F.explode(F.arrays_zip("items", folded.alias("b"))).alias("z")).select(*keys, *[F.col(f"z.items.{o}").alias(o) for o in order], F.col("z.b").alias("batch"))


def joined(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    sep = f"\n\n{C.SEGMENT}\n\n"
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s[text]), sep).alias("request"), F.count("*").alias("n"))


def split_reply(reply) -> object:
    return F.transform(F.split(reply, rf"(?U)\s*{C.SEGMENT}\s*", -1), lambda x: F.btrim(x, F.lit(" \t\r\n")))
