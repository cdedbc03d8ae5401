"""Page blocks: extraction filters, grouping, gap clusters, duplicates between sources, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


def native_blocks(blocks: DataFrame, words: DataFrame | None = None, min_chars: int = 5) -> DataFrame:
    """Blocks whose cleaned text is long enough, with the number of their words when words are given."""
    kept = blocks.where(T.strip(F.col("text")) != "").withColumn("clean", T.clean_text(F.col("text"))).where(F.char_length("clean") >= min_chars)
    if words is None:
        return kept
    counts = words.groupBy("page_key", "block_no").agg(F.count("*").alias("n_words"))
    return kept.join(counts, ["page_key", "block_no"], "left").fillna(0, ["n_words"])


def ocr_groups(words: DataFrame, keys: list[str], by_line: bool, min_conf: float = 40) -> DataFrame:
    """Confident words of a group: bounding box, mean confidence, and text in order."""
    good = words.where((F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) >= min_conf) & (T.strip(F.col("word")) != ""))
    order = (["line_no"] if by_line else []) + ["x0", "word_no"]
    items = F.array_sort(F.collect_list(F.struct(*order, "word")))
    g = good.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("conf").alias("conf"), items.alias("items"))
    text = F.array_join(F.transform("items", lambda s: s["word"]), " ")
    if by_line:  # words of a line by a space, lines by a line break
        text = F.aggregate("items", F.struct(F.lit("").alias("t"), F.lit(-1).alias("l")), lambda a, s: F.struct(F.concat(a["t"], F.when(a["l"] == -1, "").when(a["l"] == s["line_no"], " ").otherwise("\n"), s["word"]).alias("t"), s["line_no"].alias("l")), lambda a: a["t"])
    return g.select(*keys, "x0", "y0", "x1", "y1", "conf", T.clean_text(text).alias("text")).where(F.char_length("text") >= 2)


def line_cover(words: DataFrame) -> DataFrame:
    """A block's line boxes in line order."""
    per = words.where(T.strip(F.col("word")) != "").groupBy("page_key", "block_no", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return per.groupBy("page_key", "block_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "x0", "y0", "x1", "y1"))).alias("cover"))


def gap_clusters(words: DataFrame, order: list[str], factor: float = 2.5) -> DataFrame:
    """Words of each line cut where the gap to the running right edge is over factor times the upper median height."""
    line = ["page_key", "block_no", "line_no"]
    heights = words.where("y1 > y0").groupBy(*line).agg(F.array_sort(F.collect_list(F.expr("y1 - y0"))).alias("h"))
    median = heights.select(*line, F.element_at("h", F.expr("cast(size(h) div 2 as int) + 1")).alias("h"))
    solid = words.where(T.strip(F.col("word")) != "").join(median, line, "left").withColumn("h", F.coalesce("h", F.lit(10.0)))
    w = W.partitionBy(*line).orderBy(*order)
    edge = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = solid.withColumn("cut", F.when(F.col("x0") - edge > factor * F.col("h"), 1).otherwise(0))
    return cut.withColumn("cluster", F.sum("cut").over(w)).drop("cut")


def cluster_boxes(clustered: DataFrame, order: list[str]) -> DataFrame:
    keys = ["page_key", "block_no", "line_no", "cluster"]
    items = F.array_sort(F.collect_list(F.struct(*order, "word")))
    g = clustered.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n_words"), items.alias("items"))
    return g.select(*keys, "x0", "x1", "n_words", F.array_join(F.transform("items", lambda s: s["word"]), " ").alias("text"))


def drop_duplicates_of_native(ocr: DataFrame, native: DataFrame, least: float = 0.20) -> DataFrame:
    """OCR blocks without a native block on their page that overlaps them by IoU of at least `least`."""
    o, n = ocr.select(*[F.col(c).alias(f"o_{c}") for c in ocr.columns]), native.select(*[F.col(c).alias(f"n_{c}") for c in ("page_key", "x0", "y0", "x1", "y1")])
    left = o.join(n, (F.col("o_page_key") == F.col("n_page_key")) & (G.iou("o_", "n_") >= least), "left_anti")
    return left.select(*[F.col(f"o_{c}").alias(c) for c in ocr.columns])


def words_in_blocks(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, block, word) of every word box that overlaps a block's box."""
    w = words.select(*[F.col(c).alias(f"w_{c}") for c in ("page_key", "word_no", "x0", "y0", "x1", "y1")])
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in ("page_key", "block_no", "x0", "y0", "x1", "y1")])
    return w.join(b, (F.col("w_page_key") == F.col("b_page_key")) & G.overlaps("w_", "b_")).select(F.col("b_page_key").alias("page_key"), F.col("b_block_no").alias("block_no"), F.col("w_word_no").alias("word_no"))


def union_blocks(native: DataFrame, ocr: DataFrame) -> DataFrame:
    return native.unionByName(ocr, allowMissingColumns=True)


def reading_order(df: DataFrame, *ties: str) -> DataFrame:
    key: Column = F.bround(F.col("y0") / 10) * 10
    return df.withColumn("rank", F.row_number().over(W.partitionBy("page_key").orderBy(key, "x0", *ties)))
