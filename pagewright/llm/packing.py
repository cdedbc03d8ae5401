"""Packing documents into sequences of a fixed number of tokens: hierarchical residual packing.

Every group of items is packed by best fit, longest first. Bins that are full but for a small slack are done. Of two
bins of a group one is always over half full, as the later one's first item didn't fit the earlier; so what can still be
joined is at most one bin a group, with another such bin or with a fuller one. These bins, and as many of the
emptiest others, go up a tree as items of their own and are packed by best fit again, until one group remains. An
item's place is the sum of the offsets on its way up.

Defined cases: a null text is empty and is the one end token. Rows that repeat a doc_id are packed each. No
piece is lost, cut pieces are exactly full but for the last, and lengths are unlimited.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, texts_of_ids
from .common import slices, text_bytes, written

#: Most items that one task packs.
GROUP = 100_000


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end token, cut where over capacity."""
    tail = np.uint32(end).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, width = codec(path), 4 * capacity
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            encoded = texts_of_ids(*tool.encode(text_bytes(batch.column("text"))))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += tail
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, x in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For sizes in falling order: each one's bin and offset there, and the bins' fills. A bit of `open` is a gap that some bin has."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins, offsets, fills = 0, [], [], []
    for size in sizes:
        rest = open_ >> size
        if rest:
            gap = size + (rest & -rest).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_ ^= 1 << gap
        else:
            b = len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        left = capacity - fills[b]
        if left:
            by_gap[left].append(b)
            open_ |= 1 << left
    return bins, offsets, fills


def _packed(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """item, bin, shift, fill: items (item, size) packed in each of so many groups. A bin is named after its first item."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, offsets, fills = best_fit(group["size"].tolist(), capacity)
        bins, offsets = np.array(bins), np.array(offsets)
        names = np.empty(len(fills), np.int64)
        names[bins[offsets == 0]] = group["item"].to_numpy()[offsets == 0]
        return pd.DataFrame({"item": group["item"], "bin": names[bins], "shift": offsets, "fill": np.array(fills)[bins]})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(run, "item long, bin long, shift long, fill long")


def pack(cut: DataFrame, capacity: int = 2048, slack: int | None = None, group: int = GROUP) -> DataFrame:
    """The rows of `cut` (with a column length of 1 to capacity) with sequence_id and offset."""
    slack = capacity // 256 if slack is None else slack
    cut = written(cut.withColumn("_pw_item", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < capacity).select(F.col("_pw_item").alias("item"), F.col("length").alias("size"))
    levels, groups = [], -(-rest.count() // group)
    while groups:
        levels.append(written(_packed(rest, groups, capacity), "bins"))
        if groups == 1:
            break
        bins = levels[-1].where((F.col("shift") == 0) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        small = bins.where(F.col("size") <= capacity // 2)
        n = small.count()  # at most one a group
        # Any join of two bins needs a small one, and if a fuller one takes it, so would one of the n emptiest.
        rest = small.unionByName(bins.where(F.col("size") > capacity // 2).orderBy("size", "item").limit(n))
        groups = -(-2 * n // max(group, 4))
    out = cut.withColumns({"sequence_id": F.col("_pw_item"), "offset": F.lit(0).cast("long")})
    for level in levels:
        up = level.select(F.col("item").alias("sequence_id"), F.col("bin").alias("_pw_bin"), F.col("shift").alias("_pw_shift"))
        out = out.join(up, "sequence_id", "left").withColumns({"sequence_id": F.coalesce("_pw_bin", "sequence_id"), "offset": F.col("offset") + F.coalesce("_pw_shift", F.lit(0))}).drop("_pw_bin", "_pw_shift")
    return out.drop("_pw_item")


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(pieces(docs, path, capacity), capacity).select(*columns)
