"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a code of radius + 1 bits. For each non-zero vector v of that length a mask keeps the
positions whose code has odd overlap with v. Any `radius` codes lie in the kernel of some v, so two fingerprints
that differ in at most `radius` bits agree under some mask: no pair is missed. Fingerprints are made distinct
first; a mask's buckets give a spanning forest of their links, not all pairs. A crowded bucket is cut by blocks
of the bits that its mask leaves out, again so that every close pair shares a block.

Defined cases: null and empty texts have fingerprint zero, linked like any other. Rows with a null doc_id have a
fingerprint, no component, and link nothing. Rows of one doc_id are one document whatever their texts: all their
fingerprints are of one component. `keep_one_each` goes by texts instead, so that no text is lost by a repeated doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_each, slices, spread_join, text_bytes, written
from .components import components

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: A bucket with more fingerprints is cut further before pairs are compared.
CROWDED = 512


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half the hashes of the shingles of A-Z-lowered words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for at in range(0, n, 65536):
        spans = zip(starts[at : min(n, at + 65536)].tolist(), ends[at + size - 1 : at + size - 1 + 65536].tolist(), strict=False)
        h = np.array([digest(line[s:e], SEED) for s, e in spans], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x) for x in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """2**(radius + 1) - 1 masks; position i has the code 1 + i mod that many."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(fps: np.ndarray, free: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most `radius` differing bits) among distinct fps, which differ in `free` bits only."""
    if len(fps) < 2:
        return []
    positions = [i for i in range(BITS) if free >> i & 1]
    if len(fps) > CROWDED and len(positions) > radius:
        out = []
        for k in range(radius + 1):
            block = sum(1 << i for i in positions[k :: radius + 1])
            key = fps & np.uint64(block)
            order = np.argsort(key, kind="stable")
            for part in np.split(fps[order], np.flatnonzero(np.diff(key[order])) + 1):
                out += close_links(part, free & ~block, radius)
        return out
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(fps) - 1):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(fps[j])))
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: linked distinct fingerprints of `distinct` (fp) that join the same groups as all links do."""
    tables = masks(radius)
    rows = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(tables)])
    dealt = distinct.select("fp", F.explode(rows).alias("key")).select("key.table", "key.part", "fp")
    dealt = dealt.repartition("table", "part").sortWithinPartitions("table", "part", "fp")
    full = (1 << BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def made(table, part, fps, upto):
            found = []
            if len(fps):
                cuts = np.flatnonzero((np.diff(table) != 0) | (np.diff(part) != 0)) + 1
                bounds = np.concatenate([[0], cuts, [len(fps)]])
                many = np.flatnonzero(np.diff(bounds) > 1)
                for k in many.tolist():
                    s, e = bounds[k], bounds[k + 1]
                    if e <= upto:
                        found += close_links(fps[s:e].view(np.uint64), full & ~tables[int(table[s])], radius)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            now = [np.array(batch.column(i)) for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            table, part, fps = held
            last = np.flatnonzero((table != table[-1]) | (part != part[-1])) if len(fps) else []
            start = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if start:
                yield made(table, part, fps, start)
                held = [x[start:] for x in held]
        if held is not None:
            yield made(*held, len(held[2]))

    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_nodes(prints: DataFrame) -> DataFrame:
    """fp, first (its smallest doc_id), n (its rows) of the rows with a doc_id."""
    return prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, component_id: the smallest doc_id reachable over links of fingerprints and over rows of one doc_id."""
    prints = written(fingerprints(docs), "fingerprints")
    rows, total = prints.where("doc_id is not null"), prints.count()
    nodes = written(fingerprint_nodes(prints), "nodes")
    first = lambda c: nodes.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    # A fingerprint's node is its smallest doc_id, so the least node reachable is the answer.
    edges = links(nodes.select("fp"), radius).join(first("a"), "a").join(first("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.count("*").alias("n")).where("least <> most").select("doc_id", "n")
    again = spread_join(rows, written(several, "several"), ["doc_id"], total).select("doc_id", "fp").distinct().join(nodes.select("fp", "first"), "fp")
    joined = written(components(edges.union(again.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))), "components")
    groups = nodes.join(joined, nodes["first"] == joined["node"], "left").select("fp", "n", F.coalesce("root", "first").alias("component_id"))
    named = spread_join(rows, written(groups, "groups"), ["fp"], total).select(*prints.columns, "component_id")
    return named.unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of texts that are near-duplicates, of its smallest doc_id. Rows with a null doc_id stay."""
    prints = written(fingerprints(docs.where("doc_id is not null")), "fingerprints")
    nodes = written(fingerprint_nodes(prints).select("fp", "n"), "nodes")
    joined = written(components(links(nodes.select("fp"), radius)), "components")
    groups = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("grp"))
    return one_each(docs, spread_join(prints, written(groups, "groups"), ["fp"], prints.count()))
