"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker turns into arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = (1 << 20) - 4096
#: A key with over one in so many rows is hot; there are fewer such keys than this, whatever the table's size.
HOT = 2000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one if all runs in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir isn't set, and executors of {master} share no other folder")
        found = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by `written` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside all columns in one struct `row`, so that no other column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", *[F.col(f"row.{c}").alias(c) for c in columns])


def unboxed(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The struct's columns again, some of them replaced."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with `keyed`, which has one row a key and in `n` the number of `rows` with it; total: all rows.

    Hot keys, fewer than HOT by definition, are broadcast, so that their rows stay where they are; the others are
    joined by shuffle, where no key has over one in HOT of the rows.
    """
    hot = keyed.where(F.col("n") * HOT > total).drop("n")
    cold = keyed.where(F.col("n") * HOT <= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def one_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs without all but one row of each group, the one of its smallest doc_id. Rows with a null doc_id stay.

    grouped: doc_id, text_hash (xxhash64 of the text) and grp of every row with a doc_id; rows that are equal in the first two are of one group."""
    row = ["doc_id", "text_hash"]
    texts = grouped.groupBy(*row).agg(F.min("grp").alias("grp"), F.count("*").alias("n"))
    kept = written(texts.groupBy("grp").agg(F.min(F.struct(*row, "n")).alias("kept")).select("kept.*"), "kept")
    given = boxed(docs, "doc_id").withColumn("text_hash", F.xxhash64("row.text"))
    found = given.join(kept.hint("shuffle_hash"), row, "left").where("doc_id is null or n is not null")
    if kept.where("n > 1").isEmpty():
        return unboxed(found, docs.columns)
    single = found.where("doc_id is null or n = 1").select("row")
    return unboxed(single.unionByName(found.where("n > 1").groupBy(*row).agg(F.first("row").alias("row")).select("row")), docs.columns)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no slice but a single row's has over `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        start, held = 0, 0
        for i, n in enumerate(sizes.to_pylist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 .. for each size, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - before, size)


# Arithmetic modulo 2**64: a position-weighted sum can be taken from prefix sums as the weight is odd, hence invertible.
WORD_STEP, GRAM_STEP = 0x9E3779B97F4A7C1B, 0xD1342543DE82EF93


_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i for at least `size` positions. A worker holds one pair of arrays a step, as long as it has needed."""
    if step not in _held or len(_held[step][0]) < size:
        out = []
        for x in (step, pow(step, -1, 1 << 64)):
            p = np.full(1 << max(16, int(size - 1).bit_length()), x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _held[step] = out[0], out[1]
    return _held[step]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts as arrays: byte span, document number and 64-bit hash."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        b, n = self.bytes, len(self.bytes)
        solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = solid[:-1], solid[1:]
            cut = self.offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            before[cut], after[cut - 1] = False, False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)  # of each document's words
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = powers(WORD_STEP, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values()[b] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n words from each place, and whether they are of one document; shorter by n - 1."""
        return grams(self.hash, n), self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1] if len(self.doc) >= n else np.zeros(0, bool)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n neighbours."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(GRAM_STEP, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])
