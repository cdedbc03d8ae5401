"""Quality selection by importance resampling.

Hashed unigram and bigram counts give two generative models: of target text (documents labelled as good) and of
raw text (every document). A document's log weight is the sum over its n-grams of log p_target - log p_raw; with
Gumbel noise, drawn from a hash of seed and doc_id, the k largest sums are a sample without replacement in
proportion to the weights. The k-th largest is found by counting digits of the keys, not by sorting.

The target model is fitted on at most about `sample_docs` labelled documents; the raw model counts all text, and
every document is scored on its whole text. k is `share` of all rows, by default the share of labelled
documents that are good, that is of quality and not toxic.

Defined cases: null and empty texts have weight 0; a null doc_id is scored and hashes like 0; equal keys are
ordered by doc_id, rows that repeat both stay or go together; without labels the target is the raw text and every row is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, text_bytes, written

BUCKETS = 1 << 13
SAMPLE_DOCS = 20_000
GOOD = "(quality = 1 and coalesce(toxic, 0) = 0)"
UNIT = 1_000_000  # of a key, for exact comparison


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of every unigram and bigram."""
    w = Words(texts)
    pair, whole = w.grams(2)
    bits = np.uint64(buckets - 1)
    return np.concatenate([w.doc, w.doc[:-1][whole] if len(w.doc) > 1 else w.doc[:0]]), np.concatenate([w.hash & bits, pair[whole] & bits]).astype(np.int64)


def model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """log p_target - log p_raw by bucket."""
    good = labels.where(f"{GOOD} and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, sample_docs / max(1, good.count()))
    # A bounded sample of ids, so the broadcast is bounded too: some 16 bytes each.
    ids = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(UNIT)) < int(share * UNIT)).withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in slices(batches):
            doc, at = features(text_bytes(batch.column("text")), buckets)
            counts[0] += np.bincount(at, minlength=buckets)
            counts[1] += np.bincount(at[np.array(batch.column("target"))[doc]], minlength=buckets)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "raw", "target"])

    summed = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in summed.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == buckets:
        return np.zeros(buckets, np.float32)
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight, n_features."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, at = features(text_bytes(batch.column("text")), len(sent.value))
            n = np.bincount(doc, minlength=batch.num_rows)
            total = np.bincount(doc, sent.value[at].astype(np.float64), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(n.astype(np.int64))], names=["doc_id", "log_weight", "n_features"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, log_weight double, n_features long")


def kth_largest(df: DataFrame, column: str, k: int, bits: int = 16) -> tuple[int, int]:
    """The k-th largest value of a long column, and how many of the k equal it; a count of digits a pass."""
    shifted = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    prefix = 0
    for shift in range(64 - bits, -1, -bits):
        digit = F.shiftrightunsigned(shifted, shift).bitwiseAND(F.lit((1 << bits) - 1))
        part = df if shift + bits == 64 else df.where(F.shiftrightunsigned(shifted, shift + bits) == prefix)
        for d, n in sorted(((r[0], r[1]) for r in part.groupBy(digit.alias("d")).count().collect()), reverse=True):
            if k <= n:
                prefix = (prefix << bits) | d
                break
            k -= n
    return prefix - (1 << 63), k


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11, temperature: float = 1.0) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept for every row of docs."""
    if share is None:
        by_doc = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.expr(GOOD).cast("double")).alias("good"))
        share = by_doc.agg(F.avg("good")).first()[0]
        share = 1.0 if share is None else share
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0).cast("long"))), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    scored = weights(docs, model(docs, labels)).withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(uniform)))
    scored = written(scored.withColumn("key", F.round(F.col("gumbel_key") * UNIT).cast("long")), "weights")
    n = scored.count()
    k = min(n, round(share * n))
    if not k:
        return scored.select("doc_id", "log_weight", "gumbel_key", F.lit(False).alias("kept"))
    least, ties = kth_largest(scored, "key", k)
    # Of equal keys the smallest ids: the largest of their negatives.
    negative = scored.where(F.col("key") == least).select((-F.coalesce("doc_id", F.lit(0).cast("long"))).alias("negative"))
    last, _ = kth_largest(negative, "negative", ties)
    kept = (F.col("key") > least) | ((F.col("key") == least) & (-F.coalesce("doc_id", F.lit(0).cast("long")) >= last))
    return scored.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept"))
