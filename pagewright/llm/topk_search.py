"""Exact top-k inner-product search by block-at-a-time pruning.

A component is an impact of one of two terms, its positive and its negative side. Rows lie in order of id; so many of
them are a document-range block, which has a forward index (the integer matrix) and the maximum impact of every term. For
a query the blocks of a chunk are ordered by their summed term maxima, which bound every score in the block, and scored
through the forward index until the next bound is below the k-th best score: nothing that is skipped could have entered.

The rows stay in their partitions. Queries come to them by broadcast, QUERIES at a time and one job each, so a task holds
one block of queries, one chunk of rows, and k results a query. The k-th best score among a sample of the rows is a bound
that every task starts with: no task returns, or opens a block for, what cannot be among the k best. Ties go to the smaller id.

Defined cases: null vectors, vectors with null, NaN or infinite components and rows with a null id take no part; rows
that repeat an id are one vector, the least of them in order of components, as query and as candidate; no query finds its
own id; vectors of other lengths than the query's are compared as if padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BLOCK, CHUNK, QUERIES = 256, 8192, 32_768
#: Rows that give the first bound, at most and as a share of all.
SAMPLE, SHARE = 16_384, 0.25
#: Below every score, and safe to negate.
LEAST = -(1 << 62)
NO_ID = np.iinfo(np.int64).max


def impacts(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """id, v: floor(scale * component) as doubles' floors, of the rows that take part, one an id."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    whole = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.where(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(np.array(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.array(column.flatten())
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows; by floating point where that is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    for kind, limit in ((np.float32, 1 << 23), (np.float64, 1 << 52)):
        if most < limit:
            return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)
    return a @ b.T


class Search:
    """The best k for each of some queries, over chunks of rows that come one after the other."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None, block: int = BLOCK):
        self.q_ids, self.q, self.k, self.block = q_ids, q, k, block
        self.floor = np.full(len(q), LEAST) if floor is None else floor
        self.best, self.best_id = np.full((len(q), k), LEAST), np.full((len(q), k), NO_ID)
        self.blocks = self.opened = 0  # pairs of a query and a block, and those that were scored

    def chunk(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """ids in rising order."""
        starts, q = range(0, len(ids), self.block), self.q
        tops = np.array([rows[s : s + self.block].max(0) for s in starts])
        lows = np.array([rows[s : s + self.block].min(0) for s in starts])
        bound = _dots(np.maximum(q, 0), np.maximum(tops, 0)) + _dots(np.maximum(-q, 0), np.maximum(-lows, 0))
        order = np.argsort(-bound, axis=1, kind="stable")
        self.blocks += bound.size
        for turn in range(order.shape[1]):
            at = order[:, turn]
            least = np.maximum(self.best[:, -1], self.floor)
            open_ = np.flatnonzero(bound[np.arange(len(q)), at] >= least)
            if not len(open_):
                break
            self.opened += len(open_)
            found = []
            for b in np.unique(at[open_]).tolist():
                who = open_[at[open_] == b]
                part = slice(b * self.block, (b + 1) * self.block)
                scores = _dots(q[who], rows[part])
                i, j = np.nonzero(scores >= least[who][:, None])
                found.append((who[i], ids[part][j], scores[i, j]))
            self._take(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _take(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        other = self.q_ids[who] != ids
        who, ids, scores = who[other], ids[other], scores[other]
        touched, place = np.unique(who, return_inverse=True)
        if not len(touched):
            return
        place = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        s, i = np.concatenate([self.best[touched].ravel(), scores]), np.concatenate([self.best_id[touched].ravel(), ids])
        turn = np.lexsort((i, -s, place))
        head = np.searchsorted(place[turn], np.arange(len(touched)))
        keep = turn[(head[:, None] + np.arange(self.k)).ravel()]
        self.best[touched], self.best_id[touched] = s[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of all found."""
        full = self.best > LEAST
        return np.repeat(self.q_ids, self.k)[full.ravel()], self.best_id[full], self.best[full]


def _search(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None, block: int) -> DataFrame:
    """query_id, rank, vec_id, score of one block of queries; rows lie in order of id within their partitions."""
    sent = rows.sparkSession.sparkContext.broadcast((q_ids, q, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors, least = sent.value
        search = Search(own, vectors, k, least, block)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                search.chunk(np.array(part.column("id")), _matrix(part.column("v"), vectors.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in search.results()], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, asked: str, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. rows: id long, v array<long>, one an id; asked: the condition on id of a query."""
    rows = written(rows, "impacts")
    n, width, n_queries = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.expr(asked))).first()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (8 * CHUNK)))
    ranged = written(rows.repartitionByRange(parts, "id").sortWithinPartitions("id"), "ranges")
    some = ranged.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 52)) < int(min(SHARE, SAMPLE / max(1, n)) * (1 << 52)))
    groups = max(1, -(-n_queries // QUERIES))
    out = []
    for g in range(groups):
        of = ranged.where(F.expr(asked) & (F.pmod(F.xxhash64("id"), F.lit(groups)) == g)).toArrow().combine_chunks()
        q_ids = np.array(of.column("id"), np.int64)
        q = _matrix(of.column("v").combine_chunks() if len(of) else pa.array([], pa.list_(pa.int64())), width or 0)
        floor = np.full(len(q), LEAST)
        place = {int(x): i for i, x in enumerate(q_ids)}
        for r in _search(some, q_ids, q, k, None, block).where(F.col("rank") == k).collect():
            floor[place[r.query_id]] = r.score
        found = _search(ranged, q_ids, q, k, floor, block)
        out.append(found if groups == 1 else written(found, "found"))
    return reduce(DataFrame.unionByName, out)


def embedding_top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    return top_k(impacts(vectors), f"id % {every} = 0", k)


ORACLE = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) as v
  from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by vec_id),
flat as (select vec_id, unnest(v) as x, unnest(range(len(v))) as i from v),
pairs as (select q.vec_id as query_id, r.vec_id from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
products as (
  select q.vec_id as query_id, r.vec_id, cast(sum(q.x * r.x) as bigint) as score
  from flat q join flat r on q.i = r.i and q.vec_id <> r.vec_id where q.vec_id % 20 = 0 group by 1, 2),
scored as (select query_id, vec_id, coalesce(score, 0) as score from pairs left join products using (query_id, vec_id)),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
