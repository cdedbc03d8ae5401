"""Language identification: word-first backoff.

A known word has a log frequency per language. An unseen word is scored by its longest character n-grams that
some language has seen, from N down to 1 at each place. A document's score is the sum over its words.

Words are runs of letters (Unicode's L) in lower case, in learning as in prediction. The word table is fitted on a bounded
sample of the labelled rows (`sample_docs`, chosen by a hash of doc_id), on all words of their whole texts; n-grams that
fewer than `LEAST` words of it have are noise and are left out. Every document is predicted from its whole text: Arrow
splits a slice's texts and finds its distinct words, each of which is scored once.

Defined cases: null text and text without a letter give `und` with score 0, as does everything if no row is
labelled; rows with a null lang are never learnt from; a null doc_id is never learnt from but is predicted; repeated rows
are learnt from and predicted each.
"""

from __future__ import annotations

import math
import pickle
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, slices, unboxed, written

UNKNOWN = "und"
#: What lies between words.
BETWEEN = r"[^\p{L}]+"
#: Longest n-gram, and the least words that an n-gram is learnt from.
LONGEST, LEAST = 5, 3
#: Unseen words that a worker remembers.
CACHED = 100_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, sample_docs: int) -> DataFrame:
    """lang, word, n of the sampled labelled documents."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    n = docs.where("lang is not null and doc_id is not null").count()
    if n > sample_docs:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < (sample_docs << 62) // n)
    words = labelled.select("lang", F.explode(F.split(F.lower("text"), BETWEEN)).alias("word")).where("word <> ''")
    return written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")


class Model:
    """Log frequencies by language: `rows[words[w]]` of a known word, `gram_rows[grams[g]]` of an n-gram."""

    def __init__(self, languages: list[str], words: dict[str, int], rows: np.ndarray, grams: dict[str, int], gram_rows: np.ndarray):
        self.languages, self.words, self.rows, self.grams, self.gram_rows = languages, words, rows, grams, gram_rows
        self.unseen: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, found: pa.Table) -> Model:
        """found: lang, word, n."""
        langs, names = found.column("lang").combine_chunks().dictionary_encode(), found.column("word").combine_chunks().dictionary_encode()
        order = np.argsort(np.array(langs.dictionary.to_pylist(), object))
        languages = [langs.dictionary[int(i)].as_py() for i in order]
        words = {w: i for i, w in enumerate(names.dictionary.to_pylist())}
        counts = np.zeros((len(words), len(languages)))
        np.add.at(counts, (np.array(names.indices), np.argsort(order)[np.array(langs.indices)]), np.array(found.column("n")))
        grams: dict[str, int] = {}
        at, of = array("i"), array("i")  # plain numbers: the driver's memory is small
        for word in words:
            pieces = cls.pieces(word)
            at.extend([grams.setdefault(g, len(grams)) for g in pieces])
            of.append(len(pieces))
        at, of = np.frombuffer(at, np.int32) if at else np.zeros(0, np.int32), np.array(of, np.int32)
        gram_counts = np.stack([np.bincount(at, np.repeat(counts[:, k], of), len(grams)) for k in range(len(languages))], axis=1) if languages else np.zeros((0, 0))
        del at
        kept, rows = {}, [np.zeros((0, len(languages)), np.float32)]
        for size in range(1, LONGEST + 1):
            own = [g for g, i in grams.items() if len(g) == size and gram_counts[i].sum() >= LEAST]
            if own:
                kept |= {g: len(kept) + i for i, g in enumerate(own)}
                rows.append(cls.logs(gram_counts[[grams[g] for g in own]]))
        return cls(languages, words, cls.logs(counts), kept, np.concatenate(rows))

    @staticmethod
    def pieces(word: str) -> list[str]:
        marked = f"<{word}>"
        return [marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)]

    @staticmethod
    def logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / np.maximum(counts.sum(0) + 0.5 * len(counts), 0.5)).astype(np.float32)

    def backoff(self, word: str) -> np.ndarray:
        """Sum over the word's places of the longest known n-gram there, over the root of their number."""
        marked, grams, found = f"<{word}>", self.grams, []
        i, n = 0, len(marked)
        while i < n:
            for size in range(min(LONGEST, n - i), 0, -1):
                if (at := grams.get(marked[i : i + size])) is not None:
                    found.append(at)
                    break
            else:
                size = 1
            i += max(1, size - 1)
        return self.gram_rows[found].sum(0) / math.sqrt(len(found)) if found else np.zeros(len(self.languages), np.float32)

    def score(self, word: str) -> np.ndarray:
        if (i := self.words.get(word)) is not None:
            return self.rows[i]
        if (v := self.unseen.get(word)) is None:
            if len(self.unseen) >= CACHED:
                self.unseen = {}
            v = self.unseen[word] = self.backoff(word)
        return v

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())), BETWEEN)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if not self.languages or not len(distinct):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        per_word = np.array([self.score(w) if w else np.zeros(len(self.languages), np.float32) for w in distinct])
        at, doc = np.array(words.indices), np.repeat(np.arange(len(texts)), np.diff(np.array(lists.offsets)))
        total = np.stack([np.bincount(doc, per_word[at, k], len(texts)) for k in range(len(self.languages))], axis=1)
        real = np.bincount(doc, np.array([bool(w) for w in distinct])[at], len(texts)) > 0
        best = total.argmax(1)
        score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), real.tolist(), strict=True)], np.where(real, score, 0.0)


def fitted(docs: DataFrame, sample_docs: int = 2_500) -> bytes:
    """The pickled model. One task fits it, on the words of the bounded sample, so that the driver only passes it on."""
    counts = word_counts(docs, sample_docs)
    empty = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        model = Model.fit(pa.Table.from_batches(found, found[0].schema if found else empty))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = counts.coalesce(1).mapInArrow(run, "model binary").first()
    return bytes(made[0]) if made else pickle.dumps(Model.fit(empty.empty_table()))


@lru_cache(maxsize=1)
def _loaded(model: bytes) -> Model:
    """One a Python worker."""
    return pickle.loads(model)


def predicted(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = _loaded(sent.value).predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows that aren't held out."""
    model = fitted(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, min_score: float = 0.5, languages: list[str] | None = None) -> DataFrame:
    """Rows of docs whose text is in a known language (one of `languages` if given) with at least that score."""
    model = fitted(docs.where(~held_out(F.col("doc_id"))))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field("text")], names=["row", "text"]) for b in batches)
        for batch in slices(whole):
            found = zip(*_loaded(sent.value).predict(batch.column("text")), strict=True)
            keep = [lang != UNKNOWN and bool(score >= min_score) and (languages is None or lang in languages) for lang, score in found]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["row"])

    rows = boxed(docs)
    return unboxed(rows.mapInArrow(run, rows.schema), columns)
