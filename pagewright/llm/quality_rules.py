"""Quality rules on repetition: which share of a text's characters lies inside n-grams and lines that it repeats.

Rolling hashes of every n-gram length are taken with numpy over many texts at once. A word counts once however
many repeated n-grams cover it. The verdict compares each share with its limit, and symbols with words.

Defined cases: a null or empty text has no words and fails; a null doc_id is carried along; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, grams, mix, slices, text_bytes

#: The characters that count as symbols.
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


@dataclass(frozen=True)
class Limits:
    """Largest share of word characters in repeated n-grams by n, in repeated lines; symbols a word; base rules."""

    grams: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.28), (7, 0.26), (8, 0.24), (9, 0.22), (10, 0.20))
    line_chars: float = 0.30
    symbols: float = 0.10
    min_words: int = 20
    repeat_words: int = 30  # in a hundred, in 8-word windows


def repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries' key occurs twice or more in its document."""
    whole = mix(key + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(whole, kind="stable")
    same = np.zeros(len(whole), bool)
    if len(whole) > 1:
        eq = whole[order[1:]] == whole[order[:-1]]
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
    return same


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words that begins at one of `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], limits: Limits) -> dict[str, np.ndarray]:
    w = Words(texts)
    n_docs, n = len(texts), len(w.start)
    per_doc = lambda values: np.bincount(w.doc, values, n_docs)
    head = np.concatenate([[0], np.cumsum((w.bytes & 0xC0) != 0x80)])
    chars = head[w.end] - head[w.start]
    word_chars = per_doc(chars)
    n_words = np.diff(w.first)
    symbol = np.concatenate([[0], np.cumsum(np.isin(w.bytes, SYMBOLS))])
    n_symbols = symbol[w.offsets[1:]] - symbol[w.offsets[:-1]]

    shares = {}
    for size in sorted({*dict(limits.grams), 8}):
        if n < size:
            shares[size] = np.zeros(n, bool)
            continue
        key, whole = w.grams(size)
        at = np.flatnonzero(whole)
        shares[size] = covered(at[repeated(key[at], w.doc[at])], size, n)
    n_repeat = per_doc(shares[8].astype(float))

    # Lines: the bytes between line breaks, white space and all, if they hold a word.
    breaks = np.flatnonzero(w.bytes == 10)
    starts = np.union1d(w.offsets[:-1][np.diff(w.offsets) > 0], breaks + 1)
    starts = starts[starts < len(w.bytes)]
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(w.bytes))
    ends = ends - (w.bytes[ends - 1] == 10) if len(ends) else ends
    words = np.searchsorted(w.start, ends) - np.searchsorted(w.start, starts)
    full = words > 0
    starts, ends, doc = starts[full], ends[full], doc[full]
    buffer = w.bytes.tobytes()
    seen: dict = {}
    dup_lines, dup_chars = np.zeros(n_docs), np.zeros(n_docs)
    chars_to = np.concatenate([[0], np.cumsum(chars)])
    held = chars_to[np.searchsorted(w.start, ends)] - chars_to[np.searchsorted(w.start, starts)]
    last = -1
    for d, s, e, c in zip(doc.tolist(), starts.tolist(), ends.tolist(), held.tolist(), strict=True):
        if d != last:
            seen, last = {}, d
        line = buffer[s:e]
        if line in seen:
            dup_lines[d] += 1
            dup_chars[d] += c
        else:
            seen[line] = True

    failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_words * n_words)
    total = np.maximum(word_chars, 1)
    good = (dup_chars <= limits.line_chars * total) & (n_symbols <= limits.symbols * n_words)
    for size, most in limits.grams:
        good &= per_doc(shares[size] * chars) <= most * total
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "base_failed": failed, "kept": good & ~failed}


def quality_report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = measure(text_bytes(batch.column("text")), limits)
            arrays = [pa.array(np.asarray(v), pa.bool_()) if k in ("base_failed", "kept") else pa.array(np.asarray(v).astype(np.int64)) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


__all__ = ["Limits", "grams", "measure", "quality_report"]
