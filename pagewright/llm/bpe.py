"""Byte-pair encoding and decoding with a public tokenizer's vocabulary file.

Each short word is a row of a contiguous array of part ids beside an array of the ranks of adjacent parts. All
words of one length go together: find the least rank of each row, delete that boundary, refresh the ranks of
its two neighbours, until a row has no rank left. Words over LONG bytes go through a heap over a linked list,
which gives the same parts in n log n.

A text is cut into units before every run of white space that follows something else, and before punctuation after a
letter or digit, which no word of either kind of file crosses. Arrow finds a slice's distinct units; only those that a Python worker hasn't met are normalised and
split into words (by the file's own rules, in the library) and merged, and a bounded store of their ids is
gathered into the texts' ids.

Defined cases: a null text is empty and gives no ids; the strings of special tokens in a text become those
tokens, as the tokenizers library does by default; lengths are unlimited. Repeated rows are encoded each, and a null
doc_id is carried along. Files of another make than the two kinds below are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import ranges, slices, text_bytes

LONG = 64
NONE = np.int32(2**31 - 1)

#: Fixed value: how the byte-level kind splits a text into words, here of ASCII characters.
ASCII_WORDS = rb"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\s A-Za-z0-9]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairTable:
    """(left id, right id) -> rank and merged id, looked up for whole arrays: two-choice hashing."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.merged = np.array(merged, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        bits = max(8, (4 * len(keys)).bit_length())
        while not self._filled(keys, bits):
            bits += 1

    def _places(self, keys: np.ndarray, which: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(self.MULTIPLIERS[which])
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _filled(self, keys: np.ndarray, bits: int) -> bool:
        self.bits = bits
        self.key = [np.full(1 << bits, 2**64 - 1, np.uint64) for _ in range(2)]
        self.value = [np.full(1 << bits, NONE, np.int32) for _ in range(2)]
        place = [self._places(keys, 0).tolist(), self._places(keys, 1).tolist()]
        used: list[dict[int, int]] = [{}, {}]
        for i in range(len(keys)):
            item, side = i, 0
            for _ in range(500):
                at = place[side][item]
                item, used[side][at] = used[side].get(at, -1), item
                if item < 0:
                    break
                side = 1 - side
            else:
                return False
        for side in range(2):
            for at, i in used[side].items():
                self.key[side][at], self.value[side][at] = keys[i], i
        return True

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        a, b = self._places(keys, 0), self._places(keys, 1)
        return np.where(self.key[0][a] == keys, self.value[0][a], np.where(self.key[1][b] == keys, self.value[1][b], NONE))


def merge_rows(parts: np.ndarray, pairs: PairTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a matrix of part ids, a word a row: (row numbers, final ids), as rows end."""
    rows = np.arange(len(parts))
    ranks = pairs(parts[:, :-1], parts[:, 1:]) if parts.shape[1] > 1 else np.empty((len(parts), 0), np.int32)
    while len(rows):
        if not ranks.shape[1]:
            yield rows, parts
            return
        at = ranks.argmin(1)
        each = np.arange(len(rows))
        least = ranks[each, at]
        done = least == NONE
        if done.any():
            yield rows[done], parts[done]
            rows, parts, ranks, at, least = (x[~done] for x in (rows, parts, ranks, at, least))
            each = np.arange(len(rows))
            if not len(rows):
                return
        n, width = parts.shape
        parts[each, at] = pairs.merged[least]
        stays = np.ones((n, width), bool)
        stays[each, at + 1] = False
        parts = parts[stays].reshape(n, width - 1)
        stays = np.ones((n, width - 1), bool)
        stays[each, at] = False
        ranks = ranks[stays].reshape(n, width - 2)
        if width > 2:
            for place, ok in ((at - 1, at > 0), (at, at < width - 2)):
                r, c = each[ok], place[ok]
                ranks[r, c] = pairs(parts[r, c], parts[r, c + 1])


def merge_long(ids: list[int], pairs: PairTable) -> list[int]:
    """The same for one long word: a heap of (rank, place) over a linked list."""
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    rank = pairs.rank
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or rank.get((ids[i], ids[j])) != r:
            continue
        ids[i], alive[j], after[i] = int(pairs.merged[r]), False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (s := rank.get((ids[a], ids[after[a]]))) is not None:
                heapq.heappush(heap, (s, a))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


def _kind(spec: dict) -> str:
    """"bytes" or "words"; another make of file would be encoded wrongly, so it is refused."""
    model, names = spec["model"], lambda x, key: [y["type"] for y in (x.get(key) or [x])] if x else []
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    plain &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    made = names(spec["normalizer"], "normalizers"), names(spec["pre_tokenizer"], "pretokenizers")
    level = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}])[-1]
    if plain and not level.get("add_prefix_space", True):
        if made == ([], ["ByteLevel"]) and level["use_regex"] and not model.get("end_of_word_suffix"):
            return "bytes"
        if made == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and not level["use_regex"] and model.get("end_of_word_suffix"):
            return "words"
    raise ValueError(f"no rules for a tokenizer with {made[0]} and {made[1]}")


SPACE, PLAIN, MARK = 1, 2, 3


@lru_cache(maxsize=4)
def _byte_kinds(inner: bytes) -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[33:127] = MARK
    kind[[32, *range(9, 14)]] = SPACE
    kind[[b for b in range(128) if chr(b).isalnum()]] = PLAIN
    kind[list(inner)] = 0
    return kind


def unit_starts(data: np.ndarray, offsets: np.ndarray, inner: bytes) -> np.ndarray:
    """Where units begin in joined texts: at each text that isn't empty, at white space after something else, and at
    ASCII punctuation (but for `inner`, which special tokens hold) after an ASCII letter or digit.

    White space of several bytes cuts nothing, and no cut follows what may be such."""
    mark = np.zeros(len(data), bool)
    kind = _byte_kinds(inner)[data]
    at = np.flatnonzero(((kind[1:] == SPACE) & (kind[:-1] != SPACE)) | ((kind[1:] == MARK) & (kind[:-1] == PLAIN))) + 1
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    if len(wide):
        x = at[wide]
        pair = lambda k: (data[np.maximum(x - k, 0)].astype(np.int32) << 8) | data[np.maximum(x - k + 1, 0)]
        blank = np.isin(pair(2), [0xC285, 0xC2A0]) | np.isin(pair(3), [0xE19A, 0xE280, 0xE281, 0xE380])
        at = np.delete(at, wide[blank])
    mark[at] = True
    mark[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(mark)


class Codec:
    """A vocabulary file of the tokenizers library, of the byte-level kind or the word kind (lower case, word ends)."""

    CACHED = 250_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = _kind(spec) == "words"
        rules = Tokenizer.from_file(path)
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = PairTable([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").encode() if self.words else ASCII_WORDS
        self.ascii = re.compile(own).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        # A special token stays in one unit.
        self.inner = "".join(sorted({b for t in self.special for a, b in zip(t, t[1:], strict=False) if a.isalnum() and not b.isalnum()})).encode()
        back = {s: b for b, s in enumerate(symbols)}
        self.to_bytes = {ord(s): chr(b) for s, b in back.items()}
        token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            ended = bool(end) and token.endswith(end) and i not in self.special.values()
            token_bytes[i] = bytes(back[c] for c in (token[: -len(end)] if ended else token)) + b" " * ended
        self.token_size = np.array([len(x) for x in token_bytes])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(token_bytes), np.uint8)
        self._forget()

    # -- words

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word's bytes, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for n, group in by_size.items():
            if not n:
                continue
            matrix = np.frombuffer(b"".join([words[i] for i in group]), np.uint8).reshape(len(group), n)
            ids = self.first[matrix]
            ids[:, -1] = self.last[matrix[:, -1]]
            if n > LONG:
                for i, row in zip(group, ids, strict=True):
                    out[i] = np.array(merge_long(row.tolist(), self.pairs), "<u4").tobytes()
                continue
            for rows, parts in merge_rows(ids, self.pairs):
                blob, step = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
                for k, r in enumerate(rows.tolist()):
                    out[group[r]] = blob[k * step : (k + 1) * step]
        return out

    def _words(self, unit: str) -> list[bytes]:
        if unit.isascii():  # the same rules, without a call for each unit
            return self.ascii((unit.lower() if self.words else unit).encode())
        if self.normalizer is not None:
            unit = self.normalizer.normalize_str(unit)
        return [w.translate(self.to_bytes).encode("latin-1") for w, _ in self.splitter.pre_tokenize_str(unit)]

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units."""
        plan: list[list] = []
        flat: list[bytes] = []
        where: dict[bytes, int] = {}
        for unit in units:
            text = unit.decode()
            plan.append([])
            for part in self.cut.split(text) if "<|" in text else (text,):
                if part in self.special:
                    plan[-1].append(np.uint32(self.special[part]).tobytes())
                    continue
                for w in self._words(part):
                    if w not in where:
                        where[w] = len(flat)
                        flat.append(w)
                    plan[-1].append(where[w])
        ids = self._merged(flat)
        return [b"".join([ids[x] if isinstance(x, int) else x for x in parts]) for parts in plan]

    # -- the store of known units

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.start, self.size, self.store, self.held = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _slots(self, units: list[bytes]) -> np.ndarray:
        if len(self.slot) > self.CACHED:
            self._forget()
        slot = self.slot
        new = [u for u in units if u not in slot]
        if new:
            made = self._ids_of(new)
            sizes, ids = np.array([len(x) // 4 for x in made]), np.frombuffer(b"".join(made), "<u4")
            at, upto = len(slot), len(slot) + len(new)
            while upto > len(self.start):
                self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
            while self.held + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, self.store])
            self.store[self.held : self.held + len(ids)] = ids
            self.size[at:upto], self.start[at:upto] = sizes, self.held + np.cumsum(sizes) - sizes
            self.held += len(ids)
            slot.update(zip(new, range(at, upto), strict=True))
        return np.array([slot[u] for u in units], np.int64)

    # -- texts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after the other, and where each text's begin, with the end of the last."""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
        joined = b"".join(texts)
        starts = unit_starts(np.frombuffer(joined, np.uint8), offsets, self.inner)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        edges = pa.py_buffer(np.append(starts, len(joined)).astype(np.int64))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(joined)]).dictionary_encode()
        slots = self._slots(units.dictionary.to_pylist())[units.indices.to_numpy()]
        size = self.size[slots]
        ids = self.store[ranges(self.start[slots], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids that lie as encode gives them, special tokens too; of a word vocabulary, its words with a space after each."""
        size = self.token_size[ids]
        data = self.token_data[ranges(self.token_start[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One a Python worker."""
    return Codec(path)


def texts_of_ids(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    blob, at = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
    return [blob[a:b] for a, b in zip(at, at[1:], strict=False)]


def mapped(docs: DataFrame, schema: str, rows: Callable[[Codec, pa.Array, list[bytes]], pa.RecordBatch], path: str) -> DataFrame:
    """docs (doc_id, text) through a codec, slice by slice."""

    def run(batches):
        tool = codec(path)
        for batch in slices(batches):
            yield rows(tool, batch.column("doc_id"), text_bytes(batch.column("text")))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digest(tool: Codec, doc_id: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    ids, offsets = tool.encode(texts)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    decoded = [sha(x.encode()) for x in tool.decode(ids, offsets)]
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(np.diff(offsets)), pa.array([sha(x) for x in texts_of_ids(ids, offsets)], pa.string()), pa.array(decoded, pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _encoded(tool: Codec, doc_id: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    ids, offsets = tool.encode(texts)
    return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text."""
    return mapped(docs, "doc_id long, ids array<int>", _encoded, path)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids; null ids give an empty text."""

    def run(batches):
        tool = codec(path)
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
            texts = tool.decode(np.concatenate([*rows, np.zeros(0, np.int64)]), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Every text encoded, and decoded from its ids; digests of both."""
    return mapped(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest, path)
