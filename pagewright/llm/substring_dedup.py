"""Substring deduplication by words: suffix automata of reference shards, matching statistics, span removal.

A suffix automaton of the reference accepts its substrings; streaming a text through it gives, at each word, the
longest match that ends there (the matching statistic). A match of `window` words or more marks those words.

Two forms:

* `strip_reference` removes spans that occur in a reference table whose size is checked: the reference is cut into shards of
  bounded size, their automata are broadcast, and documents are streamed through each.
* `dedupe_corpus` removes spans that occur in a document with a smaller doc_id. There the reference is the corpus
  itself, which no broadcast can hold and which no document can be streamed against whole, so shards and texts
  meet by a key that they share: every window of `window` words has an anchor, the least hash among its 5-word
  shingles, and equal windows have equal anchors. Documents lie in blocks of some megabytes. (1) Blocks send the
  anchors' short hashes, a few bytes each; (2) buckets answer which anchors two documents share; (3) blocks send
  each different segment around a shared anchor once, as word codes with its smallest doc_id; (4) shards build
  automata, with the first document of every state, and answer each window's first document; (5) blocks
  remove covered words. A passage in a third of all documents costs one segment a block.

Word codes and anchors are hashes (32 bits a word, so 416 bits a window).

Defined cases: a null or empty text has no words and keeps none. A null doc_id takes no part and keeps its words.
Rows that repeat a doc_id are one document: neither loses words to the other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, ranges, slices, text_bytes

WINDOW, ANCHOR = 13, 5
BLOCK_BYTES = 3 << 20
#: Bytes of a reference that one broadcast automaton shard may hold, and that a reference may have at all.
SHARD_BYTES, REFERENCE_BYTES = 1 << 20, 64 << 20


class SuffixAutomaton:
    """Of several sequences added in rising order of document: `first` of a state is the first document that has its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, first: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _clone(self, p: int, c, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def add(self, sequence, document: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, document, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            last = new

    def statistics(self, sequence, window: int) -> Iterator[tuple[int, int]]:
        """At each place: the longest match that ends there, and the first document of its last `window` words (-1: no such match)."""
        state = size = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            at = state
            while at and self.length[self.link[at]] >= window:
                at = self.link[at]
            if size >= window:
                state, size = at, min(size, self.length[at])  # longer matches say nothing more
            yield size, self.first[at] if size >= window else -1


# -- a bounded reference, broadcast


def reference_shards(reference: DataFrame, window: int = WINDOW) -> list[SuffixAutomaton]:
    """Automata of a reference table (text) of at most REFERENCE_BYTES."""
    total = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > REFERENCE_BYTES:
        raise ValueError(f"the reference has {total} bytes of text; {REFERENCE_BYTES} can be broadcast; use dedupe_corpus")
    shards, held = [], SHARD_BYTES + 1
    for (text,) in reference.where(F.col("text").isNotNull()).select("text").toLocalIterator():
        words = text.encode().split()
        if len(words) < window:
            continue
        if held > SHARD_BYTES:
            shards.append(SuffixAutomaton())
            held = 0
        shards[-1].add(words, 0)
        held += len(text)
    return shards


def strip_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text without the words of any `window` words that the reference has."""
    shards = [docs.sparkSession.sparkContext.broadcast(x) for x in reference_shards(reference, window)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for text in text_bytes(batch.column("text")):
                words = text.split()
                hit = np.zeros(len(words) + 1, np.int32)
                for shard in shards:
                    for i, (size, _) in enumerate(shard.value.statistics(words, window)):
                        if size >= window:
                            hit[i + 1 - window] += 1
                            hit[i + 1] -= 1
                stays = np.cumsum(hit[:-1]) == 0
                out[0].append(len(words))
                out[1].append(int((~stays).sum()))
                out[2].append(b" ".join(compress(words, stays.tolist())).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


# -- the corpus itself


class Block:
    """A block's rows by doc_id, cut into slices, with the anchors of all windows."""

    def __init__(self, rows: pa.Table):
        self.doc_id = rows.column("doc_id").combine_chunks() if rows.num_rows else pa.array([], pa.int64())
        ids = np.array(self.doc_id.fill_null(-1), np.int64)
        nulls = np.array(self.doc_id.is_null(), bool)
        self.order = np.lexsort((ids, nulls))
        column = rows.column("text").combine_chunks().cast(pa.binary())
        self.texts = [column[int(i)].as_py() or b"" for i in self.order]
        self.ids, self.nulls = ids[self.order], nulls[self.order]
        words = Words(self.texts)
        self.first, self.doc = words.first, words.doc
        self.code = (words.hash >> np.uint64(32)).astype(np.uint32)
        n = len(words.start)
        self.window = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        if n >= WINDOW:
            shingles = grams(words.hash, ANCHOR)
            at = _sliding_argmin(shingles, WINDOW - ANCHOR + 1)
            whole = (words.doc[WINDOW - 1 :] == words.doc[: n - WINDOW + 1]) & ~self.nulls[words.doc[: n - WINDOW + 1]]
            self.window = np.flatnonzero(whole)
            self.at = at[self.window]
            self.anchor = shingles[self.at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors in order, and whether two documents here have it."""
        if not len(self.anchor):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        ids = self.ids[self.doc[self.window]]
        order = np.lexsort((ids, self.anchor))
        a, d = self.anchor[order], ids[order]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        tail = np.append(head[1:], len(a)) - 1
        return a[head], d[head] != d[tail]

    def segments(self, shared: np.ndarray) -> Segments:
        return Segments(self, shared)


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the (first) least of each `width` neighbours."""
    n = len(values) - width + 1
    best, at = values[:n].copy(), np.arange(n)
    for k in range(1, width):
        less = values[k : k + n] < best
        best = np.where(less, values[k : k + n], best)
        at = np.where(less, np.arange(k, k + n), at)
    return at


class Segments:
    """Runs of windows with one shared anchor; `unique` ones by anchor and content, each with its smallest doc_id."""

    def __init__(self, block: Block, shared: np.ndarray):
        place = np.searchsorted(shared, block.anchor)
        ok = np.zeros(len(block.anchor), bool)
        if len(shared):
            ok = shared[np.minimum(place, len(shared) - 1)] == block.anchor
        window, at, anchor = block.window[ok], block.at[ok], block.anchor[ok]
        new = np.ones(len(window), bool)
        if len(window):
            new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
        head = np.flatnonzero(new)
        self.start = window[head]
        self.windows = np.diff(np.append(head, len(window)))
        self.words = self.windows + WINDOW - 1 if len(head) else self.windows
        self.anchor = anchor[head]
        self.ids = block.ids[block.doc[self.start]] if len(head) else np.zeros(0, np.int64)
        # A position-weighted sum of its word codes stands for a segment's content.
        self.content = _content(block.code, self.start, self.words)
        order = np.lexsort((self.ids, self.content, self.words, self.anchor))
        key = [x[order] for x in (self.anchor, self.words, self.content)]
        first = np.ones(len(order), bool)
        if len(order):
            first[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        self.which = np.empty(len(order), np.int64)  # the unique segment of each
        self.which[order] = np.cumsum(first) - 1
        self.unique = order[first]


def _content(code: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    from .common import GRAM_STEP, mix, powers

    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(GRAM_STEP, len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64)) * up[: len(code)], out=total[1:])
    return mix((total[start + words] - total[start]) * down[start])


def _binary(parts: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def _by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part's entries, in order."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        yield i, order[bounds[i] : bounds[i + 1]]


def _answers(table: pa.Table, ordered: str) -> list[tuple[int, bytes]]:
    return sorted(zip(table.column(ordered).to_pylist(), table.column("data").to_pylist(), strict=True))


def _part(anchor: np.ndarray, n: int) -> np.ndarray:
    """An anchor's bucket or shard: by its upper bits."""
    return ((anchor >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _short(anchor: np.ndarray) -> np.ndarray:
    """The lower 40 bits, as n x 5 bytes."""
    return anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def first_documents(anchor: np.ndarray, words: np.ndarray, content: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """A shard's answer: for each segment the first document of each of its windows."""
    starts = np.cumsum(words) - words
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(anchor)
    order = np.lexsort((ids, content, words, anchor))
    a, w, c, d = anchor[order], words[order], content[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]])) - 1 if len(a) else np.zeros(0, np.int64)
    same = (w == w[head][group]) & (c == c[head][group]) if len(a) else np.zeros(0, bool)
    single = np.ones(len(head), bool)
    np.logical_and.at(single, group, same)
    least = d[head].copy()
    np.minimum.at(least, group, d)
    bounds = np.append(head, len(a))
    for g in range(len(head)):
        members = order[bounds[g] : bounds[g + 1]]
        if single[g]:  # one string, whose automaton is a path: all windows are first where the string is
            for m in members.tolist():
                out[m] = least[g : g + 1]
            continue
        automaton, variants = SuffixAutomaton(), {}
        for m in members[np.argsort(ids[members], kind="stable")].tolist():
            text = codes[starts[m] : starts[m] + words[m]]
            key = text.tobytes()
            if key not in variants:
                variants[key] = text.tolist()
                automaton.add(variants[key], int(ids[m]))
            out[m] = key  # type: ignore[assignment]
        found = {k: np.array([f for _, f in automaton.statistics(v, WINDOW)][WINDOW - 1 :], np.int64) for k, v in variants.items()}
        for m in members.tolist():
            out[m] = found[out[m]]  # type: ignore[index]
    return out


def dedupe_corpus(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, text: without the words of windows that a smaller doc_id has too."""
    return _dedupe(docs, block_bytes, digest=False)


def removal_digest(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _dedupe(docs, block_bytes, digest=True)


def _dedupe(docs: DataFrame, block_bytes: int, digest: bool) -> DataFrame:
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = max(1, blocks // 4)  # buckets and shards: of several blocks' size, so that messages stay long
    lie = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).otherwise(F.pmod(F.xxhash64("text"), F.lit(blocks)))
    dealt = docs.withColumn("block", lie)
    ours = dealt.groupBy("block")
    message = "part long, block long, data binary"

    def send(rows: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})

    def ask_anchors(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        anchors, here = Block(rows).anchors()
        out = []
        for p, i in _by_part(_part(anchors, parts), parts):
            out.append((p, block, np.uint32(len(i)).tobytes() + _binary([_short(anchors[i]), here[i]])))
        return send(out)

    def answer_anchors(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = _answers(rows, "block")
        short, here, sizes = [], [], []
        for _, data in found:
            n = int(np.frombuffer(data, "<u4", 1)[0])
            whole = np.zeros((n, 8), np.uint8)
            whole[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 4).reshape(n, 5)
            short.append(whole.view("<u8").ravel())
            here.append(np.frombuffer(data, bool, n, 4 + 5 * n))
            sizes.append(n)
        a, h = np.concatenate(short), np.concatenate(here)
        order = np.argsort(a, kind="stable")
        eq = a[order[1:]] == a[order[:-1]]
        twice = h.copy()
        twice[order[1:]] |= eq
        twice[order[:-1]] |= eq
        cuts = np.split(twice, np.cumsum(sizes)[:-1])
        return send([(key[0].as_py(), b, np.packbits(x).tobytes()) for (b, _), x in zip(found, cuts, strict=True)])

    def shared(block: Block, bits: dict[int, bytes]) -> np.ndarray:
        anchors, _ = block.anchors()
        ok = np.zeros(len(anchors), bool)
        for p, i in _by_part(_part(anchors, parts), parts):
            ok[i] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=len(i)).astype(bool)
        return anchors[ok]

    def ask_segments(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return send([])
        block = Block(rows)
        known = shared(block, dict(_answers(answers, "part")))
        s = block.segments(known)
        u, out = s.unique, []
        for p, i in _by_part(_part(s.anchor[u], parts), parts):
            m = u[i]
            codes = block.code[ranges(s.start[m], s.words[m])]
            out.append((p, key[0].as_py(), np.uint32(len(m)).tobytes() + _binary([s.anchor[m], s.content[m], s.ids[m], s.words[m].astype(np.uint8), codes])))
        return send(out)

    def answer_segments(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found = _answers(rows, "block")
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, data in found:
            n = int(np.frombuffer(data, "<u4", 1)[0])
            for column, (kind, at) in zip(columns, (("<u8", 4), ("<u8", 4 + 8 * n), ("<i8", 4 + 16 * n), ("u1", 4 + 24 * n)), strict=False):
                column.append(np.frombuffer(data, kind, n, at))
            columns[4].append(np.frombuffer(data, "<u4", -1, 4 + 25 * n))
        sizes = [len(x) for x in columns[0]]
        anchor, content, ids, words, codes = (np.concatenate(x) for x in columns)
        firsts = first_documents(anchor, words.astype(np.int64), content, ids, codes)
        out, at = [], 0
        for (block, _), n in zip(found, sizes, strict=True):
            mine = firsts[at : at + n]
            at += n
            lengths = np.array([len(x) for x in mine], np.uint8)
            out.append((part, block, np.uint32(n).tobytes() + _binary([lengths, np.concatenate(mine)])))
        return send(out)

    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return result([], [], [], [])
        block = Block(rows)
        data = dict(_answers(answers, "part"))
        known = shared(block, {-1 - p: x for p, x in data.items() if p < 0})
        s = block.segments(known)
        lost = np.zeros(len(block.doc) + 1, np.int32)
        u = s.unique
        firsts: list = [None] * len(u)
        for p, i in _by_part(_part(s.anchor[u], parts), parts):
            raw = data[p]
            lengths = np.frombuffer(raw, np.uint8, len(i), 4).astype(np.int64)
            values = np.frombuffer(raw, "<i8", -1, 4 + len(i))
            for k, x in zip(i.tolist(), np.split(values, np.cumsum(lengths)[:-1]), strict=True):
                firsts[k] = x
        if len(u):
            # One first document for all windows of a segment, or one each.
            size = np.array([len(x) for x in firsts])
            base = np.cumsum(size) - size
            flat = np.concatenate(firsts)
            each = np.repeat(np.arange(len(s.start)), s.windows)
            turn = ranges(np.zeros(len(s.start), np.int64), s.windows)
            of = s.which[each]
            first = flat[base[of] + np.where(size[of] > 1, turn, 0)]
            at = (s.start[each] + turn)[first < s.ids[each]]
            np.add.at(lost, at, 1)
            np.add.at(lost, at + WINDOW, -1)
        stays = np.cumsum(lost[:-1]) == 0
        n_words = np.diff(block.first)
        removed = n_words - np.diff(np.concatenate([[0], np.cumsum(stays)])[block.first])
        kept = []
        for text, a, b, n in zip(block.texts, block.first[:-1].tolist(), block.first[1:].tolist(), removed.tolist(), strict=True):
            words = text.split()
            kept.append(b" ".join(words if not n else compress(words, stays[a:b].tolist())))
        return result(block.doc_id.take(pa.array(block.order)), n_words, removed, kept)

    def result(ids, n_words, removed, kept) -> pa.Table:
        last = pa.array([hashlib.sha256(x).hexdigest() if digest else x.decode() for x in kept], pa.string())
        return pa.table({"doc_id": pa.array(ids, pa.int64()) if isinstance(ids, list) else ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256" if digest else "text": last})

    asked = ours.applyInArrow(ask_anchors, message)
    answered = asked.groupBy("part").applyInArrow(answer_anchors, message)
    sent = ours.cogroup(answered.groupBy("block")).applyInArrow(ask_segments, message)
    back = sent.groupBy("part").applyInArrow(answer_segments, message)
    # One query, so that the texts are dealt out once and that exchange serves all three passes.
    replies = back.unionByName(answered.withColumn("part", -1 - F.col("part")))
    return ours.cogroup(replies.groupBy("block")).applyInArrow(finish, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")


#: The same rows in DuckDB.
ORACLE = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
win as (select doc_id, i as w_at, list_slice(words, i, i + 12) as seq from w, unnest(range(1, len(words) - 11)) t(i)),
firsts as (select *, min(doc_id) over (partition by seq) as first_id from win),
lost as (select distinct doc_id, unnest(range(w_at, w_at + 13)) as pos from firsts where first_id < doc_id),
flat as (select doc_id, words[i] as word, i as pos from w, unnest(range(1, len(words) + 1)) t(i)),
kept as (
  select f.doc_id, count(*) as n_words, count(l.pos) as n_removed,
         string_agg(f.word, ' ' order by f.pos) filter (where l.pos is null) as kept
  from flat f left join lost l on f.doc_id = l.doc_id and f.pos = l.pos group by f.doc_id)
select w.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""
