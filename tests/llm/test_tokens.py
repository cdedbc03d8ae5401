"""Encoding and packing against the tokenizers library: ids, digests, pieces, and the sequences' bound."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from pagewright.llm import bpe, packing
from pagewright.llm.common import table

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RND = random.Random(5)
TEXTS = ["", " ", "a  b", "ÀÉ é e\u0301x ΑΣ. İI", "q" * 3000, "<|endoftext|>a <|endoftext|>", "x <|endoftext|>  y\n\n z \n", "a\u00a0 b \u2003\n c\u3000 \u0085d",
         *["".join(RND.choice(" \n\t'aAbsétE0<|>.,\x1c\u2028\u00a0’") for _ in range(RND.randint(1, 50))) for _ in range(800)]]
#: Every eleventh code point, assigned or not, beside letters and white space.
TEXTS += [f"x{chr(c)}y {chr(c)} {chr(c)}{chr(c)}" for c in range(1, 0x30000, 11) if not 0xD800 <= c < 0xE000]
LONG = "Straße <p> über 12.5 " * 60_000 + "z" * 40_000  # over a megabyte


def le(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_equal_the_library(path):
    tok, own = Tokenizer.from_file(path), bpe.Codec(path)
    own.CACHED = 500  # the store is emptied now and then
    for k in range(0, len(TEXTS), 700):
        part = TEXTS[k : k + 700]
        ids, offsets = own.encode([t.encode() for t in part])
        back = own.decode(ids, offsets)
        for i, (want, t) in enumerate(zip(tok.encode_batch(part, add_special_tokens=False), part, strict=True)):
            assert want.ids == ids[offsets[i] : offsets[i + 1]].tolist(), t
            if path == BYTES:
                assert back[i] == t


def test_decoded_words():
    own = bpe.Codec(WORDS)
    assert own.decode(*own.encode([b"", "Straße  12\nÉ it's".encode(), b"a<|endoftext|>"])) == ["", "straße 1 2 é it 's ", "a <|endoftext|>"]


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(BYTES, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Codec(str(tmp_path / "t.json"))


def rows_of(spark):
    rows = [(i, t) for i, t in enumerate([None, LONG, *TEXTS[:60]])] + [(3, TEXTS[3]), (None, "a b"), (None, None)]
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, length int")


def test_digest_columns(spark):
    rows, docs = rows_of(spark)
    tok, want = Tokenizer.from_file(BYTES), collections.Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert want == collections.Counter(tuple(r) for r in bpe.bpe_digest(docs, BYTES).collect())
    assert bpe.bpe_digest(docs.limit(0), BYTES).count() == 0


def checked(got, capacity=2048):
    """The number of sequences, which are gapless and within capacity."""
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(x for _, x in b[:i]) for i, (o, _) in enumerate(b)) and sum(x for _, x in b) <= capacity
    return len(bins)


def test_pieces(spark):
    rows, docs = rows_of(spark)
    t = table(spark, SF, "documents")
    rows += [(r.doc_id, r.text) for r in t.collect()]
    docs = docs.select("doc_id", "text").union(t.select("doc_id", "text"))
    tok, want, total = Tokenizer.from_file(WORDS), collections.Counter(), 0
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, n, at, len(part), zlib.crc32(le(part)))] += 1
    got = packing.packed_documents(docs, WORDS).collect()
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert checked(got) <= -(-total // 2048) + 2
    assert packing.packed_documents(docs.limit(0), WORDS).count() == 0


LENGTHS = {"any": lambda r: r.randint(1, 2048), "over half": lambda r: r.randint(1025, 2000), "short": lambda r: r.randint(1, 300), "mixed": lambda r: r.choice([r.randint(1, 60), r.randint(1500, 2040)])}


@pytest.mark.parametrize("kind", sorted(LENGTHS))
def test_tree_ends(kind, spark):
    """Few groups lose next to nothing against one; odd group sizes end too."""
    rnd = random.Random(6)
    cut = spark.createDataFrame([(LENGTHS[kind](rnd),) for _ in range(3000)], "length long")
    n = {group: checked(packing.pack(cut, 2048, group=group).collect()) for group in (7, 400, 100_000)}
    assert n[100_000] <= n[400] <= 1.04 * n[100_000] + 1 and n[7] <= 1.3 * n[100_000]
