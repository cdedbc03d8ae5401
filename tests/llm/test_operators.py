"""The training-data operators: brute force, round trips, held-out accuracy, and odd rows."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF

from pagewright.llm import bpe, components, language_id, line_dedup, quality_classifier, quality_rules, simhash_dedup, substring_dedup
from pagewright.llm import common
from pagewright.llm.common import spread_join, table

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, kept string, bits string"
LINE = "This line is long enough to count as boilerplate everywhere."
SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


def odd_rows():
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n\t ", "a", passage, passage, "x " + passage + " y", "\n".join([LINE, "other"]), *[f"{LINE}\nline {i} of its own" for i in range(6)], "Straße É " * 4000, "password=3da3a2ce706927ddf6 here", "z" * 30000, "<|endoftext|> 12\x0b3"]
    rows = [(i, t, "en" if i % 2 else None, None, None if t is None else len(t), "r", 1, "k", "b") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, passage, None, None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["substring", "lines"])
def test_sql(name, spark, compare):
    query, sql = {
        "substring": (lambda s, d: substring_dedup.removal_digest(table(s, d, "documents"), 100_000), substring_dedup.ORACLE),
        "lines": (lambda s, d: line_dedup.line_digest(table(s, d, "documents")), line_dedup.ORACLE),
    }[name]
    compare(query, sql)


PER_ROW = {
    "op1": substring_dedup.removal_digest, "op3": language_id.identify, "op6": lambda d: bpe.bpe_digest(d, BYTES), "op7": quality_rules.quality_report,
    "op8": simhash_dedup.fingerprint_groups, "op10": line_dedup.line_digest,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_odd_and_empty(name, odd, empty):
    assert PER_ROW[name](empty).count() == 0
    got = collections.Counter(r.doc_id for r in PER_ROW[name](odd).collect())
    assert got == collections.Counter(r[0] for r in odd_rows())


def test_substring_brute_force(odd):
    rows = odd_rows()
    first = {}
    for i, t, *_ in rows:
        w = SPLIT(t or "") if i is not None else []
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = collections.Counter()
    for i, t, *_ in rows:
        w, lost = SPLIT(t or ""), set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                lost.update(range(k, k + 13))
        want[(i, len(w), len(lost), " ".join(x for k, x in enumerate(w) if k not in lost))] += 1
    assert want == collections.Counter(tuple(r) for r in substring_dedup.dedupe_corpus(odd, 300).collect())


def test_substring_reference(spark, odd):
    reference = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20, 40)),), (None,), ("short",)], "text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.strip_reference(odd, reference).collect()}
    assert got[4] == (60, 20) and got[6] == (62, 20) and got[7][1] == 0 and got[0] == (0, 0)


def test_automaton_statistics():
    rnd = random.Random(3)
    for _ in range(100):
        refs = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))) for _ in range(3)]
        a = substring_dedup.SuffixAutomaton()
        for d, r in enumerate(refs):
            a.add(r, d)
        text, n = "".join(rnd.choice("abc") for _ in range(20)), 3
        for i, (_, first) in enumerate(a.statistics(text, n)):
            s = text[max(0, i - n + 1) : i + 1]
            assert first == (next((d for d, r in enumerate(refs) if s in r), -1) if len(s) == n else -1)


def test_lines_and_pipeline_columns(odd):
    out = line_dedup.dedupe_lines(odd)
    assert out.columns == odd.columns
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert [i for i, t in kept.items() if t and LINE in t] == [13] and kept[0] is None and kept[7] == "other"


def test_bpe_round_trip(docs):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_quality_rules_brute_force(docs):
    got = {r.doc_id: r for r in quality_rules.quality_report(docs).collect()}
    for r in docs.collect():
        w, seen, dup = SPLIT(r.text), set(), 0
        for line in r.text.split("\n"):
            if SPLIT(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), dup, len(cover))
        assert x.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (x.kept and x.base_failed)


def test_simhash_brute_force(odd):
    prints = {}
    for i, t, *_ in odd_rows():
        w = SPLIT(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        if i is not None:
            prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            least[i] = min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.fingerprint_groups(odd).collect() if r.doc_id is not None}
    assert got == {i: (f"{f:016x}", least[i]) for i, f in prints.items()}
    assert {r.doc_id for r in simhash_dedup.keep_one_each(odd).collect()} == {None, *least.values()}


def test_close_links_find_every_pair():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [base, *[base ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (3, 40)).astype(np.uint64)) for _ in range(30)]]
    fps = np.unique(np.concatenate(fps))
    assert len(fps) > simhash_dedup.CROWDED
    roots = list(range(len(fps)))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    at = {int(f): i for i, f in enumerate(fps)}
    for a, b in simhash_dedup.close_links(fps, 2**64 - 1):
        x, y = root(roots, at[a]), root(roots, at[b])
        roots[max(x, y)] = min(x, y)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            assert root(roots, i) == root(roots, j)


def test_masks_cover():
    masks = simhash_dedup.masks()
    rnd = random.Random(2)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(not diff & m for m in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200)] + [(500, 500 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100} | {500 + k: 500 for k in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_resampling(spark, docs, odd, empty):
    labels = table(spark, SF, "labels")
    out = quality_classifier.resample(docs, labels, share=0.5).collect()
    assert sum(r.kept for r in out) == round(0.5 * len(out))
    assert min(r.gumbel_key for r in out if r.kept) >= max(r.gumbel_key for r in out if not r.kept) - 1e-6
    assert quality_classifier.resample(odd, labels.limit(0)).where("kept").count() == odd.count()
    assert quality_classifier.resample(empty, labels).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    n = table(spark, SF, "documents").count()
    docs = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert 0.8 * n < len(docs) < n


@pytest.mark.parametrize("total", [1, 100_000, 10**9])
def test_spread_join(total, spark):
    """The same rows whether all keys, some (those with over 50 rows) or none are hot."""
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(25 * k + 1)] + [(None, 1), (77, 1)], "k long, i long")
    keyed = spark.createDataFrame([(k, 25 * k + 1, f"v{k}") for k in range(6)] + [(99, 1, "none")], "k long, n long, v string")
    got = collections.Counter(tuple(r) for r in spread_join(rows, keyed, ["k"], total).select("k", "i", "v").collect())
    assert got == collections.Counter((k, i, f"v{k}") for k in range(6) for i in range(25 * k + 1))


@pytest.mark.parametrize("share", [1, 10])
def test_cold_prints(share, spark, odd, monkeypatch):
    """Groups don't depend on which keys are hot."""
    want = sorted(map(repr, simhash_dedup.fingerprint_groups(odd).collect()))
    monkeypatch.setattr(common, "HOT", share)
    assert want == sorted(map(repr, simhash_dedup.fingerprint_groups(odd).collect()))
