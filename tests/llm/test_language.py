"""Language identification: held-out accuracy, scores by hand, letters, odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
import regex
from conftest import SF

from pagewright.llm import language_id
from pagewright.llm.common import table

SCHEMA = "doc_id long, lang string, text string, row string, word string, lang_pred string"


def test_held_out(spark):
    docs = table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert len(out) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)


def plain_scores(known, grams, languages, text):
    """The sums by hand: word by word, n-gram by n-gram."""
    total = [0.0] * len(languages)
    for word in regex.findall(r"\p{L}+", text.lower()):
        if word in known:
            add = known[word]
        else:
            marked, found, i = f"<{word}>", [], 0
            while i < len(marked):
                size = next((n for n in range(5, 0, -1) if i + n <= len(marked) and marked[i : i + n] in grams), 1)
                if marked[i : i + size] in grams:
                    found.append(grams[marked[i : i + size]])
                i += max(1, size - 1)
            add = [sum(f[k] for f in found) / math.sqrt(len(found)) if found else 0.0 for k in range(len(languages))]
        total = [a + b for a, b in zip(total, add, strict=True)]
    best = max(total)
    share = [math.exp(t - best) for t in total]
    return languages[total.index(best)], max(share) / sum(share)


def test_scores_by_hand(spark):
    rows = [(1, "en", "the cat and the hat, often the cat"), (2, "de", "der Hut und die Katze, der Hut"), (3, "de", "Straße und Hut")]
    found = language_id.word_counts(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 100).toArrow()
    model = language_id.Model.fit(found)
    assert model.languages == ["de", "en"]
    counts: dict = {}
    for lang, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(word, [0, 0])[lang == "en"] += n
    logs = lambda c: {w: [math.log((n[k] + 0.5) / (sum(x[k] for x in c.values()) + 0.5 * len(c))) for k in (0, 1)] for w, n in c.items()}
    grams: dict = {}
    for word, n in counts.items():
        for size in range(1, 6):
            for i in range(len(word) + 3 - size):
                g = f"<{word}>"[i : i + size]
                grams[g] = [a + b for a, b in zip(grams.get(g, [0, 0]), n, strict=True)]
    known = {}
    for size in range(1, 6):
        known |= logs({g: n for g, n in grams.items() if len(g) == size and sum(n) >= 3})
    texts = ["the hat", "der hats Hüte", "unhattend 12 Straßen", "z", "und und THE"]
    got = model.predict(pa.array(texts))
    for lang, score, text in zip(*got, texts, strict=True):
        want = plain_scores(logs(counts), known, ["de", "en"], text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4), text


def test_odd_rows(spark):
    rows = [(i, "en" if i % 2 else "fr", ("the cat sat " if i % 2 else "le chat dort ") * 5) for i in range(40)]
    odd = [(100, "en", None), (101, "en", ""), (102, None, "½ ² ③ Ⅷ 12 _ 。"), (103, None, "the cat"), (None, "fr", "nevermore nevermore"), (104, None, "l" * 1_500_000 + " the cat sat"), (105, None, "le chat"), (105, None, "le chat")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows + odd], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102)) and got[103][0] == "en" and got[105][0] == "fr" and None in got
    assert language_id.identify(docs).count() == len(rows) + len(odd)
    kept = language_id.keep_languages(docs)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint(r.doc_id for r in kept.collect()) and kept.where("doc_id = 105").count() == 2
    none = docs.where("doc_id is null")
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"} and language_id.keep_languages(none).count() == 0
    assert language_id.identify(docs.limit(0)).count() == 0 and language_id.keep_languages(docs.limit(0)).count() == 0


def test_sample_is_bounded_and_never_none(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'en' as lang", "concat('word', id) as text")
    assert 50 < language_id.word_counts(docs, 100).selectExpr("sum(n)").first()[0] < 200
    assert (2_500 << 62) // 10**12 > 10**9  # at a trillion labelled rows
    long_word = "a" * 60
    assert [r.word for r in language_id.word_counts(spark.createDataFrame([(1, "en", long_word)], "doc_id long, lang string, text string"), 9).collect()] == [long_word]
