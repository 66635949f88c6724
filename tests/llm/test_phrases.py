"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from fleetbooks.llm import collocations
from fleetbooks.llm.collocations import collocations as mined


def plain(docs, longest, support, top, share=100):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    totals, counts = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    counts[lang, tuple(words[k : k + size])] += 1
    known = {key: n for key, n in counts.items() if n >= support}
    inside = Counter()
    for (lang, words), n in known.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = lang, words[k : k + size]
                inside[part] = max(inside[part], n)
    found = {}
    for (lang, words), a in known.items():
        if len(words) < 2 or 100 * inside[lang, words] >= share * a and (lang, words) in inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((score, a, " ".join(words), l, r))
    rows = []
    for lang, own in found.items():
        own.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, k + 1, p, a, l, r, totals[lang], s) for k, (s, a, p, l, r) in enumerate(own[:top])]
    return sorted(rows)


def frame(spark, docs):
    rows = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(docs)], "doc_id long, text string, lang string")
    return rows.selectExpr("*", "1 AS n", "2 AS size", "'x' AS phrase", "3 AS hash").repartition(6, "doc_id")


def made(seed, docs=60):
    draw = random.Random(seed)
    words = ["a", "b", "C", "\u00e9t\u00e9", "\u00c9", "d-e", "x\u00a0y", "new", "york", "City"]
    gaps = [" ", "  ", "\t", ", ", "\n", ". ", "!", "\x0b"]
    weights = [30, 3, 3, 1, 1, 2, 1, 1]
    text = lambda: "".join(draw.choice(words) + draw.choices(gaps, weights)[0] for _ in range(draw.randint(0, 60)))
    return [(draw.choice(["en", "en", None, "und", ""]), text()) for _ in range(docs)]


@pytest.mark.parametrize(
    "seed, longest, support, shards, top, share",
    [(1, 5, 5, 4, 2000, 100), (2, 5, 3, 1, 7, 100), (3, 3, 4, 7, 50, 60), (4, 2, 9, 20, 10, 100), (5, 6, 2, 3, 3000, 100)],
)
def test_against_all_phrases(spark, seed, longest, support, shards, top, share):
    docs = made(seed)
    found = mined(frame(spark, docs), longest=longest, support=support, shards=shards, top=top, share=share)
    want = plain(docs, longest, support, top, share)
    assert want and sorted(tuple(r) for r in found.collect()) == want


def test_small_steps_and_sums(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STEP", 200)
    monkeypatch.setattr(collocations, "HELD", 50)
    # So few bits that most phrases share theirs with another.
    monkeypatch.setattr(collocations, "BITS", 8)
    docs = made(6, 200)
    found = mined(frame(spark, docs), support=6, shards=5, top=40)
    assert sorted(tuple(r) for r in found.collect()) == plain(docs, 5, 6, 40)


def test_odd_rows(spark):
    long = "red green blue " * 40_000
    docs = [("en", None), ("en", ""), ("en", " \t\n..!"), (None, "no lang at all"), ("und", "No lang, at all"), ("xx", long), ("en", "one")]
    found = mined(frame(spark, docs), support=2, shards=3)
    assert sorted(tuple(r) for r in found.collect()) == plain(docs, 5, 2, 2000)
    repeated = docs + docs[3:4] * 3
    found = mined(frame(spark, repeated), support=2, shards=3)
    assert sorted(tuple(r) for r in found.collect()) == plain(repeated, 5, 2, 2000)


def test_nothing(spark):
    for docs in ([], [("en", None)], [("en", "too few words")]):
        found = mined(frame(spark, docs))
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.collect() == []
    for wrong in ({"support": 0}, {"shards": 0}):
        with pytest.raises(ValueError):
            mined(frame(spark, []), **wrong)


def test_scores_beyond_64_bits(spark):
    a, l, r, n = 987_654_321_012, 3_210_987_654_321, 1_234_567_890_123, 9_876_543_210_987_654
    counts = spark.createDataFrame(
        [("x", "", 0, n), ("x", "p", 1, l), ("x", "q", 1, r), ("x", "p q", 2, a), ("x", "q p", 2, 7)],
        "lang string, phrase string, size int, n long",
    )
    got = {r["phrase"]: r["score"] for r in collocations.scored(counts).collect()}
    assert got == {"p q": 1000 * a * n // (l * r), "q p": 1000 * 7 * n // (l * r)}
