"""Texts longer than one inner step, ties, and plain versions of the two classifiers' scores."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from fleetbooks.llm import bpe, common, decontaminate, langid, simhash, tokencount, toxicity
from tests.llm.test_copies import plain_hits, plain_print
from tests.llm.test_words import WORDS, texts_of

BPE = public_tokenizers.path("byte_bpe_50k.json")


def long_text(seed, size):
    draw = random.Random(seed)
    words = ["the", "river", "don't", "1999", "été", "a", "walks", "日本", "quickly,", "and", "\n", "(x)"]
    out = []
    while sum(map(len, out)) + len(out) < size:
        out += [draw.choice(words) for _ in range(1000)]
    return " ".join(out)


LONG = 3 * common.CHUNK


def test_long_texts_as_the_tokenizer_libraries(frame):
    docs = [(1, "short"), (2, long_text(1, LONG)), (3, "a" * 5000 + " tail"), (4, "after")]
    library = Tokenizer.from_file(BPE)
    found = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame(docs), BPE), BPE).collect()}
    for k, text in docs:
        want = library.encode(text, add_special_tokens=False).ids
        assert found[k]["ids"] == want and found[k]["decoded"] == library.decode(want, skip_special_tokens=False)
    vocabulary = tokencount.load(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    found = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(frame(docs), vocabulary).collect()}
    assert found == {k: len(library.encode("▁" + t.replace(" ", "▁")).ids) for k, t in docs}


def test_long_texts_have_their_fingerprint(frame):
    docs = [(1, "a b c d"), (2, long_text(2, LONG)), (3, long_text(2, LONG).upper().replace("ÉTÉ", "été")), (4, "x")]
    found = {r["doc_id"]: r for r in simhash.near_copies(frame(docs)).collect()}
    assert [found[k]["fingerprint"] for k, _ in docs] == [f"{plain_print(t):016x}" for _, t in docs]
    assert found[3]["component_id"] == 2


def test_long_texts_are_decontaminated(spark, frame):
    text = long_text(3, LONG)
    words = text.split()
    tests = [(7, " ".join(words[100:120])), (8, " ".join(words[-60:-30])), (9, "nowhere at all is this phrase of more than thirteen words to be found")]
    docs = [(1, "one"), (2, text), (3, " ".join(words[95:130]))]
    items = spark.createDataFrame([(i, t) for i, t in tests], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contamination(frame(docs), items).collect()}
    for (id, _), (n, hit, names, _) in zip(docs, plain_hits(docs, tests)):
        assert (found[id]["n_words"], found[id]["n_hit"], sorted(found[id]["items"])) == (n, len(hit), names)


def plain_language(model, text):
    """Shares of the languages: the log odds of every trigram around a letter, one by one."""
    data = (text or "").encode()
    signs = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
    sums, n = np.zeros(model["weights"].shape[1]), 0
    for k, sign in enumerate(signs):
        if sign == 32:
            continue
        before, after = signs[k - 1] if k else 32, signs[k + 1] if k + 1 < len(signs) else 32
        bucket = ((before | sign << 8 | after << 16) * 2654435761 & 0xFFFFFFFF) >> 16
        sums += model["weights"][bucket].astype(float)
        n += 1
    losses = []
    for code in model["code"]:
        margins = [s / math.sqrt(max(1, n)) for s in sums]
        losses.append(sum(t * np.logaddexp(0, -m * c) for t, m, c in zip(model["trust"], margins, code)))
    norm = sum(model["trust"]) / max(1, len(model["trust"]))
    shares = [math.exp(-(x - min(losses)) / norm) for x in losses]
    return [s / sum(shares) for s in shares]


def test_languages_by_a_plain_version_and_of_long_texts(spark, frame):
    rows = [(t, lang) for lang in WORDS for t in texts_of(lang, 30, 1)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    docs = [(k, texts_of(lang, 1, k)[0]) for k, lang in enumerate(list(WORDS) * 3)]
    docs += [(90, "a"), (91, "the die le é zq"), (92, (" ".join(texts_of("de", 40, 5)) + " ") * (LONG // 4000))]
    assert len(docs[-1][1]) > common.CHUNK
    found = {r["doc_id"]: r for r in langid.identify(frame(docs), model).collect()}
    for k, text in docs:
        shares = plain_language(model, text)
        assert found[k]["score"] == pytest.approx(max(shares), abs=1e-4)
        assert found[k]["lang_pred"] == model["langs"][int(np.argmax(shares))]
    assert found[92]["lang_pred"] == "de"


def test_equal_languages_are_a_tie(spark, frame):
    rows = [("zwei gleiche texte", lang) for lang in ("yy", "xx")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    row = langid.identify(frame([(1, "zwei gleiche")]), model).first()
    assert (row["lang_pred"], row["score"], row["ambiguous"]) == ("xx", pytest.approx(0.5), True)


def test_toxicity_by_a_plain_version(spark, frame):
    draw = random.Random(11)
    plain = WORDS["en"] + "house tree river stone moose kitten walks".split()
    bad = ["idiot", "moron", "scum"]
    docs = [(k, " ".join(draw.choice(plain) for _ in range(12)) + (f" {draw.choice(bad)}" if k % 4 == 0 else "")) for k in range(500)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(frame(docs), labels)
    reader = toxicity.Reader(model["cost"])
    odd = ["the m0ron", "s c u m", "kitten", "IDIOT!!", "id*ot tree", "", None, "moose mooose", "a scumbag and an idiotic moron"]
    odd += [" ".join(draw.choice([*plain, *bad, "1d1ot", "m*ron", "sc-um"]) for _ in range(9)) for _ in range(60)]
    told = {r["doc_id"]: r["score"] for r in toxicity.score(frame(list(enumerate(odd))), model, tell=False).collect()}
    for k, text in enumerate(odd):
        words = set(reader.words(text or ""))
        marks = {w for w in words} | {w[:n] + "*" for w in words for n in range(3, 9) if len(w) > n}
        total = model["bias"] + sum(model["weights"][p] for x, p in model["place"].items() if x in marks)
        assert told[k] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_tables_can_be_removed(spark):
    df = common.written(spark.range(5), "short-lived")
    (path,) = {x.rsplit("/", 1)[0] for x in df.inputFiles()}
    assert common.remove_tables(spark) >= 1 and common.remove_tables(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
