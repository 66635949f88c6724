"""Tokens, token counts, languages and toxicity."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from fleetbooks.llm import bpe, charlm, langid, queries, tokencount, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a" * 3000, " " * 40 + "x", "<|endoftext|>", "a<|endoftext|>b", "\x85\x1c\x1f x y",
    "日本語 🙂🙂 é", "don't we'll I'M", "1²³٣ ½x", "\n\n\n a\t\tb \n", "aaa aaaa aaaaa hahahaha",
]


def random_texts(n, seed=1):
    draw = random.Random(seed)
    signs = [chr(draw.choice([draw.randrange(32, 0x3000), draw.randrange(0x10000, 0x1FFFF)])) for _ in range(300)]
    return ["".join(draw.choice(signs + list(" ab'\n")) for _ in range(draw.randint(1, 60))) for _ in range(n)]


def test_bpe_as_the_library(frame):
    texts = ODD + random_texts(300)
    library = Tokenizer.from_file(BPE)
    docs = frame(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, BPE), BPE).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[k]["ids"] == want
        assert got[k]["decoded"] == library.decode(want, skip_special_tokens=False)
        assert got[k]["text"] == text


def test_token_digest_and_repeats(frame):
    found = queries.token_digest(frame([(1, "the cat"), (1, "the cat"), (None, None)]), BPE).collect()
    ids = Tokenizer.from_file(BPE).encode("the cat", add_special_tokens=False).ids
    want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"the cat").hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r)[1:] for r in found) == sorted([want, want, (0, empty, empty)])
    assert queries.token_digest(frame([]), BPE).collect() == []


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [50256, -1, 99999999]), (4, [220, 255])], "k int, ids array<int>")
    found = {r["k"]: r["decoded"] for r in bpe.decode(rows, BPE).collect()}
    library = Tokenizer.from_file(BPE)
    assert found == {1: "", 2: "", 3: "<|endoftext|>", 4: library.decode([220, 255], skip_special_tokens=False)}


def test_counts_as_the_library(frame):
    vocabulary = tokencount.load(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    texts = [t for t in ODD if t] + ["<0x41><s></s><unk>", "x▁▁y"] + random_texts(150, 3)
    docs = [*enumerate(texts), (None, None), (-1, "")]
    found = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(frame(docs), vocabulary).collect()}
    assert found.pop(None) == found.pop(-1) == 0
    assert found == {k: len(library.encode("▁" + t.replace(" ", "▁")).ids) for k, t in enumerate(texts)}
    assert tokencount.token_counts(frame([]), vocabulary).collect() == []


@pytest.mark.parametrize("whole", [True, False])
def test_counts_with_ties(whole):
    draw = random.Random(5)
    for _ in range(150):
        pieces = {"".join(draw.choice("ab▁c") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 12))}
        score = (lambda: float(-draw.randint(0, 3))) if whole else (lambda: -draw.choice([0.1, 0.2, 0.3, 0.7]))
        vocabulary = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *((p, score()) for p in sorted(pieces))]
        ours, library = tokencount.Counter(vocabulary), Tokenizer(models.Unigram(vocabulary, 0, True))
        for _ in range(8):
            text = "".join(draw.choice("abcdé \n") for _ in range(draw.randint(1, 30)))
            assert ours.count(text) == len(library.encode("▁" + text.replace(" ", "▁")).ids)


WORDS = {
    "en": "the and with from that this was are have of to in".split(),
    "de": "der die und nicht mit von auf für ein ist zu das".split(),
    "fr": "le la les des une avec pour dans que qui est pas".split(),
    "es": "el los una con para por que del las como más y".split(),
    "xx": "zqk wqz kzw qqz zzk wkq".split(),
}


def texts_of(lang, n, seed):
    draw = random.Random(f"{lang}{seed}")
    return [" ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(5, 30))) for _ in range(n)]


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "de", "fr", "es"], list(WORDS)])
def test_languages(spark, frame, langs):
    rows = [(t, lang) for lang in langs for t in texts_of(lang, 30, 1)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    new = [(k, t) for k, t in enumerate(t for lang in langs for t in texts_of(lang, 20, 2))]
    odd = [(1000, None), (1001, ""), (1002, "123 -- !"), (1003, "THE AND WITH THE"), (1003, "THE AND WITH THE")]
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(frame(new + odd), model).collect()]
    want = [lang for lang in langs for _ in range(20)]
    right = sum(want[k] == lang for k, lang, _ in found if k < 1000)
    assert right >= 0.95 * len(want)
    assert all(0 <= s <= 1 for _, _, s in found)
    assert sorted(x for x in found if 1000 <= x[0] < 1003) == [(k, "und", 0.0) for k in (1000, 1001, 1002)]
    assert [x[1] for x in found if x[0] == 1003] == ["en", "en"]


def test_codewords_differ():
    for n in range(2, 20):
        code = langid.codewords(n)
        nearest = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert nearest >= max(1, code.shape[1] // 4)


def test_no_language_learned(spark, frame):
    model = langid.fit(spark.createDataFrame([("text", None)], "text string, lang string"))
    assert [tuple(r) for r in langid.identify(frame([(1, "some words")]), model).collect()] == [(1, "und", 0.0, True)]
    assert langid.identify(frame([]), model).collect() == []


@pytest.fixture(scope="module")
def toxic(spark, frame):
    draw = random.Random(4)
    plain = WORDS["en"] + "cat dog house tree river stone walk talk bread water".split()
    bad = "idiot stupid moron scum loser".split()
    docs, labels = [], []
    for k in range(800):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 25))]
        if k % 5 == 0:
            for word in draw.sample(bad, 2):
                words.insert(draw.randint(0, len(words)), word)
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    labels = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    return toxicity.fit(frame(docs), labels)


DISGUISED = [
    "1d10t", "idi0t", "idiooooot", "i d i o t", "i.d.i.o.t", "st*pid", "$tup1d", "m0r0n", "l-o-s-e-r", "sc*m", "s c u m", "LOOOSER!!!",
]


def test_toxicity_reads_disguise(frame, toxic):
    docs = [(k, f"the house and {word} of the river") for k, word in enumerate(DISGUISED)]
    found = {r["doc_id"]: r for r in toxicity.score(frame(docs), toxic).collect()}
    missed = [DISGUISED[k] for k, r in found.items() if not r["predicted"]]
    assert missed == []
    assert found[3]["restored"] == ["i d i o t > idiot"]


SET_APART = ["i--d--i--o--t", "i..d..i..o..t", "s**c**u**m", "l-._o-._s-._e-._r", "(i--d--i--o--t)", "x/s..c..u..m"]


def test_toxicity_reads_letters_set_apart_without_spaces(frame, toxic):
    docs = [(k, f"the house and {word} of the river") for k, word in enumerate(SET_APART)]
    found = {r["doc_id"]: r for r in toxicity.score(frame(docs), toxic).collect()}
    assert [SET_APART[k] for k, r in found.items() if not r["predicted"]] == []
    assert found[0]["restored"] == ["i--d--i--o--t > idiot"]


def test_toxicity_leaves_the_rest(frame, toxic):
    docs = [(1, None), (2, ""), (3, "the dog walks to the tree"), (4, "call 555 0199 or a b c"), (5, "x" * 50_000)]
    docs += [(6, "in 2024 a price of $15!! and 3rd"), (6, "in 2024 a price of $15!! and 3rd")]
    found = toxicity.score(frame(docs), toxic).collect()
    assert len(found) == len(docs) and not any(r["predicted"] for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    kept = toxicity.clean(frame([*docs, (9, "you stupid idiot")]), toxic)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 6]
    assert kept.columns == frame([]).columns


MASKED = ["id**t", "st**id", "m**on", "l*s*r", "sstuupid", "iddioott", "sscumm", "s*u*1d", "lo##r"]


def test_toxicity_reads_masks_and_doubled_letters(frame, toxic):
    docs = [(k, f"the house and {word} of the river") for k, word in enumerate(MASKED)]
    found = {r["doc_id"]: r for r in toxicity.score(frame(docs), toxic).collect()}
    assert [(MASKED[k], r["restored"]) for k, r in found.items() if not r["predicted"]] == []


def test_doubled_letters_keep_the_word(toxic):
    reader = toxicity.Reader(toxic["cost"])
    for word in ("tree", "loose", "butt", "tree,tree"):
        assert set(toxicity._WORD.findall(word)) <= set(reader.token(word)[0])
    assert [x for _, x in reader.set_apart("an s c u walk", set())] == [toxicity._WORD.findall(reader.apart("s c u"))]


def test_scores_do_not_depend_on_what_is_told(frame, toxic):
    draw = random.Random(9)
    odd = [*DISGUISED, *SET_APART, *MASKED, "tree", "aaaaaabc", "!!", "$$$", "l00ser.", "scc*um,", "x*y", "\u00b2a", "idi_ot", "ss-tt"]
    signs = "abdeimnorstu*#@$10 .-_*"
    odd += ["".join(draw.choice(signs) for _ in range(draw.randint(2, 12))) for _ in range(800)]
    docs = [(k, " ".join(draw.sample(odd, 6)) + " of the house") for k in range(400)] + [(k, x) for k, x in enumerate(odd, 400)]
    told = {r["doc_id"]: r["score"] for r in toxicity.score(frame(docs), toxic).collect()}
    short = toxicity.score(frame(docs), toxic, tell=False)
    assert short.columns == ["doc_id", "score", "predicted"]
    assert {r["doc_id"]: r["score"] for r in short.collect()} == told


def test_texts_without_letters_set_apart_are_told():
    draw = random.Random(12)
    signs = ["a", "b", "7", "\u00e9", "\u2014", "\U0001f600", "\u00b2", "_", " ", " ", ".", "-", "*", "~", "\n", ",", "ab", "the "]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(30_000)]
    texts += ["s c u m", "ab\u2014s c u", "s c u\u2014ab", "\u2014s.c.u", "s_c_u", "x/s..c..u..m"]
    has = [t for t in texts if toxicity._APART.search(t)]
    assert len(has) > 200 and all(toxicity._SECOND.search(t) for t in has)
    assert not toxicity._SECOND.search("a house and I had a 2nd one")


@pytest.mark.parametrize("roots", [("idiot", "st*", "mo"), ("aab*", "bba", "a"), ("xyz",)])
def test_beginnings_against_all_readings(roots):
    import itertools

    import numpy as np

    scorer = toxicity.Scorer(np.zeros((32,) * 4, np.float32), {x: k for k, x in enumerate(roots)})
    draw = random.Random(3)
    for _ in range(400):
        token = "".join(draw.choice("aabbmoidst*0 1!-x") for _ in range(draw.randint(1, 7))).strip()
        places = scorer.reader.places(token)
        if places is None:
            continue
        readings = ("".join(x for x, _ in path) for path in itertools.islice(itertools.product(*places), 50_000))
        heads = {w[:3] for text in readings for w in toxicity._WORD.findall(text)}
        if heads & scorer.roots:
            assert scorer.reaches(places) and scorer.may_count(token)


@pytest.mark.parametrize("wide", [1, 1000])
def test_lattice_of_hidden_signs_against_all_paths(monkeypatch, wide):
    import itertools

    import numpy as np

    monkeypatch.setattr(charlm, "WIDE", wide)
    monkeypatch.setattr(charlm, "BLOCK", 3)
    cost = charlm.costs(np.random.default_rng(3).integers(0, 50, (32,) * 4).astype(float) ** 3)
    for token in ("f*c*ing", "s*u*id", "a**b", "a***b", "1*a*b", "ss*uu*é", "a#1#b"):
        lattice = toxicity._lattice(token)
        paths = [(0.0, (0, 0, 0), "")]
        for place in [*lattice, [(" ", 0.0)]]:
            after = []
            for (total, back, text), (reading, price) in itertools.product(paths, place):
                total += price
                for c in charlm.classes(reading):
                    if c or back[2]:
                        total += float(cost[(*back, c)])
                    back = (back[1], back[2], c) if c else (0, 0, 0)
                after.append((total, back, text + reading))
            paths = after
        best = min(total for total, _, _ in paths)
        got = charlm.read(lattice, cost)
        assert min(total for total, _, text in paths if text.strip() == got) == pytest.approx(best)


def test_nothing_to_learn(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(frame([(1, "a b c")]), none)
    assert [(r["score"], r["predicted"]) for r in toxicity.score(frame([(1, "a b c")]), model).collect()] == [(pytest.approx(0), 0)]
    assert toxicity.score(frame([]), model).collect() == []


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    cost = charlm.costs(np.random.default_rng(1).integers(0, 50, (32,) * 4).astype(float))

    def price(text):
        total, back = 0.0, (0, 0, 0)
        for c in charlm.classes(text):
            if c or back[2]:
                total += float(cost[back[0], back[1], back[2], c])
            back = (back[1], back[2], c) if c else (0, 0, 0)
        return total

    draw = random.Random(2)
    for _ in range(40):
        lattice = [[(draw.choice(["a", "b", "", "cd", " "]), draw.random()) for _ in range(3)] for _ in range(4)]
        paths = itertools.product(*lattice)
        best = min(price("".join(t for t, _ in p) + " ") + sum(x for _, x in p) for p in paths)
        got = charlm.read(lattice, cost, beam=10_000)
        options = [sum(x for _, x in p) for p in itertools.product(*lattice) if "".join(t for t, _ in p).strip() == got]
        texts = ["".join(t for t, _ in p) for p in itertools.product(*lattice) if "".join(t for t, _ in p).strip() == got]
        assert min(price(t + " ") + o for t, o in zip(texts, options)) == pytest.approx(best)
