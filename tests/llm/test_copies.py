"""Line dedup, near copies and decontamination against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash

from fleetbooks.llm import components, decontaminate, golay, linededup, simhash

LINE_WORD = re.compile(r"[^ \t\r\f\x0B]+")


def kept_lines(docs, words):
    """(id, text) in order -> texts left, by looking at every run of lines."""
    seen, out = set(), []
    runs = []
    for d, (_, text) in enumerate(docs):
        lines = text.split("\n")
        sizes = [len(LINE_WORD.findall(x)) for x in lines]
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(sizes[s : e + 1]) >= words:
                    runs.append((d, s, e, tuple(lines[s : e + 1])))
    gone = [set() for _ in docs]
    for d, s, e, run in runs:
        if run in seen:
            gone[d].update(range(s, e + 1))
        seen.add(run)
    for d, (_, text) in enumerate(docs):
        out.append("\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[d]))
    return out


@pytest.mark.parametrize("words", [1, 3, 6, 12])
def test_lines_against_all_runs(frame, words):
    draw = random.Random(words)
    pool = ["", " ", "a", "b c", "d e f", "g h i j k l", "one line of seven words in all"]
    docs = [(k, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 14)))) for k in range(40)]
    found = {r["doc_id"]: r for r in linededup.without_repeats(frame(docs), words=words).collect()}
    want = kept_lines(docs, words)
    assert [found[k]["text"] for k, _ in docs] == want
    for (k, text), left in zip(docs, want):
        n = len(text.split("\n"))
        assert found[k]["n_lines"] == n
        assert found[k]["n_removed"] in (n - len(left.split("\n")), n)


def test_lines_of_odd_rows(frame):
    line = "five words are in here"
    docs = [(2, line), (1, None), (3, ""), (None, line + "\nx"), (4, f"a\n{line}\n{line}\nb"), (4, f"a\n{line}\n{line}\nb")]
    df = frame(docs)
    found = linededup.without_repeats(df)
    assert found.columns == [c for c in df.columns if c != "n_removed"] + ["n_lines", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["key"]) for r in found.collect()), key=str)
    want = [
        (2, "", 1, 1, 3),
        (1, None, 0, 0, 3),
        (3, "", 1, 0, 3),
        (None, line + "\nx", 2, 0, 3),
        (4, "a\nb", 4, 2, 3),
        (4, "a\nb", 4, 2, 3),
    ]
    assert got == sorted(want, key=str)
    assert linededup.without_repeats(frame([])).collect() == []


def test_lines_of_a_long_text(frame):
    text = "\n".join(f"line {k % 7000} of a long text" for k in range(20_000))
    row = linededup.without_repeats(frame([(1, text)])).first()
    assert row["n_removed"] == 13_000 and row["text"] == "\n".join(text.split("\n")[:7000])


def test_golay_keys_meet():
    code = golay.Golay()
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << golay.BITS, 4000)
    near = code.near(words)
    assert set((near >= 0).sum(axis=1).tolist()) <= {1, 6}
    for bits in (0, 1, 2):
        other = words.copy()
        for row in range(len(other)):
            for bit in draw.choice(golay.BITS, bits, replace=False):
                other[row] ^= 1 << int(bit)
        met = (near[:, :, None] == code.near(other)[:, None, :]) & (near[:, :, None] >= 0)
        assert met.any(axis=(1, 2)).all()


def plain_print(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, bits):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def near_texts(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(8):
        base = [draw.choice(words) for _ in range(draw.randint(1, 120))]
        for _ in range(draw.randint(1, 14)):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            docs.append(draw.choice([" ", "\n", "  "]).join(copy))
    return docs + ["", None, " \t\n", "A b", "a B", "x\xa0y z"]


@pytest.mark.parametrize("block", [3, 1000])
@pytest.mark.parametrize("bits", [0, 4])
def test_near_copies(frame, monkeypatch, bits, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.links, "__defaults__", (4, block))
    texts = near_texts(bits)
    docs = [(k + 10, t) for k, t in enumerate(texts)]
    prints = [plain_print(t) for t in texts]
    groups = plain_groups(prints, bits)
    found = {r["doc_id"]: r for r in simhash.near_copies(frame(docs), bits=bits).collect()}
    for k in range(len(texts)):
        assert found[k + 10]["fingerprint"] == f"{prints[k]:016x}"
        assert found[k + 10]["component_id"] == groups[k] + 10
    kept = simhash.one_of_each(frame(docs), bits=bits).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({g + 10 for g in groups})


def test_links_of_dense_prints(spark):
    draw = random.Random(3)
    prints = {draw.getrandbits(64)}
    while len(prints) < 150:  # a chain of near ones, and some far
        prints.add(draw.choice(sorted(prints)) ^ sum(1 << b for b in draw.sample(range(64), draw.choice([2, 4, 5]))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    for block in (4, 1000):
        rows = spark.createDataFrame([(p,) for p in signed * 2], "print long")
        links = [tuple(r) for r in simhash.links(rows, 4, block).collect()]
        place = {p: k for k, p in enumerate(signed)}
        root = list(range(len(signed)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in links:
            x, y = find(place[a]), find(place[b])
            root[max(x, y)] = min(x, y)
        assert [find(k) for k in range(len(signed))] == plain_groups([p & (1 << 64) - 1 for p in signed], 4)


def test_near_copies_of_odd_rows(frame):
    docs = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "q r s t"), (None, "only here")]
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_copies(frame(docs)).collect()), key=str)
    assert found == [(5, 5), (5, 5), (7, 7), (None, 5), (None, None)]
    kept = simhash.one_of_each(frame(docs))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "None", "None"]
    assert kept.columns == frame([]).columns
    assert simhash.near_copies(frame([])).collect() == [] and simhash.one_of_each(frame([])).collect() == []


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "print long"), 5)


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(30)] + [(500, 500), (7, 3), (None, 4)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, **{200 + k: 200 for k in range(1, 30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, tests, window=13):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for id, text in tests:
        words = TEST_WORD.findall(lower(text))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + window]), set()).add(id)
    out = []
    for _, text in docs:
        words, hit, items = TEST_WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                own = windows.get(tuple(words[k : k + size]))
                if own:
                    hit.update(range(k, k + size))
                    items |= own
        spans = [m.span() for m in TEST_WORD.finditer(lower(text))]
        out.append((len(words), sorted(hit), sorted(str(i) for i in items if i is not None), spans))
    return out


def contaminated_sample(seed):
    draw = random.Random(seed)
    words = "the a of to in it Is was for on As at by x1 é".split()
    phrase = lambda n: [draw.choice(words) for _ in range(n)]
    tests = [(k, " ".join(phrase(draw.choice([0, 1, 2, 5, 13, 14, 30])))) for k in range(12)] + [(12, None), (None, "a a a a")]
    docs = []
    for k in range(40):
        text = phrase(draw.randint(0, 40))
        for _ in range(draw.randint(0, 2)):
            own = (draw.choice(tests)[1] or "").split()
            at = draw.randint(0, len(text))
            text[at:at] = own[draw.randint(0, 3) :]
        docs.append((k, draw.choice([" ", ", ", "\n"]).join(text)))
    return docs + [(100, None), (101, ""), (102, "??")], tests


@pytest.mark.parametrize("block", [8_000_000, 120])
@pytest.mark.parametrize("window", [3, 13])
def test_contamination(spark, frame, window, block):
    docs, tests = contaminated_sample(window)
    items = spark.createDataFrame(tests, "item_id long, text string")
    found = decontaminate.contamination(frame(docs), items, window=window, block_bytes=block).collect()
    found = {r["doc_id"]: r for r in found}
    assert len(found) == len(docs)
    for (id, text), (n, hit, names, spans) in zip(docs, plain_hits(docs, tests, window)):
        row = found[id]
        assert (row["n_words"], row["n_hit"], row["items"]) == (n, len(hit), names)
        runs = [(k, k) for k in hit if k - 1 not in hit]
        runs = [(a, next(b for b in range(a, n) if b + 1 not in hit)) for a, _ in runs]
        size = lambda k: len((text or "")[:k].encode())
        assert [(s["begin"], s["end"]) for s in row["spans"]] == [(size(spans[a][0]), size(spans[b][1])) for a, b in runs]


def test_repeated_rows_with_one_block_and_many(spark, frame):
    docs, tests = contaminated_sample(3)
    items = spark.createDataFrame(tests, "item_id long, text string")
    docs = [*docs * 2, docs[0], (None, None), (None, None), (docs[0][0], docs[1][1])]
    one, many = (
        sorted(map(str, decontaminate.contamination(frame(docs), items, window=3, block_bytes=b).collect()))
        for b in (8_000_000, 120)
    )
    assert len(one) == len(docs) and one == many


def test_contamination_without_rows(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.contamination(frame([(1, "a b")]), none).first()
    assert (row["n_words"], row["n_hit"], row["items"], row["spans"]) == (2, 0, [], [])
    assert decontaminate.contamination(frame([]), none).collect() == []


def test_only_contaminated_documents_go(spark, frame):
    phrase = " ".join(f"p{k}" for k in range(13))
    tests = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    long_ = " ".join(f"w{k}" for k in range(300))
    docs = [(1, phrase), (2, f"{phrase} {long_}"), (3, "clean"), (3, "clean"), (None, phrase), (None, None)]
    kept = decontaminate.clean(frame(docs), tests)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "3", "None"]
    assert kept.columns == frame([]).columns
