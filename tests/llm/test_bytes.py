"""Repeated byte strings against a search through all of them."""

import random

import numpy as np
import pytest

from fleetbooks.llm import bwt, bytededup


def brute(docs, length):
    """(id, text) in order -> removed places of each."""
    seen, out = set(), []
    for _, text in docs:
        data, gone = (text or "").encode(), set()
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                gone.update(range(k, k + length))
            seen.add(data[k : k + length])
        out.append((data, gone))
    return out


def sample(seed, n=40):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdé \n") for _ in range(draw.randint(0, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        text = draw.choice(base) * draw.randint(1, 3)
        texts.append(text[draw.randint(0, 20) :] + draw.choice(base)[: draw.randint(0, 90)])
    return texts


def test_transforms_are_sorted_suffixes():
    draw = random.Random(1)
    for _ in range(100):
        texts = [bytes(draw.choice([1, 2, 3]) for _ in range(draw.randint(0, 40))) for _ in range(draw.randint(1, 6))]
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        order, before, longer = bwt.transforms(data, begins)
        for a, text in zip(begins, texts):
            rows = order[a : a + len(text) + 1] - a
            assert rows.tolist() == sorted(range(len(text) + 1), key=lambda p: text[p:] + b"\0")
        for r, place in enumerate(order):
            if longer[r] >= 0:
                assert order[longer[r]] == place - 1 and before[r] == data[place - 1]
            else:
                assert place in begins


@pytest.mark.parametrize("length", [1, 3, 8, 20])
def test_merge_finds_all_repeats(length):
    draw = random.Random(length)
    for _ in range(60):
        texts = [bytes(draw.choice([1, 2]) for _ in range(draw.randint(0, 50))) for _ in range(draw.randint(1, 6))]
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        want = {}
        for a, text in zip(begins, texts):
            for k in range(len(text) - length + 1):
                want.setdefault(text[k : k + length], []).append(int(a + k))
        got = {}
        for place, block in zip(*bwt.repeats(data, begins, length)):
            got.setdefault(int(block), []).append(int(place))
        assert sorted(sorted(x) for x in got.values()) == sorted(x for x in want.values() if len(x) > 1)


@pytest.mark.parametrize("pieces", [1, 4000])
@pytest.mark.parametrize("length", [12, 25])
def test_against_brute_force(frame, length, pieces):
    docs = list(enumerate(sample(length + pieces)))
    found = bytededup.without_repeats(frame(docs), length=length, pieces=pieces).collect()
    found = {r["doc_id"]: r for r in found}
    assert len(found) == len(docs)
    for (id, _), (data, gone) in zip(docs, brute(docs, length)):
        row = found[id]
        assert (row["n_bytes"], row["n_removed"]) == (len(data), len(gone))
        assert bytes(row["kept"]) == bytes(b for k, b in enumerate(data) if k not in gone)
        covered = [k for s in row["spans"] for k in range(s["begin"], s["end"])]
        assert covered == sorted(gone)
        assert all(a["end"] < b["begin"] for a, b in zip(row["spans"], row["spans"][1:]))


def test_odd_rows(frame):
    text = "0123456789" * 2
    docs = [(None, text), (3, text), (3, text), (3, "x" + text + "y"), (1, None), (2, ""), (4, "é" * 30)]
    found = bytededup.without_repeats(frame(docs), length=20).collect()
    assert len(found) == len(docs)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert by[None] == [(20, 0)]  # a missing id is the first
    assert sorted(by[3]) == [(20, 20), (20, 20), (22, 20)]
    assert by[1] == by[2] == [(0, 0)]
    assert by[4] == [(60, 60 - 0)] or by[4][0][0] == 60


@pytest.mark.parametrize("pieces", [1, 4000])
def test_repeated_rows_with_pieces_of_their_own(frame, pieces):
    draw = random.Random(7)
    shared = "".join(draw.choice("abcdefgh") for _ in range(60))
    docs = [(k, shared + "".join(draw.choice("abcdefgh") for _ in range(30))) for k in range(1, 5)]
    docs += [(5, "z" * 200), (6, "ab" * 60 + shared)]
    want = {id: len(gone) for (id, _), (_, gone) in zip(docs, brute(docs, 50))}
    for times in (1, 2, 3):
        found = bytededup.without_repeats(frame(docs * times), length=50, pieces=pieces).collect()
        assert len(found) == times * len(docs)
        assert {(r["doc_id"], r["n_removed"]) for r in found} == set(want.items())
    assert want[1] == 0 and want[5] == 199


def test_no_group_is_large(frame, monkeypatch):
    draw = random.Random(8)
    passage = "".join(draw.choice("abcdefgh") for _ in range(75))
    docs = [(k, passage + "".join(draw.choice("abcdefgh") for _ in range(30))) for k in range(200)]
    docs += [(1000 + k, docs[k][1][10:] + "z" * 60) for k in range(20)]
    tables = []

    def kept(df, name, written=bytededup.written):
        tables.append(written(df, name))
        return tables[-1]

    monkeypatch.setattr(bytededup, "written", kept)
    found = bytededup.without_repeats(frame(docs), length=60, pieces=20).collect()
    largest = [t.filter("kind = 0").groupBy("group").count().agg({"count": "max"}).first()[0] or 0 for t in tables]
    assert len(largest) == 3 and max(largest) <= 20
    assert {r["doc_id"]: r["n_removed"] for r in found} == {id: len(gone) for (id, _), (_, gone) in zip(docs, brute(docs, 60))}


def test_overlap_in_one_text(frame):
    row = bytededup.without_repeats(frame([(1, "ab" * 60)]), length=20).first()
    data, gone = brute([(1, "ab" * 60)], 20)[0]
    assert row["n_removed"] == len(gone) and bytes(row["kept"]) == data[:2]


def test_empty_table(frame):
    assert bytededup.without_repeats(frame([])).collect() == []
