"""Byte-level BPE: texts to token ids and back, as the tokenizer file says.

Texts are cut into words by the byte-level pattern. All new words of a batch
lie in one flat array of symbols; each round finds the ranks of neighbouring
symbols by binary search over the sorted pair keys, and merges in every word its
lowest-ranked pair at once. A token is made by one rule only, so pairs that hold
a new token rank after the rule that made it, and merging all places of a pair
together gives what merging them one by one gives.

The vocabulary is read on the driver and broadcast; a file has a fixed number
of rules, whatever the texts are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetbooks.llm.common import buffers, chunks, lists, ragged, strings

# Fixed value: how byte-level tokenizers cut text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Words remembered by a task; when there are more it starts anew.
REMEMBERED = 250_000

# Bytes of text that are encoded at once.
STEP = 500_000


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable ones for
    themselves, the others in order from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    first: np.ndarray  # id of each byte
    keys: np.ndarray  # left id * size + right id, sorted
    ranks: np.ndarray  # rank of each key
    made: np.ndarray  # id that each rank makes
    special: dict[str, int]  # texts that are one token
    letters: np.ndarray  # bytes of all tokens end to end
    starts: np.ndarray  # where token i begins in them

    @property
    def size(self) -> int:
        return len(self.starts) - 1


def load(path: str) -> Vocabulary:
    """Reads a byte-level ``tokenizers`` file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    ids, letters = told["model"]["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
    size = max([*ids.values(), *special.values()]) + 1
    tokens = [b""] * size
    for word, i in ids.items():
        tokens[i] = bytes(letters[c] for c in word)
    for word, i in special.items():
        tokens[i] = word.encode()
    first = np.zeros(256, np.int64)
    for letter, b in letters.items():
        first[b] = ids[letter]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    lengths = np.array([len(t) for t in tokens])
    return Vocabulary(
        first,
        keys[order],
        order.astype(np.int64),
        made,
        special,
        np.frombuffer(b"".join(tokens), np.uint8),
        np.concatenate([[0], np.cumsum(lengths)]),
    )


def merged(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words end to end, and how many each word has."""
    lengths = np.array([len(w) for w in words], np.int64)
    symbols = v.first[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.zeros(len(words), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.int64(len(v.made))

    def ranked(at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at some places."""
        after = np.minimum(at + 1, len(symbols) - 1)
        pair = symbols[at] * v.size + symbols[after]
        key = np.minimum(np.searchsorted(v.keys, pair), len(v.keys) - 1)
        return np.where((v.keys[key] == pair) & (owner[at] == owner[after]) & (at < after), v.ranks[key], none)

    rank = ranked(np.arange(len(symbols)))
    while len(symbols):
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, begins)
        here = np.repeat(lowest, np.diff(np.append(begins, len(owner))))
        open_ = here < none
        if not open_.all():  # words without a pair to merge are done
            kept.append((symbols[~open_], owner[~open_]))
            symbols, owner, rank, here = symbols[open_], owner[open_], rank[open_], here[open_]
            if not len(symbols):
                break
        spot = np.flatnonzero(rank == here)
        # Of pairs that overlap (a a a), every second one from the first on.
        new_run = np.append(True, np.diff(spot) != 1)
        run_start = spot[new_run][np.cumsum(new_run) - 1]
        spot = spot[(spot - run_start) % 2 == 0]
        symbols[spot] = v.made[rank[spot]]
        stay = np.ones(len(symbols), bool)
        stay[spot + 1] = False
        symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
        # Only pairs with a new symbol have new ranks.
        spot = spot - np.arange(len(spot))
        changed = np.concatenate([spot, np.maximum(spot - 1, 0)])
        rank[changed] = ranked(changed)
    if not kept:
        return np.zeros(0, np.int64), counts
    symbols, owner = (np.concatenate(x) for x in zip(*kept))
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes lists of texts; remembers the ids of words it has met."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.cut = regex.compile(WORDS)
        marks = sorted(v.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        for mark, i in self.v.special.items():
            self._add([mark], np.array([i]), np.array([1]))

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        for word in words:
            self.place[word] = len(self.place)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])

    def words(self, text: str) -> list[str]:
        if self.marks is None or not any(m in text for m in self.v.special):
            return self.cut.findall(text)
        found: list[str] = []
        for part in self.marks.split(text):
            found += [part] if part in self.v.special else self.cut.findall(part)
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if len(self.place) > REMEMBERED:
            self.forget()
        rows = [self.words(t) for t in texts]
        new = [w for w in set(chain.from_iterable(rows)) if w not in self.place]
        if new:
            self._add(new, *merged([w.encode() for w in new], self.v))
        sizes = np.array([len(r) for r in rows], np.int64)
        which = np.fromiter(map(self.place.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        lengths = self.starts[which + 1] - self.starts[which]
        ids = self.ids[ragged(self.starts[which], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[ends])


def _replaced(batch: pa.RecordBatch, drop: str, name: str, made: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], [*names, name])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: bool = True) -> DataFrame:
    """``df`` with an array column of token ids in place of any column of that name;
    without the text if ``keep`` is false.

    A null text is an empty one and has no ids. Every row gives one row, copies
    and repeated keys as well; an empty table stays empty. No special tokens are
    added; their strings in a text are those tokens, as the library has it.
    """
    shared = df.sparkSession.sparkContext.broadcast(astuple(load(path)))
    df = df.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            column = batch.column(text)
            for low, high in chunks(buffers(column)[1], STEP):
                values, counts = encoder.encode([t or "" for t in column[low:high].to_pylist()])
                made = lists(values, counts, pa.int32())
                yield _replaced(batch.slice(low, high - low), "" if keep else text, ids, made)

    return df.mapInArrow(run, _schema(df if keep else df.drop(text), f"`{ids}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: bool = True) -> DataFrame:
    """``df`` with the text of an array of token ids, special tokens included;
    without the ids if ``keep`` is false.

    Null gives an empty text, bytes that are no UTF-8 give U+FFFD. An id outside
    the vocabulary stands for nothing, as in the library.
    """
    shared = df.sparkSession.sparkContext.broadcast(astuple(load(path)))
    df = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        for batch in batches:
            column = batch.column(ids)
            counts = np.where(column.is_valid(), np.diff(column.offsets.to_numpy()), 0)
            flat, ends = column.flatten(), np.concatenate([[0], np.cumsum(counts)])
            for low, high in chunks(ends, STEP // 2):
                own = flat[ends[low] : ends[high]]
                tokens = own.fill_null(-1).to_numpy().astype(np.int64)
                known = (tokens >= 0) & (tokens < v.size)
                row = np.repeat(np.arange(high - low), counts[low:high])[known]
                tokens = tokens[known]
                lengths = v.starts[tokens + 1] - v.starts[tokens]
                letters = v.letters[ragged(v.starts[tokens], lengths)]
                sizes = np.bincount(row, weights=lengths, minlength=high - low).astype(np.int64)
                made = strings(letters, sizes)
                yield _replaced(batch.slice(low, high - low), "" if keep else ids, text, made)

    return df.mapInArrow(run, _schema(df if keep else df.drop(ids), f"`{text}` string"))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])
