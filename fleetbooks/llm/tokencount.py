"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton enumerates all pieces of the vocabulary that end at a
place; dynamic programming carries the best score up to each place and the number
of pieces on that path. Ties go as in the tokenizer: of paths to one place with equal
scores, the one whose last piece begins first. A character that is no piece by itself
may be passed at the price of an unknown one, and counts as its bytes.

If all scores are whole numbers (sums are then exact) and no piece crosses a gap
between words, words are counted one by one and remembered; else whole texts are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.common import text_or_empty

SPACE = "▁"

# Fixed value: how far below the worst piece an unknown character is.
UNKNOWN = 10.0

# Words remembered by a task; when there are more it starts anew.
REMEMBERED = 300_000


def load(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a ``sentencepiece`` file."""
    told = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(told.id_to_piece(k), told.get_score(k)) for k in range(told.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.found = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        if len(self.found):
            self.found.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min([s for _, s in vocabulary], default=0.0) - UNKNOWN
        pieces = [p for p, _ in vocabulary]
        # Words begin with a run of spaces; line ends stand by themselves.
        exact = all(float(s).is_integer() for _, s in vocabulary)
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) or (len(p) > 1 and "\n" in p) for p in pieces)
        self.words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+") if exact and not inside else None
        self.known: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces on the best path through ``text``."""
        n = len(text)
        score, count = [0.0, *[-inf] * n], [0] * (n + 1)
        matches = self.found.iter(text) if len(self.found) else ()
        if self.single.issuperset(text):
            # Longest first at each place, so that the earliest start keeps a tie.
            for last, (size, own) in matches:
                total = score[last + 1 - size] + own
                if total > score[last + 1]:
                    score[last + 1], count[last + 1] = total, count[last + 1 - size] + 1
            return count[n]
        done = 0  # places up to here have their best path
        for last, (size, own) in matches:
            while done < last:
                done = self._unknown(text[done], done, score, count)
            total = score[last + 1 - size] + own
            if total > score[last + 1]:
                score[last + 1], count[last + 1] = total, count[last + 1 - size] + 1
        while done < n:
            done = self._unknown(text[done], done, score, count)
        return count[n]

    def _unknown(self, c: str, at: int, score: list[float], count: list[int]) -> int:
        if c not in self.single and score[at] + self.unknown > score[at + 1]:
            score[at + 1] = score[at] + self.unknown
            count[at + 1] = count[at] + len(c.encode("utf-8", "replace"))
        return at + 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.words is None:
            return self.best(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, total = self.known, 0
        for word in self.words.findall(text):
            own = known.get(word)
            if own is None:
                own = known[word] = self.best(word)
            total += own
        return total


def token_counts(
    rows: DataFrame, vocabulary: list[tuple[str, float]], id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``id`` and ``n_tokens``, the number of tokens of the whole text.

    A space counts as the sign ``▁``, and one stands before the text. A null or empty
    text has no tokens. Bytes stand for characters that no piece covers, so there
    is no unknown token. Every row gives one row, copies too; other columns take no part.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rows = rows.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column("text")
            counts = np.fromiter((counter.count(t.as_py()) for t in texts), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts)], ["id", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id)
