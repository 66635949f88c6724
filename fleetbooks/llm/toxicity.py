"""Toxicity: disguised words are read through a noisy channel, then scored.

Leetspeak, letters set apart and repeated letters span a lattice of readings;
Viterbi picks the likeliest under a character model that Spark counts over all
documents. Words of the restored text and their beginnings are the features of a
logistic regression. It is fitted on ``SAMPLE`` labelled documents at most, with
the ``FEATURES`` words that tell most; driver and executors hold no more than that.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm import charlm
from fleetbooks.llm.common import buffers, chunks, lists, text_or_empty, written
from fleetbooks.llm.langid import held_out

SAMPLE = 20_000
FEATURES = 5_000
THRESHOLD = 0.3
PREFIXES = range(3, 9)
DRAWN = 10

# Tokens remembered by a task; when there are more it starts anew.
REMEMBERED = 200_000

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l",
}
HIDDEN = "*#"  # each may hide any letter between two others

_SIGNS = re.escape("".join(LEET) + HIDDEN)
# Letters set apart, four or more; three if no star is between them, which may hide a letter.
_APART = re.compile(
    r"(?<![^\W_])(?:(?:[^\W_](?: |[.\-_*~ ]{1,3})){3,}|(?:[^\W_](?: |[.\-_~ ]{1,3})){2})[^\W_](?![^\W_])"
)
# The second and third of such letters: a quick look at texts that have none.
_SECOND = re.compile(r"[.\-_*~ ][^\W_][.\-_*~ ]{1,3}[^\W_](?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[^\w$@!|+(<{€£]+|[^\w$@€£]+$|([$@€£])\1\1[^\w]*$")
_SIGN = re.compile(f"[{_SIGNS}]")
_DOTTED = re.compile(r"[^\W_](?:(?:[.\-_*~]{1,3}[^\W_]){3,}|(?:[.\-_~]{1,3}[^\W_]){2})")
_RUN = re.compile(r"(\w)\1+|.", re.S)
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_DOUBLED = re.compile(r"([^\W\d_])\1")


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each sign of a lower-case token may be, and the price of each reading."""
    places = []
    for run in _RUN.finditer(token):
        c, n = run[0][0], len(run[0])
        inner = run.start() > 0 and run.end() < len(token)
        if c in LEET:
            letters = [(x * k, 1.5) for x in LEET[c] for k in range(1, min(n, 2) + 1)]
            places.append([*letters, (run[0] if c.isdigit() else " ", 2.5)])
        elif c in HIDDEN and inner:
            places += [[(" ", 0.0), *((chr(x), 3.0) for x in range(97, 123))]] * n
        elif _WORD.fullmatch(c):
            if n == 1:
                places.append([(c, 0.0)])
            else:
                places.append([(c * 2, 0.0 if n == 2 else 0.5), (c, 3.0 if n == 2 else 0.5)])
        else:
            places.append([(" ", 0.0)])
    return places


def _gaps(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of letters set apart: each gap is one between words, or nothing."""
    places = []
    for part in re.finditer(r"[^\W_]|(?:(?![^\W_]).)+", run):
        signs = [(x, 1.5) for x in LEET.get(part[0], "")]
        places.append([(part[0], 0.0), *signs] if len(part[0]) == 1 and part[0].isalnum() else [("", 0.4), (" ", 1.0)])
    return places


class Reader:
    """Words of texts, disguised ones restored; remembers the tokens it has met."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost
        self.known: dict[str, tuple[list[str], bool]] = {}

    def token(self, token: str) -> tuple[list[str], bool]:
        """Words of one lower-case token without white space; whether they were disguised.

        Where letters are at most doubled, and nothing else is odd, the words count as
        they stand as well: most of them are spelt so.
        """
        bare = token.rstrip(".,;:!?")
        if bare.isalpha():
            if not _DOUBLED.search(bare):
                return [bare], False
            token = bare
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            plain, words = _WORD.findall(token), _WORD.findall(self.restored(token))
            core = _EDGE.sub("", token)
            if not (_SIGN.search(core) or _LONG_RUN.search(core) or _DOTTED.fullmatch(core)):
                words += [w for w in plain if w not in words]
            found = self.known[token] = (words, words != plain)
        return found

    def places(self, token: str) -> list[list[tuple[str, float]]] | None:
        """The lattice of a token, or None if it stands for itself."""
        core = _EDGE.sub("", token)
        if _DOTTED.fullmatch(core):
            return _gaps(core)
        letters = sum(map(len, _WORD.findall(core)))
        signs = len(_SIGN.findall(core))
        # With very few letters it is a number or a rule, not a word in disguise.
        if signs > 3 * letters or not letters or not (signs or _DOUBLED.search(core)):
            return None
        return _lattice(core)

    def restored(self, token: str) -> str:
        places = self.places(token)
        return token if places is None else charlm.read(places, self.cost)

    def apart(self, run: str) -> str:
        return charlm.read(_gaps(run), self.cost)

    def set_apart(
        self, text: str, tokens: set[str], wanted: Callable[[str], bool] | None = None
    ) -> Iterator[tuple[str, list[str]]]:
        """Runs of single letters in a lower-case text, and the words they are read as; only
        the ``wanted`` ones, if that is given. Runs that are one of its tokens are read there."""
        for run in _APART.finditer(text) if _SECOND.search(text) else ():
            if run[0] not in tokens and (wanted is None or wanted(run[0])):
                yield run[0], _WORD.findall(self.apart(run[0]))

    def words(self, text: str) -> Iterator[str]:
        """Words of a text as restored; each different token counts once."""
        text = text.lower()
        tokens = set(text.split())
        for token in tokens:
            yield from self.token(token)[0]
        for _, words in self.set_apart(text, tokens):
            yield from words


def features(words: Iterable[str]) -> set[str]:
    """Words, and their beginnings marked by a star."""
    found = set()
    for word in words:
        found.add(word)
        found.update(word[:k] + "*" for k in PREFIXES if len(word) > k)
    return found


def _evidence(cost: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a task have each feature."""
    reader, toxic, clean = Reader(cost), Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = features(reader.words(text))
            (toxic if label else clean).update(own)
    names = list(toxic | clean)
    for low in range(0, len(names), 50_000):
        part = names[low : low + 50_000]
        counts = [pa.array([c[x] for x in part], pa.int64()) for c in (toxic, clean)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], ["feature", "toxic", "clean"])


class Scorer:
    """Places of the learned features that a text has.

    A word has none unless it begins like one of them. So what need not be told of is
    decoded only if one of its readings, likely or not, has a word with such a beginning.
    """

    def __init__(self, cost: np.ndarray, place: dict[str, int]) -> None:
        self.reader, self.place = Reader(cost), place
        self.roots = {x.rstrip("*")[: PREFIXES[0]] for x in place}
        self.stems = {root[:k] for root in self.roots for k in range(len(root))}
        # Tokens met before: their features, and those without any.
        self.known: dict[str, tuple[int, ...]] = {}
        self.empty: set[str] = set()

    def reaches(self, places: list[list[tuple[str, float]]]) -> bool:
        """Has any reading of a lattice a word that begins like a learned feature?"""
        # Letters of the word so far; None in a word that began otherwise.
        states: set[str | None] = {""}
        for place in places:
            after: set[str | None] = set()
            for reading, _ in place:
                for now in states:
                    for c in reading:
                        if not (c.isalnum() and not c.isdecimal()):
                            now = ""
                        elif now is not None:
                            now += c
                            if now in self.roots:
                                return True
                            now = now if now in self.stems else None
                    after.add(now)
            states = after
        return False

    def may_count(self, token: str) -> bool:
        """Can a token have a learned feature, as it stands or in some reading?"""
        bare = token.rstrip(".,;:!?")
        if bare.isalpha():
            if bare[: PREFIXES[0]] in self.roots:
                return True
            heads = {""}
            for run in islice(_RUN.finditer(bare), PREFIXES[0]):
                c = run[0][0]
                heads = {h + x for h in heads for x in ((c,) if len(run[0]) == 1 else (c, c + c))}
            return any(h[: PREFIXES[0]] in self.roots for h in heads)
        if any(w[: PREFIXES[0]] in self.roots for w in _WORD.findall(token)):
            return True
        places = self.reader.places(token)
        return places is not None and self.reaches(places)

    def token(self, token: str, restored: list[tuple[str, str]] | None) -> tuple[int, ...]:
        if restored is None and not self.may_count(token):
            self.empty.add(token)
            return ()
        words, disguised = self.reader.token(token)
        found = tuple(k for w in words for k in self.word(w))
        if disguised and restored is not None:
            # Looked at each time, to be told of.
            restored.append((token, " ".join(words)))
        elif found:
            self.known[token] = found
        else:
            self.empty.add(token)
        return found

    def word(self, word: str) -> list[int]:
        if word[: PREFIXES[0]] not in self.roots:
            return []
        return [self.place[x] for x in features([word]) if x in self.place]

    def of(self, text: str, restored: list[tuple[str, str]] | None = None) -> list[int]:
        """The features of a text; what was disguised goes to ``restored``, if that is given."""
        if len(self.empty) >= REMEMBERED:
            self.empty.clear()
            self.known.clear()
        found: set[int] = set()
        known, empty, roots, text = self.known, self.empty, self.roots, text.lower()
        tokens = set(text.split())
        for token in tokens - empty:
            own = known.get(token)
            if own is None:
                bare = token.rstrip(".,;:!?")
                head = bare[: PREFIXES[0]]
                # Most words are told from their first letters: a doubled one changes these
                # only if it is the first or second.
                if restored is None and head not in roots and bare.isalpha():
                    if head[:1] != head[1:2] != head[2:]:
                        empty.add(token)
                        continue
                own = self.token(token, restored)
            if own:
                found.update(own)
        wanted = None if restored is not None else lambda run: self.reaches(_gaps(run))
        for run, words in self.reader.set_apart(text, tokens, wanted):
            if restored is not None:
                restored.append((run, " ".join(words)))
            found.update(k for w in words for k in self.word(w))
        return sorted(found)


def _placed(cost: np.ndarray, place: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(cost, place)
    for batch in batches:
        own = pa.array([scorer.of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), own], ["toxic", "own"])


def _regression(
    rows: list[np.ndarray], target: np.ndarray, n: int, rounds: int = 800
) -> tuple[np.ndarray, float]:
    """Logistic regression on shares, with a penalty on the weights, by Adam on all rows."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w, b = np.zeros(n), float(np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        share = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[col], minlength=len(rows)), -30, 30)))
        miss = (share - target) / len(target)
        grad = np.append(np.bincount(col, weights=miss[row], minlength=n) + 2e-5 * w, miss.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:n], b - move[n]
    return w, float(b)


def _alone(top: list, place: dict[str, int], share: float) -> tuple[list[np.ndarray], np.ndarray]:
    """A row for each learned feature as if a text had nothing else, with its share of
    toxic documents, drawn towards the share of all; words that mostly come together
    then weigh on their own as well."""
    rows, target = [], []
    for r in top:
        word = r["feature"].rstrip("*")
        own = {r["feature"], *(word[:k] + "*" for k in PREFIXES if len(word) > k)}
        rows.append(np.array(sorted(place[x] for x in own if x in place)))
        target.append((r["t"] + DRAWN * share) / (r["t"] + r["c"] + DRAWN))
    return rows, np.array(target, float)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    sample: int = SAMPLE,
    size: int = FEATURES,
) -> dict:
    """Character costs from all ``docs``, weights from a sample of the labelled ones.

    A document with several labels is toxic if one of them says so. Rows held out
    by ``held_out``, and labels that are null, teach nothing. Where there is nothing
    to learn from, every text gets the share of toxic labels, or 0.
    """
    docs = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    cost = charlm.costs(charlm.count(docs))
    told = labels.filter(F.col(toxic).isNotNull() & F.col(id).isNotNull() & ~held_out(id))
    told = told.groupBy(F.col(id).alias("id")).agg(F.max(F.col(toxic)).cast("int").alias("toxic"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(sample)
    drawn = written(docs.join(F.broadcast(told), "id").select("text", "toxic"), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(cost)
    seen = drawn.mapInArrow(lambda b: _evidence(shared.value, b), "feature string, toxic long, clean long")
    seen = written(seen.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")), "evidence")
    n = drawn.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    # How much more likely the counts are with shares of their own (G statistic).
    expected = lambda of: (F.col("t") + F.col("c")) * F.lit(of / max(1, n["n"]))
    part = lambda x, of: x * F.log((x + 1e-9) / (expected(of) + 1e-9))
    gain = part(F.col("t"), n["t"]) + part(F.col("c"), n["n"] - n["t"])
    # A gain that one of so many features is likely to have by chance tells nothing.
    told = seen.withColumn("gain", gain).filter(F.col("gain") > float(np.log(max(1, seen.count()))))
    top = told.orderBy(F.desc("gain"), "feature").limit(size).collect()
    place = {r["feature"]: k for k, r in enumerate(top)}
    own = docs.sparkSession.sparkContext.broadcast(place)
    placed = drawn.mapInArrow(lambda b: _placed(shared.value, own.value, b), "toxic int, own array<int>").toPandas()
    alone, target = _alone(top, place, n["t"] / max(1, n["n"]))
    rows, target = [*placed["own"], *alone], np.concatenate([placed["toxic"].to_numpy(float), target])
    w, b = _regression(rows, target, len(place)) if n["t"] else (np.zeros(len(place)), -np.inf)
    return {"cost": cost, "place": place, "weights": w, "bias": b}


def _scored(model: dict, tell: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model["cost"], model["place"])
    for batch in batches:
        column = batch.column("text")
        for low, high in chunks(buffers(column)[1]):
            sums, read, counts = np.zeros(high - low), [], []
            for k, text in enumerate(column[low:high].to_pylist()):
                restored: list[tuple[str, str]] | None = [] if tell else None
                sums[k] = model["bias"] + model["weights"][scorer.of(text, restored)].sum()
                read += [f"{a} > {b}" for a, b in sorted(restored or [])]
                counts.append(len(restored or []))
            made = {"id": batch.column("id")[low:high], "score": pa.array(1 / (1 + np.exp(-np.clip(sums, -700, 700))))}
            if tell:
                made["restored"] = lists(pa.array(read, pa.string()), np.array(counts), pa.string())
            yield pa.RecordBatch.from_pydict(made)


def score(rows: DataFrame, model: dict, id: str = "doc_id", text: str = "text", tell: bool = True) -> DataFrame:
    """Per row: ``id``, ``score`` (0 to 1), ``predicted`` (1 from ``THRESHOLD`` on) and
    ``restored``, the disguised words with what they were read as.

    Without ``tell`` there is no ``restored``, and words that cannot count are not decoded;
    scores are the same. A null or empty text has the score of a text without any learned
    word. Every row gives one row, copies too; columns besides id and text take no part.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, score double"
    found = rows.mapInArrow(lambda b: _scored(shared.value, tell, b), kind + ", restored array<string>" * tell)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select(F.col("id").alias(id), "score", predicted, *["restored"] * tell)


def clean(rows: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text).cast(pa.string()), "")
            own = pa.RecordBatch.from_arrays([texts, texts], ["id", "text"])
            scores = [np.asarray(x.column("score")) for x in _scored(shared.value, False, iter([own]))]
            yield batch.filter(pa.array(np.concatenate([*scores, np.zeros(0)]) < THRESHOLD))

    return rows.mapInArrow(run, rows.schema)
