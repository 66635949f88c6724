"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit, a binary classifier over hashed
letter trigrams says how much a text looks like the languages with a 1 there
rather than a 0: its weights are log odds of trigram counts, which Spark adds up
over all training texts. A text gets the language whose codeword is nearest, each
bit's loss weighted by how well its classifier tells the two sides apart.
Driver and executors hold ``BUCKETS`` numbers for a language or a bit, whatever
the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.common import buffers, chunks, text_or_empty

BUCKETS = 1 << 16
SMOOTHING = 0.5
UNKNOWN = "und"

# Two languages whose scores are nearer than this are told apart with little trust.
CLEAR = 0.2

# Letters of ASCII, lowered, and all bytes of other characters; the rest is a gap.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def held_out(id: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    crc = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")))
    return F.pmod(crc, F.lit(4)) == 2


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its range, the buckets of all trigrams around a letter, their rows."""
    data, starts = buffers(column)
    for low, high in chunks(starts):
        here = _LETTERS[data[starts[low] : starts[high]]]
        edges = starts[low : high + 1] - starts[low]
        filled = np.diff(edges) > 0
        before, after = np.roll(here, 1), np.roll(here, -1)
        before[edges[:-1][filled]] = after[edges[1:][filled] - 1] = 32
        spot = np.flatnonzero(here != 32)
        key = before[spot].astype(np.uint32) | here[spot].astype(np.uint32) << 8 | after[spot].astype(np.uint32) << 16
        ends = np.searchsorted(spot, edges)
        yield low, high, (key * np.uint32(2654435761)) >> np.uint32(16), ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for low, high, buckets, ends in _trigrams(batch.column("text")):
            for lang in set(langs[low:high]):
                own = np.repeat(langs[low:high] == lang, np.diff(ends))
                seen[lang] = seen.get(lang, 0) + np.bincount(buckets[own], minlength=BUCKETS)
    for lang, counts in seen.items():
        spot = np.flatnonzero(counts)
        # A language without a trigram is still one that was seen.
        spot = spot if len(spot) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(spot)), pa.array(spot, pa.int32()), pa.array(counts[spot])],
            ["lang", "bucket", "n"],
        )


def codewords(n: int) -> np.ndarray:
    """Codewords of ``n`` classes as rows of -1 and 1.

    Up to seven classes: every way to part them in two. Beyond that, random
    columns, eight for each doubling of the classes, the best of 50 draws by the
    distance of the two nearest codewords.
    """
    if n <= 7:
        ways = range(1, 1 << max(0, n - 1))
        return np.array([[1 if w >> k & 1 else -1 for w in ways] for k in range(n)], np.float64).reshape(n, len(ways))
    draw = np.random.default_rng(n)
    best, far = None, -1
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], (n, 8 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        nearest = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9).min()
        if nearest > far:
            best, far = code, nearest
    return best


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Classifiers of all bits from every row with a language; plain arrays."""
    rows = rows.select(text_or_empty(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.filter(F.col("lang").isNotNull()).mapInArrow(_counted, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    table[counts["lang"].map({x: k for k, x in enumerate(langs)}).astype(int), counts["bucket"]] = counts["n"]
    # Each language counts alike, however many texts it has.
    share = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    code = codewords(len(langs))
    weights, trust = [], []
    for bit in code.T:
        one, zero = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
        odds = np.log(one / zero)
        loss = (one * np.log1p(np.exp(-odds)) + zero * np.log1p(np.exp(odds))).sum() / 2
        weights.append(odds)
        trust.append(max(0.0, 1 - loss / np.log(2)) + 1e-9)
    w = np.array(weights, np.float32).reshape(len(weights), BUCKETS).T.copy()
    return {"langs": langs, "code": code, "weights": w, "trust": np.array(trust)}


def _scores(model: dict, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Share of each language, from the sums of the bits' weights of each text."""
    margin = sums / np.sqrt(np.maximum(counts, 1))[:, None]
    loss = np.zeros((len(sums), len(model["langs"])))
    for bit in range(margin.shape[1]):
        own = np.logaddexp(0, -margin[:, bit : bit + 1] * model["code"][None, :, bit])
        loss += model["trust"][bit] * own
    loss /= max(1e-9, model["trust"].sum() / max(1, len(model["trust"])))
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return share / share.sum(axis=1, keepdims=True)


def _predicted(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs = model["langs"]
    for batch in batches:
        letters = np.asarray(batch.column("letters")).astype(bool) & bool(langs)
        pred = np.full(batch.num_rows, UNKNOWN, object)
        score, second = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for low, high, buckets, ends in _trigrams(batch.column("text")):
            if not langs:
                break
            sums = np.zeros((high - low, model["weights"].shape[1]))
            filled = np.flatnonzero(np.diff(ends) > 0)
            if len(filled):
                sums[filled] = np.add.reduceat(model["weights"][buckets], ends[:-1][filled], axis=0, dtype=np.float64)
            share = _scores(model, sums, np.diff(ends))
            order = np.argsort(-share, axis=1, kind="stable")
            each = np.arange(high - low)
            pred[low:high] = np.array(langs, object)[order[:, 0]]
            score[low:high] = share[each, order[:, 0]]
            if len(langs) > 1:
                second[low:high] = share[each, order[:, 1]]
        pred[~letters], score[~letters], second[~letters] = UNKNOWN, 0, 0
        keys = [c for c in batch.schema.names if c not in ("text", "letters")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keys), pa.array(pred, pa.string()), pa.array(score), pa.array(score - second < CLEAR)],
            [*keys, "lang_pred", "score", "ambiguous"],
        )


def identify(rows: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    A null text, one without letters, and any text under a model that has learned
    no language, is ``und`` with score 0 and ambiguous. Every row gives one row,
    copies too; equal scores go to the first language by name. Columns besides id
    and text take no part.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = rows.select(F.col(id).alias("id"), text_or_empty(text).alias("text")).select("*", letters)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(
        lambda b: _predicted(shared.value, b), f"id {kind}, lang_pred string, score double, ambiguous boolean"
    )
    return found.withColumnRenamed("id", id)
