"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares two words by the subsequences of three and four letters that
they share, with up to two letters between (each step costs a factor DECAY), the
borders of a word counting as letters.  So ``st-upid``, ``stXupid`` and ``s t u p i d`` stay
near ``stupid``.  Nystroem landmarks give the machine its features.  Since the
kernel is a sum over subsequences, the trained machine folds into one table of
weights by subsequence, and a text is scored in one vectorised pass.

Only texts are labelled, not their sentences: all sentences of clean texts are
labelled clean, and of a toxic text the WITNESSES sentences that speak most for
toxicity are labelled toxic.  At first the beginnings of words that toxic texts
have more often choose them, and once the machine is trained it chooses anew.
The kernel compares sentences by their closest words, so an instance is the word
that speaks most in its sentence; all words of clean sentences are instances of
the other class.  A text's score is a logistic function of its highest words and
of its length.

Defined results: a null text is the empty text; a text without words has the
score of no evidence; without labels of both kinds all scores are 0; repeated
rows are scored each; null labels and ids are not learnt from; a document that
carries both labels counts as toxic, and of several texts of one labelled id the
smallest is learnt from; other columns are never inputs; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from sys import intern
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of

#: The model is fitted on this many labelled texts of either kind at most, those of smallest hash.
TRAINING_TEXTS = 1000
LANDMARKS = 160
DECAY = 0.7
#: Rounds of choosing instances and training, and the most telling sentences that a toxic text gives in each.
STEPS, WITNESSES = 3, 3
#: A word is an instance of toxicity only if clean texts have it this much more rarely than toxic ones.
RARER = 0.02
RIDGE = 20.0
PREDICTED = 0.7
_BITS = 6
_BORDER, _DROP = 0, 63
#: offsets of a subsequence's letters from its first
_STEPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
#: numbers of subsequences: those of three letters as they are, those of four by a hash
_THREE, _FOUR = 1 << 3 * _BITS, 1 << 20
_SIZE = _THREE + _FOUR
#: highest words that the final function sees
_HIGHEST = 4
_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßğ"
_NONE = -2.0


def _alphabet() -> np.ndarray:
    """Letter class of each code point of the basic plane."""
    out = np.full(0x10000, _DROP, np.uint8)
    for point in range(0x10000):
        c = chr(point)
        if c.isspace():
            out[point] = _BORDER
        elif c.isalpha():
            low = c.lower()[:1]
            if "a" <= low <= "z":
                out[point] = ord(low) - 96
            elif low in _ACCENTED:
                out[point] = 27 + _ACCENTED.index(low)
            else:
                out[point] = 59 + ord(low) % 4
    return out


_classes: list[np.ndarray] = []


def letters(text: str, join: bool = True) -> np.ndarray:
    """Classes of the letters of a text, words between single borders."""
    if not _classes:
        _classes.append(_alphabet())
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = _classes[0][np.minimum(points, 0xFFFF)]
    c = np.concatenate([[_BORDER], c[c != _DROP], [_BORDER]]).astype(np.uint8)
    c = c[np.concatenate([[True], (c[1:] != _BORDER) | (c[:-1] != _BORDER)])]
    if join and len(c) > 4:  # letters that stand alone side by side are one word
        border = c == _BORDER
        alone = np.zeros(len(c), bool)
        alone[1:-1] = border[:-2] & ~border[1:-1] & border[2:]
        joined = np.zeros(len(c), bool)
        joined[1:-1] = border[1:-1] & alone[:-2] & alone[2:]
        c = c[~joined]
    return c


def occurrences(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each kind of step: subsequence numbers, the positions of their second letter, and the span."""
    n = len(c)
    borders = np.cumsum(c == _BORDER)
    wide = c.astype(np.int64)
    for steps in _STEPS:
        last = steps[-1]
        if n <= last:
            continue
        first = np.flatnonzero(borders[last - 1 : n - 1] == borders[: n - last])  # no border inside
        code = wide[first]
        for step in steps:
            code = (code << _BITS) | wide[first + step]
        if len(steps) == 3:
            code = _THREE + ((code * 0x9E3779B1 >> 16) & (_FOUR - 1))
        yield code, first + steps[0], last


def word_scores(c: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for every word of ``letters``."""
    border = np.flatnonzero(c == _BORDER)
    size = np.diff(border) - 1
    if not len(size):
        return np.empty(0)
    word = np.cumsum(c == _BORDER) - 1
    total = np.zeros(len(size) + 1)
    for code, place, span in occurrences(c):
        total += np.bincount(word[place], weights[code], len(size) + 1) * DECAY**span
    return total[:-1] / _norm(size) + bias


def _norm(size: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector, with repeated subsequences taken as different."""
    n = np.maximum(size, 1)
    times = {last: np.maximum(n + 2 - last, 0) for last in (2, 3, 4)}
    return np.sqrt(sum(times[steps[-1]] * DECAY ** (2 * steps[-1]) for steps in _STEPS))


def _counts(words: list[str], number: np.ndarray, width: int) -> np.ndarray:
    """Feature rows of words over the subsequences that ``number`` maps to 0 .. width - 1."""
    c = letters(" ".join(words), join=False)
    border = np.flatnonzero(c == _BORDER)
    word = np.cumsum(c == _BORDER) - 1
    cells, values = [], []
    for code, place, span in occurrences(c):
        k = number[code]
        has = k >= 0
        cells.append(word[place][has] * width + k[has])
        values.append(np.full(len(cells[-1]), DECAY**span))
    out = np.bincount(np.concatenate(cells), np.concatenate(values), len(words) * width)
    return out.reshape(len(words), width) / _norm(np.diff(border) - 1)[:, None]


def _mapped(words: list[str], number: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Feature rows of words times ``table``, without the rows themselves; float32."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    table = table.astype(np.float32)
    for at in range(0, len(words), 2000):
        c = letters(" ".join(words[at : at + 2000]), join=False)
        border = np.flatnonzero(c == _BORDER)
        word = np.cumsum(c == _BORDER) - 1
        part = out[at : at + 2000]
        for code, place, span in occurrences(c):
            k = number[code]
            has = np.flatnonzero(k >= 0)
            if len(has):
                owner = word[place[has]]  # in order
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                part[owner[first]] += np.add.reduceat(table[k[has]], first, axis=0) * np.float32(DECAY**span)
        part /= _norm(np.diff(border) - 1)[:, None].astype(np.float32)
    return out


_LETTERS = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Words as the scorer sees them: letters only, those that stand alone joined."""
    out, run = [], ""
    for piece in [*text.lower().split(), ""]:
        word = "".join(_LETTERS.findall(piece))
        if len(word) == 1:
            run += word
            continue
        if run:
            out.append(run)
            run = ""
        if word:
            out.append(intern(word))
    return out


def sentences(text: str) -> list[str]:
    """Sentences of a text; marks inside a word don't end one."""
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a linear machine under the squared hinge loss, by Newton steps on the active rows."""
    width = x.shape[1] + 1
    w = np.zeros(width)
    keep = np.eye(width) * ridge
    keep[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(30):
        left, right = keep.copy(), np.zeros(width)
        for at in range(0, len(x), 4096):  # in blocks, so that x is held once
            on = active[at : at + 4096]
            rows = np.hstack([x[at : at + 4096][on].astype(float), np.ones((int(on.sum()), 1))])
            weighted = rows * weight[at : at + 4096][on, None]
            left += weighted.T @ rows
            right += weighted.T @ y[at : at + 4096][on]
        w = np.linalg.solve(left, right)
        after = y * (x @ w[:-1].astype(np.float32) + w[-1]) < 1
        if np.array_equal(after, active) or not after.any():
            break
        active = after
    return w


_SLOTS = 1 << 21


@lru_cache(1 << 14)
def _heads(word: str) -> tuple[int, ...]:
    """Slots of the word and of its beginnings of four letters and more, in counters of a fixed size."""
    found = [word + "$", *(word[:k] for k in range(4, min(len(word), 8) + 1))]
    return tuple(crc32(x.encode()) & (_SLOTS - 1) for x in found)


def _head_counts(texts: list[set[str]]) -> np.ndarray:
    """In how many texts each slot is met."""
    out = np.zeros(_SLOTS, np.int32)
    for words in texts:
        out[np.unique(np.fromiter((k for w in words for k in _heads(w)), np.int64))] += 1
    return out


def fit(texts: list[str], toxic: list[int]) -> dict | None:
    """Weights by subsequence and the final logistic function; None without both labels."""
    if len(set(toxic)) < 2:
        return None
    marked = [t for t, y in zip(texts, toxic, strict=True) if y]
    bags = [[w for w in map(set, map(_words, sentences(t))) if w] for t in marked]
    spoken = [set(_words(t)) for t, y in zip(texts, toxic, strict=True) if not y]
    # at first, a sentence speaks for toxicity by beginnings of words that toxic texts have far more often
    in_marked = Counter(w for bag in bags for w in set().union(*bag))
    in_clean = Counter(w for words in spoken for w in words)
    far, near = _head_counts([set().union(*bag) for bag in bags]), _head_counts(spoken)
    ratio = (len(spoken) + 1) / (len(bags) + 1)
    value = {w: math.log(max((far[g] + 1.0) / (near[g] + 1.0) for g in _heads(w)) * ratio) for w in in_marked}
    del far, near, spoken
    negative = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    weights, bias = None, 0.0
    for _ in range(STEPS):
        seeds: Counter = Counter()
        for bag in bags:  # each text's best sentences give their best word
            best = sorted((max((value[w], w) for w in s) for s in bag), reverse=True)[:WITNESSES]
            seeds.update(w for k, (v, w) in enumerate(best) if k == 0 or v > 0)
        positive = [w for w, n in sorted(seeds.items(), key=lambda x: (-x[1], x[0])) if in_clean[w] <= RARER * in_marked[w]] or [w for w, _ in seeds.most_common(1)]
        if not positive:
            return None
        rows = [*positive, *negative]
        marks = list(dict.fromkeys([*positive[: LANDMARKS * 2 // 3], *negative[:: max(1, len(negative) // (LANDMARKS // 3))][: LANDMARKS // 3]]))
        codes = np.unique(np.concatenate([code for code, _, _ in occurrences(letters(" ".join(marks), join=False))]))
        number = np.full(_SIZE, -1, np.int64)
        number[codes] = np.arange(len(codes))
        landmarks = _counts(marks, number, len(codes))
        values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # Nystroem map
        x = _mapped(rows, number, landmarks.T @ root)
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        share = np.array([np.sqrt(seeds[w]) for w in positive])
        weight = np.concatenate([share / share.sum(), np.full(len(negative), 1 / len(negative))]) * len(rows) / 2
        w = _machine(x, y, weight)
        weights, bias = np.zeros(_SIZE), float(w[-1])
        weights[codes] = landmarks.T @ (root @ w[:-1])
        every = list(in_marked)
        for k in range(0, len(every), 20_000):
            part = every[k : k + 20_000]
            value.update(zip(part, word_scores(letters(" ".join(part), join=False), weights, bias).tolist(), strict=True))
    x = np.array([_evidence(t, weights, bias) for t in texts])
    y = np.array(toxic, float)
    w, balance = np.zeros(x.shape[1]), np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(50):  # ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (p - y)) + 0.5 * w
        turn = (x * (balance * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        move = np.linalg.solve(turn, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return {"weights": weights.astype(np.float32), "bias": bias, "last": w}


def _evidence(text: str, weights: np.ndarray, bias: float) -> np.ndarray:
    """The highest words, from -2 to 2, in falling order; the logarithm of the number of words; one."""
    values = np.clip(word_scores(letters(text), weights, bias), -2, 2)
    out = np.full(_HIGHEST + 2, _NONE)
    high = np.sort(np.partition(values, -_HIGHEST)[-_HIGHEST:] if len(values) > _HIGHEST else values)[::-1]
    out[: len(high)] = high
    out[-2:] = math.log1p(len(values)) / 5, 1
    return out


def score_text(text: str, model: dict | None) -> float:
    """Toxicity of one text, 0 to 1."""
    if model is None:
        return 0.0
    value = _evidence(text, model["weights"], model["bias"]) @ model["last"]
    return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def _fold(column: str):
    return F.crc32(F.col(column).cast("string")) % 3


def train(documents: DataFrame, labels: DataFrame, most: int = TRAINING_TEXTS) -> dict | None:
    """Fit on labelled documents outside the held-out third, ``most`` of either label at most."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(_fold("doc_id") != 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(most))
    # 2 * most rows of two numbers: a fixed bound
    rows = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return fit([r.text for r in rows], [int(r.toxic) for r in rows])


def score(documents: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every document by its whole text."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)  # one table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [score_text(t, sent.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["id", "score"])

    return documents.select(documents[id_col].alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def clean(documents: DataFrame, model: dict | None, text_col: str = "text", limit: float = PREDICTED) -> DataFrame:
    """The documents with a score below ``limit``, all columns, in one pass."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([score_text(t or "", sent.value) < limit for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``; a third of the documents is held out."""
    documents = table(spark, sf_dir, "documents")
    out = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (_fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
