"""Periodic runs of words: every lag is scanned, true stretches are runs.

A run is a maximal stretch of words that repeats with a smallest period ``q``
at least ``min_exponent`` times.  At lag ``q`` a run of that exponent is a
stretch of ``(min_exponent - 1) * q`` places or more at which the array of word
ids equals itself shifted by ``q``.  Such a stretch holds ``min_exponent - 1``
multiples of ``q`` in a row, so comparing the array with its shift at the
multiples of ``q`` first (one strided comparison a lag, n / q places) loses no
run; only where that many in a row are equal is the shift compared at every
place, and the true stretch measured.  All lags up to n / min_exponent are scanned.

The texts of a batch are one array whose ids differ from text to text, so a lag
is one comparison for all of them, longest first.  A document of more than
``LAGS`` lags is cut into document-lag ranges that Spark deals out over machines
and whose runs meet again by document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of, written

#: Lags of one range; a document has at most ``RANGES`` of them, so long ones have wider ranges.
LAGS, RANGES = 4096, 64
WORDS = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORDS)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def _stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The places around ``at`` where the array equals its shift, end exclusive."""
    end, step = at, 64
    while (stop := min(end + step, len(ids) - lag)) > end:
        differ = ids[end:stop] != ids[end + lag : stop + lag]
        first = int(differ.argmax())
        if differ[first]:
            end += first
            break
        end, step = stop, step * 4
    start, step = at, 64
    while (stop := max(start - step, 0)) < start:
        differ = (ids[stop:start] != ids[stop + lag : start + lag])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            start -= first
            break
        start, step = stop, step * 4
    return start, end


def _smallest(ids: np.ndarray, start: int, end: int, period: int) -> int:
    """The smallest period of a stretch that has ``period`` and at least two of it: a divisor."""
    rest, factor = period, 2
    while rest > 1:
        factor = factor if factor * factor <= rest else rest
        if rest % factor:
            factor += 1
            continue
        rest //= factor
        shorter = period // factor
        if np.array_equal(ids[start : end - shorter], ids[start + shorter : end]):
            period = shorter
    return period


def find(ids: np.ndarray, sizes: np.ndarray, first: int = 1, last: int | None = None, min_exponent: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs whose period is in [first, last].

    ``ids`` holds the texts one after another, longest first, of ``sizes``
    words each; no id stands in two of them.
    """
    out: list[tuple[int, int, int]] = []
    if not len(ids):
        return out
    ends, last = np.cumsum(sizes), min(int(sizes[0]) // min_exponent, last or len(ids))
    known: list[tuple[int, int, int]] = []  # runs of any period, each word's newest in ``inside``
    met: dict[tuple[int, int], int] = {}
    inside = np.full(len(ids), -1, np.int32)
    for lag in range(first, last + 1):
        texts = int(np.searchsorted(-sizes, -max(min_length, min_exponent * lag), "right"))
        if not texts:
            break
        sample = ids[: ends[texts - 1] : lag]
        equal = sample[1:] == sample[:-1]
        hits = equal[: max(len(equal) - min_exponent + 2, 0)].copy()
        for n in range(1, min_exponent - 1):
            hits &= equal[n : len(hits) + n]
        if not hits.any():
            continue
        at = np.flatnonzero(hits) * lag
        n = 0
        while n < len(at):
            place = int(at[n])
            held = inside[place + lag]
            if held >= 0:  # a run of a shorter period goes through here: its multiples end where it ends
                start, end, period = known[held]
                if lag % period == 0 and start <= place and place + (min_exponent - 1) * lag < end:
                    n = int(np.searchsorted(at, end - lag))
                    continue
            start, end = _stretch(ids, place, lag)
            n = max(int(np.searchsorted(at, end)), n + 1)
            end += lag
            if end - start < max(min_length, min_exponent * lag) or (start, end) in met:
                continue
            period = lag if first == 1 else _smallest(ids, start, end, lag)
            met[start, end] = period
            inside[start:end] = len(known)
            known.append((start, end, period))
            if period == lag:
                out.append((start, end - start, lag))
    return out


def _batch(texts: list[str], ranges: list[tuple[int, int | None]], min_exponent: int, min_length: int) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Words and runs of each text.  Texts of one range of lags are scanned together."""
    words = [_WORDS.findall(t) for t in texts]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for bounds in set(ranges):
        chosen = sorted((n for n, r in enumerate(ranges) if r == bounds), key=lambda n: -len(words[n]))
        number, parts = count(), []
        for n in chosen:
            known: dict[str, int] = defaultdict(number.__next__)
            parts.append(np.fromiter(map(known.__getitem__, words[n]), np.int32, len(words[n])))
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for start, length, period in find(np.concatenate(parts), sizes, *bounds, min_exponent, min_length):
            k = int(np.searchsorted(starts, start, "right")) - 1
            runs[chosen[k]].append((start - int(starts[k]), length, period))
    return [(w, sorted(r, key=lambda x: (x[0], x[2]))) for w, r in zip(words, runs, strict=True)]


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(compress(words, keep.tolist()))


def _told(batch: pa.RecordBatch, found: list[tuple[list[str], list[tuple[int, int, int]]]]) -> pa.RecordBatch:
    runs = pa.array([[{"start": a, "length": b, "period": c} for a, b, c in r] for _, r in found], _RUNS)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w, _ in found], pa.int64()), runs, pa.array([_collapsed(w, r) for w, r in found], pa.string())], ["id", "n_words", "runs", "collapsed"])


def _in_ranges(long: DataFrame, kind: str, min_exponent: int, min_length: int, lags: int) -> DataFrame:
    """Documents of many lags: ranges of lags are dealt out, and their runs come together by document."""
    keyed = long.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "text"), 256))
    last = F.floor(F.regexp_count("text", F.lit(WORDS)) / min_exponent).cast("long")
    wide = keyed.select("key", "text", last.alias("last")).withColumn("width", F.greatest(F.lit(lags), F.ceil(F.col("last") / RANGES)).cast("long"))
    ranges = wide.select("key", "text", "width", "last", F.explode(F.sequence(F.lit(1).cast("long"), "last", "width")).alias("first"))
    dealt = ranges.select("key", "text", "first", F.least(F.col("first") + F.col("width") - 1, "last").alias("last")).repartition("key", "first")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for n, (first, last) in enumerate(bounds):  # a text at a time: it is long
                [(_, runs)] = _batch([batch.column(1)[n].as_py()], [(first, last)], min_exponent, min_length)
                key = pa.array([batch.column(0)[n].as_py()] * len(runs), pa.string())
                yield pa.RecordBatch.from_arrays([key, *(pa.array([r[k] for r in runs], pa.int64()) for k in range(3))], ["key", "start", "length", "period"])

    found = dealt.mapInArrow(scan, "key string, start long, length long, period long").distinct()
    runs = found.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # of one document

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [sorted(((r["start"], r["length"], r["period"]) for r in row or []), key=lambda x: (x[0], x[2])) for row in batch.column(2).to_pylist()]
            yield _told(batch, [(_WORDS.findall(t), r) for t, r in zip(batch.column(1).to_pylist(), given, strict=True)])

    return keyed.join(runs, "key", "left").select("id", "text", "runs").mapInArrow(tell, f"id {kind}, n_words long, {_RUNS_SQL}, collapsed string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_exponent: int = 4, min_length: int = 6, lags: int = LAGS) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` of every text: its maximal runs by start and period, and the text with each run's first period only.

    Words are what stands between ASCII white space.  Null and empty texts have
    no words, no run and an empty collapsed text; rows with a null id and
    repeated rows are answered each; an empty table gives an empty table; other
    columns are not read.  Runs may overlap; of equal stretches the smallest
    period counts.  One pass without a shuffle; documents of more than ``lags``
    lags go to as many tasks as they have ranges.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("an exponent and a length of at least 2")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _told(batch, _batch(batch.column(1).to_pylist(), [(1, None)] * batch.num_rows, min_exponent, min_length))

    many = (F.length("text") >= 2 * min_exponent * lags) & (F.regexp_count("text", F.lit(WORDS)) > min_exponent * lags)
    long = written(rows.where(many), "long")  # few: texts are read once for them and once for all others
    found = rows.where(~many).mapInArrow(run, f"id {kind}, n_words long, {_RUNS_SQL}, collapsed string")
    if not long.isEmpty():
        found = found.union(_in_ranges(long, kind, min_exponent, min_length, lags))
    return found.withColumnRenamed("id", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The text; in a tenth of the documents, chosen by the CRC-32 of their id, the words from some place on repeat with a period."""
    mark = F.coalesce(F.crc32(doc_id.cast("string")), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, g = F.size(words), F.floor(mark / 10)
    a = (g % n).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    return F.when((mark % 10 == 0) & F.regexp_like(text, F.lit(WORDS)), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text of ``documents``, a tenth of which get repeats from a place on; the longest by exponent, and digests."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), text_of()).alias("text")))
    # greatest length/period, exactly: products of longs, ties by start, then period
    ahead = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(ahead(y, x), y).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.expr("(1000 * best.length) div best.period"))
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
