"""Fingerprints of documents by locally consistent parsing.

A text is parsed, level by level, into phrases whose ends depend on a few
neighbouring symbols alone, so equal substrings are parsed alike but for their
rims, wherever they stand.  A level works thus: a run of one symbol becomes one
symbol; deterministic coin tossing gives every symbol the place and the value
of the lowest bit in which it differs from the symbol before it, again and
again, until the labels are small and neighbours still differ; a phrase begins
at each label that is below both of its neighbours.  A phrase's name is a hash
of its symbols' names, and the names are the symbols of the next level, up to
one name for the whole text.

The fingerprint is that name and, for three levels, the smallest hashes of
their distinct names (a bottom-k sketch), of which likeness is read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .common import small_batches, table, text_of

#: Levels of which a sketch is kept, and the names it holds.  A name of level 1, 2 and 3 stands for some 3, 10 and 30 bytes.
SKETCHES = {3: 64, 2: 48, 1: 32}
#: A level is compared if both texts have so many names in it.
LEAST_NAMES = {3: 24, 2: 8, 1: 0}
#: Bytes of text that are parsed together.
TOGETHER = 1 << 19
#: Rows of smallest hash from which the ranges of ids are taken, for each range.
SAMPLE_A_RANGE = 20

_ROUNDS = 3  # 64 bits, then below 128, 14, 8
_ONE = np.uint64(1)
Sketch = dict[int, tuple[int, np.ndarray]]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS = _mixed(np.arange(1001, 1129, dtype=np.uint64)) | _ONE


def _tossed(labels: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Place and value of the lowest bit that tells each label from the one before; the first of a text is told from its complement."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[firsts] = ~labels[firsts]
    differ = labels ^ before
    place = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
    return (place << np.uint8(1)) | ((labels >> place.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)


def _phrases(symbols: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and owners of the phrases of one level; ``owner`` tells the texts apart.  Symbols are bytes, or names."""
    change = np.empty(len(symbols), bool)
    change[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=change[1:])
    change[1:] |= owner[1:] != owner[:-1]
    length = None
    if not change.all():  # a run of one symbol is one symbol, named by its length
        at = np.flatnonzero(change)
        length = np.diff(at, append=len(symbols))
        symbols, owner = symbols[at], owner[at]
    firsts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    labels = symbols
    for _ in range(_ROUNDS):
        labels = _tossed(labels, firsts)
    start = np.zeros(len(symbols), bool)
    start[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    start[firsts[1:] - 1] = False  # the last symbol of a text does not begin a phrase, the first one does
    start[firsts] = True
    names = _BYTES[symbols] if symbols.dtype == np.uint8 else symbols.copy()
    if length is not None:
        many = np.flatnonzero(length > 1)
        names[many] = _mixed(names[many] + length[many].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero(start)
    place = np.arange(len(names), dtype=np.int32) - np.repeat(at.astype(np.int32), np.diff(at, append=len(names)))
    names *= _POWERS[place & 127]
    return _mixed(np.add.reduceat(names, at) + np.uint64(level)), owner[at]


def _sketched(names: np.ndarray, owner: np.ndarray, texts: int, most: int) -> list[tuple[int, np.ndarray]]:
    """For each text the number of distinct names and their smallest hashes."""
    keys = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (_mixed(names ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)))
    ends = np.searchsorted(keys >> np.uint64(32), np.arange(texts + 1, dtype=np.uint64)).tolist()
    low = keys.astype(np.uint32)
    return [(b - a, low[a : min(b, a + most)]) for a, b in zip(ends, ends[1:], strict=False)]


def _parsed(texts: Sequence[bytes]) -> list[tuple[int, Sketch]]:
    """Name of the whole text, and sketches by level."""
    root = np.zeros(len(texts), np.uint64)
    sketches: list[Sketch] = [{level: (0, np.empty(0, np.uint32)) for level in SKETCHES} for _ in texts]
    names = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    level = 0
    while len(names):
        level += 1
        names, owner = _phrases(names, owner, level)
        if level in SKETCHES:
            for own, found in zip(sketches, _sketched(names, owner, len(texts), SKETCHES[level]), strict=True):
                own[level] = found
        alone = np.ones(len(names), bool)
        alone[1:] &= owner[1:] != owner[:-1]
        alone[:-1] &= owner[1:] != owner[:-1]
        if level >= max(SKETCHES):  # what is one phrase is the whole text
            root[owner[alone]] = names[alone]
            names, owner = names[~alone], owner[~alone]
    return list(zip(root.tolist(), sketches, strict=True))


def parse(texts: Sequence[bytes]) -> list[tuple[int, Sketch]]:
    """Fingerprints as numbers; texts are parsed ``TOGETHER`` bytes at a time, a longer one alone."""
    out: list[tuple[int, Sketch]] = []
    first = held = 0
    for n, text in enumerate(texts):
        if held and held + len(text) > TOGETHER:
            out += _parsed(texts[first:n])
            first, held = n, 0
        held += len(text)
    return out + (_parsed(texts[first:]) if first < len(texts) else [])


def told(found: tuple[int, Sketch]) -> str:
    """A fingerprint as text: the whole text's name, then level, number of names and smallest hashes, level by level."""
    root, sketch = found
    return "|".join([f"{root:016x}", *(f"{level}:{n}:{low.astype('>u4').tobytes().hex()}" for level, (n, low) in sketch.items())])


def read(fingerprint: str) -> tuple[int, Sketch]:
    root, *levels = fingerprint.split("|")
    parts = (x.split(":") for x in levels)
    return int(root, 16), {int(level): (int(n), np.frombuffer(bytes.fromhex(low), ">u4").astype(np.uint32)) for level, n, low in parts}


def alike(a: tuple[int, Sketch], b: tuple[int, Sketch]) -> float:
    """The share of distinct names that two texts have in common (twice the common ones by the sum of both), at the
    highest level at which both have enough; 1 for equal texts, 0 if just one is empty."""
    (root_a, one), (root_b, two) = a, b
    level = next(k for k, least in LEAST_NAMES.items() if min(one[k][0], two[k][0]) >= least)
    (n, x), (m, y) = one[level], two[level]
    if root_a == root_b and n == m and np.array_equal(x, y):
        return 1.0
    if len(x) < n:  # of a full sketch only what is below its end is known
        y = y[y <= x[-1]]
    if len(y) and m > SKETCHES[level]:
        x = x[x <= two[level][1][-1]]
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 2 * common / ((len(x) + len(y)) or 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` of every text, in one pass without a shuffle.

    Null texts are empty ones, which all have one fingerprint; rows with a null
    id and repeated rows are answered each; an empty table gives an empty one;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = parse([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(told, found), pa.string())], ["id", "fingerprint"])

    return docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprints, 0 to 1; null for null."""
    return pd.Series([None if x is None or y is None else alike(read(x), read(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def _order(id_: int | None, digest: int) -> tuple[int, int, int]:
    """Place of a row among all: descending ids, null last, equal ids by the digest of their text."""
    return (1, 0, digest) if id_ is None else (0, ~id_, digest)


def _ranges(keys: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """Ends of ``ranges`` ranges of rows of about one size, from a bounded number of rows of smallest hash."""
    sample = keys.orderBy(F.xxhash64("digest", "id"), "digest", "id").limit(SAMPLE_A_RANGE * ranges).collect()
    ordered = sorted(_order(r.id, r.digest) for r in sample)
    return sorted({ordered[len(ordered) * n // ranges] for n in range(1, ranges)}) if ordered else []


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Every row with the fingerprints of its text, of the text after it, and of its text with the end replaced.

    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  Rows stand in descending order of ids, null ids last, rows of
    one id by a digest of their text; the first follows the last.  The edited
    text has its last third of code points replaced by the first as many (or
    all) of the text after it.  A null text is empty; repeated rows follow one
    another and are answered each; one row alone follows itself; an empty table
    gives an empty one; other columns are not read.

    Rows are shuffled once, to ranges of ids; a range also gets the first row of
    the range after it.  The ends of the ranges are read from a sample of
    ``SAMPLE_A_RANGE`` rows a range, and they shape tasks alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    keys = rows.select("id", "digest")
    ends = _ranges(keys, ranges)

    @F.pandas_udf(IntegerType())
    def range_of(missing: pd.Series, ids: pd.Series, digest: pd.Series) -> pd.Series:
        found = zip(missing.tolist(), ids.tolist(), digest.tolist(), strict=True)
        return pd.Series([bisect_right(ends, _order(None if m else i, d)) for m, i, d in found], dtype="int32")

    def placed(some: DataFrame) -> DataFrame:
        return some.withColumn("range", range_of(F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("digest")))

    order = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not(F.coalesce("id", F.lit(0).cast("long"))).alias("down"), "digest")
    firsts = sorted(placed(keys).groupBy("range").agg(F.min(order).alias("first")).collect(), key=lambda r: r["range"])  # a row a range
    heads = [(None if r["first"].none else ~r["first"].down, r["first"].digest, firsts[n - 1]["range"]) for n, r in enumerate(firsts)]
    head = F.broadcast(spark.createDataFrame(heads, "h_id long, h_digest long, before int"))
    met = placed(rows).join(head, rows["id"].eqNullSafe(head["h_id"]) & (rows["digest"] == head["h_digest"]), "left")
    own, copy = F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    dealt = met.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    dealt = dealt.select("to.range", "to.copy", "id", "digest", "text").repartition(ranges, "range")
    dealt = dealt.sortWithinPartitions("range", "copy", F.desc_nulls_last("id"), "digest", "text").select("range", "copy", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the one after it
        for batch in batches:
            texts = batch.column(3).to_pylist()
            parsed = parse([t.encode("utf-8", "surrogatepass") for t in texts])
            seen = ([held] if held else []) + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, parsed, strict=True))
            pairs = [(a, b) for a, b in zip(seen, seen[1:], strict=False) if not a[1] and a[0] == b[0]]
            held = seen[-1] if seen else None
            edited = []
            for (_, _, _, text, _), (_, _, _, following, _) in pairs:
                third = len(text) // 3
                edited.append((text[: len(text) - third] + following[:third]).encode("utf-8", "surrogatepass"))
            anew = parse(edited)
            columns = [
                pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array([told(a[4]) for a, _ in pairs], pa.string()), pa.array(map(told, anew), pa.string()),
                pa.array([alike(a[4], e) for (a, _), e in zip(pairs, anew, strict=True)], pa.float64()), pa.array([alike(a[4], b[4]) for a, b in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text, and their likeness."""
    return followed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
