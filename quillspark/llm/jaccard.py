"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds its distinct word shingles.  Shingles stand in one
global order, rare ones first; two sets that are similar enough share a shingle
among the first few of each (the prefix).  The steps:

1. Count shingles in a fixed number of counters over all documents; the order
   is (counter's magnitude, hash).
2. Collapse equal sets into a class, and classes of equal prefix and size into
   a group.
3. Deal groups by prefix shingle.  In every bucket the group with the fewest
   rarer shingles is the centre; each group is verified against its commonest
   centre.  Large clusters of near copies become connected so in linear work.
4. Only buckets that still hold several components give further group pairs;
   those are filtered by size and position, expanded to members and verified.

Pairs inside one component are not looked at again, so no link that joins two
components is lost and no pairs of a group of copies are listed.  Links are
decided on 64-bit hashes of the shingles.  Before whole sets are fetched, the
parities of each set's hashes in as many cells as it has shingles are compared:
no more cells differ than shingles that only one of the two has.

Defined results: a null, empty or blank text has an empty set (``n_shingles``
0) and links with nothing; repeated rows share a class; rows of one id with
different texts are judged each by its text; a component is named by its
smallest id; rows with a null id are kept apart from all others and have a null
component; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, few, small_batches, table, text_of, written
from .components import components

#: Counters of the shingle frequencies: 2 ** BITS, a fixed size at any input.
BITS = 20
#: Fewest cells of a set's parities.
LEAST_CELLS = 256
_BLOCK = 1 << 14
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2 ** 64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, 1 << 18), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a lower-cased text."""
    raw = np.frombuffer(data, np.uint8)
    ink = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(ink.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=sums[1:])
        inverse = _power(_INVERSE, len(raw))
        hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return _mix(hashes), starts


def shingle_sets(texts: list[bytes], width: int = 3) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < 1 << 18):
            size += len(texts[stop]) + 1
            stop += 1
        part = texts[at:stop]
        words, starts = _word_hashes(b" ".join(part).lower())
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        with np.errstate(over="ignore"):
            if len(words) >= width:
                every = np.zeros(len(words) - width + 1, np.uint64)
                for k in range(width):
                    every = every * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k]
                every = _mix(every)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(every[lo : hi - width + 1])
            elif hi > lo:  # fewer words: the whole sequence, told apart from full shingles by its length
                one = int.from_bytes(hashlib.blake2b(words[lo:hi].tobytes() + bytes([hi - lo]), digest_size=8).digest(), "little")
                yield np.array([one], np.uint64)
            else:
                yield np.empty(0, np.uint64)
        at = stop


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def frequency_classes(docs: DataFrame, width: int) -> np.ndarray:
    """Magnitude (bit length) of each counter, over all documents of ``id, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            met = np.concatenate([*shingle_sets(_bytes(batch, "text"), width), np.empty(0, np.uint64)])
            total += np.bincount((met >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        for k in range(0, 1 << BITS, _BLOCK):
            part = total[k : k + _BLOCK]
            kind = np.min_scalar_type(int(part.max(initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK]), pa.array([part.astype(kind).tobytes()])], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(counts, f"u{len(counts) // _BLOCK}")
                sums[block] = sums[block] + more if block in sums else more.astype(np.int64)
        for block, counts in sums.items():
            classes = np.frexp(counts.astype(float))[1].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([classes.tobytes()])], ["block", "classes"])

    blocks = (1 << BITS) // _BLOCK
    rows = docs.mapInArrow(count, "block long, counts binary").repartition(blocks, "block").mapInArrow(add, "block long, classes binary").collect()
    out = np.zeros(1 << BITS, np.uint8)
    for block, classes in rows:  # 2 ** BITS bytes at any input
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(classes, np.uint8)
    return out


def _print(hashes: np.ndarray) -> bytes:
    """Digest of a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each cell, in words of 64; a power of two of cells, one a hash or more."""
    cells = max(LEAST_CELLS, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def _prefixes(docs: DataFrame, width: int, percent: int, classes) -> DataFrame:
    """A row for each of ``docs (id, mark, text)``.

    ``row`` (a number of its own), ``n`` (size), ``print`` (digest of the set),
    ``key`` (digest of prefix and size), ``cells`` (parities), ``prefix`` (in the
    global order).
    """
    kind, mark = (docs.schema[c].dataType.simpleString() for c in ("id", "mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, row = classes.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, prints, keys, cells, prefixes = [], [], [], [], []
            for hashes in shingle_sets(_bytes(batch, "text"), width):
                n = len(hashes)
                p = n - -(-n * percent // 100) + 1 if n else 0
                rank = np.argsort(order[(hashes >> np.uint64(64 - BITS)).astype(np.int64)], kind="stable")[:p]
                first = hashes[rank]
                sizes.append(n)
                # sets without shingles are no class; a digest of its own spreads them
                prints.append(_print(hashes) if n else (row + len(prints)).to_bytes(8, "little"))
                keys.append(hashlib.blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest())
                cells.append(_parities(hashes) if n else np.empty(0, np.int64))
                prefixes.append(first.view(np.int64))
            rows = np.arange(row, row + len(sizes))
            row += len(sizes)
            columns = [batch.column("id"), batch.column("mark"), pa.array(rows), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), pa.array(keys, pa.binary()), _lists(cells), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "row", "n", "print", "key", "cells", "prefix"])

    return docs.mapInArrow(run, f"id {kind}, mark {mark}, row long, n int, print binary, key binary, cells array<long>, prefix array<long>")


def _buckets(groups: DataFrame, percent: int) -> DataFrame:
    """Rows of prefix shingles that several groups share: ``e, gid, n, pos, centre``.

    One pass over rows sorted by shingle and size.  A row that has no row of a
    similar size beside it can't be in a pair; the row of a size band with the
    lowest position is its centre.  Nothing of a bucket is held but its last row
    and the band's centre so far.
    """
    rows = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "e"))
    rows = rows.select("e", "pos", "gid", "n").repartition("e").sortWithinPartitions("e", "n", "pos", "gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, which the next batch decides about
        joined = False  # it has a neighbour before it
        best = (0, 0)  # position and group of the open band's centre
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            e, pos, gid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            band = np.floor(np.log(n) / 0.1).astype(np.int32)
            near = (e[1:] == e[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            same = np.concatenate([[joined if held is not None else False], near])
            new = np.concatenate([[held is None], (e[1:] != e[:-1]) | (band[1:] != band[:-1])])
            group = np.cumsum(new)
            order = np.lexsort((gid, pos, group))
            first = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
            lead, at = gid[first].copy(), pos[first].copy()
            if not new[0] and best < (at[0], lead[0]):
                at[0], lead[0] = best
            centres = lead[group - group[0]]
            best = (int(at[-1]), int(lead[-1]))
            several = same | np.concatenate([same[1:], [False]])
            keep = np.flatnonzero(several[:-1])
            if len(keep):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(keep)) for k in (0, 2, 3, 1)), pa.array(centres[keep])], ["e", "gid", "n", "pos", "centre"])
            held, joined = batch.slice(len(e) - 1), bool(same[-1])
        if held is not None and joined:
            yield pa.RecordBatch.from_arrays([*(held.column(k) for k in (0, 2, 3, 1)), pa.array([best[1]])], ["e", "gid", "n", "pos", "centre"])

    return rows.mapInArrow(run, "e long, gid long, n int, pos int, centre long")


def _ends(pairs: DataFrame) -> DataFrame:
    """Distinct ends of pairs."""
    return pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()


def _apart(x: Column, y: Column) -> Column:
    """Number of cells whose parities differ; the longer list is folded to the length of the other."""

    def folded(long: Column, short: Column) -> Column:
        n = F.size(short)
        parts = F.sequence(F.lit(0), F.floor(F.size(long) / n).cast("int") - 1)
        return F.aggregate(parts, short, lambda a, k: F.zip_with(a, F.slice(long, k * n + 1, n), lambda u, v: u.bitwiseXOR(v)))

    words = F.when(F.size(x) >= F.size(y), folded(x, y)).otherwise(folded(y, x))
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def _verified(pairs: DataFrame, every: DataFrame, docs: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """The pairs ``a, b`` of rows whose sets are similar enough, by the whole texts."""
    candidates = written(pairs, f"{label}-candidates")
    ends = written(_ends(candidates), f"{label}-ends")
    some = written(every.select("row", "id", "n", "print", "cells").join(few(ends), "row", "left_semi"), f"{label}-cells")
    x, y = (some.select(F.col("row").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")) for c in "ab")
    near = 100 * F.least("na", "nb").cast("long") >= percent * F.greatest("na", "nb").cast("long")
    sized = candidates.join(x, "a").join(y, "b").where(near)
    pairs = sized.where((100 + percent) * _apart(F.col("ca"), F.col("cb")).cast("long") <= (100 - percent) * (F.col("na") + F.col("nb")).cast("long"))
    pairs = written(pairs.select("a", "b").distinct(), f"{label}-pairs")
    last = written(_ends(pairs), f"{label}-last")
    wanted = written(some.select("row", "id", "print").join(few(last), "row", "left_semi"), f"{label}-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(_bytes(batch, "text"), width))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_print(h) for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], ["id", "print", "s"])

    texts = docs.select("id", "text").join(few(written(wanted.select("id").distinct(), f"{label}-ids")), "id", "left_semi")
    of_text = texts.mapInArrow(sets, "id long, print binary, s binary").join(few(wanted), ["id", "print"]).select("row", "s")
    found = written(of_text, f"{label}-sets")
    if found.count() > wanted.count():  # repeated rows of one id and text
        found, again = written(found.dropDuplicates(["row"]), f"{label}-sets"), found
        dropped(again)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common and 100 * common >= percent * (len(both) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).take(pa.array(keep, pa.int64()))

    met = pairs.join(found.select(F.col("row").alias("b"), F.col("s").alias("sb")), "b").join(found.select(F.col("row").alias("a"), F.col("s").alias("sa")), "a")
    links = written(met.select("a", "b", "sa", "sb").mapInArrow(compare, "src long, dst long"), f"{label}-links")
    dropped(candidates, ends, some, pairs, last, wanted, found)
    return links


def _alike(percent: int):
    """Size and position filters for rows x and y of one bucket."""
    x, y = F.col("n").cast("long"), F.col("n2").cast("long")
    least = F.least(x - F.col("pos"), y - F.col("pos2"))  # this shingle and all that may follow it
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * least >= percent * (x + y))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, mark: Column | None = None) -> DataFrame:
    """``id_col, n_shingles, component_id``: one row per document.

    Documents whose shingle sets have a Jaccard similarity of ``percent`` / 100
    or more are linked; the component is the smallest id reachable by links.
    ``mark``: an expression over ``docs`` that is carried along as a column.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[id_col].cast("long").alias("id"), (F.lit(0) if mark is None else mark).alias("mark"), text_of(text_col).alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(docs, width))
    every = written(_prefixes(docs, width, percent, classes), "prefixes")
    full = every.where("n > 0 and id is not null")
    # classes of equal sets, by their first row; the rest of the work is on these
    first = F.min(F.struct("row", "key")).alias("first")
    reps = written(full.groupBy("print").agg(first, F.min("id").alias("low"), F.count("*").alias("copies")).select("print", "first.row", "first.key", "low", "copies"), "classes")
    shared_keys = written(reps.groupBy("key").agg(F.min("row").alias("gid"), F.count("*").alias("n")).where("n > 1").drop("n"), "keys")
    members = written(reps.select("row", "key").join(few(shared_keys), "key", "left").select("row", F.coalesce("gid", "row").alias("gid")), "members")
    # most rows stand for a group of their own, so those that don't are left out
    spare = written(full.select("row").join(members.where("row = gid"), "row", "left_anti"), "spare")
    groups = full.select(F.col("row").alias("gid"), "n", "prefix").join(few(spare.withColumnRenamed("row", "gid")), "gid", "left_anti")
    shared = written(_buckets(groups, percent), "buckets")
    # every group against the centre that it meets most often, every member against its group's first
    star = shared.where("gid <> centre").groupBy("gid", "centre").count()
    star = star.groupBy("gid").agg(F.max_by("centre", F.struct("count", "centre")).alias("centre"))
    pairs = star.select(F.col("centre").alias("a"), F.col("gid").alias("b")).union(members.where("row <> gid").select(F.col("gid").alias("a"), F.col("row").alias("b")))
    links = _verified(pairs, every, docs, width, percent, "star")
    joined = components(links, "joined")
    # buckets and groups that still hold several components; most groups are a component of their own
    state = written(members.join(few(joined), F.col("row") == F.col("vertex"), "left").select("row", "gid", F.coalesce("component", "row").alias("comp")), "state")
    span = state.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> gid or hi <> gid")
    span = written(span, "spans")
    met = shared.drop("centre").join(few(span), "gid", "left").withColumns({"lo": F.coalesce("lo", "gid"), "hi": F.coalesce("hi", "gid")})
    bucket = Window.partitionBy("e")
    mixed = met.withColumns({"least": F.min("lo").over(bucket), "most": F.max("hi").over(bucket)}).where("least < most").drop("least", "most")
    other = mixed.select("e", *(F.col(c).alias(f"{c}2") for c in ("gid", "n", "pos", "lo", "hi")))
    several = ~((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2")))
    group_pairs = mixed.join(other, "e").where((F.col("gid") < F.col("gid2")) & several & _alike(percent)).select("gid", "gid2").distinct()
    group_pairs = group_pairs.union(span.where("lo < hi").select("gid", F.col("gid").alias("gid2")))
    left = state.select("gid", F.col("row").alias("a"), F.col("comp").alias("ca"))
    right = state.select(F.col("gid").alias("gid2"), F.col("row").alias("b"), F.col("comp").alias("cb"))
    more = group_pairs.join(left, "gid").join(right, "gid2").where("ca <> cb and (gid < gid2 or a < b)").select("a", "b")
    later = _verified(more, every, docs, width, percent, "expanded")
    last = components(links.union(later), "final")
    dropped(links, later, shared_keys, members, spare, shared, state, span)
    # the smallest id of each component; classes of one row without links are named by their own id
    linked = reps.join(few(last), F.col("row") == F.col("vertex"), "left").select("print", "low", "copies", F.coalesce("component", "row").alias("root"), (F.col("component").isNotNull()).alias("moved"))
    lows = linked.groupBy("root").agg(F.min("low").alias("name"), F.count("*").alias("classes")).where("classes > 1")
    roots = linked.join(few(written(lows, "names")), "root", "left").where("copies > 1 or name is not null").select("print", F.coalesce("name", "low").alias("name"))
    roots = few(written(roots, "roots"))
    out = every.select("id", "mark", "n", "print").join(roots, "print", "left")
    extra = [] if mark is None else ["mark"]
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("name", "id")).alias("component_id"), *extra)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all ``documents`` by 3-word shingles at a similarity of 0.9."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)


OP7_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
l AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN l ON l.a = d.doc_id
"""
