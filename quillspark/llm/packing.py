"""Packing by lexical retrieval.

Documents are tokenised once and written with the document frequency of every
token (a table of the vocabulary's size, counted over all documents) and with a
lexical key: the document's rarest tokens, which are those that the vocabulary
learnt last.  All documents are sorted by that key, so documents that share rare
tokens stand side by side wherever they were read, and the order is dealt out in
ranges.  A task goes through its range in shards of a bounded number of tokens,
whatever the size of the input.  A shard has a BM25 inverted index; a window
starts with a seed document, the index returns the unused documents of the shard
most like it (by all terms of the seed), and these fill the window greedily.
What does not fit is cut, and its rest is the next seed, so windows are full;
the tail of a task is cut into sequences whose lengths are powers of two, which
need no padding.

A batch of texts is cut at single spaces and newlines, where pieces of text
can't touch each other's tokens; its distinct pieces are merged side by side as
one text, and their ids are given out by position.

Defined results: a null text is the empty text, which is the end token alone; a
document longer than a window fills several; ties in score go to the earlier
document of the shard; repeated rows are packed each, and many rows of one key
are dealt out as well; a null id is kept; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches, table, text_of, written

WINDOW = 2048
END = 1
SHARD_TOKENS = 1_000_000
#: One of so many distinct tokens of a document is too rare for its lexical key.
RARE = 64
#: BM25 constants.
K1, B = 1.2, 0.75
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: What the pieces that begin a text start with; others begin with a newline, or stand after a space.
_FIRST = "\x01"
_WHITE = r"\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that are not cut at spaces alone: white space side by side, or the sign above.
_CAREFUL = rf"[{_WHITE}][{_WHITE}]|\x01"
#: Pieces that can stand side by side in one text: after spaces, and after newlines.
_BESIDE = rf"(?s)^[^{_WHITE}\x01](?:.*[^{_WHITE}])?\z"
_BELOW = rf"(?s)^[\n\x01][^{_WHITE}](?:.*[^{_WHITE}])?\z"


class Tokeniser:
    """Ids of whole texts, a batch at a time; the distinct pieces of a batch are merged by the ranks of the same vocabulary."""

    def __init__(self, path: str, ranks: str):
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.whole = bpe.Encoder(bpe.vocabulary(path), piece=self.plain._core_bpe.encode_ordinary)
        self.lengths = np.array(self.whole.vocabulary.length)
        self.specials = list(self.whole.vocabulary.special)

    def _merged(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, disallowed_special=())

    def _one(self, piece: str) -> np.ndarray:
        return self._merged(piece[1:] if piece[:1] == _FIRST else piece if piece[:1] == "\n" else " " + piece)

    def _together(self, pieces: pa.Array, before: str, between: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``pieces`` as one text, and the number of ids up to the end of each; None if a token spans two of them."""
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), between)[0].as_py()
        ids = self._merged(before + whole)
        ends = np.cumsum(self.lengths[ids])
        bounds = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + len(before))
        cuts = np.searchsorted(ends, bounds)
        return (ids, cuts + 1) if cuts[-1] == len(ids) - 1 and np.array_equal(ends[cuts], bounds) else None

    def known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces: all ids, and where those of each piece start and end."""
        held, size = [np.empty(0, np.uint32)], 0
        starts, ends = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        alone = np.ones(len(pieces), bool)
        for pattern, before, between in ((_BESIDE, " ", " "), (_BELOW, "", "")):
            at = np.flatnonzero(pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            some = pieces.take(pa.array(at))
            first = pc.starts_with(some, _FIRST).to_numpy(zero_copy_only=False)
            if first.any():  # a newline in place of the sign keeps them apart and is left out again
                some = pc.replace_substring(some, _FIRST, "\n")
            found = self._together(some, before, between)
            if found is None:
                continue
            ids, cuts = found
            begin = np.concatenate([[0], cuts[:-1]])
            if not before and np.any(self.lengths[ids[begin]] != 1):
                continue
            starts[at], ends[at], alone[at] = size + begin + first, size + cuts, False
            held.append(ids)
            size += len(ids)
        for k in np.flatnonzero(alone).tolist():
            held.append(self._one(pieces[k].as_py()))
            starts[k], size = size, size + len(held[-1])
            ends[k] = size
        return np.concatenate(held), starts, ends

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (strings without nulls)."""
        careful = pc.match_substring_regex(texts, _CAREFUL)
        for token in self.specials:
            careful = pc.or_(careful, pc.match_substring(texts, token))
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        for k in np.flatnonzero(careful.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.frombuffer(self.whole.ids(texts[k].as_py()), "<u4")
        plain = np.flatnonzero(~careful.to_numpy(zero_copy_only=False))
        if len(plain):
            marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), "")
            cut = pc.split_pattern(marked, " ")
            distinct = cut.flatten().dictionary_encode()
            ids, starts, stops = self.known(distinct.dictionary)
            which = distinct.indices.to_numpy()
            lengths = (stops - starts)[which]
            ends = np.cumsum(lengths)
            flat = ids[np.arange(ends[-1]) + np.repeat(starts[which] - (ends - lengths), lengths)] if ends[-1] else ids[:0]
            bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
            for k, a, b in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out[k] = flat[a:b]
        return out


_tokenisers: dict[tuple[str, str], Tokeniser] = {}


def tokeniser(path: str, ranks: str) -> Tokeniser:
    """One whose memory of pieces outlives a task of this worker."""
    if (path, ranks) not in _tokenisers:
        _tokenisers[path, ranks] = Tokeniser(path, ranks)
    return _tokenisers[path, ranks]


def _tokenised(docs: DataFrame, path: str, ranks: str) -> DataFrame:
    """``id, ids, key, row, part``: ids as bytes, the lexical key, a number of the row.

    A row with ``part`` true ends a task and holds its document frequencies.
    """
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "ids", "key", "row", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokeniser(path, ranks)
        size = len(own.whole.vocabulary.raw)
        narrow, bits = ("<u2", 16) if size <= 1 << 16 else ("<u4", 21)
        frequency, kind = np.zeros(size, np.int64), None
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, keys = [], []
            kind = batch.schema.field(0).type
            for ids in own.batch(batch.column(1)):
                here = np.unique(ids)
                frequency[here] += 1
                # the same share of a document's rarest tokens is passed over, so long ones don't gather at one end
                key, last = 0, len(here) - len(here) // RARE
                for token in here[max(0, last - 63 // bits) : last][::-1].tolist():
                    key = key << bits | token
                keys.append(key)
                rows.append(ids.astype(narrow).tobytes())
            number = pa.array(np.arange(row, row + len(rows)))
            row += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(keys, pa.int64()), number, pa.array([False] * len(rows))], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([frequency.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([True])], names)

    return docs.mapInArrow(run, f"id {kind}, ids binary, key long, row long, part boolean")


def _sum(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' tables, in two steps; the result has the vocabulary's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                more = np.frombuffer(x, np.int64)
                total = more.copy() if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["ids"])

    some = parts.select("ids").repartition(32).mapInArrow(add, "ids binary").collect()
    return np.sum([np.frombuffer(r.ids, np.int64) for r in some], axis=0) if some else np.zeros(1, np.int64)


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores, in order; of equal ones the earlier come first."""
    if len(score) <= n:
        return np.argsort(-score, kind="stable")
    able = np.flatnonzero(score >= np.partition(score, -n)[-n])
    return able[np.argsort(-score[able], kind="stable")[:n]]


class _Index:
    """BM25 inverted index of one shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean
        self.parts = [np.unique(x, return_counts=True) for x in ids]
        self.length = np.array([len(x) for x in ids], float)
        self.keep(np.arange(len(ids)))

    def keep(self, live: np.ndarray) -> None:
        """Index these documents alone; the terms of the others can still ask."""
        terms, counts = ([self.parts[k][c] for k in live.tolist()] for c in (0, 1))
        term, count = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, counts))
        owner = np.repeat(np.arange(len(live)), [len(t) for t in terms])
        order = np.argsort(term, kind="stable")
        term, count, self.owner, self.live = term[order], count[order], owner[order], live
        self.weight = self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * self.length[live][self.owner] / max(self.mean, 1.0)))
        self.place = np.searchsorted(term, np.arange(len(self.idf) + 1))

    def like(self, k: int) -> np.ndarray:
        """Scores of the indexed documents for all terms of document k."""
        terms = self.parts[k][0]
        first = self.place[terms]
        n = self.place[terms + 1] - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)  # all postings of the terms
        return np.bincount(self.owner[at], self.weight[at], len(self.live))


class _Packer:
    """Fills windows over the shards of one task."""

    def __init__(self, idf: np.ndarray, mean: float, first_sequence: int, window: int):
        self.idf, self.mean, self.sequence, self.window = idf, mean, first_sequence, window
        self.filled = 0
        self.rows: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Put as much of a document as fits; returns where it is cut."""
        n = min(self.window - self.filled, len(ids) - start)
        self.rows.append((doc_id, start, n, ids, self.sequence, self.filled))
        self.filled += n
        if self.filled == self.window:
            self.sequence, self.filled = self.sequence + 1, 0
        return start + n

    def shard(self, names: list, ids: list[np.ndarray]) -> None:
        index = _Index([x[:-1] for x in ids], self.idf, self.mean)
        unused = np.ones(len(ids), bool)
        for seed in range(len(ids)):
            k, at = seed, 0
            if not unused[seed]:
                continue
            unused[seed] = False
            while at < len(ids[k]):
                at = self.put(names[k], ids[k], at)
            while self.filled:  # neighbours of the seed until the window is full
                free = unused[index.live]
                if 4 * np.count_nonzero(free) < 3 * len(free):  # used documents need no scores
                    index.keep(np.flatnonzero(unused))
                    free = unused[index.live]
                if not free.any():
                    return  # the window goes on in the next shard
                score = index.like(k)
                score[~free] = -1
                top = index.live[_best(score, 64)]
                top = top[unused[top]]
                for j in top.tolist():
                    unused[j] = False
                    cut = self.put(names[j], ids[j], 0)
                    if cut < len(ids[j]):  # its rest is the next seed
                        while cut < len(ids[j]):
                            cut = self.put(names[j], ids[j], cut)
                        k = j
                        break
                    if not self.filled:
                        break

    def tail(self) -> None:
        """Cut the last window into sequences of lengths that are powers of two."""
        if not self.filled or self.filled & (self.filled - 1) == 0:
            return
        first = next(i for i, r in enumerate(self.rows) if r[4] == self.sequence)
        last, self.rows = self.rows[first:], self.rows[:first]
        left = self.filled
        room = 1 << (left.bit_length() - 1)
        offset = 0
        for doc_id, start, n, ids, _, _ in last:
            while n:
                take = min(n, room - offset)
                self.rows.append((doc_id, start, take, ids, self.sequence, offset))
                start, n, offset = start + take, n - take, offset + take
                if offset == room:
                    left -= room
                    self.sequence, offset = self.sequence + 1, 0
                    room = 1 << (left.bit_length() - 1) if left else 1

    def drain(self, keep_open: bool, kind: pa.DataType) -> pa.RecordBatch:
        """Rows of windows that are closed."""
        done = [r for r in self.rows if not keep_open or r[4] < self.sequence]
        self.rows = [r for r in self.rows if keep_open and r[4] == self.sequence]
        crc = [zlib.crc32(ids[start : start + n].astype("<u4").tobytes()) for _, start, n, ids, _, _ in done]
        columns = [pa.array([r[0] for r in done], kind), *(pa.array([r[c] for r in done], pa.int64()) for c in (1, 2)), pa.array(crc, pa.int64()), pa.array([len(r[3]) for r in done], pa.int64()), *(pa.array([r[c] for r in done], pa.int64()) for c in (4, 5))]
        return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, path: str = bpe.VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """A row for each piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    small_batches(spark)
    done = written(_tokenised(docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text")), path, ranks), "tokens")
    frequency = _sum(done.where("part"))
    size = done.where("not part").agg(F.count("*"), F.sum(F.length("ids"))).first()
    wide = 2 if len(frequency) <= 1 << 16 else 4
    mean = (size[1] or 0) / wide / max(size[0], 1)
    idf = np.log1p((size[0] - frequency + 0.5) / (frequency + 0.5))
    sent = spark.sparkContext.broadcast((idf, mean))  # of the vocabulary's size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(*sent.value, TaskContext.get().partitionId() << 40, window)
        names, ids, held, kind = [], [], 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                ids.append(np.append(np.frombuffer(x, f"<u{wide}").astype(np.int32), np.int32(end)))
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    packer.shard(names, ids)
                    yield packer.drain(True, kind)
                    names, ids, held = [], [], 0
        if ids:
            packer.shard(names, ids)
        packer.tail()
        yield packer.drain(False, kind)

    dealt = done.where("not part").select("id", "ids", "key", "row").repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("id", "ids")
    out = dealt.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in windows of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
