"""BPE encoding and decoding.

Encoding is by backtracking: an Aho-Corasick automaton over the vocabulary
gives the longest token at each place, a pair-compatibility table says whether
two neighbouring tokens can stand side by side in the result of the merges, and
a token that fits nowhere is taken back and shortened.  This gives exactly the
tokens of the merge rules in time linear in the text.  Decoding copies byte
ranges by an offset table.

Defined results: a null text is the empty text; an empty text has no ids and
decodes to the empty text; repeated rows are encoded each; an empty table gives
an empty result; columns of the input other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words in each of the two generations of a worker's memory: this bounds memory, not what is encoded.
WORD_MEMORY = 350_000

_SPLIT = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: White space beside a space; white space that is rarer than this makes a text take the careful way.
_NEAR_SPACE = [x for w in "\n\t\r\v\f" for x in (f"{w} ", f" {w}")]
_RARE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_INNER_SPACE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens of a byte-level BPE file with the tables that encoding and decoding need."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        raw: list[bytes] = [b""] * size
        for token, i in ids.items():
            raw[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.raw = raw
        # ranks: single bytes first, then the merges in their order
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.rank = [-1] * size
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merge.setdefault((left, right), whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = n, (left, right)
        self.automaton = ahocorasick.Automaton()
        plain = {token: i for i, token in enumerate(raw) if i not in self.special.values()}
        for token, i in plain.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        # the next shorter token that begins a token
        self.shorter = [-1] * size
        for token, i in plain.items():
            for end in range(len(token) - 1, 0, -1):
                if (j := plain.get(token[:end])) is not None:
                    self.shorter[i] = j
                    break
        self.length = [len(x) for x in raw]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum(self.length, out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges would leave ``a`` and ``b`` side by side.

        The two tokens are taken apart in the reverse order of their merges;
        they do not fit if a merge over their border would have come first.
        """
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        rank, parts, merge = self.rank, self.parts, self.merge
        left, right, good, before = a, b, True, 1 << 60
        while True:
            whole = merge.get((left, right))
            if whole is not None and rank[whole] < before:
                good = False
                break
            ra, rb = rank[left], rank[right]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the later merge is undone first
                before, left = ra, parts[left][1]
            else:  # of two equal merges the left one came first
                before, right = rb + 1, parts[right][0]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[a, b] = good
        return good

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one piece of text inside which merges run."""
        best: dict[int, int] = {}
        for end, (n, i) in self.automaton.iter(word.decode("latin-1")):
            best[end - n + 1] = i  # ends grow: the longest stays
        out: list[int] = []
        size, at, token = len(word), 0, best[0]
        closed: set[int] = set()
        length, shorter, fits = self.length, self.shorter, self.fits
        while True:
            end = at + length[token]
            if end not in closed and (not out or fits(out[-1], token)):
                out.append(token)
                if end == size:
                    return out
                at, token = end, best[end]
                continue
            token_next = shorter[token]
            while token_next < 0:  # nothing fits here: take the last token back
                closed.add(at)
                token = out.pop()
                at -= length[token]
                token_next = shorter[token]
            token = token_next

    def encode_piece(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out: list[int] = []
        for word in _SPLIT.findall(text):
            out += self.encode_word(word.encode())
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from the token bytes by the offset table."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.bytes[place].tobytes()


class Encoder:
    """Encodes texts, remembering the words it has met (a bounded memory)."""

    def __init__(self, vocabulary: Vocabulary, decimal: bool = False, piece=None):
        """piece: encodes a text without special tokens; the backtracking encoder unless given."""
        self.vocabulary, self.decimal = vocabulary, decimal
        piece = piece or vocabulary.encode_piece
        self.inner, self.first = _Memory(piece, " ", decimal), _Memory(piece, "", decimal)
        self.most = WORD_MEMORY * 2 // 3 if decimal else WORD_MEMORY
        self.specials = sorted(vocabulary.special, key=len, reverse=True)

    def chunks(self, text: str) -> list:
        """What the memory holds of each piece of the text, in order."""
        for token in self.specials:
            if token in text:
                before, _, after = text.partition(token)
                i = self.vocabulary.special[token]
                one = (np.array([i], "<u4").tobytes(), str(i)) if self.decimal else np.array([i], "<u4").tobytes()
                return [*self.chunks(before), one, *self.chunks(after)] if after.count(token) < 200 else self._many(text, token, one)
        if not text:
            return []
        pieces = text.split(" ")
        if "" in pieces or any(x in text for x in _NEAR_SPACE) or not text.isascii() and _RARE_SPACE.search(text):
            pieces = _INNER_SPACE.split(text)
        if len(self.inner) > self.most:
            self.inner.turn()
        if len(self.first) > self.most // 10:
            self.first.turn()
        out = list(map(self.inner.__getitem__, pieces[1:]))
        out.insert(0, self.first[pieces[0]])
        return out

    def _many(self, text: str, token: str, one) -> list:
        out: list = []
        for n, part in enumerate(text.split(token)):
            if n:
                out.append(one)
            out += self.chunks(part)
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        found = self.chunks(text)
        return b"".join([x[0] for x in found] if self.decimal else found)


class _Memory(dict):
    """What words encode to; words that come again outlive a turn."""

    def __init__(self, encode, lead: str, decimal: bool):
        super().__init__()
        self.encode, self.lead, self.decimal = encode, lead, decimal
        self.older: dict = {}

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str):
        if (known := self.older.get(piece)) is not None:
            self[piece] = known
            return known
        ids = self.encode(self.lead + piece)
        out = array("I", ids).tobytes()
        if self.decimal:
            out = (out, ",".join(map(str, ids)))
        if len(piece) < 64:  # long ones hardly come again
            self[piece] = out
        return out


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file, read once in a process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str = VOCABULARY, decimal: bool = False) -> Encoder:
    """An encoder whose memory of words outlives a task of this worker."""
    if (path, decimal) not in _encoders:
        _encoders[path, decimal] = Encoder(vocabulary(path), decimal)
    return _encoders[path, decimal]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col, ids array<int>`` of every text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            flat = [np.frombuffer(own.ids(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*flat, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``id_col, text`` of every list of ids; null lists give the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        for batch in batches:
            texts = [tokens.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document, in one pass."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        own = encoder(path, decimal=True)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                found = own.chunks(text)
                ids = np.frombuffer(b"".join([x[0] for x in found]), "<u4")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([x[1] for x in found if x[1]]).encode()).hexdigest())
                back = tokens.decode(ids).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))
