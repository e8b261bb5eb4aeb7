"""Secret scans of whole texts.

An Aho-Corasick automaton finds keywords; anchored expressions are tried only
where a keyword stands; tokens that carry a checksum are kept only if it holds.
Hexadecimal runs have no keyword: the bytes are mapped to two letters and a run
of the least length is searched as one string.

Work is on UTF-8 bytes, since all expressions are ASCII; offsets become code
points at the end.

Defined results: a null text is the empty text, without spans; equal starts go
in the order of KINDS; repeated rows are scanned each; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of

#: The first three are fixed by the contract of the query; the rest carry a checksum or a decodable head.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = 3
LEAST_HEX, LEAST_ACCESS, LEAST_VALUE = 24, 20, 6

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[opsru]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
_JWT_PART = re.compile(rb"[A-Za-z0-9_-]+")
_KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": tuple(f"gh{c}_" for c in "opsru"), "npm": ("npm_",), "jwt": ("eyj",)}
_IS_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_DIGITS = (string.digits + string.ascii_uppercase + string.ascii_lowercase).encode()


def checksum62(payload: bytes) -> bytes:
    """CRC-32 of the payload as six digits of base 62."""
    left, out = zlib.crc32(payload), b""
    for _ in range(6):
        left, digit = divmod(left, 62)
        out = _DIGITS[digit : digit + 1] + out
    return out


def _decodes(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= LEAST_VALUE),
    "access": (_ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS),
    "github": (_GITHUB, lambda m: checksum62(m[1]) == m[2]),
    "npm": (_NPM, lambda m: checksum62(m[1]) == m[2]),
    "jwt": (_JWT, lambda m: _decodes(m[1])),
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)`` in code points, in order."""
    raw = text.encode()
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in automaton.iter(raw.lower().decode("latin-1")):
        starts.setdefault(kind, []).append(end - n + 1)
    spans = []
    for kind, places in starts.items():
        pattern, good = _RULES[kind]
        done = 0
        for at in sorted(places):
            if at < done:
                continue
            if m := pattern.match(raw, at):
                done = m.end()  # what fails is passed over as well
                if good(m):
                    spans.append((m.start(), KINDS.index(kind), done))
            elif kind == "jwt":  # later keywords of the same run go on as this one does, so they fail too
                done = _JWT_PART.match(raw, at).end()
    mapped = raw.translate(_IS_HEX)
    at = mapped.find(b"h" * LEAST_HEX)
    while at >= 0:
        end = _HEX.match(raw, at).end()
        spans.append((at, 2, end))
        at = mapped.find(b"h" * LEAST_HEX, end)
    spans.sort()
    if spans and len(raw) != len(text):
        points, last, count = {}, 0, 0
        for place in sorted({p for start, _, end in spans for p in (start, end)}):
            count += len(raw[last:place].decode())
            points[place], last = count, place
        spans = [(points[a], kind, points[b]) for a, kind, b in spans]
    return spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<kind, start, end>>`` of every text, ends exclusive."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t, automaton)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], ["id", "spans"])

    return docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = scan(text, automaton)
                base = [s for s in spans if s[1] < BASE]
                counts = [sum(k == n for _, k, _ in base) for n in range(BASE)]
                shown, of_base = (",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (spans, base))
                rows.append((*counts, hashlib.sha256(of_base.encode()).hexdigest(), shown))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields[1:], strict=True))], [n for n, _ in fields])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))
