"""Fingerprints: equal substrings are parsed alike, likeness follows what is shared, rows in their order."""

import hashlib
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import phrases

FOLDER = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def plain_phrases(symbols):
    """Ends of phrases of one level, symbol by symbol."""
    runs = []
    for s in symbols:
        if not runs or runs[-1] != s:
            runs.append(s)
    labels, bits = runs, (1 << 8) - 1
    for _ in range(phrases._ROUNDS):
        made = []
        for n, x in enumerate(labels):
            differ = x ^ (labels[n - 1] if n else ~x & bits)
            place = (differ & -differ).bit_length() - 1 if differ else 8
            made.append(2 * place + ((x >> place) & 1))
        labels = made
    return 1 + sum(labels[n] < labels[n - 1] and labels[n] < labels[n + 1] for n in range(1, len(labels) - 1))


def test_the_first_level_symbol_by_symbol():
    rng = random.Random(1)
    for size in (1, 2, 3, 10, 500):
        text = prose(rng, size).encode() + b"  aaaa" * (size % 3)
        names, _ = phrases._phrases(np.frombuffer(text, np.uint8), np.zeros(len(text), np.int32), 1)
        assert len(names) == plain_phrases(text)


def test_inner_phrases_do_not_depend_on_where_they_stand():
    rng = random.Random(2)
    middle = prose(rng, 400)
    for level in (1, 2, 3):
        named = []
        for before in ("", "x", prose(rng, 7), prose(rng, 50)):
            names = np.frombuffer((before + middle + prose(rng, 5)).encode(), np.uint8)
            owner = np.zeros(len(names), np.int32)
            for k in range(1, level + 1):
                names, owner = phrases._phrases(names, owner, k)
            named.append(names.tolist())
        inner = named[0][12:-12]
        assert len(inner) > 20
        assert all(any(other[n : n + len(inner)] == inner for n in range(len(other))) for other in named[1:])


def test_a_text_alone_or_among_others_has_one_fingerprint():
    rng = random.Random(3)
    texts = [b"", b"a", b"aa", b"ab" * 500, *(prose(rng, n).encode() for n in (1, 5, 40, 3000)), b"a" * 10_000, b""]
    together = phrases.parse(texts * 3)
    assert [phrases.told(x) for x in together] == [phrases.told(phrases.parse([t])[0]) for t in texts * 3]
    told = [phrases.told(x) for x in together[: len(texts)]]
    assert len(set(told)) == len(texts) - 1
    assert all(phrases.told(phrases.read(x)) == x for x in told)


def test_likeness():
    rng = random.Random(4)
    alike = lambda a, b: phrases.alike(*phrases.parse([a.encode(), b.encode()]))
    for size in (300, 3000):
        a, b = prose(rng, size), prose(rng, size)
        assert alike(a, a) == 1 and alike(a, b) < 0.05
        for share in (0.5, 0.67, 0.9):
            cut = int(len(a) * share)
            assert abs(alike(a, b[: len(a) - cut] + a[:cut]) - share) < 0.15
    assert alike("", "") == 1 and alike("", "word") == 0 and alike("", "a longer text of several words") == 0


def test_likeness_against_all_names():
    """The sketch's estimate against the share of all distinct names."""
    rng = random.Random(5)
    for _ in range(6):
        a = prose(rng, 4000)
        b = prose(rng, 1500) + a[: rng.randrange(len(a))]
        sets = []
        for text in (a, b):
            names, owner = np.frombuffer(text.encode(), np.uint8), np.zeros(len(text), np.int32)
            for k in (1, 2, 3):
                names, owner = phrases._phrases(names, owner, k)
            sets.append(set(names.tolist()))
        exact = 2 * len(sets[0] & sets[1]) / (len(sets[0]) + len(sets[1]))
        assert abs(phrases.alike(*phrases.parse([a.encode(), b.encode()])) - exact) < 0.2


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = (text[: len(text) - third] + after[:third]).encode()
        own, other, next_ = phrases.parse([text.encode(), edited, after.encode()])
        out.append((i, len(text), hashlib.sha256(edited).hexdigest(), phrases.told(own), phrases.told(other), phrases.alike(own, other), phrases.alike(own, next_)))
    return out


def test_rows_in_their_order_whatever_the_ranges(spark):
    rng = random.Random(6)
    rows = [(n * 7 % 101 - 50, prose(rng, rng.randrange(60)) + "é" * (n % 4)) for n in range(100)] + [(None, "a b c"), (99, None), (98, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").repartition(5)
    for ranges in (1, 7, 300):
        got = phrases.followed(df, ranges=ranges)
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)
    one = phrases.followed(df.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert phrases.followed(df.limit(0)).count() == 0


def test_repeated_rows_are_answered_each(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (None, "x"), (None, "x")]
    got = phrases.followed(spark.createDataFrame(rows, "doc_id long, text string"), ranges=3).collect()
    assert len(got) == 5 and sorted(r.near_next == 1 for r in got).count(True) == 2
    found = phrases.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.columns == ["doc_id", "fingerprint"] and found.select("fingerprint").distinct().count() == 3
    pairs = found.select("fingerprint", F.lit(None).cast("string").alias("none")).limit(1)
    assert pairs.select(phrases.likeness("fingerprint", "fingerprint"), phrases.likeness("fingerprint", "none")).first()[:] == (1.0, None)


def test_the_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    df = phrases.op13_document_fingerprints(spark, str(Path(FOLDER)))
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(expected(docs))
    assert sum(r[5] > r[6] for r in got) > 0.95 * len(got)
