"""Periodic runs against brute force over all stretches and against the letter of the contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import periods

FOLDER = "/root/testdata/sf0.001"


def brute(words, exponent=4, least=6):
    """Every lag, every place; a stretch counts for its smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                if i - start + q >= max(least, exponent * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    words = []
    while len(words) < rng.choice([0, 3, 30, 200]):
        if rng.random() < 0.5:
            words += [rng.choice("ab") for _ in range(rng.randrange(1, 12))]
        else:
            block = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            words += block * rng.randrange(2, 9) + block[: rng.randrange(len(block))]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(12)]
    for (exponent, least) in ((4, 6), (2, 2), (3, 8)):
        got = periods._batch([" ".join(w) for w in texts], [(1, None)] * len(texts), exponent, least)
        assert [r for _, r in got] == [brute(w, exponent, least) for w in texts]


@pytest.mark.parametrize("words", [["a"] * 300, ["a", "b"] * 150, (["a"] * 20 + ["b"]) * 9, ["a"] * 100 + ["b"] + ["a"] * 100])
def test_ranges_of_lags_find_each_run_once(words):
    ids = np.unique(words, return_inverse=True)[1].astype(np.int32)
    parts = [r for first in range(1, 76, 10) for r in periods.find(ids, np.array([len(ids)]), first, first + 9)]
    assert sorted(parts) == sorted(brute(words))


def test_a_long_text_of_one_word_is_not_quadratic():
    [(_, runs)] = periods._batch(["a " * 400_000], [(1, None)], 4, 6)
    assert runs == [(0, 400_000, 1)]
    [(_, runs)] = periods._batch(["a " * 100_000], [(20_000, 25_000)], 4, 6)
    assert runs == []


def odd(spark):
    block = " ".join(f"w{n}" for n in range(50))
    rows = [(1, "a b " * 9, 0), (1, "a b " * 9, 1), (2, None, 2), (3, "", 3), (None, "x x x x x x x", 4), (4, " \t\n", 5), (5, " ".join([block] * 8), 6), (None, "x x x x x x x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs int")


def test_odd_rows_and_documents_cut_into_ranges(spark):
    want = {"a b " * 9: [(0, 18, 2)], "x x x x x x x": [(0, 7, 1)]}
    for lags in (periods.LAGS, 2):  # one range, and many
        got = periods.periodic_runs(odd(spark), lags=lags).collect()
        assert len(got) == 8 and got[0].asDict().keys() == {"doc_id", "n_words", "runs", "collapsed"}
        told = sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed[:9]) for r in got)
        assert told == [
            (-1, 7, want["x x x x x x x"], "x"), (-1, 7, want["x x x x x x x"], "x"), (1, 18, want["a b " * 9], "a b"), (1, 18, want["a b " * 9], "a b"),
            (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 400, [(0, 400, 50)], "w0 w1 w2 "),
        ]
    assert periods.periodic_runs(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(odd(spark), min_exponent=1)


def by_the_letter(doc_id, text):
    words = periods._WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *last, digest(told), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_query_by_the_letter_of_its_contract(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    df = periods.op11_periodic_runs(spark, FOLDER)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(df.dtypes)["exponent_milli"] == "bigint" and dict(df.dtypes)["n_runs"] == "bigint"
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(by_the_letter(*r) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_texts_without_words_among_those_that_get_repeats(spark):
    ids = [n for n in range(400) if zlib.crc32(str(n).encode()) % 10 == 0]
    texts = [None, "", " \t", "one", "one two", "a b c d e f g h i j k l m n o p q r s t"]
    rows = [(n, texts[k % len(texts)]) for k, n in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in df.select("doc_id", periods.planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")).collect()}
    for n, text in rows:
        words = periods._WORDS.findall(text or "")
        if words:
            size, g = len(words), zlib.crc32(str(n).encode()) // 10
            a = g % size
            p = 1 + (size - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
        assert periods._WORDS.findall(got[n]) == words
