"""Near duplicates of vectors and texts, components, and exact search, against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import components, hamming, jaccard, neardup


def closure(n, links):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(n, n + 1) for n in range(300, 340)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    low = closure(400, links)
    assert all(got.get(v, v) == low[v] for v in {x for pair in links for x in pair})
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.5]) for i in range(300)]
    rows = [list(map(float, np.float32(r))) for r in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] * 16, [1.0] * 8]
    return rows + odd


def test_vectors_against_brute_force(spark):
    rows = vectors(spark)
    df = spark.createDataFrame([(n, v, 1) for n, v in enumerate(rows)], "vec_id long, embedding array<float>, n_links int")
    for size in (8192, 60):  # one tile, and many
        got = {r.vec_id: r for r in neardup.near_duplicates(df, 0.95, block_rows=size).collect()}
        x = np.array(rows[:300])
        near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
        np.fill_diagonal(near, False)
        low = closure(300, list(zip(*np.nonzero(near))))
        assert [got[n].n_links for n in range(300)] == near.sum(1).tolist()
        assert [got[n].component_id for n in range(300)] == low
        assert all((got[n].n_links, got[n].component_id, got[n].kept) == (0, n, True) for n in range(300, len(rows)))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def documents():
    rng = random.Random(7)
    words = [f"w{n}" for n in range(500)]
    shared = " ".join(rng.choices(words, k=60))
    out = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(3, 120))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("\n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    out += [shared + " " + " ".join(rng.choices(words, k=4)) for _ in range(60)]
    return [*out, None, "", " \t\n", "one", "ONE", "one two", "one  two", "a b c", "a\x0bb\x0cc", "a\xa0b c d", "long " * 20_000]


def brute(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], closure(len(texts), links)


def test_texts_against_brute_force(spark):
    texts = documents()
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, component_id string")
    for width, percent in ((3, 90), (5, 80)):
        sizes, low = brute(texts, width, percent)
        got = {r.doc_id: r for r in jaccard.near_duplicates(df, width=width, percent=percent).collect()}
        assert [got[n].n_shingles for n in range(len(texts))] == sizes
        assert [got[n].component_id for n in range(len(texts))] == low
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard.near_duplicates(df, width=3, percent=90).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (5, 3)]


def test_hamming_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [list(map(float, v)) for v in rng.normal(size=(230, 40))]
    rows[100:130] = [rows[0]] * 30
    odd = [None, [], [float("nan")] * 40, [1.0] * 8]
    df = spark.createDataFrame([(n, v, 0) for n, v in enumerate(rows + odd)], "vec_id long, embedding array<float>, distance int")
    got = {}
    for r in hamming.top_k(df, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    bits = np.array(rows) > 0
    for q in range(0, 230, 50):
        found = sorted((int((bits[q] != bits[k]).sum()), k) for k in range(230) if k != q)[:7]
        assert sorted(got[q]) == [(n + 1, *x) for n, x in enumerate(found)]
    few = hamming.top_k(df.where("vec_id < 3"), 7, is_query=F.lit(True))
    assert few.count() == 6
    assert hamming.top_k(df.limit(0)).count() == 0


def test_hamming_of_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, -1.0, 1.0]), (0, [1.0, -1.0, 1.0]), (1, [1.0, -1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (None, [1.0, -1.0, 1.0]), (3, None), (4, []), (5, [1.0])]
    df = spark.createDataFrame([(*r, 9, "x", 1) for r in rows], "vec_id long, embedding array<double>, id long, code string, distance long")
    got = sorted((r.query_id, r.rank, r.neighbour_id, r.distance) for r in hamming.top_k(df, 5, is_query=F.col("vec_id").isin(0, 2) | F.col("vec_id").isNull()).collect())
    assert got == sorted([(0, 1, 1, 0), (0, 2, 2, 1)] * 2 + [(2, 1, 0, 1), (2, 2, 1, 1)] * 2)
