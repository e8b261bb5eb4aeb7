import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bpe, packing

FOLDER = "/root/testdata/sf0.001"


def check(rows, texts, window):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, packing.END] for k, t in texts.items()}
    places, sequences = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        places.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: len(v) for k, v in ids.items()} == {k: sum(n for _, n in v) for k, v in places.items()}
    sizes = []
    for pieces in [*places.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    for pieces in sequences.values():
        sizes.append(sum(n for _, n in pieces))
    assert all(s == window or s < window and s & (s - 1) == 0 for s in sizes)


@pytest.mark.parametrize("window", [2048, 64])
def test_every_token_once_without_padding(spark, window):
    texts = {n: t for n, t in enumerate([None, "", "a", "hello world " * 40, "x y z " * 3000, *(f"alpha beta {n} gamma " * (n % 9) for n in range(80))])}
    df = spark.createDataFrame([(n, t, "x") for n, t in texts.items()], "doc_id long, text string, start string")
    check(packing.pack(df, window=window).collect(), texts, window)
    assert packing.pack(df.limit(0), window=window).count() == 0


def test_ids_of_random_texts_equal_the_library():
    library = Tokenizer.from_file(bpe.VOCABULARY)
    own, random = packing.Tokeniser(bpe.VOCABULARY, packing.RANKS), np.random.default_rng(7)
    parts = ["a", "the", " the", " ", "\n", "\nB", "\t", "\x01", "'s", " 's", "é", "中", "12", ".", "!!", "\x1c", "\x85", "<|endoftext|>", "😀", "\r\n", "\x00"]
    texts = ["".join(random.choice(parts, random.integers(0, 14))) for _ in range(3000)]
    texts += ["".join(random.choice(["the", " b", "\nc", " 's", "\n'", "7"], random.integers(0, 14))) for _ in range(3000)]
    for at in range(0, len(texts), 64):
        batch = texts[at : at + 64]
        assert [x.tolist() for x in own.batch(pa.array(batch, pa.string()))] == [library.encode(x, add_special_tokens=False).ids for x in batch]


def test_best_scores_in_order():
    random = np.random.default_rng(3)
    for size in (0, 1, 5, 64, 65, 500):
        score = random.integers(-1, 9, size).astype(float)
        assert packing._best(score, 64).tolist() == np.argsort(-score, kind="stable")[:64].tolist()


def test_neighbours_are_alike():
    from quillspark.llm.packing import _Index

    ids = [np.array(x) for x in ([1, 2, 3, 4], [5, 6, 7, 8], [1, 2, 3, 9], [5, 6, 10])]
    index = _Index(ids, np.ones(11), 4.0)
    assert np.argsort(-index.like(0), kind="stable")[:2].tolist() == [0, 2]


def test_all_terms_of_a_seed_ask():
    from quillspark.llm.packing import _Index

    idf = np.ones(400)
    idf[:30] = 2.0
    index = _Index([np.arange(300), np.arange(300, 400), np.arange(30, 300)], idf, 220.0)
    assert index.like(0)[2] > 0 == index.like(0)[1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at, kept = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, FOLDER)
        assert at.schema.names == docs.schema.names
        kept.append(at.count())
    assert kept == sorted(kept, reverse=True)
    assert kept[2] < kept[0]
    assert at.where("text rlike '[A-Za-z0-9._%+-]@[A-Za-z0-9-]+[.][a-z]'").count() == 0
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    check(rows, {r.doc_id: r.text for r in at.collect()}, packing.WINDOW)
