import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe

ALPHABET = "ab cdé  \n\t\x85\xa0'stll123²½٣漢字🙂.,-_\x0b"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def texts(n=400, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return ["", " ", "  ", "<|endoftext|>", "a<|endoftext|> b", "x" * 3000, "ab" * 2000, " \n" * 50, "<|endoftext|>" * 300, *made]


def test_ids_are_those_of_the_library(library):
    own = bpe.encoder()
    for t in texts():
        ids = np.frombuffer(own.ids(t), "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert bpe.vocabulary().decode(np.array(ids, np.int64)).decode("utf-8", "replace") == t


def test_columns_round_trip(spark):
    rows = spark.createDataFrame([(n, t, "x") for n, t in enumerate([None, *texts(30)])], "doc_id long, text string, ids string")
    encoded = bpe.encode(rows)
    back = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert back == {r.doc_id: r.text or "" for r in rows.collect()}


def test_digests(spark, library):
    rows = spark.createDataFrame([(1, "Hello world", 1), (1, "Hello world", 2), (None, None, 3)], "doc_id long, text string, n_tokens int")
    got = bpe.digests(rows).collect()
    ids = library.encode("Hello world", add_special_tokens=False).ids
    assert len(got) == 3
    assert got[0] == got[1]
    assert got[0].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.digests(rows.limit(0)).count() == 0
