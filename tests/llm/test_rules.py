"""Cases that once went wrong, odd inputs, and texts that must cost time in proportion to their length."""

import random
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bpe, common, htmltext, jaccard, neardup, packing, pii, secrets, toxicity, urlfilter

FOLDER = "/root/testdata/sf0.001"


# --- vectors and sets -------------------------------------------------------------


def test_vectors_of_one_id_are_told_apart(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.0])]
    for kind in ("float", "double"):
        got = neardup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 0, None), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_bounds_hold_at_any_width(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=3000)
    rows = [(n, [float(x) for x in base + rng.normal(size=3000) * e]) for n, e in enumerate([0.0, 0.3, 0.32, 0.33, 0.34, 0.5, 1.0])]
    x = np.array([v for _, v in rows])
    near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[n] for n in range(len(rows))] == (near.sum(1) - 1).tolist()


def test_texts_of_one_id_are_told_apart(spark):
    same, other = " ".join(f"a{n}" for n in range(40)), " ".join(f"b{n}" for n in range(40))
    rows = [(7, same), (7, other), (3, same), (9, other + " x"), (7, other), (5, None), (5, " ")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 36, 3), (5, 0, 5), (5, 0, 5), (7, 36, 3), (7, 36, 7), (7, 36, 7), (9, 37, 7)]


def test_parities_never_differ_in_more_cells_than_sets_in_members(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for n in (1, 5, 200, 300, 700, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for keep in (0.5, 0.8, 0.95):
            y = np.unique(np.concatenate([x[rng.random(len(x)) < keep], rng.integers(0, 1 << 63, max(1, int(n * (1 - keep))), dtype=np.uint64)]))
            pairs.append((jaccard._parities(x).tolist(), jaccard._parities(y).tolist(), len(np.setxor1d(x, y))))
    df = spark.createDataFrame(pairs, "x array<long>, y array<long>, d int")
    from pyspark.sql import functions as F

    got = df.select(jaccard._apart(F.col("x"), F.col("y")).alias("least"), jaccard._apart(F.col("y"), F.col("x")).alias("again"), "d").collect()
    assert all(r.least == r.again <= r.d for r in got)
    assert any(r.least > r.d / 2 for r in got)


# --- rules ----------------------------------------------------------------------------


def test_contradictory_rules_do_not_depend_on_their_order(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x/"), (1, "http://a.b/x/"), (2, None)], "page_id long, url string")
    rules = [("a.b", "/x/", "allow"), ("a.b", "/x/", "block"), ("b", "/", "allow")]
    for some in (rules, rules[::-1]):
        got = urlfilter.judge(pages, spark.createDataFrame(some, "host string, path string, verdict string")).collect()
        assert sorted((r.page_id, r.rule, r.verdict) for r in got if r.rule) == [(1, "a.b/x/", "block")] * 2


# --- time ---------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", ["<p ", '<p "', "<svg>", "<!-", "<a'", "</", "<p>x", "&", "<div class='a b'>"])
def test_pages_cost_time_in_proportion(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 30


@pytest.mark.parametrize("piece", ["eyJ", "eyJa.", "eyJa.eyJb.", "token", "token=", "ghp_", "AKIA", "a" * 23 + "g", "password: "])
def test_scans_cost_time_in_proportion(piece):
    automaton = secrets._automaton()
    began = time.time()
    secrets.scan(piece * (1_000_000 // len(piece)), automaton)
    assert time.time() - began < 20


def test_texts_with_very_many_addresses(spark):
    texts = [" ".join(f"word{n} a{n}@mail.org" for n in range(20_000)), "1.2.3.4 " * 20_000, "x" * 400_000 + " y@z.org", "+1 555 123 4567 " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert [len(got[n].base) for n in range(4)] == [20_000, 20_000, 1, 5000]
    last = got[0].base[-1]
    assert texts[0][last.start : last.end] == "a19999@mail.org"
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == " ".join(f"word{n} [EMAIL]" for n in range(20_000))
    assert clean[1] == "[IP] " * 20_000
    assert clean[2] == "x" * 400_000 + " [EMAIL]"
    assert time.time() - began < 240


# --- pages ----------------------------------------------------------------------------------


def test_self_closed_elements_and_names_of_paragraphs():
    assert htmltext.main_text("<article><p>A</p><svg class='i'/><p>B</p><iframe src='x'/><p>C</p></article>") == "A\nB\nC"
    page = '<article><p class="notice-period">One month</p><div class="tags-explained">What tags are</div><div class="comment-body">I think</div><p class="ad">Buy</p></article>'
    assert htmltext.main_text(page) == "One month\nWhat tags are"
    assert htmltext.main_text("<p>a</p><script>x = '<p>no</p>'</script><p>b<!-- c --> d</p>") == "a\nb d"


def made_page(rng):
    """A page from a random template, with its main text."""
    words = [f"w{n}" for n in range(300)]

    def prose(n):
        return " ".join(rng.choices(words, k=n)) + "."

    def links(n, k):
        return "<ul>" + "".join(f"<li><a href=/{i}>{prose(k)}</a></li>" for i in range(n)) + "</ul>"

    main = [prose(rng.randint(4, 9))] + [prose(rng.randint(25, 120)) for _ in range(rng.randint(2, 8))]
    body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{p}</p>" for p in main[1:])
    aside = {
        "head": rng.choice(["<header><a href=/>Site</a></header>", f'<div class="site-header">{prose(3)}</div>', ""]),
        "menu": rng.choice([f"<nav>{links(5, 1)}</nav>", f'<div id="menu">{links(4, 1)}</div>', links(6, 1)]),
        "ad": rng.choice([f'<div class="ad">{prose(12)}</div>', f'<aside class="sponsored">{prose(20)}</aside>', ""]),
        "cookies": rng.choice([f'<div class="cookie-notice">{prose(18)}</div>', f'<div role="dialog">{prose(15)}</div>', ""]),
        "comments": rng.choice([f'<section id="comments"><h3>{prose(2)}</h3><p>{prose(40)}</p></section>', f'<div class="comment-list"><p>{prose(30)}</p></div>', ""]),
        "related": rng.choice([f'<div class="related-posts">{links(4, 7)}</div>', f'<div class="sidebar">{links(3, 6)}</div>', ""]),
        "foot": rng.choice([f"<footer>{prose(8)}</footer>", f'<div class="footer-links">{links(3, 2)}</div>']),
    }
    held = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>']).format(body + aside["ad"])
    page = f"<html><head><title>t</title></head><body>{aside['cookies']}{aside['head']}{aside['menu']}{held}{aside['comments']}{aside['related']}{aside['foot']}</body></html>"
    return page, "\n".join(main)


def test_held_out_pages():
    rng = random.Random(5)
    made = [made_page(rng) for _ in range(300)]
    right = sum(htmltext.main_text(page) == text for page, text in made)
    assert right >= 0.97 * len(made)


# --- the string kernel ------------------------------------------------------------------------


def kernel(a, b):
    """Summed pair by pair: equal subsequences of three and four letters, each step at most two letters apart."""

    def found(word):
        c = [0, *toxicity.letters(word, join=False)[1:-1].tolist(), 0]
        out = {}
        for n in (3, 4):
            for places in combinations(range(len(c)), n):
                if places[-1] - places[0] <= 4:
                    key = tuple(c[k] for k in places)
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (places[-1] - places[0])
        return out

    x, y = found(a), found(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def test_kernel_folded_table_and_landmarks():
    words = ["stupid", "stxupid", "idiot", "house", "garden", "ab", "stu", "über"]
    codes = np.unique(np.concatenate([c for c, _, _ in toxicity.occurrences(toxicity.letters(" ".join(words), join=False))]))
    number = np.full(toxicity._SIZE, -1, np.int64)
    number[codes] = np.arange(len(codes))
    rows = toxicity._counts(words, number, len(codes))
    norm = toxicity._norm(np.array([len(w) for w in words]))
    plain = np.array([[kernel(a, b) for b in words] for a in words]) / np.outer(norm, norm)
    assert np.allclose(rows @ rows.T, plain, atol=1e-9)
    table = np.random.default_rng(1).normal(size=(len(codes), 5))
    assert np.allclose(toxicity._mapped(words, number, table), rows @ table, atol=1e-4)
    weights = np.zeros(toxicity._SIZE)
    weights[codes] = table[:, 0]
    assert np.allclose(toxicity.word_scores(toxicity.letters(" ".join(words), join=False), weights, 0.25), rows @ table[:, 0] + 0.25)
    # the Nystroem map is exact between landmarks
    values, vectors = np.linalg.eigh(plain)
    good = values > 1e-9
    mapped = plain @ (vectors[:, good] / np.sqrt(values[good]))
    assert np.allclose(mapped @ mapped.T, plain, atol=1e-6)
    assert plain[0, 1] > 2 * plain[0, 3]


def test_labelled_texts_are_bounded_by_ids(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: held.append(sorted(texts)))
    one, two = [n for n in range(20) if zlib.crc32(str(n).encode()) % 3 != 1][:2]  # not held out
    docs = spark.createDataFrame([(one, f"text {n:04d}") for n in range(500)] + [(two, "b"), (two, "a"), (None, "z")], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(one, 1), (two, 0), (two, 0)], "doc_id long, toxic int"), most=5)
    assert held == [["a", "text 0000"]]


# --- packing --------------------------------------------------------------------------------------


def test_batches_of_texts_are_tokenised_as_by_the_library():
    library = Tokenizer.from_file(bpe.VOCABULARY)
    rng = random.Random(4)
    letters = ["a", "bc", "the", "É", " ", " ", " ", "\n", "\t", "  ", "\xa0", " ", "\x85", "1", "'s", ".", "\x01", "<|endoftext|>", "漢", "🙂", "\x1c", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "\n", " a", "a ", "\na", "a\n", "a\n\nb", "x" * 5000, "word " * 3000]
    own = packing.tokeniser(bpe.VOCABULARY, packing.RANKS)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        for text, ids in zip(part, own.batch(pa.array(part, pa.string())), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents_that_share_rare_words_are_packed_together(spark):
    rng = random.Random(8)
    common_words = [f"common{n}" for n in range(40)]
    topics = [[f"{'xyzwvu'[t % 6]}{t}topic{k}" for k in range(12)] for t in range(40)]
    rows = [(n, " ".join(rng.choices(common_words, k=20) + rng.choices(topics[n % 40], k=20))) for n in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = packing.pack(df, window=512).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id)
    pairs = [(a % 40 == b % 40) for w in windows.values() for a, b in combinations(sorted(w), 2)]
    assert sum(pairs) / len(pairs) > 0.2  # 0.025 by chance


def test_many_equal_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(1, "same words here")] * 500 + [(None, None), (2, "")], "doc_id long, text string")
    got = packing.pack(df, window=64).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 500 * got[0].doc_tokens or sum(r.doc_id == 1 and r.start == 0 for r in got) == 500
    assert sorted(r.length for r in got if r.doc_id != 1) == [1, 1]


# --- stages -------------------------------------------------------------------------------------------


def test_stages_on_odd_rows(spark, tmp_path):
    words = " ".join(f"w{n}" for n in range(60))
    rows = [(1, words), (1, words), (2, words + " x"), (3, None), (3, None), (None, words), (None, "mail a@b.co"), (4, ""), (5, "mail a@b.co"), (6, words.replace("w", "v")), (6, words)]
    docs = spark.createDataFrame([(i, t, "en", n, "k", 0.5, "m") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, row long, key string, score double, mark string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    assert sorted(r.row for r in kept if r.text != words) == [3, 4, 6, 7, 8, 9]
    assert sorted((r.doc_id or 0) for r in kept if r.text == words) == [0, 1]
    clean = {r.row: r.text for r in corpus_pipeline.redact_pii(spark, docs, FOLDER).collect()}
    assert (clean[6], clean[8], clean[3], clean[7]) == ("mail [EMAIL]", "mail [EMAIL]", None, "")
    assert corpus_pipeline.pack_windows(spark, docs.limit(0), FOLDER).count() == 0


def test_a_step_deletes_only_what_the_step_before_is_done_with(spark, tmp_path):
    import os

    def first(docs):
        return common.written(docs, "mine")

    docs = spark.createDataFrame([(1,)], "a long")
    docs.write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    with common.step(spark, "test", 0, read):
        lazy = first(read)
    with common.step(spark, "test", 1, lazy):
        pass
    assert lazy.count() == 1  # still read
    with common.step(spark, "test", 0, read):
        made = first(read)
    path = made._written_to.removeprefix("file:")
    made.write.parquet(str(tmp_path / "out"))
    with common.step(spark, "test", 1, spark.read.parquet(str(tmp_path / "out"))):
        assert not os.path.exists(path)
    assert lazy.count() == 1


# --- personal data in context -------------------------------------------------------------------------


def test_precision_and_recall_of_contexts(spark):
    """A made corpus: three contexts with addresses and, in one case of eight, a name that no expression finds."""
    rng = random.Random(11)
    plain = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(800)]
    contexts = ["please contact {} for details", "this was signed by {} on", "a ticket opened by {} yesterday"]
    texts, hidden = [], []
    for n in range(600):
        name = "".join(rng.choices("bcdfghjkmpq", k=8))
        unseen = n % 8 == 0
        sentence = rng.choice(contexts).format(name if unseen else f"{name}@mail{n % 7}.org")
        words = rng.choices(plain, k=30)
        words.insert(rng.randrange(30), sentence)
        if n % 5 == 0:
            words.insert(rng.randrange(30), "please contact us for " + rng.choice(plain))
        texts.append(" ".join(words))
        hidden.append(name if unseen else None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find_pii(df).selectExpr("doc_id", "transform(filter(spans, x -> x.kind = 4), x -> struct(x.start, x.end)) as s").collect()
    found = [(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in got for s in r.s]
    wanted = {(n, name) for n, name in enumerate(hidden) if name}
    right = sum(x in wanted for x in found)
    print(f"precision {right / max(1, len(found)):.3f}, recall {right / len(wanted):.3f}")
    assert right >= 0.95 * len(found)
    assert right >= 0.9 * len(wanted)


def test_only_foreign_elements_close_themselves():
    page = '<article><script src="a.js"/>alert(1)</script><p>Text of the page.</p><style/>p{color:red}</style><p>More of it.</p><svg class="i"/><p>And the end.</p></article>'
    assert htmltext.main_text(page) == "Text of the page.\nMore of it.\nAnd the end."


def test_vectors_of_any_size_are_compared(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e180]), (2, [1e-200, 0.0]), (3, [0.0, 1e-200]), (4, [3.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (0, 3), 4: (3, 0)}
