"""Dense and sparse scoring and their top-k.

A query's vector or terms are literals of the plan, so scoring is one pass over
the pruned, filtered columns and ends in a TakeOrdered: each task keeps its own
best k, and only those move.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, AVERAGE = 1.2, 0.75, 256.0
#: What separates words.
_BREAK = r"[^a-z0-9]+"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero, never NaN."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dense_scores(rows: DataFrame, query: Sequence[float], *, id_col: str = "id", vector_col: str = "dense") -> DataFrame:
    """``id, score`` of all rows by cosine, in no order."""
    size = sum(x * x for x in query) ** 0.5
    own = F.sqrt(dot(F.col(vector_col), F.col(vector_col)))
    score = F.when((own > 0) & F.lit(size > 0), dot(F.col(vector_col), literal(query)) / (own * F.lit(float(size) or 1.0))).otherwise(0.0)
    return rows.select(F.col(id_col).alias("id"), score.alias("score"))


def dense_top_k(rows: DataFrame, query: Sequence[float], k: int, *, id_col: str = "id", vector_col: str = "dense", where: Column | None = None, offset: int = 0) -> DataFrame:
    """``id, score``: the k nearest by cosine among rows that pass the filter; ties by id."""
    scored = dense_scores(rows if where is None else rows.where(where), query, id_col=id_col, vector_col=vector_col)
    return scored.orderBy(F.desc("score"), "id").offset(offset).limit(k)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")


def query_words(text: str) -> list[str]:
    return [w for w in re.split(_BREAK, text.lower()) if w]


#: Postings after which weights are given out.
HELD = 20_000


def weighed(rows: DataFrame, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B, average: float = AVERAGE) -> DataFrame:
    """``id, top, most, terms, weights``: the weights of ``bm25_weights``, text by text, with the heaviest term; words are counted where a text is read."""
    kind = rows.schema[id_col].dataType.simpleString()
    word = re.compile("[a-z0-9]+")
    names = ["id", "top", "most", "terms", "weights"]

    def made(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        owners, tops, mosts, terms, weights = zip(*held, strict=True)
        columns = [pa.array(tops, pa.string()), pa.array(mosts, pa.float64()), pa.array(terms, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *columns], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, postings = [], 0
            for n, text in enumerate(batch.column(1)):
                found = word.findall(text.as_py() or "")
                if not found:
                    continue
                norm = k1 * (1 - b + b * len(found) / average)
                weights = {t: tf * (k1 + 1) / (tf + norm) for t, tf in Counter(found).items()}
                most, top = max((w, t) for t, w in weights.items())
                held.append((n, top, most, list(weights), list(weights.values())))
                postings += len(weights)
                if postings >= HELD:
                    yield made(batch, held)
                    held, postings = [], 0
            if held:
                yield made(batch, held)

    return rows.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).mapInArrow(count, f"id {kind}, top string, most double, terms array<string>, weights array<double>")


def bm25_weights(rows: DataFrame, *, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B, average: float = AVERAGE, idf: bool = False) -> DataFrame:
    """The sparse vectors as a long table ``id, term, weight``; ids are distinct.

    Weights are of term frequencies alone and need no shuffle; ``idf`` counts
    documents as well, and the weights meet the counts in one shuffle without a sort.
    """
    out = weighed(rows, id_col, text_col, k1, b, average).select("id", F.explode(F.arrays_zip("terms", "weights")).alias("p")).select("id", F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))
    if not idf:
        return out
    total = rows.count()
    df = out.groupBy("term").agg(F.count("*").alias("df"))
    return out.join(df.hint("shuffle_hash"), "term").select("id", "term", (F.col("weight") * F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))


def term_weights(text: str, k1: float = K1, b: float = B, average: float = AVERAGE) -> dict[str, float]:
    """A query's sparse vector, weighted as documents are."""
    found = query_words(text)
    return {w: (n := found.count(w)) * (k1 + 1) / (n + k1 * (1 - b + b * len(found) / average)) for w in dict.fromkeys(found)}


def _scored(rows: DataFrame, query: str, id_col: str, text_col: str, k1: float, b: float, average: float, keep: Sequence[str]) -> DataFrame:
    """``id, score, keep``: 0 for rows without a word of the query that hold its letters somewhere.

    The words of a text are set apart by two spaces once, as generated code; a
    word is then counted by what the text loses when it is taken out.
    """
    terms = term_weights(query, k1, b, average)
    low = F.lower(text_col)
    held = reduce(lambda x, y: x | y, (F.contains(low, F.lit(t)) for t in terms), F.lit(False))
    apart = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _BREAK, "  ")), F.lit(" "))
    size = F.length(apart)
    n = (size - F.length(F.replace(apart, F.lit("  "), F.lit("")))) / 2 + 1  # rows with none hold no term either

    def part(term: str, weight: float) -> Column:
        tf = (size - F.length(F.replace(apart, F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)
        return F.lit(weight) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / average))

    parts = [part(t, w) for t, w in terms.items()]
    score = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    return rows.where(held).select(F.col(id_col).alias("id"), score.alias("score"), *keep)


def sparse_scores(rows: DataFrame, query: str, *, id_col: str = "id", text_col: str = "text", where: Column | None = None, k1: float = K1, b: float = B, average: float = AVERAGE, keep: Sequence[str] = ()) -> DataFrame:
    """``id, score`` of rows that hold a word of the query: no shuffle."""
    return _scored(rows if where is None else rows.where(where), query, id_col, text_col, k1, b, average, keep).where("score > 0")


def sparse_top_k(rows: DataFrame, query: str, k: int, *, offset: int = 0, id_col: str = "id", text_col: str = "text", where: Column | None = None, k1: float = K1, b: float = B, average: float = AVERAGE, keep: Sequence[str] = ()) -> DataFrame:
    """The k best of ``sparse_scores``; rows without a word go after the cut, so that the text is worked on once."""
    scored = _scored(rows if where is None else rows.where(where), query, id_col, text_col, k1, b, average, keep)
    return scored.orderBy(F.desc("score"), "id").offset(offset).limit(k).where("score > 0")


def index_top_k(weights: DataFrame, query: str, k: int, **how) -> DataFrame:
    """Top-k over a stored table of ``bm25_weights``: the query's terms pick their rows of it."""
    terms = term_weights(query, **how)
    chosen = weights.where(F.col("term").isin(list(terms)))
    weight = F.coalesce(*(F.when(F.col("term") == t, w) for t, w in terms.items())) if terms else F.lit(0.0)
    return chosen.groupBy("id").agg(F.sum(weight * F.col("weight")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def quantise(rows: DataFrame, *, id_col: str = "id", vector_col: str = "dense", quantile: float = 0.99) -> DataFrame:
    """``id, q, step``: int8 vectors; the bound is a quantile of all absolute values."""
    sizes = rows.select(F.explode(F.transform(vector_col, lambda x: F.abs(x.cast("double")))).alias("x"))
    bound = sizes.select(F.percentile_approx("x", quantile, 10_000).alias("bound"))  # one row
    step = F.col("bound") / 127

    def cut(x: Column) -> Column:
        return F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") / step))).cast("tinyint")

    return rows.join(F.broadcast(bound)).select(F.col(id_col).alias("id"), F.transform(vector_col, cut).alias("q"), step.alias("step"))


def rescored_top_k(rows: DataFrame, query: Sequence[float], k: int, *, times: int = 4, id_col: str = "id", vector_col: str = "dense", quantile: float = 0.99) -> DataFrame:
    """Candidates by int8 products (``times`` as many as asked for), the best of them by exact cosine."""
    coded = quantise(rows, id_col=id_col, vector_col=vector_col, quantile=quantile)
    product = F.aggregate(F.zip_with("q", literal(query), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rough = F.when(length > 0, product / F.sqrt(length)).otherwise(0.0)
    chosen = coded.select("id", rough.alias("rough")).orderBy(F.desc("rough"), "id").limit(k * times)
    return dense_top_k(rows.join(F.broadcast(chosen.select(F.col("id").alias(id_col))), id_col, "left_semi"), query, k, id_col=id_col, vector_col=vector_col)


def embedding_or_zero(vector: Column, dimensions: int) -> Column:
    """A failed embedding is the zero vector."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0), dimensions).cast("array<float>"))


def dense_input(text: Column, most: int = 30_000) -> Column:
    return F.substring(text, 1, most)
