"""Calls of outside models as columns: embeddings, summaries, explanations.

A call is a plain function from a list of texts to a list of results; it is run
an Arrow batch at a time, and a batch that fails gives what the caller named
instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embed(call: Callable[[list[str]], list[list[float]]], text: Column, dimensions: int, chunk: int = 100) -> Column:
    """Vectors of texts; a chunk that fails is zero vectors."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        values, out = [t or "" for t in texts], []
        for k in range(0, len(values), chunk):
            try:
                out += call(values[k : k + chunk])
            except Exception:  # noqa: BLE001 - the caller sees zeros
                out += [[0.0] * dimensions] * len(values[k : k + chunk])
        return pd.Series(out)

    return run(F.substring(text, 1, 30_000))


def generate(call: Callable[[str], str], text: Column) -> Column:
    """``struct<text, error>`` of a text model."""

    @F.pandas_udf("text string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            try:
                out.append((call(value) if value else None, None))
            except Exception as problem:  # noqa: BLE001 - recorded with the row
                out.append((None, str(problem)[:500]))
        return pd.DataFrame(out, columns=["text", "error"])

    return run(text)


def summaries(cases, made, call: Callable[[str], str], model: str):
    """Summaries of judgments that have none: rows of the parent with the summary's own columns."""
    from quillspark.operators.filters import summary_text
    from quillspark.operators.ingest import new_only

    good, text, cut = summary_text()
    todo = new_only(cases.where(good), made, F.concat(F.col("id"), F.lit("-summary")), "id")
    done = todo.withColumn("__s", generate(call, text))
    return done.select(F.concat("id", F.lit("-summary")).alias("id"), F.col("id").alias("caselaw_id"), F.col("__s.text").alias("text"), F.col("__s.error").alias("error"), F.lit(model).alias("ai_model"), F.length("text").alias("source_text_length"), cut.alias("source_text_truncated"))
