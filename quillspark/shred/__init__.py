"""Shredders: XML and HTML documents to typed rows.

Each is a plain function from a document's text to a list of records, and
``rows`` applies one to a column in one pass, a document at a time: rows are
given out as they are made, so a task's Python holds the rows of some text, not
those of a batch.  A document that can't be read gives a row in the quarantine
instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StringType, StructType

Reader = Callable[[str], Iterable[dict]]
#: Rows, or letters of texts read, after which rows are given out.
MOST_ROWS, MOST_LETTERS = 1000, 1 << 20


def _read(f: Reader, text: str | None) -> tuple[list[dict] | None, str | None]:
    """A document's records, or the error that it ended with."""
    try:
        return (list(f(text)) if text else []), None
    except Exception as problem:  # noqa: BLE001 - one bad document must not end the job
        return None, f"{type(problem).__name__}: {problem}"[:500]


def records(f: Reader, schema: str, text: Column | str) -> Column:
    """``struct<rows: array<struct<schema>>, error: string>`` of each document."""
    out = StructType.fromDDL(f"rows array<struct<{schema}>>, error string")

    @F.arrow_udf(out)
    def run(texts: pa.Array) -> pa.Array:
        kind = to_arrow_type(out)
        parts, held, letters = [], [], 0
        for value in texts:
            value = value.as_py()
            held.append(dict(zip(("rows", "error"), _read(f, value), strict=True)))
            letters += len(value or "")
            if letters >= MOST_LETTERS:
                parts.append(pa.array(held, kind))
                held, letters = [], 0
        return pa.concat_arrays([*parts, pa.array(held, kind)])

    return run(F.col(text) if isinstance(text, str) else text)


def shredded(docs: DataFrame, readers: dict[str, tuple[Reader, str]], text: str, *keep: str) -> DataFrame:
    """``keep, reader, error`` and a struct by the name of each reader: one pass in which every reader gets every document.

    A row is a record of the reader that it names, or that reader's error.
    """
    schema = StructType()
    for name in keep:
        schema = schema.add(name, docs.schema[name].dataType)
    schema = schema.add("reader", StringType()).add("error", StringType())
    for name, (_, record) in readers.items():
        schema = schema.add(name, StructType.fromDDL(record))

    def batch_of(batch: pa.RecordBatch, held: list[tuple[int, str, str | None, dict | None]]) -> pa.RecordBatch:
        out, place = to_arrow_schema(schema), pa.array([h[0] for h in held], pa.int64())
        told = [pa.array([h[n] for h in held], pa.string()) for n in (1, 2)]
        found = [pa.array([h[3] if h[1] == name else None for h in held], out.field(name).type) for name in readers]
        return pa.RecordBatch.from_arrays([*(c.take(place) for c in batch.columns[1:]), *told, *found], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, letters = [], 0
            for n, value in enumerate(batch.column(0)):
                value = value.as_py()
                for name, (f, _) in readers.items():
                    found, error = _read(f, value)
                    held += [(n, name, None, r) for r in found] if error is None else [(n, name, error, None)]
                letters += len(value or "")
                if len(held) >= MOST_ROWS or letters >= MOST_LETTERS:
                    yield batch_of(batch, held)
                    held, letters = [], 0
            if held:
                yield batch_of(batch, held)

    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def rows(docs: DataFrame, f: Reader, schema: str, text: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all documents with the columns to keep, and the quarantine ``keep, error``."""
    read = shredded(docs, {"__r": (f, schema)}, text, *keep)
    return read.where("error is null").select(*keep, "__r.*"), read.where("error is not null").select(*keep, "error")
