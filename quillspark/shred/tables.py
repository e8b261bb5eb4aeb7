"""Shredders as table functions, for SQL and lateral joins.

A row is given out when it is made, so a document is never an array of all of
its rows.  ``register`` makes every shredder a function of a text:

    SELECT d.id, s.* FROM documents d, LATERAL judgment_sections(d.text) s

A text that can't be read gives one row of nulls with ``error``; null and empty
texts give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillspark.shred import clml, judgment, pages


def table_function(read: Callable[[str], Iterable[dict]], schema: str):
    """A table function of a text whose columns are ``schema`` and ``error``."""
    columns = StructType.fromDDL(schema)
    names = list(columns.names)
    columns = columns.add("error", StringType())

    class Shredder:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if text.dataType != StringType():
                raise ValueError("a shredder takes a text")
            return AnalyzeResult(columns)

        def eval(self, text: str):
            if not text:
                return
            try:
                for row in read(text):
                    yield (*(row.get(n) for n in names), None)
            except Exception as problem:  # noqa: BLE001 - one bad document must not end the job
                yield (*[None] * len(names), f"{type(problem).__name__}: {problem}"[:500])

    return udtf(Shredder)


def register(spark: SparkSession) -> None:
    """All shredders by name."""
    found = {
        "act_headers": (clml.header, clml.HEADER), "act_provisions": (clml.provisions, clml.PROVISION), "act_commentaries": (clml.commentaries, clml.COMMENTARY), "judgment_headers": (judgment.header, judgment.HEADER),
        "judgment_sections": (judgment.each_section, judgment.SECTION), "change_rows": (pages.changes, pages.CHANGE), "note_rows": (pages.notes, pages.NOTE),
    }
    for name, (read, schema) in found.items():
        spark.udtf.register(name, table_function(read, schema))
