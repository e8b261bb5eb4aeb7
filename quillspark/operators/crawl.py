"""A crawl in rounds: a frontier, what it gave, and what has been seen.

Every round fetches the frontier, writes the pages, takes their links, leaves
out by an anti-join what any round has had in its frontier, and writes what
remains as the next frontier; the crawl ends with an empty one.  Rounds are
folders, so a crawl that was cut off goes on with the round that is not whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import exists
from quillspark.shred import pages as shredded

#: What a frontier holds: an address, what kind of page it is, and whose it is.
FRONTIER = "url string, kind string, root string"
PAGES = f"{FRONTIER}, html string"
Fetch = Callable[[DataFrame], DataFrame]
Links = Callable[[DataFrame], DataFrame]


def _put(rows: DataFrame, path: str, folder: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{folder}/round={number}")


def _round(spark: SparkSession, path: str, folder: str, number: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{folder}/round={number}")


def once(rows: DataFrame) -> DataFrame:
    """One row of each address: the least kind and root."""
    return rows.where("url is not null").groupBy("url").agg(F.min(F.struct("kind", "root")).alias("x")).select("url", "x.*")


def crawl(seeds: DataFrame, fetch: Fetch, links: Links, path: str, most_rounds: int = 1000) -> DataFrame:
    """``url, kind, root, html, round`` of all pages that the seeds lead to; ``round`` is the distance from a seed.

    ``fetch`` gives the frontier's rows with ``html``, null where there is no
    page; ``links`` gives ``url, kind, root`` of the pages' links.  A page is
    fetched once, whatever leads to it; null addresses are left out; no seeds
    give no pages.
    """
    spark, number = seeds.sparkSession, 0
    if not exists(spark, f"{path}/frontier/round=0/_SUCCESS"):
        _put(once(seeds), path, "frontier", 0)
    while exists(spark, f"{path}/frontier/round={number + 1}/_SUCCESS"):  # whole rounds of a run before
        number += 1
    while not (frontier := _round(spark, path, "frontier", number, FRONTIER)).isEmpty():
        if number >= most_rounds:
            raise RuntimeError(f"links still lead on after {most_rounds} rounds")
        _put(fetch(frontier).select("url", "kind", "root", "html"), path, "pages", number)
        seen = spark.read.schema(FRONTIER).parquet(*(f"{path}/frontier/round={n}" for n in range(number + 1)))
        found = once(links(_round(spark, path, "pages", number, PAGES).where("html is not null")))
        _put(found.join(seen.select("url"), "url", "left_anti").select("url", "kind", "root"), path, "frontier", number + 1)
        number += 1
    if not number:
        return spark.createDataFrame([], f"{PAGES}, round int")
    return spark.read.schema(f"{PAGES}, round int").parquet(f"{path}/pages")


def from_table(pages: DataFrame) -> Fetch:
    """A fetch from a table ``url, html``; of several rows of an address the least html."""
    held = pages.groupBy("url").agg(F.min("html").alias("html"))
    return lambda frontier: frontier.join(held, "url", "left")


def notes(acts: DataFrame, fetch: Fetch, path: str, act: str = "url") -> DataFrame:
    """``root, style, order, route, text`` of the explanatory notes of acts, from their contents pages on.

    From an act's contents the crawl goes to the contents of its notes; in the
    old style these lead to one page of all notes, in the new style each page
    leads to the next, the contents being the first.  Acts without notes and
    contents of neither style give no rows.  ``order`` counts an act's notes
    from 0 over all of its pages.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [(u, k, r["root"]) for r in rows for u, k in shredded.note_links(r["html"], r["kind"], r["url"])]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.string()) for n in range(3)], ["url", "kind", "root"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("root", pa.string()), ("style", pa.string()), ("round", pa.int32()), ("place", pa.int32()), ("route", pa.list_(pa.string())), ("text", pa.string())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tree = shredded.tree(r["html"])
                style = shredded.note_style(tree) if r["kind"] == shredded.CONTENTS_PAGE else None
                if style != "old":  # the old style's contents hold no notes
                    out += [{"root": r["root"], "style": style, "round": r["round"], "place": n["order"], "route": n["route"], "text": n["text"]} for n in shredded.notes(r["html"], inside=True)]
                else:
                    out.append({"root": r["root"], "style": style, "round": r["round"], "place": -1, "route": [], "text": ""})
            yield pa.RecordBatch.from_pylist(out, schema)

    seeds = acts.select(F.concat(F.col(act), F.lit("/contents")).alias("url"), F.lit(shredded.ACT_PAGE).alias("kind"), F.col(act).alias("root"))
    links = lambda pages: pages.select("url", "kind", "root", "html").mapInArrow(step, FRONTIER)
    pages = crawl(seeds, fetch, links, path).where("html is not null").where(F.col("kind") != shredded.ACT_PAGE)
    rows = pages.select("root", "kind", "html", "round").mapInArrow(read, "root string, style string, round int, place int, route array<string>, text string")
    of_act = Window.partitionBy("root")
    styled = rows.withColumn("style", F.max("style").over(of_act)).where("style is not null and place >= 0")
    order = F.row_number().over(of_act.orderBy("round", "place")) - 1
    return styled.select("root", "style", order.alias("order"), "route", "text")
