"""Records of scanned acts: what a text model made of a PDF, as an act and its provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.fixed import BASE_URI, SITE, TYPE_CODES
from quillspark.functions.regnal import identity_of
from quillspark.functions.text import iso_date

EXTRACTED = (
    "struct<metadata: struct<title: string, date_enacted: string>, preamble: string, "
    "sections: array<struct<number: string, heading: string, text: string>>, schedules: array<struct<number: string, title: string, text: string>>>"
)


def _read(results: DataFrame, data: str) -> DataFrame:
    return results.where(F.col(data).isNotNull()).withColumn("__x", F.from_json(data, EXTRACTED)).where(F.col("__x").isNotNull())


def _list(name: str) -> Column:
    return F.coalesce(F.col(f"__x.{name}"), F.array().cast(EXTRACTED.split(f"{name}: ")[1].partition(">>")[0] + ">>"))


def acts(results: DataFrame, short: str = "legislation_id", data: str = "extracted_data") -> DataFrame:
    """One row an act; an unknown type is a public general act, JSON that can't be read gives no row."""
    x = _read(results, data).withColumn("__id", identity_of(short))
    preamble, number = F.coalesce("__x.preamble", F.lit("")), F.size(_list("sections")) + F.size(_list("schedules"))

    def texts(name: str, title: str) -> Column:
        return F.array_join(F.transform(_list(name), lambda p: F.concat(F.lit("\n\n"), F.coalesce(p[title], F.lit("")), F.lit("\n"), F.coalesce(p["text"], F.lit("")))), "")

    whole = F.concat(preamble, texts("sections", "heading"), texts("schedules", "title"))
    kind = F.col("__id.type")
    return x.select(
        F.concat(F.lit(BASE_URI), short).alias("id"), F.concat(F.lit(SITE), short).alias("uri"), F.coalesce("__x.metadata.title", F.concat(F.lit("Unknown ("), short, F.lit(")"))).alias("title"),
        F.substring(preamble, 1, 500).alias("description"), iso_date("__x.metadata.date_enacted").alias("enactment_date"), F.when(F.lower(kind).contains("si"), "secondary").otherwise("primary").alias("category"),
        F.when(kind.isin(TYPE_CODES), kind).otherwise("ukpga").alias("type"), "__id.year", "__id.number", F.lit("unknown").alias("status"), number.alias("number_of_provisions"), F.regexp_replace(whole, r"^\s+|\s+$", "").alias("text"),
    )


def provisions(results: DataFrame, short: str = "legislation_id", data: str = "extracted_data") -> DataFrame:
    """Sections, then schedules, each numbered from 1 by their place."""
    act = F.concat(F.lit(BASE_URI), short)
    out = []
    for name, title, kind in (("sections", "heading", "section"), ("schedules", "title", "schedule")):
        rows = _read(results, data).select(act.alias("legislation_id"), F.posexplode(_list(name)).alias("n", "p"))
        number = F.col("n") + 1
        uri = F.concat("legislation_id", F.lit(f"/{kind}/"), number.cast("string"))
        named = F.coalesce(f"p.{title}", F.concat(F.lit(f"{kind.capitalize()} "), F.coalesce("p.number", number.cast("string"))))
        out.append(rows.select(uri.alias("id"), "legislation_id", named.alias("title"), F.coalesce("p.text", F.lit("")).alias("text"), F.lit(kind).alias("provision_type"), number.alias("number")))
    return out[0].unionByName(out[1])
