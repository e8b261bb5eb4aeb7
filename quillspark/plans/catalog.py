"""Registered queries: every operator applied to the driver's tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.fixed import CATEGORIES, TYPES
from quillspark.functions import text as T
from quillspark.functions import uri as U
from quillspark.functions.regnal import fast_year
from quillspark.operators import audit, cells, filters, fusion, ingest, lookup, postings, search, vectors
from quillspark.session import made_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Words that the text searches ask for.
TEXT = "the la der"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def docs(spark, d) -> DataFrame:
    return t(spark, d, "documents").withColumnRenamed("doc_id", "id")


def embedded(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")


#: Stored indexes by their folders.
_OPENED: dict[str, postings.Index | cells.Index] = {}


def _opened(spark, path: str, how):
    if path not in _OPENED or _OPENED[path].spark is not spark:
        _OPENED[path] = how(spark, path)
    return _OPENED[path]


def posted(spark, d) -> postings.Index:
    """The stored posting index of the documents' texts."""
    return _opened(spark, made_once(spark, f"{d}/documents.parquet", "postings", lambda path: postings.build(docs(spark, d), path)), postings.opened)


def celled(spark, d) -> cells.Index:
    """The stored cells of the embeddings."""
    return _opened(spark, made_once(spark, f"{d}/embeddings.parquet", "cells", lambda path: cells.build(embedded(spark, d), path)), cells.opened)


def asked(spark, d, vec_id: int = 7) -> list[float]:
    """The query's vector: one row."""
    return embedded(spark, d).where(F.col("id") == vec_id).select("dense").first()[0]


# --- vector search and fusion ----------------------------------------------

_DENSE = "SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS score FROM embeddings e"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_QW = "(2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 256.0)))"


def _sparse(source: str = "documents", key: str = "doc_id", where: str = "true") -> str:
    tf = [f"len(list_filter(w, lambda x: x = '{word}'))" for word in TEXT.split()]
    parts = " + ".join(f"{_QW} * {x} * 2.2 / ({x} + 1.2 * (0.25 + 0.75 * len(w) / 256.0))" for x in tf)
    return f"SELECT id, {parts} AS score FROM (SELECT {key} AS id, {_WORDS} AS w FROM {source} WHERE {where}) WHERE {' + '.join(tf)} > 0"


def _top(sql: str, n: int) -> str:
    return f"SELECT * FROM ({sql}) ORDER BY score DESC, id LIMIT {n}"


_SPREAD = "SELECT id, CASE WHEN coalesce(s, 0) > 0 THEN greatest(0.0, least(1.0, (score - (m - 3 * s)) / (6 * s))) ELSE 0.5 END AS score FROM {0}, (SELECT avg(score) m, stddev_samp(score) s FROM {0})"


def _dbsf(dense: str, sparse: str, n: int) -> str:
    return f"WITH a AS ({dense}), b AS ({sparse}) SELECT id, round(sum(score), 6) AS score FROM ({_SPREAD.format('a')} UNION ALL {_SPREAD.format('b')}) GROUP BY id ORDER BY sum(score) DESC, id LIMIT {n}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"SELECT id, round(score, 6) AS score FROM ({_top(_DENSE, 50)})")
def dense_top_k(spark, d):
    return _rounded(celled(spark, d).top_k(asked(spark, d), 50))


@query(f"SELECT id, round(score, 6) AS score FROM ({_top(_DENSE, 50)})")
def dense_scan(spark, d):
    """The same rows by a scan of all vectors."""
    return _rounded(vectors.dense_top_k(embedded(spark, d), asked(spark, d), 50))


@query(f"SELECT id, round(score, 6) AS score FROM ({_top(_DENSE + ' WHERE label IN (1, 3)', 20)})")
def dense_top_k_filtered(spark, d):
    return _rounded(vectors.dense_top_k(embedded(spark, d), asked(spark, d), 20, where=F.col("label").isin(1, 3)))


@query(f"SELECT id, round(score, 6) AS score FROM ({_top(_sparse(), 40)})")
def sparse_top_k(spark, d):
    return _rounded(posted(spark, d).top_k(TEXT, 40))


@query(f"SELECT id, round(score, 6) AS score FROM ({_top(_sparse(), 40)})")
def sparse_scan(spark, d):
    """The same rows by a scan of all texts."""
    return _rounded(vectors.sparse_top_k(docs(spark, d), TEXT, 40))


@query(f"SELECT id, round(score, 6) AS score FROM ({_top(_sparse(where='n_chars > 900'), 30)})")
def sparse_top_k_filtered(spark, d):
    """A filter's ids meet the postings before the cut."""
    return _rounded(posted(spark, d).top_k(TEXT, 30, allowed=docs(spark, d).where("n_chars > 900")))


@query(f"""WITH x AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
 n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT term, count(*) AS documents, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0))), 6) AS most FROM c JOIN n USING (doc_id) GROUP BY term""")
def posting_index(spark, d):
    """The stored index, term by term: documents and the highest weight of its blocks.  Builds it where it is missing."""
    held = spark.read.parquet(f"{posted(spark, d).path}/blocks")
    return held.groupBy("term").agg(F.sum(F.size("postings")).alias("documents"), F.round(F.max("most"), 6).alias("most"))


@query("SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda v: CAST(round(v::DOUBLE * 1000) AS INTEGER)), ',') AS vector FROM embeddings")
def vector_index(spark, d):
    """The stored cells, vector by vector.  Builds them where they are missing."""
    held = spark.read.parquet(f"{celled(spark, d).path}/vectors")
    return held.select("id", F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string")), ",").alias("vector"))


@query("""WITH x AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
 u AS (SELECT id, len(w) AS n, unnest(w) AS term FROM x), c AS (SELECT id, n, term, count(*) AS tf FROM u GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT id, c.term, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)) * ln(1 + ((SELECT count(*) FROM x) - df + 0.5) / (df + 0.5)), 6) AS weight FROM c JOIN f USING (term)""")
def bm25_weights_idf(spark, d):
    return vectors.bm25_weights(docs(spark, d), idf=True).withColumn("weight", F.round("weight", 6))


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN len(list_distinct({_WORDS})) ELSE 0 END::BIGINT AS terms FROM documents")
def sparse_failures(spark, d):
    """A text that failed has an empty sparse vector: no terms, and its document stays."""
    x = docs(spark, d).withColumn("text", F.when(F.col("id") % 5 > 0, F.col("text")))
    terms = vectors.bm25_weights(x).groupBy("id").agg(F.count("*").alias("terms"))
    return x.select("id").join(terms, "id", "left").select("id", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_top(_sparse(), 25)})")
def sparse_index_top_k(spark, d):
    stored = vectors.bm25_weights(docs(spark, d))
    return _rounded(vectors.index_top_k(stored, TEXT, 25))


@query(_dbsf(_top(_DENSE, 60), _top(_sparse(), 16), 20))
def hybrid_dbsf(spark, d):
    return _rounded(search.hybrid(docs(spark, d), TEXT, asked(spark, d), 20, posted=posted(spark, d), celled=celled(spark, d)))


def _rrf(n: int) -> str:
    one = "SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS score FROM {0}"
    return f"WITH a AS ({_top(_DENSE, n)}), b AS ({_top(_sparse(), n)}) SELECT id, round(sum(score), 6) AS score FROM ({one.format('a')} UNION ALL {one.format('b')}) GROUP BY id ORDER BY sum(score) DESC, id LIMIT {n}"


@query(_rrf(20))
def hybrid_rrf(spark, d):
    return _rounded(search.hybrid(docs(spark, d), TEXT, asked(spark, d), 20, how="rrf", posted=posted(spark, d), celled=celled(spark, d)))


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM ({_sparse(where=chr(39) + 'en' + chr(39) + ' = lang')}) ORDER BY score DESC, id LIMIT 10 OFFSET 5)")
def sparse_search_page(spark, d):
    return _rounded(search.hybrid(docs(spark, d), TEXT, None, 10, offset=5, where=F.col("lang") == "en"))


@query(f"SELECT x.*, (SELECT count(*) FROM documents WHERE lang IN ('en', 'fr')) AS total, count(*) OVER () AS on_page FROM (SELECT id, round(score, 6) AS score FROM ({_top(_sparse(where=chr(34) + 'lang' + chr(34) + ' IN ' + str(('en', 'fr'))), 12)})) x")
def case_search(spark, d):
    return _rounded(search.case_search(docs(spark, d), TEXT, None, 12, courts=["en", "fr"], court_column="lang"))


@query(f"WITH a AS ({_top(_sparse(where='n_chars >= 700'), 30)}) SELECT id, round(100 * score / (SELECT max(score) FROM a), 2) AS score FROM a")
def bulk_search(spark, d):
    return search.bulk_search(docs(spark, d), TEXT, None, 30, first=700, year_column="n_chars")


@query(f"WITH a AS ({_top(_sparse('(SELECT * FROM benchmark)', 'item_id'), 15)}) SELECT id, round(score / (SELECT max(score) FROM a), 6) AS score FROM a")
def title_search(spark, d):
    acts = t(spark, d, "benchmark").withColumnRenamed("item_id", "id").withColumns({"type": F.lit("ukpga"), "year": F.lit(2000)})
    return _rounded(search.title_search(acts, TEXT, None, 15, category="primary", first=1990))


# the same searches with a vector, over documents that have one
_BOTH = "(SELECT d.*, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"


def both(spark, d) -> DataFrame:
    return docs(spark, d).join(embedded(spark, d).drop("label"), "id")


def _lists(where: str, dense: int, sparse: int) -> str:
    near = f"SELECT doc_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS score FROM {_BOTH} WHERE {where}"
    return f"a AS ({_top(near, dense)}), b AS ({_top(_sparse(_BOTH, where=where), sparse)})"


_BY_SPREAD = f"SELECT id, sum(score) AS score FROM ({_SPREAD.format('a')} UNION ALL {_SPREAD.format('b')}) GROUP BY id"
_BY_RANK = "SELECT id, sum(score) AS score FROM (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS score FROM a UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM b) GROUP BY id"


def _page(fused: str, size: int, offset: int = 0) -> str:
    return f"SELECT id, score FROM ({fused}) ORDER BY score DESC, id LIMIT {size} OFFSET {offset}"


@query(f"WITH {_lists(chr(34) + 'lang' + chr(34) + ' IN ' + str(('en', 'fr')) + ' AND n_chars >= 300', 45, 12)} SELECT id, round(score, 6) AS score FROM ({_page(_BY_SPREAD, 10, 5)})")
def section_search_fused(spark, d):
    return _rounded(search.section_search(both(spark, d), TEXT, asked(spark, d), 10, 5, types=["en", "fr"], first=300, type_column="lang", year_column="n_chars"))


@query(f"WITH {_lists('true', 45, 12)}, c AS ({_page(_BY_SPREAD, 15)}) SELECT id, round(score / (SELECT CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END FROM c), 6) AS score FROM c")
def title_search_fused(spark, d):
    acts = both(spark, d).withColumns({"type": F.lit("ukpga"), "year": F.lit(2000)})
    return _rounded(search.title_search(acts, TEXT, asked(spark, d), 15, category="primary", first=1990))


_FRENCH = "lang IN ('fr', 'de')"


@query(f"WITH {_lists(_FRENCH, 15, 15)} SELECT id, round(score, 6) AS score, (SELECT count(*) FROM {_BOTH} WHERE {_FRENCH}) AS total, count(*) OVER () AS on_page FROM ({_page(_BY_RANK, 12, 3)})")
def case_search_fused(spark, d):
    return _rounded(search.case_search(both(spark, d), TEXT, asked(spark, d), 12, 3, courts=["fr", "de"], court_column="lang"))


@query(f"WITH {_lists('n_chars >= 500', 20, 20)} SELECT id, round(score, 6) AS score, (SELECT count(*) FROM {_BOTH} WHERE n_chars >= 500) AS total, count(*) OVER () AS on_page FROM ({_page(_BY_RANK, 20)})")
def summary_search(spark, d):
    return _rounded(search.case_search(both(spark, d), TEXT, asked(spark, d), first=500, year_column="n_chars"))


_SOURCES = "source IN ('src1', 'src2', 'src3')"


@query(f"WITH {_lists(_SOURCES, 10, 10)} SELECT id, round(score, 6) AS score, (SELECT count(*) FROM {_BOTH} WHERE {_SOURCES}) AS total, count(*) OVER () AS on_page FROM ({_page(_BY_RANK, 10)})")
def case_section_search(spark, d):
    return _rounded(search.case_search(both(spark, d), TEXT, asked(spark, d), 10, divisions=["src1", "src2", "src3"], division_column="source"))


@query(f"WITH {_lists(_FRENCH + ' AND ' + _SOURCES, 9, 9)} SELECT id, round(score, 6) AS score FROM ({_page(_BY_RANK, 9)})")
def note_search(spark, d):
    notes = both(spark, d).withColumnsRenamed({"lang": "note_type", "source": "section_type"}).withColumn("legislation_id", F.lit("x"))
    return _rounded(search.note_search(notes, TEXT, asked(spark, d), 9, act="x", note_types=["fr", "de"], section_types=["src1", "src2", "src3"]))


@query(f"WITH {_lists('n_chars >= 700', 90, 24)}, c AS ({_page(_BY_SPREAD, 30)}) SELECT id, round(100 * score / (SELECT CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END FROM c), 2) AS score FROM c")
def bulk_search_fused(spark, d):
    return search.bulk_search(both(spark, d), TEXT, asked(spark, d), 30, first=700, year_column="n_chars")


@query(f"WITH a AS ({_top(_DENSE, 30)}) SELECT id, round(score / (SELECT CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END FROM a), 6) AS score FROM a")
def normalised_by_max(spark, d):
    return _rounded(fusion.by_max(vectors.dense_top_k(embedded(spark, d), asked(spark, d), 30)))


@query(f"WITH a AS ({_top(_DENSE, 30)}) SELECT id, round(100 * score, 2) AS score FROM a")
def scores_in_percent(spark, d):
    return vectors.dense_top_k(embedded(spark, d), asked(spark, d), 30).select("id", fusion.percent(F.col("score")).alias("score"))


@query("""WITH x AS (SELECT abs(unnest(embedding)::DOUBLE) AS a FROM embeddings), b AS (SELECT max(a) / 127 AS step FROM x)
SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda v: CAST(round(v::DOUBLE / step) AS INTEGER)), ',') AS q FROM embeddings, b""")
def quantised_vectors(spark, d):
    q = vectors.quantise(embedded(spark, d), quantile=1.0)
    return q.select("id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


def _pool(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = docs(spark, d)
    found = vectors.sparse_top_k(x, TEXT, search.POOL, keep=["source", "lang", "n_chars"])  # the texts are read once, for what a hit shows too
    sections = found.select("id", "score", F.col("source").alias("act"), F.col("id").alias("number"), F.lit("section").alias("kind"), F.concat(F.lit("part of "), "source").alias("title"), F.col("lang").alias("type"), (F.col("n_chars") % 100).alias("year"))
    items = t(spark, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("id"), "text")
    titles = fusion.by_max(vectors.sparse_top_k(items, TEXT, search.TITLES))
    acts = x.where("source <> 'src3'").groupBy("source").agg(F.min("lang").alias("type"), F.count("*").alias("year")).select(F.col("source").alias("id"), F.concat(F.lit("Act "), "source").alias("title"), "type", "year")
    return sections, titles, acts


@query(f"""WITH f AS ({_top(_sparse(), 200)}),
 s AS (SELECT f.id, f.score, source AS act, lang AS type, n_chars % 100 AS year, row_number() OVER (ORDER BY score DESC, f.id) AS place FROM f JOIN documents d ON d.doc_id = f.id),
 b AS ({_top(_sparse("(SELECT 'src' || item_id AS k, text FROM benchmark)", "k"), 20)}),
 tt AS (SELECT id AS t_act, score / (SELECT CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END FROM b) AS t_score FROM b),
 tp AS (SELECT *, row_number() OVER (ORDER BY t_score DESC, t_act) AS t_place FROM tt),
 m AS (SELECT coalesce(act, t_act) AS act, id, place, t_place, type, year,
   CASE WHEN place IS NULL THEN t_score WHEN t_score IS NOT NULL THEN least(1.0, score + 0.3 * t_score) ELSE score END AS score FROM s FULL JOIN tp ON act = t_act),
 r AS (SELECT *, row_number() OVER (PARTITION BY act ORDER BY score DESC, place) AS nth FROM m),
 g AS (SELECT act, min(place) AS first, min(t_place) AS by_title,
   string_agg(CASE WHEN place IS NULL THEN 'title' ELSE id::VARCHAR END, ',' ORDER BY nth) AS sections, arg_min(type, nth) AS st, arg_min(year, nth) AS sy FROM r WHERE nth <= 10 GROUP BY act),
 o AS (SELECT *, row_number() OVER (ORDER BY first NULLS LAST, by_title NULLS LAST, act) AS position, count(*) OVER () AS total FROM g),
 a AS (SELECT source AS id, 'Act ' || source AS title, min(lang) AS type, count(*) AS year FROM documents WHERE source <> 'src3' GROUP BY source)
SELECT position, act, CASE WHEN a.id IS NULL THEN CASE WHEN first IS NULL THEN NULL ELSE 'part of ' || act END ELSE a.title END AS title,
 CASE WHEN a.id IS NULL THEN st ELSE a.type END AS type, CASE WHEN a.id IS NULL THEN sy ELSE a.year END AS year,
 CASE WHEN a.id IS NULL THEN 'stub' ELSE '' END AS status, sections, total
FROM o LEFT JOIN a ON a.id = o.act WHERE position BETWEEN 4 AND 23""")
def act_search(spark, d):
    out = search.act_search(*_pool(spark, d), size=20, offset=3)
    shown = F.transform("sections", lambda s: F.when(s["provision_type"] == "title_match", "title").otherwise(s["number"]))
    return out.withColumn("sections", F.array_join(shown, ","))


# --- filters and projections -----------------------------------------------


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus IN ('O', 'P')")
def filter_types_and_years(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    return x.where(filters.acts(["O", "P"], None, 1996, 1998, type_column="o_orderstatus")).select("o_orderkey", "year")


@query("SELECT doc_id, source FROM documents WHERE source = 'src1'")
def filter_one_act_beats_others(spark, d):
    x = t(spark, d, "documents")
    return x.where(filters.provisions("src1", ["fr"], None, 1990, 1991, act_column="source", type_column="lang", year_column="n_chars")).select("doc_id", "source")


@query("SELECT type, count(*) AS n FROM (SELECT unnest(['ukpga','wsi','eur','asp','uksi','ukla']) AS type, doc_id FROM documents) WHERE type IN ('ukpga','asp','asc','anaw','ukcm','nia') GROUP BY type")
def filter_category(spark, d):
    kinds = F.explode(F.array(*map(F.lit, ["ukpga", "wsi", "eur", "asp", "uksi", "ukla"])))
    return t(spark, d, "documents").select(kinds.alias("type")).where(filters.acts(category="primary", year_column="x")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'es') AND source IN ('src1', 'src2', 'src3') AND n_chars >= 1000")
def filter_court_division_years(spark, d):
    return t(spark, d, "documents").where(filters.cases(["de", "es"], ["src1", "src2", "src3"], 1000, court_column="lang", division_column="source", year_column="n_chars")).select("doc_id")


@query("SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY l_orderkey HAVING list_has_any(list(l_partkey), [1, 2, 3, 5, 8, 13])")
def filter_array_overlap(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return x.where(filters.overlaps("parts", [1, 2, 3, 5, 8, 13])).select("l_orderkey", F.size("parts").cast("long").alias("parts"))


@query("SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND length(trim(text)) >= 100")
def filter_present_and_long(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return x.where(filters.present("toxic") & filters.enough_text("text")).select("doc_id", "toxic")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND lang <> 'en'")
def filter_explainable(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return x.withColumn("lang", F.when(F.col("lang") == "en", "Coming into Force").otherwise(F.col("lang"))).where(filters.explainable("quality", "lang")).select("doc_id")


@query("SELECT doc_id, substring(text, 1, 900000) AS text, length(text) > 900000 AS cut FROM documents WHERE length(text) >= 500")
def summary_eligible(spark, d):
    good, text, cut = filters.summary_text("text")
    return t(spark, d, "documents").where(good).select("doc_id", text.alias("text"), cut.alias("cut"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ing') OR contains(lower(p_type), 'ing') OR contains(p_size::VARCHAR, 'ing')")
def filter_mentions(spark, d):
    return t(spark, d, "part").where(filters.mentions("ING", "p_name", "p_type", "p_size")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part")
def filter_of_short_queries(spark, d):
    return t(spark, d, "part").where(filters.mentions("zz", "p_name")).select("p_partkey")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (length(text) > 200) > 0")
def filter_present_arrays(spark, d):
    x = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.length("text") > 200, F.col("turn"))).alias("long"))
    return x.where(filters.present("long", array=True)).select("conv_id")


@query("SELECT * EXCLUDE (text, n_chars) FROM documents")
def columns_left_out(spark, d):
    return lookup.without(t(spark, d, "documents"), "text", "n_chars")


@query("SELECT page_id, url FROM pages WHERE NOT contains(url, '/0000')")
def filter_placeholders(spark, d):
    return t(spark, d, "pages").where(filters.no_placeholder("url")).select("page_id", "url")


@query("SELECT page_id FROM pages WHERE page_id % 5 > 0")
def filter_made_placeholders(spark, d):
    url = F.concat("url", F.when(F.col("page_id") % 5 == 0, "/0000/1").otherwise("/1"))
    return t(spark, d, "pages").withColumn("made", F.regexp_replace(url, "/0000(?!/1$)", "")).where(filters.no_placeholder("made")).select("page_id")


_TYPE_ROWS = ", ".join(f"({n}, '{c}', {a}, {b})" for n, (c, _, a, b) in enumerate(TYPES))


@query(f"WITH y(n, code, a, b) AS (VALUES {_TYPE_ROWS}), o AS (SELECT DISTINCT 1960 + (o_orderkey % 60)::INT AS year FROM orders) SELECT year, coalesce(string_agg(code, ',' ORDER BY n) FILTER (WHERE year BETWEEN a AND b), '') AS types FROM o, y GROUP BY year")
def types_active_in_year(spark, d):
    years = t(spark, d, "orders").select((F.col("o_orderkey") % 60 + 1960).cast("int").alias("year")).distinct()
    return years.select("year", F.array_join(filters.active_types(F.col("year")), ",").alias("types"))


@query("SELECT p_partkey, p_size, (p_size + 1250 BETWEEN 1267 AND 2030 AND p_partkey % 7 > 0) AS valid FROM part")
def lookup_validity(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_size", filters.valid_lookup(F.col("p_size") + 1250, F.col("p_partkey") % 7).alias("valid"))


# --- joins ------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(toxic, -1) AS toxic, CASE WHEN l.doc_id IS NULL THEN 'stub' ELSE '' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_with_stub(spark, d):
    known = t(spark, d, "labels").select("doc_id", "toxic", F.lit("").alias("status"))
    return t(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("status", F.lit("stub")).alias("status"))


@query("SELECT coalesce(c.c_custkey, o.o_custkey) AS custkey, c_nationkey, n FROM (SELECT * FROM customer WHERE c_nationkey < 12) c FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) o ON c_custkey = o_custkey")
def full_outer_join(spark, d):
    c = t(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    o = t(spark, d, "orders").where("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    return c.join(o, "custkey", "full_outer")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_items_only(spark, d):
    return ingest.new_only(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id", "doc_id").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id || '-summary' NOT IN (SELECT doc_id || '-summary' FROM labels WHERE quality = 1)")
def without_summary(spark, d):
    made = t(spark, d, "labels").where("quality = 1").select(F.concat(F.col("doc_id").cast("string"), F.lit("-summary")).alias("id"))
    return ingest.new_only(t(spark, d, "documents"), made, F.concat(F.col("doc_id").cast("string"), F.lit("-summary")), "id").select("doc_id")


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def point_lookup(spark, d):
    wanted = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.point_lookup(t(spark, d, "customer"), wanted, "c_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_parents(spark, d):
    found = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.missing(t(spark, d, "orders"), found, "o_custkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_contains(list(l_suppkey), 3)")
def citing_cases(spark, d):
    return lookup.citing_edges(t(spark, d, "lineitem"), 3, "l_orderkey", "l_suppkey")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING list_contains(list(turn), 3)")
def citing_by_array(spark, d):
    x = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("refs"))
    return lookup.citing(x, F.lit(3).cast("long"), "refs").select("conv_id")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey = 11")
def amendments_to(spark, d):
    return lookup.edges_of(t(spark, d, "lineitem"), 11, n=None, changed="l_partkey", affecting="l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 7")
def amendments_made_by(spark, d):
    return lookup.edges_of(t(spark, d, "lineitem"), 7, True, None, changed="l_partkey", affecting="l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey")


def _provision_edges(spark, d) -> DataFrame:
    """Edges between provisions: order and line on one side, part and supplier on the other."""
    x = t(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.concat(F.lit("part/"), (F.col("l_partkey") % 100).cast("string")).alias("changed_provision_url"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("affecting_provision_url"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 100 = 11")
def amendments_to_provision(spark, d):
    return lookup.edges_of(_provision_edges(spark, d), "part/11", n=None, changed="changed_provision_url", affecting="affecting_provision_url").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 7")
def amendments_made_by_provision(spark, d):
    return lookup.edges_of(_provision_edges(spark, d), "supplier/7", True, None, changed="changed_provision_url", affecting="affecting_provision_url").select("l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT l_partkey % 40 AS a, 0 AS side FROM lineitem UNION ALL SELECT l_suppkey % 40, 1 FROM lineitem)
SELECT 'http://www.legislation.gov.uk/id/ukpga/2000/' || a AS act, count(*) FILTER (side = 0) AS changed_by, count(*) FILTER (side = 1) AS affecting FROM e GROUP BY a""")
def amendments_by_act(spark, d):
    tail = {c: F.concat(F.lit("ukpga/2000/"), (F.col(c) % 40).cast("string")) for c in ("l_partkey", "l_suppkey")}
    sites = F.array(*(F.lit(f"{s}://www.legislation.gov.uk/{i}") for s in ("http", "https") for i in ("id/", "")))
    url = {c: F.concat(F.element_at(sites, (F.col("l_linenumber") % 4 + 1).cast("int")), tail[c]) for c in tail}  # all four spellings
    return audit.changes_by_act(t(spark, d, "lineitem"), F.array(*(U.normalise_uri(u) for u in url.values())))


@query("SELECT conv_id, count(*) AS notes FROM conversations GROUP BY 1")
def notes_by_act(spark, d):
    return audit.notes_by_act(t(spark, d, "conversations"), "conv_id")


_CHANGE = "SELECT l_partkey, max(year(l_shipdate))::INT AS last_change FROM lineitem WHERE l_partkey IS NOT NULL AND year(l_shipdate) > 0 GROUP BY 1"


def _edges(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"))


@query(_CHANGE)
def last_change(spark, d):
    return ingest.last_change(_edges(spark, d), "l_partkey", "year")


@query(f"SELECT c.l_partkey, last_change, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN 1980 + p_size < last_change THEN 'stale' ELSE 'current' END AS state FROM ({_CHANGE}) c LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey")
def staleness(spark, d):
    held = t(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") + 1980).alias("y"))
    return ingest.staleness(ingest.last_change(_edges(spark, d), "l_partkey", "year"), held, "l_partkey", "y").select("l_partkey", "last_change", "state")


@query(f"SELECT p_partkey, p_name, CASE WHEN p_size > 5 THEN 'stale' ELSE 'missing' END AS state FROM ({_CHANGE}) c JOIN part ON p_partkey = l_partkey WHERE p_size <= 5 OR 1980 + p_size < last_change")
def refreshed_documents(spark, d):
    x = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size", (F.col("p_size") + 1980).alias("y"))
    due = ingest.to_refresh(ingest.last_change(_edges(spark, d), "l_partkey", "year"), x.where("p_size > 5"), x.select("l_partkey", "p_name"), "l_partkey", "y")
    return due.select(F.col("l_partkey").alias("p_partkey"), "p_name", "state")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failure' ELSE 'success' END AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def document_loop(spark, d):
    """One run over what no run has done: each document is read, and what can't be read is recorded as failed."""
    from quillspark import shred

    todo = ingest.new_only(t(spark, d, "documents"), t(spark, d, "labels").where("quality = 1"), "doc_id", "doc_id")
    xml = F.when(F.col("doc_id") % 3 == 0, "<broken").otherwise("<a>x</a>")
    read = todo.select("doc_id", shred.records(_one_row, "n int", xml).alias("r"))
    return read.select("doc_id", ingest.outcome(F.col("r.error"), F.lit(False))["status"].alias("status"))


def _one_row(text: str) -> list[dict]:
    from quillspark.shred.tree import parse

    return [{"n": len(parse(text).text)}]


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey // 2")
def edge_to_parent_text(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return t(spark, d, "lineitem").withColumn("k", F.floor(F.col("l_partkey") / 2)).join(p, "k", "left").select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT event_id, user_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id::INT % 50 END, min(CASE WHEN event_id % 3 = 0 THEN event_id::INT % 50 END) OVER (PARTITION BY user_id)) AS year FROM events")
def year_from_text_of_act(spark, d):
    x = t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 50).cast("int")).alias("year"))
    return ingest.spread_year(x, "user_id", "year").select("event_id", "user_id", "year")


# --- aggregates -------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (quality = 0) AS n_low, count(*) FILTER (quality = 1) AS n_high, count(*) FILTER (quality IS NULL) AS n_none FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_counts(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select(F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("s"))
    return audit.coverage(x, "s", ["low", "high"])


@query("""SELECT CASE WHEN y < 1996 THEN 'before 1996' WHEN y < 1998 THEN '1996-1997' WHEN y < 2000 THEN '1998-1999' ELSE '2000+' END AS period, count(*) AS total,
 count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY 1""")
def year_histogram(spark, d):
    return audit.histogram(t(spark, d, "orders"), F.year("o_orderdate"), [1996, 1998, 2000], "o_orderstatus", ["F", "O"])


@query("""SELECT CASE WHEN y IS NULL THEN NULL WHEN y < 1996 THEN 'before 1996' WHEN y < 1998 THEN '1996-1997' ELSE '1998+' END AS period, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_F
FROM (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS y FROM orders) GROUP BY 1""")
def year_histogram_with_unknown(spark, d):
    x = t(spark, d, "orders").withColumn("y", F.when(F.col("o_orderkey") % 7 > 0, F.year("o_orderdate")))
    return audit.histogram(x, F.col("y"), [1996, 1998], "o_orderstatus", ["F"])


@query("SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1 FROM documents GROUP BY lang HAVING count(*) > 0")
def counts_by_key_types(spark, d):
    return t(spark, d, "documents").groupBy("lang").pivot("source", ["src0", "src1"]).count().na.fill(0)


@query("SELECT coalesce(lang, 'total') AS lang, coalesce(source, 'total') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_totals(spark, d):
    return t(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("total")).alias("lang"), F.coalesce("source", F.lit("total")).alias("source"), "n")


@query("SELECT name, n FROM (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events)")
def points_by_collection(spark, d):
    return audit.counts_of({n: t(spark, d, n) for n in ("documents", "pages", "events")})


@query("SELECT event_type, format('{:,}', count(*)) AS n FROM events GROUP BY 1")
def formatted_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(audit.formatted(F.count("*")).alias("n"))


@query("SELECT user_id, count(*) FILTER (value > 0) AS successes, count(*) FILTER (value <= 0) AS failures, count(*) AS total FROM events GROUP BY 1")
def tracker_stats(spark, d):
    return audit.tracker_stats(t(spark, d, "events").withColumn("status", F.when(F.col("value") > 0, "success").when(F.col("value") <= 0, "failure")), "user_id")


@query("""SELECT l_returnflag AS kind, count(*) AS n, round(avg((l_discount > 0.05)::INT), 6) AS success_rate, sum(l_partkey)::BIGINT AS input_tokens, sum(l_suppkey)::BIGINT AS output_tokens, sum(l_orderkey)::BIGINT AS cached_tokens,
 round(avg(l_quantity), 6) AS avg_seconds, round((sum(l_partkey) * 0.15 + sum(l_suppkey) * 0.60 + sum(l_orderkey) * 0.075) / 1000000, 6)::DOUBLE AS cost FROM lineitem GROUP BY 1""")
def extraction_progress(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_discount") > 0.05).alias("success"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.col("l_orderkey").alias("cached_tokens"), F.col("l_quantity").alias("seconds"))
    return audit.progress(x, "kind")


@query("SELECT min(length(text)) AS shortest, max(length(text)) AS longest, sum(length(text))::BIGINT // count(*) AS mean FROM documents")
def text_lengths(spark, d):
    return audit.lengths(t(spark, d, "documents"), "text").select(F.col("shortest").cast("long"), F.col("longest").cast("long"), "mean")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, round(coalesce(stddev_samp(value), 0), 6) AS deviation, row_number() OVER (ORDER BY median(value), event_type) AS rank FROM events GROUP BY 1")
def latency_stats(spark, d):
    return audit.latency(t(spark, d, "events"), "event_type", "value")


@query("SELECT count(*) FILTER (c_nationkey <> c_custkey % 25) AS nation, count(*) FILTER (c_mktsegment <> 'BUILDING') AS segment FROM customer")
def changed_fields(spark, d):
    x = t(spark, d, "customer").withColumns({"nation": F.col("c_custkey") % 25, "segment": F.lit("BUILDING")})
    return audit.changed_fields(x, {"nation": ("c_nationkey", "nation"), "segment": ("c_mktsegment", "segment")})


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS tokens, arg_min(text, turn) AS first_text, arg_max(role, turn) AS last_role FROM conversations WHERE length(text) > 0 GROUP BY 1")
def merge_chunks(spark, d):
    x = t(spark, d, "conversations").select("conv_id", "turn", F.array("role").alias("roles"), F.length("text").alias("tokens"), F.col("text").alias("first_text"), F.col("role").alias("last_role"))
    out = audit.merge_chunks(x, "conv_id", "turn", ["roles"], ["tokens"], ["first_text"], ["last_role"], F.col("tokens") > 0)
    return out.withColumn("roles", F.array_join("roles", ","))


@query("SELECT conv_id, count(DISTINCT turn) AS n, min(turn) AS low, max(turn) AS high, min(turn) = 1 AND max(turn) = count(DISTINCT turn) AS complete FROM conversations GROUP BY 1")
def numbering_gaps(spark, d):
    return audit.numbering_gaps(t(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT lang AS collection, count(*) AS records, sum(length(text))::BIGINT AS bytes FROM documents GROUP BY 1 UNION ALL SELECT 'total', count(*), sum(length(text))::BIGINT FROM documents")
def manifest(spark, d):
    return audit.manifest(t(spark, d, "documents"), "lang", F.length("text"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS full_text FROM conversations GROUP BY 1")
def full_text(spark, d):
    x = t(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "user", "section").otherwise("schedule").alias("kind"), "turn", "text", F.col("turn").alias("id"))
    return lookup.full_text(x, act_col="conv_id", kind_col="kind", number_col="turn")


@query("""SELECT c.conv_id, c.turns, coalesce(string_agg(v.text, chr(10) || chr(10) ORDER BY CASE WHEN v.role = 'user' THEN 0 ELSE 1 END, v.turn), 'No text was found for this act.') AS full_text
FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) c LEFT JOIN (SELECT * FROM conversations WHERE conv_id % 3 > 0) v USING (conv_id) GROUP BY 1, 2""")
def acts_with_text(spark, d):
    x = t(spark, d, "conversations")
    provisions = x.where("conv_id % 3 > 0").select("conv_id", F.when(F.col("role") == "user", "section").otherwise("schedule").alias("kind"), "turn", "text", F.col("turn").alias("id"))
    return lookup.acts_with_text(x.groupBy("conv_id").agg(F.count("*").alias("turns")), provisions, "conv_id", kind_col="kind", number_col="turn")


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, count(*) FILTER (value <= 2.5) AS le_2_5, count(*) FILTER (value <= 10) AS le_10 FROM events GROUP BY 1")
def request_histograms(spark, d):
    return audit.histogram_of(t(spark, d, "events"), ["event_type"], "value", [2.5, 10])


@query("SELECT l_orderkey, count(*) + sum(l_linenumber)::BIGINT AS refs FROM lineitem GROUP BY 1")
def reference_totals(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("own"), F.collect_list(F.array_repeat("l_partkey", F.col("l_linenumber"))).alias("inner"))
    return x.select("l_orderkey", audit.reference_totals("own", "inner").cast("long").alias("refs"))


# --- windows, order, sets ---------------------------------------------------


@query("SELECT source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 10")
def top_ten_of_each(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("rank"), "n_chars").where("rank <= 10").drop("n_chars")


@query("SELECT source, n, position, total FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS position, count(*) OVER () AS total FROM documents GROUP BY source) WHERE position BETWEEN 6 AND 15")
def page_of_groups(spark, d):
    groups = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return lookup.page(groups, [F.desc("n"), F.col("source")], 10, 5)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def running_heading(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("heading"), F.row_number().over(w).cast("long").alias("position"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_newest_fifty(spark, d):
    x = t(spark, d, "events").withColumn("k", F.concat_ws("|", "user_id", "event_type"))
    return ingest.latest(x, "k", "ts", "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def last_three_then_distinct(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_type").distinct()


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark, d):
    x = t(spark, d, "events")
    old, new = x.where("event_id % 2 = 0"), x.where("event_id % 2 = 1")
    merged = ingest.latest(old.unionByName(new), "user_id", "ts", "event_id")
    return merged.select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_new_over_old(spark, d):
    x = t(spark, d, "events")
    return ingest.upsert(x.where("event_id % 2 = 0"), x.where("event_id % 2 = 1"), "user_id", "event_id").select("user_id", "event_id")


_KEY = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0}::VARCHAR))"
_UUID = f"(substr({_KEY}, 1, 8) || '-' || substr({_KEY}, 9, 4) || '-5' || substr({_KEY}, 14, 3) || '-' || substr('89ab', (('0x' || substr({_KEY}, 17, 1))::INT % 4) + 1, 1) || substr({_KEY}, 18, 3) || '-' || substr({_KEY}, 21, 12))"


@query(f"SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE lang = 'fr' ORDER BY {_UUID.format('doc_id')} LIMIT 25")
def filter_only_search(spark, d):
    return search.hybrid(docs(spark, d), " ", None, 25, where=F.col("lang") == "fr")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey = 10")
def act_lookup(spark, d):
    acts = t(spark, d, "part").select("p_partkey", "p_size", F.lit("ukpga").alias("type"), (F.col("p_size") % 50 + 1960).alias("year"), F.col("p_partkey").alias("number"))  # years that can be, whatever the size
    year = acts.where("number = 10").select("year").first()[0]
    return search.act_lookup(acts, "ukpga", year, 10).select("p_partkey", "p_size")


@query(f"SELECT url, {_UUID.format('url')} AS id FROM pages")
def uuid_of_uri(spark, d):
    return t(spark, d, "pages").select("url", U.uuid5("url").alias("id"))


@query(f"SELECT doc_id, n_chars FROM (SELECT * FROM documents WHERE source = 'src2' ORDER BY {_UUID.format('doc_id')} LIMIT 10)")
def limit_then_sort(spark, d):
    return lookup.sections_of(t(spark, d, "documents"), "src2", 10, act_col="source", number_col="n_chars", id_col="doc_id").select("doc_id", "n_chars")


@query(f"SELECT conv_id, turn FROM (SELECT * FROM conversations WHERE conv_id = 2 ORDER BY {_UUID.format('turn')} LIMIT 3)")
def notes_in_order(spark, d):
    return lookup.sections_of(t(spark, d, "conversations"), 2, 3, act_col="conv_id", number_col="turn", id_col="turn").select("conv_id", "turn")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def top_with_offset(spark, d):
    return t(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(20)


@query("SELECT p_partkey, p_name || ' ' || p_partkey AS title FROM part ORDER BY title LIMIT 25")
def titles_in_order(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("title"))
    return search.in_order(x, "title-asc").limit(25)


@query("SELECT doc_id, lang FROM documents ORDER BY lang, source, doc_id LIMIT 60")
def first_documents(spark, d):
    return ingest.first_documents(t(spark, d, "documents"), 60, "lang", "source", "doc_id").select("doc_id", "lang")


@query("SELECT l_orderkey, list_sort(list_distinct(list_concat(list(l_partkey % 5), list(l_suppkey % 7))))::VARCHAR AS refs FROM lineitem GROUP BY 1")
def union_of_references(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 5).alias("a"), F.collect_set(F.col("l_suppkey") % 7).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.array_union("a", "b")), lambda v: v.cast("string")), ", ")
    return x.select("l_orderkey", F.concat(F.lit("["), joined, F.lit("]")).alias("refs"))


@query("SELECT l_partkey AS key FROM lineitem WHERE l_quantity = 50 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def union_missing_and_stale(spark, d):
    a = t(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("key"))
    return a.union(t(spark, d, "part").where("p_size = 1").select("p_partkey")).distinct()


@query("SELECT unnest(range(1990, 1994)) AS year UNION ALL SELECT unnest([1999, 2001, 2002])", name="expand_years")
def expand_years(spark, d):
    return spark.sql("select explode(array({})) as year".format(",".join(f"{y}L" for y in ingest.expand_years("1999,1990-1993 2001-2002,2001"))))


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def union_of_kinds(spark, d):
    parts = [t(spark, d, n).select(F.col(k).alias("id"), F.lit(kind).alias("kind")) for n, k, kind in (("documents", "doc_id", "document"), ("pages", "page_id", "page"), ("benchmark", "item_id", "benchmark"))]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1))::INT AS year FROM orders")
def year_range_of_table(spark, d):
    ends = t(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("year"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations")
def batches_of_three(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, d, "conversations").select("conv_id", "turn", F.floor((F.row_number().over(w) - 1) / 3).alias("batch"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'FIXED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def payload_patch(spark, d):
    x = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ingest.patch(x, x.where("c_custkey % 4 = 0").select("c_custkey", F.lit("FIXED").alias("c_mktsegment")), "c_custkey", "c_mktsegment")


@query("SELECT doc_id, coalesce(length(trim(text)) >= 1000, false) AS kept FROM documents")
def quarantine(spark, d):
    good, bad = ingest.quarantine(t(spark, d, "documents"), filters.enough_text("text", 1000))
    return good.select("doc_id", F.lit(True).alias("kept")).unionByName(bad.select("doc_id", F.lit(False).alias("kept")))


@query("SELECT doc_id, CASE WHEN length(trim(text)) >= 1000 THEN 'xml' ELSE 'fallback' END AS origin FROM documents WHERE length(trim(text)) >= 1000 OR doc_id % 2 = 0")
def ingest_with_fallback(spark, d):
    x = t(spark, d, "documents").select("doc_id", "text")
    return ingest.ingest_flow(x, x.where("doc_id % 2 = 0"), "doc_id", "text", 1000).select("doc_id", "origin")


# --- functions --------------------------------------------------------------


def _from_ids(spark, d, **columns) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


@query("SELECT doc_id, 'http://www.legislation.gov.uk/id/ukpga/' || (1900 + doc_id % 120) || '/' || (doc_id % 60) AS uri FROM documents")
def normalise_uris(spark, d):
    tail = F.concat(F.lit("ukpga/"), (F.col("doc_id") % 120 + 1900).cast("string"), F.lit("/"), (F.col("doc_id") % 60).cast("string"))
    forms = [F.concat(F.lit(a), tail, F.lit(b)) for a, b in (("", ""), ("/", " "), ("https://www.legislation.gov.uk/id/", ""), ("http://www.legislation.gov.uk/", "/enacted"), ("https://www.legislation.gov.uk/", "/made/data.xml"))]
    return _from_ids(spark, d, uri=U.normalise_uri(F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int"))))


@query("SELECT doc_id, 'ukpga' AS type, (1900 + doc_id % 120)::INT AS year, (doc_id % 60)::INT AS number, (doc_id % 9)::INT AS section, 'http://www.legislation.gov.uk/id/ukpga/' || (1900 + doc_id % 120) || '/' || (doc_id % 60) || '/section/' || (doc_id % 9) AS parent FROM documents")
def parts_of_uri(spark, d):
    uri = F.concat(F.lit("http://www.legislation.gov.uk/id/ukpga/"), (F.col("doc_id") % 120 + 1900).cast("string"), F.lit("/"), (F.col("doc_id") % 60).cast("string"), F.lit("/section/"), (F.col("doc_id") % 9).cast("string"))
    return _from_ids(spark, d, type=U.legislation_type(uri), year=U.whole(U.part(uri, 5)), number=U.legislation_number(uri), section=U.section_number(uri), parent=U.parent_section(F.concat(uri, F.lit("/2/a"))))


@query("SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '/(\\d{4})/', 1), '') AS INT), NULL) AS year, nullif(regexp_extract(url, '/([a-z]+)/', 1), '') AS kind FROM pages")
def log_keys(spark, d):
    return t(spark, d, "pages").select("page_id", U.log_year("url").alias("year"), U.log_kind("url").alias("kind"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '/contents.*$', ''), '/+$', '') || '/data.xml' AS link FROM pages")
def data_links(spark, d):
    return t(spark, d, "pages").select("page_id", U.data_url("url").alias("link"))


@query("SELECT doc_id, 'ewhc' AS court, CASE WHEN doc_id % 2 = 0 THEN 'ch' END AS division FROM documents")
def court_of_case(spark, d):
    url = F.concat(F.lit("https://caselaw.nationalarchives.gov.uk/EWHC/"), F.when(F.col("doc_id") % 2 == 0, "Ch/").otherwise(""), F.lit("2017/"), F.col("doc_id").cast("string"))
    return t(spark, d, "documents").select("doc_id", U.case_court(url).alias("c")).select("doc_id", "c.court", "c.division")


@query("SELECT l_orderkey, l_linenumber, 'changed-' || l_partkey || '-prov-' || coalesce(CASE WHEN l_linenumber > 1 THEN l_linenumber::VARCHAR END, 'none') || '-affecting-' || l_suppkey || '-prov-none-type-' || l_returnflag AS id FROM lineitem")
def amendment_ids(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", U.amendment_id(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")), F.col("l_suppkey").cast("string"), F.lit(None).cast("string"), "l_returnflag").alias("id"))


@query("SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN 1837 + doc_id % 60 + 1 WHEN 1 THEN 1910 ELSE 1800 + doc_id % 200 END)::INT AS year FROM documents")
def regnal_years(spark, d):
    base = F.lit("http://www.legislation.gov.uk/id/ukla/")
    n = F.col("doc_id")
    uri = F.when(n % 3 == 0, F.concat(base, F.lit("Vict/"), (n % 60 + 1).cast("string"), F.lit("-"), (n % 60 + 2).cast("string"), F.lit("/12"))).when(n % 3 == 1, F.concat(base, F.lit("Geo5"))).otherwise(F.concat(base, (n % 200 + 1800).cast("string"), F.lit("/7")))
    return t(spark, d, "documents").select("doc_id", fast_year(uri).alias("year"))


@query("SELECT doc_id, replace(replace(replace(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM documents")
def tidy_text(spark, d):
    return t(spark, d, "documents").select("doc_id", T.tidy("text").alias("text"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def iso_dates(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'United Kingdom' WHEN 1 THEN 'England, Wales' WHEN 2 THEN 'Scotland' ELSE '' END AS extent FROM nation")
def extent_names(spark, d):
    code = F.element_at(F.array(*map(F.lit, ["E+W+S+N.I.", "E+W", "S", "Mars"])), F.col("n_nationkey") % 4 + 1)
    return t(spark, d, "nation").select("n_nationkey", T.extent_text(code).alias("extent"))


@query("SELECT p_partkey, (1990 + p_size)::INT AS year, p_partkey::VARCHAR AS number FROM part")
def amendment_cells(spark, d):
    mark = F.element_at(F.array(*map(F.lit, ["c. ", "No. ", "asc ", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    cell = F.concat((F.col("p_size") + 1990).cast("string"), F.lit(" "), mark, F.col("p_partkey").cast("string"))
    return t(spark, d, "part").select("p_partkey", T.year_number(cell).alias("x")).select("p_partkey", "x.year", "x.number")


@query(f"WITH y(n, code, a, b) AS (VALUES {_TYPE_ROWS}) SELECT code, n AS position FROM y".replace("n AS position", "n::BIGINT AS position"))
def type_table(spark, d):
    return spark.sql("select explode(sequence(0L, {}L)) as position".format(len(TYPES) - 1)).select(F.element_at(F.array(*(F.lit(x[0]) for x in TYPES)), F.col("position").cast("int") + 1).alias("code"), "position")


@query("SELECT doc_id, 'part of ' || source || chr(10) || chr(10) || text AS text FROM documents")
def embedding_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", T.embedding_text(F.concat(F.lit("part of "), "source"), F.lit(None).cast("string"), "text").alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'section' WHEN turn % 3 = 1 THEN 'part' END AS kind, CASE WHEN turn % 3 < 2 THEN turn::INT END AS number FROM conversations")
def note_sections(spark, d):
    title = F.concat(F.element_at(F.array(*map(F.lit, ["Section ", "PART ", "Annex "])), (F.col("turn") % 3 + 1).cast("int")), F.col("turn").cast("string"), F.lit(": names"))
    return t(spark, d, "conversations").select("conv_id", "turn", T.note_section(title).alias("x")).select("conv_id", "turn", "x.kind", "x.number")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'provisions' WHEN 1 THEN 'overview' END AS kind FROM nation")
def note_kinds(spark, d):
    routes = [["Introduction", "Section 3"], ["Background", "Other"], ["Annex"]]
    pick = F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in routes)), F.col("n_nationkey") % 3 + 1)
    return t(spark, d, "nation").select("n_nationkey", T.note_type(pick).alias("kind"))


@query("SELECT doc_id, sha256('api_cache:search:{\"lang\": \"' || lang || '\", \"n_chars\": ' || n_chars || '}') AS k FROM documents")
def cache_keys(spark, d):
    return t(spark, d, "documents").select("doc_id", T.cache_key("search", "n_chars", "lang").alias("k"))


@query("SELECT doc_id AS id, length(trim(text)) > 0 AS kept, substring(text, 1, 30000) AS text FROM documents")
def embedding_inputs(spark, d):
    """What goes to the model: whole texts of 30,000 letters at most, and none that is empty."""
    return docs(spark, d).select("id", F.coalesce(filters.enough_text("text", 1), F.lit(False)).alias("kept"), vectors.dense_input(F.col("text")).alias("text"))


@query("SELECT vec_id AS id, CASE WHEN label = 3 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) END AS score FROM embeddings")
def failed_embeddings(spark, d):
    """Vectors that failed are zeros, and score 0."""
    x = embedded(spark, d).withColumn("dense", vectors.embedding_or_zero(F.when(F.col("label") != 3, F.col("dense")), 64))
    return _rounded(vectors.dense_scores(x, asked(spark, d)))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), b AS (SELECT max(abs(x)) / 127 AS step FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)),
 c AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: round(x::DOUBLE / step)) AS z FROM embeddings, b),
 r AS (SELECT vec_id, embedding FROM c, q ORDER BY list_inner_product(z, v) / sqrt(list_inner_product(z, z)) DESC, vec_id LIMIT 80)
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM r, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 20""")
def rescored_top_k(spark, d):
    return _rounded(vectors.rescored_top_k(embedded(spark, d), asked(spark, d), 20, quantile=1.0))


@query("SELECT doc_id || '-summary' AS id, doc_id::VARCHAR AS caselaw_id, left(text, 40) AS text, length(text) AS source_text_length, false AS source_text_truncated FROM documents WHERE length(text) >= 500 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def summaries_made(spark, d):
    """Judgments without a summary get one from a stub model."""
    from quillspark.operators.models import summaries

    cases = docs(spark, d).withColumn("id", F.col("id").cast("string")).select("id", "text")
    made = t(spark, d, "labels").where("quality = 1").select(F.concat(F.col("doc_id").cast("string"), F.lit("-summary")).alias("id"))
    out = summaries(cases, made, lambda text: text[:40], "stub")
    return out.select("id", "caselaw_id", "text", "source_text_length", "source_text_truncated")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE < DATE '1998-06-01' - INTERVAL 28 DAY")
def archives_past_retention(spark, d):
    from datetime import date

    from quillspark.sources.sinks import expired

    return expired(t(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", date(1998, 6, 1)).select("o_orderkey")


@query("SELECT doc_id, sha256(text) AS h, (upper(left(lang, 1)) || substr(lang, 2)) AS name FROM documents")
def digests_and_names(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.initcap("lang").alias("name"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_fields(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 10080 THEN (m // 1440) || 'd ago' WHEN m < 43200 THEN (m // 10080) || 'w ago' WHEN m < 527040 THEN strftime(ts, '%-d %b') ELSE strftime(ts, '%-d %b %Y') END AS age FROM (SELECT event_id, ts, datesub('minute', ts, (SELECT max(ts) FROM events)) AS m FROM events)")
def relative_times(spark, d):
    x = t(spark, d, "events")
    now = x.agg(F.max("ts").alias("now"))
    return x.join(F.broadcast(now)).select("event_id", T.relative_time("ts", "now").alias("age"))


@query("SELECT o_orderkey, CASE WHEN days < 30 THEN (days // 7) || 'w ago' WHEN days <= 365 THEN strftime(o_orderdate, '%-d %b') ELSE strftime(o_orderdate, '%-d %b %Y') END AS age FROM (SELECT *, datesub('minute', o_orderdate, TIMESTAMP '2030-01-01') // 1440 AS days FROM orders) WHERE days >= 7")
def relative_dates(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("now"))
    return x.where(F.timestamp_diff("MINUTE", "ts", "now") >= 7 * 1440).select("o_orderkey", T.relative_time("ts", "now").alias("age"))


@query("SELECT user_id, '10.0.' || user_id % 256 || '.xxx' AS ip, '10.0.' || user_id % 256 || '.7' AS client, CASE WHEN count(*) >= 80 THEN 'exceeded' WHEN count(*) >= 72 THEN 'high' WHEN count(*) >= 56 THEN 'medium' WHEN count(*) >= 40 THEN 'moderate' ELSE 'low' END AS tier FROM events GROUP BY user_id")
def monitoring_labels(spark, d):
    x = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7"))
    return x.select("user_id", T.anonymous_ip(ip).alias("ip"), T.client_ip(F.concat(F.lit("1.2.3.4, "), ip), F.lit("9.9.9.9")).alias("client"), T.usage_tier("n", F.lit(80)).alias("tier"))


@query("SELECT doc_id, left(regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g'), 50) AS name FROM documents")
def safe_names(spark, d):
    return t(spark, d, "documents").select("doc_id", T.safe_name("text").alias("name"))


@query("SELECT p_partkey, p_name || ', ' || c AS oscola, p_name || ', ' || c || ' (UK)' AS bluebook, '[' || p_name || '](u/' || p_partkey || ') (' || c || ')' AS markdown, p_name || ' (' || c || ')' AS plain FROM (SELECT *, upper(p_type) || ' ' || p_size || '/' || p_partkey AS c FROM part)")
def citations(spark, d):
    url = F.concat(F.lit("u/"), F.col("p_partkey").cast("string"))
    return t(spark, d, "part").select("p_partkey", *(T.citation(s, "p_name", F.lower("p_type"), "p_size", "p_partkey", url).alias(s) for s in ("oscola", "bluebook", "markdown", "plain")))


@query("SELECT doc_id, regexp_extract(text, '\\b(1[2-9]\\d\\d|20[0-2]\\d)\\b') AS first_year, len(regexp_extract_all(text, '[0-9]{4}'))::INT AS n FROM documents")
def years_in_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"\b(1[2-9]\d\d|20[0-2]\d)\b", 1).alias("first_year"), F.size(F.regexp_extract_all("text", F.lit(r"[0-9]{4}"), F.lit(0))).alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"'))::INT AS links FROM pages")
def page_title_and_links(spark, d):
    from quillspark.sources.web import links, title

    return t(spark, d, "pages").select("page_id", title("html").alias("title"), F.size(links("html")).alias("links"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def five_minute_stats(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "5 minutes").start.alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE w AS (
  SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id
  UNION ALL
  SELECT w.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.opened + INTERVAL 1 HOUR) FROM w
  WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.opened + INTERVAL 1 HOUR))
SELECT e.event_id, row_number() OVER (PARTITION BY e.user_id, m.opened ORDER BY e.ts, e.event_id) AS hits
FROM events e ASOF JOIN w m ON e.user_id = m.user_id AND e.ts >= m.opened""")
def fixed_window_counts(spark, d):
    from quillspark.streaming.ratelimit import batch_counts

    return batch_counts(t(spark, d, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "hits")


@query("SELECT category, count(*) AS n FROM (VALUES " + ", ".join(f"('{c}', '{x}')" for c, xs in CATEGORIES.items() for x in xs) + ") AS v(category, type) GROUP BY 1")
def category_sizes(spark, d):
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(x).alias("type")) for c, xs in CATEGORIES.items() for x in xs))
    return spark.sql("select 1 as one").select(F.explode(rows).alias("r")).groupBy("r.category").agg(F.count("*").alias("n"))


# --- shredders --------------------------------------------------------------


@query("SELECT doc_id, 'Housing Act ' || (1900 + doc_id % 100) AS act, (doc_id % 50 + 1)::VARCHAR AS section FROM documents WHERE text IS NOT NULL")
def references_in_text(spark, d):
    from quillspark import shred
    from quillspark.shred import references

    n = F.col("doc_id")
    # whole texts, with a reference at their end
    text = F.concat("text", F.lit("\nas required under section "), (n % 50 + 1).cast("string"), F.lit("(2) of the Housing Act "), (n % 100 + 1900).cast("string"), F.lit(", and no other."))
    good, _ = shred.rows(t(spark, d, "documents").select("doc_id", text.alias("x")), references.find, references.REFERENCE, "x", "doc_id")
    return good


@query("SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN 1837 + doc_id % 60 WHEN 1 THEN 1910 + doc_id % 20 ELSE 1700 + doc_id % 200 END)::INT AS year FROM documents")
def regnal_years_of_damaged_citations(spark, d):
    from quillspark.functions.regnal import year_of

    n = F.col("doc_id")
    cited = F.when(n % 3 == 0, F.concat((n % 60 + 1).cast("string"), F.lit(" Vict. c. xii"))).when(n % 3 == 1, F.concat((n % 20 + 1).cast("string"), F.lit("-Geo-5-c-7"))).otherwise(F.concat(F.lit("local/Some_Railway_Act_"), (n % 200 + 1700).cast("string"), F.lit("_c.86")))
    return t(spark, d, "documents").select("doc_id", year_of(cited).alias("year"))


@query("SELECT doc_id, 'u/' || doc_id || '/section/' || s AS uri, s::VARCHAR AS number, s || ') ' || trim(text, ' ' || chr(10) || chr(9)) || ' ' AS text FROM (SELECT doc_id, text, unnest([1, 2]) AS s FROM documents) WHERE length(trim(text, ' ' || chr(10) || chr(9))) > 0")
def provisions_of_acts(spark, d):
    """Whole texts as the words of two sections each."""
    from quillspark import shred
    from quillspark.shred import clml

    i = F.col("doc_id").cast("string")
    words = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = [F.concat(F.lit('<P1 IdURI="u/'), i, F.lit(f'/section/{s}"><Pnumber>{s}</Pnumber><P1para><Text>'), words, F.lit("</Text></P1para></P1>")) for s in (1, 2)]
    xml = F.concat(F.lit('<Legislation xmlns="urn:x"><Body>'), *one, F.lit("</Body></Legislation>"))
    good, _ = shred.rows(t(spark, d, "documents").where(F.trim(F.translate("text", "\n\t", "  ")) != "").select("doc_id", xml.alias("x")), clml.provisions, clml.PROVISION, "x", "doc_id")
    return good.select("doc_id", "uri", "number", "text")


@query("SELECT page_id, 'Commentary' AS route, 'Text ' || page_id AS text, 0::INT AS position FROM pages WHERE contains(html, '</body>')")
def notes_of_pages(spark, d):
    """Whole pages, with a note at their end."""
    from quillspark import shred
    from quillspark.shred import pages

    note = F.concat(F.lit("<h2>Commentary</h2><p>Text "), F.col("page_id").cast("string"), F.lit("</p></body>"))
    page = F.replace("html", F.lit("</body>"), note)
    good, _ = shred.rows(t(spark, d, "pages").select("page_id", page.alias("x")), pages.notes, pages.NOTE, "x", "page_id")
    return good.select("page_id", F.array_join("route", "/").alias("route"), "text", F.col("order").alias("position"))


def _windows(hours: int, name: str) -> str:
    return f"""{name} AS (
  SELECT user_id, min(ts) AS opened FROM x GROUP BY user_id
  UNION ALL
  SELECT w.user_id, (SELECT min(e.ts) FROM x e WHERE e.user_id = w.user_id AND e.ts >= w.opened + INTERVAL {hours} HOUR) FROM {name} w
  WHERE EXISTS (SELECT 1 FROM x e WHERE e.user_id = w.user_id AND e.ts >= w.opened + INTERVAL {hours} HOUR))"""


@query(f"""WITH RECURSIVE x AS (SELECT * FROM events WHERE event_type <> 'click'), {_windows(48, "v")}, {_windows(240, "w")},
 a AS (SELECT e.event_id, row_number() OVER (PARTITION BY e.user_id, m.opened ORDER BY e.ts, e.event_id) AS n FROM x e ASOF JOIN v m ON e.user_id = m.user_id AND e.ts >= m.opened),
 b AS (SELECT e.event_id, row_number() OVER (PARTITION BY e.user_id, m.opened ORDER BY e.ts, e.event_id) AS n FROM x e ASOF JOIN w m ON e.user_id = m.user_id AND e.ts >= m.opened)
SELECT e.event_id, CASE WHEN coalesce(a.n, 0) > 3 OR coalesce(b.n, 0) > 9 THEN 429 ELSE 200 END::INT AS status, greatest(0, 3 - coalesce(a.n, 0))::BIGINT AS left_minute, greatest(0, 9 - coalesce(b.n, 0))::BIGINT AS left_hour
FROM events e LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""")
def rate_limit_decisions(spark, d):
    """Both counters, with windows and limits that fit the events."""
    from quillspark.streaming.ratelimit import EXEMPT, limited

    path = F.when(F.col("event_type") == "click", EXEMPT).otherwise("/x")
    out = limited(t(spark, d, "events"), "user_id", "ts", "event_id", path, per_minute=3, per_hour=9, seconds=(48 * 3600, 240 * 3600))
    return out.select("event_id", "status", "left_minute", "left_hour")


from quillspark.plans import flows, forms, injected, stored  # noqa: E402, F401 - they register their queries here
