"""Queries that run whole flows over the driver's tables: crawls, listings, the loop on a stream, versioned tables, sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import audit, crawl, ingest
from quillspark.operators.progress import Watch
from quillspark.plans.catalog import query, t
from quillspark.session import scratch
from quillspark.shred import tables
from quillspark.shred.judgment import each_section
from quillspark.sources import listing
from quillspark.sources.table import Table
from quillspark.streaming import loop


def _folder(spark) -> str:
    return f"{scratch(spark)}/flows-{uuid.uuid4().hex}"


def _anchor(address) -> Column:
    return F.concat(F.lit('<a href="'), address, F.lit('">x</a>'))


def _at(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _escaped(text) -> Column:
    """A text inside an element, whatever it holds."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


# --- crawls -----------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT '/p/' || page_id AS a, '/p/' || (page_id * 2 + 1) AS b FROM pages UNION ALL SELECT '/p/' || page_id, '/p/' || (page_id // 3) FROM pages
 UNION ALL SELECT '/p/' || page_id, '/c/' || page_id || '/0' FROM pages UNION ALL SELECT '/c/' || conv_id || '/' || turn, '/c/' || conv_id || '/' || (turn + 1) FROM conversations),
 r AS (SELECT '/p/' || page_id AS url, 0 AS depth FROM pages WHERE url LIKE '%/en/%' UNION SELECT b, depth + 1 FROM r JOIN e ON a = url WHERE depth < 60),
 k AS (SELECT '/p/' || page_id AS url FROM pages UNION SELECT '/c/' || conv_id || '/' || turn FROM conversations)
SELECT url, min(depth)::INT AS depth, url IN (SELECT url FROM k) AS found FROM r GROUP BY url""")
def crawled_pages(spark, d):
    """A crawl from the English pages: every page leads to two others and to a conversation, every turn to the next one."""
    p, c = t(spark, d, "pages"), t(spark, d, "conversations")
    html = F.concat(F.coalesce("html", F.lit("")), _anchor(_at("/p/", F.col("page_id") * 2 + 1)), _anchor(_at("/p/", F.floor(F.col("page_id") / 3))), _anchor(_at("/c/", F.col("page_id"), "/0")))
    pages = p.select(_at("/p/", F.col("page_id")).alias("url"), html.alias("html"))
    turns = c.select(_at("/c/", F.col("conv_id"), "/", F.col("turn")).alias("url"), F.concat(F.coalesce("text", F.lit("")), _anchor(_at("/c/", F.col("conv_id"), "/", F.col("turn") + 1))).alias("html"))
    seeds = p.where(F.contains("url", F.lit("/en/"))).select(_at("/p/", F.col("page_id")).alias("url"), F.lit("page").alias("kind"), F.lit("en").alias("root"))

    def links(fetched: DataFrame) -> DataFrame:
        return fetched.select(F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[pc]/[^"]*)">x</a>'), F.lit(1))).alias("url"), "kind", "root")

    got = crawl.crawl(seeds, crawl.from_table(pages.union(turns)), links, _folder(spark))
    return got.select("url", F.col("round").alias("depth"), F.col("html").isNotNull().alias("found"))


_LETTERS = "trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT conv_id, turn, {_LETTERS} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations)
SELECT '/a/' || conv_id AS root, CASE WHEN conv_id % 3 = 0 THEN 'old' ELSE 'new' END AS style, (row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1)::INT AS "order", text
FROM n WHERE conv_id % 3 < 2 AND conv_id IN (SELECT page_id FROM pages) AND text <> ''""")
def crawled_notes(spark, d):
    """Notes of acts, from the page of an act to its notes: all on one page, or each turn of a conversation on its own, or in no known style."""
    letters = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    c = t(spark, d, "conversations").select("conv_id", "turn", letters.alias("text"))
    kind, act = F.col("conv_id") % 3, _at("/a/", F.col("conv_id"))
    part = F.concat(F.lit("<h2>Turn "), F.col("turn").cast("string"), F.lit("</h2><p>"), F.col("text"), F.lit("</p>"))
    acts = t(spark, d, "pages").select(_at("/a/", F.col("page_id")).alias("act"), "html")
    contents = acts.select(F.concat("act", F.lit("/contents")).alias("url"), F.concat(F.lit('<a href="'), F.col("act"), F.lit('/notes">Explanatory Notes</a>'), F.coalesce("html", F.lit(""))).alias("html"))
    first = F.when(kind == 0, F.concat(F.lit('<a title="Open Explanatory Notes" href="'), act, F.lit('/notes/full">Open full notes</a>')))
    heading = F.concat(F.lit('<article><h2 class="title">What these notes do</h2><p>'), F.col("text"), F.lit("</p></article>"))
    following = F.concat(F.lit('<a class="userFunctionalElement nav" href="'), act, F.lit("/notes/"), (F.col("turn") + 1).cast("string"), F.lit('">Next</a>'))
    begun = c.where("turn = 0").select(F.concat(act, F.lit("/notes")).alias("url"), F.coalesce(first, F.when(kind == 1, F.concat(heading, following)), F.lit("<article><h2>Of no known style</h2></article>")).alias("html"))
    chain = c.where((kind == 1) & (F.col("turn") > 0)).select(F.concat(act, F.lit("/notes/"), F.col("turn").cast("string")).alias("url"), F.concat(F.lit("<article>"), part, F.lit("</article>"), following).alias("html"))
    whole = c.where(kind == 0).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "").alias("parts"))  # of one conversation
    full = whole.select(F.concat(act, F.lit("/notes/full")).alias("url"), F.concat(F.lit('<div class="LegSnippet">'), F.col("parts"), F.lit("</div>")).alias("html"))
    got = crawl.notes(acts.select("act"), crawl.from_table(contents.union(begun).union(chain).union(full)), _folder(spark), act="act")
    return got.select("root", "style", "order", "text")


# --- listings ---------------------------------------------------------------


@query("""WITH x AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 2) AS type, 2000 + page_id % 5 AS year FROM pages),
 n AS (SELECT *, row_number() OVER (PARTITION BY type, year ORDER BY page_id) - 1 AS place FROM x)
SELECT type, year::INT AS year, (place // 3 + 1)::INT AS page, '/' || type || '/' || year || '/' || page_id AS url FROM n WHERE type = 'en' AND year >= 2003""")
def listed_pages(spark, d):
    """Acts of a type and of late years from result pages of three, each naming the next; pages of other types and years are not fetched."""
    x = t(spark, d, "pages").select("page_id", "html", F.get(F.split("url", "/"), F.lit(3)).alias("type"), (2000 + F.col("page_id") % 5).alias("year"))
    place = F.row_number().over(Window.partitionBy("type", "year").orderBy("page_id")) - 1
    row = F.concat(F.lit('<tr><td><a href="/'), _at(F.col("type"), "/", F.col("year"), "/", F.col("page_id")), F.lit('/contents">'), _escaped(F.col("html")), F.lit("</a></td></tr>"))
    rows = x.withColumn("place", place).select("type", "year", F.floor(F.col("place") / 3).alias("page"), F.struct("place", row.alias("row")).alias("r"))
    listed = rows.groupBy("type", "year", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "").alias("rows"))  # three rows
    address = _at("/", F.col("type"), "/", F.col("year"))
    here = F.when(F.col("page") == 0, address).otherwise(F.concat(address, F.lit("?page="), (F.col("page") + 1).cast("string")))
    link = F.concat(F.lit('<a title="next page" href="'), address, F.lit("?page="), (F.col("page") + 2).cast("string"), F.lit('">next</a>'))
    path = _folder(spark)
    listing.store_pages(listed.select(here.alias("url"), F.concat(F.lit('<div id="content"><table><tbody>'), F.col("rows"), F.lit("</tbody></table></div>"), link).alias("html")), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(listing.Listed)
    stored = path if "://" in path or path.startswith("file:") else f"file://{path}"
    found = spark.read.format("listed").options(types="en,fr,de,es", years="2000,2001,2002,2003,2004", fetch="quillspark.sources.listing:stored_page", pages=stored).load()
    return found.where((F.col("type") == "en") & (F.col("year") >= 2003))


# --- the loop on a stream, and the table under it ---------------------------


def letters_of(text: str) -> list[dict]:
    """The document's key and how much it says; for the loop below."""
    from quillspark.shred.tree import parse

    root = parse(text)
    return [{"id": int(root.get("id")), "letters": len(root.text), "seq": 1}]


def _documents(spark, d) -> DataFrame:
    """Whole texts as XML; every third one is broken."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\\n]", "?")
    good = F.concat(F.lit('<a id="'), F.col("doc_id").cast("string"), F.lit('">'), _escaped(plain), F.lit("</a>"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<broken"), good)).otherwise(good)
    return t(spark, d, "documents").select(_at("u/", F.col("doc_id")).alias("url"), F.col("lang").alias("type"), (2000 + F.col("doc_id") % 5).cast("int").alias("year"), text.alias("text"))


_ARRIVING = "url string, type string, year int, text string"


@query("""SELECT 'u/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'failure' ELSE 'success' END AS status, CASE WHEN doc_id % 3 > 0 THEN length(coalesce(text, '')) END AS letters
FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 5 < 4""")
def document_stream(spark, d):
    """The document loop over arriving files of whole texts, run twice: the second run finds all good documents done."""
    path = _folder(spark)
    _documents(spark, d).write.parquet(f"{path}/in")
    run = loop.Loop(Table(spark, f"{path}/table", "id", "seq", 8), f"{path}/run", letters_of, "id long, letters long, seq long", types=["en", "fr"], years=[2000, 2001, 2002, 2003])
    run.start(spark.readStream.schema(_ARRIVING).parquet(f"{path}/in")).awaitTermination()
    _documents(spark, d).write.mode("append").parquet(f"{path}/in")
    run.start(spark.readStream.schema(_ARRIVING).parquet(f"{path}/in")).awaitTermination()
    held = run.table.read().select(_at("u/", F.col("id")).alias("url"), "letters")
    last = ingest.latest(run.log().select("url", "status", "batch"), "url", "batch")
    return last.join(held, "url", "left").select("url", "status", "letters")


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 2 ELSE 1 END * length(coalesce(text, '')) AS letters FROM documents WHERE doc_id % 3 > 0""")
def rescraped_documents(spark, d):
    """Documents of labelled ids are fetched and read anew, with texts twice as long; broken ones leave what was."""
    x, path = _documents(spark, d), _folder(spark)
    run = loop.Loop(Table(spark, f"{path}/table", "id", "seq", 8), f"{path}/run", letters_of, "id long, letters long, seq long")
    run.batch(x, 0)
    asked = t(spark, d, "labels").where("quality = 1").select(_at("u/", F.col("doc_id")).alias("url"), F.lit("x").alias("type"), F.lit(0).alias("year"))
    twice = F.regexp_replace("text", "(?s)>(.*)</a>$", ">$1$1</a>")
    run.again(asked, crawl.from_table(x.select("url", twice.alias("html"))), 1)
    return run.table.read().select(F.col("id").alias("doc_id"), "letters")


@query("""WITH x AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM x WHERE n = 1""")
def versioned_upserts(spark, d):
    """The last order of each customer after three upserts and a patch, from the buckets of the newest version."""
    x = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), "o_custkey", "o_orderkey", "o_totalprice", ((F.col("o_orderkey") % 3) * 1_000_000_000 + F.col("o_orderkey")).alias("seq"))
    table = Table(spark, _folder(spark), "key", "seq", 8)
    for part in (1, 2, 0):
        table.upsert(x.where(F.col("o_orderkey") % 3 == part), batch=str(part))
    table.upsert(x.where("o_orderkey % 3 = 1"), batch="1")  # has been written
    table.patch(x.where("o_custkey % 4 = 0").select("key", F.lit(-1.0).alias("o_totalprice")).distinct(), "o_totalprice")
    table.vacuum()
    return table.read().select("o_custkey", "o_orderkey", "o_totalprice")


# --- counts without another scan --------------------------------------------


@query("SELECT event_type AS collection, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1")
def live_counts(spark, d):
    """Users of each kind of event by sketches of days, of which the second half came later; held against the exact count."""
    x = t(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id", (F.col("event_id") % 2).alias("half"))
    path = _folder(spark)
    for half in (0, 1):
        audit.sketches(x.where(F.col("half") == half), "day", "event_type", "user_id").write.parquet(f"{path}/half={half}")
    told = audit.estimated(spark.read.parquet(path), "collection")
    exact = x.groupBy(F.col("event_type").alias("collection")).agg(F.count_distinct("user_id").alias("users"))
    error = F.greatest(F.lit(1.0), 4 * audit.SKETCH_ERROR * F.col("users"))
    return exact.join(told, "collection").select("collection", "users", (F.abs(F.col("n") - F.col("users")) <= error).alias("within"))


@query("SELECT count(*) AS rows, count(*) FILTER (doc_id % 3 = 0) AS failed, sum(length(coalesce(text, ''))) AS letters FROM documents")
def run_progress(spark, d):
    """What a run over all documents measured of itself while it wrote them."""
    x = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    watch = Watch("documents")
    with watch.running():
        watch.watched(x, failed=F.col("doc_id") % 3 == 0, text="text").write.parquet(_folder(spark))
    told = watch.told()
    return spark.createDataFrame([(told["rows"], told["failed"], told["letters"])], "rows long, failed long, letters long")


# --- table functions, early stops -------------------------------------------

_SECTION = "id string, number int, `order` int, text string"


@query("""WITH x AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[^ -~\\n]', '?', 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '[^ -~\\n]', '?', 'g'), chr(10)), 1) AS n FROM documents)
SELECT 'https://caselaw.nationalarchives.gov.uk/ewhc/ch/2020/' || doc_id || '-' || n AS id, doc_id::INT AS number, n::INT AS "order", trim(line, ' ' || chr(9)) AS text FROM x""")
def judgment_rows(spark, d):
    """Judgments of whole texts, a paragraph a line, by the table function in a lateral join."""
    spark.udtf.register("judgment_sections", tables.table_function(each_section, _SECTION))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\\n]", "?")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.concat(F.lit("<level><heading>h</heading><paragraph>"), _escaped(x), F.lit("</paragraph></level>")))
    uri = _at("https://caselaw.nationalarchives.gov.uk/ewhc/ch/2020/", F.col("doc_id"))
    head = F.concat(F.lit('<akomaNtoso><judgment><meta><identification><FRBRWork><FRBRdate date="2020-01-02" name="judgment"/><FRBRname value="A"/></FRBRWork><FRBRExpression><FRBRuri value="'), uri, F.lit('"/></FRBRExpression></identification></meta><judgmentBody><decision>'))
    cases = t(spark, d, "documents").select("doc_id", F.concat(head, F.array_join(lines, ""), F.lit("</decision></judgmentBody></judgment></akomaNtoso>")).alias("text"))
    return spark.sql('SELECT s.id, s.number, s.`order`, s.text FROM {cases} c, LATERAL judgment_sections(c.text) s', cases=cases)



@query("SELECT doc_id, lang FROM documents WHERE length(text) >= 900 ORDER BY 2000 + doc_id % 10 DESC, doc_id LIMIT 60")
def first_valid_documents(spark, d):
    """The first documents with enough text, newest years first; folders of later years are opened only as far as needed."""
    path = _folder(spark)
    t(spark, d, "documents").select("doc_id", "lang", "text", (2000 + F.col("doc_id") % 10).alias("year")).write.partitionBy("year").parquet(path)

    def read(folders):
        return spark.read.schema("doc_id long, lang string, text string").parquet(*folders).where("length(text) >= 900").select("doc_id", "lang").orderBy("doc_id")

    rows, _ = ingest.first_valid([f"{path}/year={y}" for y in range(2009, 1999, -1)], read, 60)
    return rows
