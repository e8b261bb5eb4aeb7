"""Tables with versions, the loop on a stream, state that goes, sketches, progress, table functions, early stops."""

import resource
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, ingest
from quillspark.operators.progress import Watch
from quillspark.shred import judgment, tables
from quillspark.sources import sinks
from quillspark.sources.table import Conflict, Table
from quillspark.streaming import loop, ratelimit
from test_shred import CASE, LAYOUTS


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, v string, seq long")


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


# --- the bucketed table -----------------------------------------------------


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = Table(spark, str(tmp_path), "id", "seq", 8)
    table.upsert(frame(spark, [(f"k{n}", "a", 1) for n in range(200)] + [(None, "x", 1)]))
    before, first = files(tmp_path), table.manifest()
    assert table.upsert(frame(spark, [("k3", "b", 2), ("k3", "c", 1), ("new", "n", 0)])) == 2
    second = table.manifest()
    moved = {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)}
    assert 1 <= len(moved) <= 2 and all(files(tmp_path)[f] == t for f, t in before.items())
    assert held(table) == sorted([(f"k{n}", "a", 1) for n in range(200) if n != 3] + [("k3", "b", 2), ("new", "n", 0)])
    assert len(held(table, 1)) == 200
    assert [tuple(r) for r in table.lookup("k3", "absent").collect()] == [("k3", "b", 2)]
    plan = table.lookup("k3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("__bucket=") <= 1 or "1 paths" in plan


def test_an_older_row_and_a_batch_again_change_nothing(spark, tmp_path):
    table = Table(spark, str(tmp_path), "id", "seq", 4)
    table.upsert(frame(spark, [("a", "new", 5)]), batch="one")
    assert table.upsert(frame(spark, [("a", "other", 9)]), batch="one") == 1
    table.upsert(frame(spark, [("a", "old", 4), ("b", "x", 1)]), batch="two")
    assert held(table) == [("a", "new", 5), ("b", "x", 1)]
    table.upsert(frame(spark, [("a", "same sequence", 5)]))
    assert held(table)[0] == ("a", "same sequence", 5)


def test_patch_recreate_and_vacuum(spark, tmp_path):
    table = Table(spark, str(tmp_path), "id", "seq", 4)
    table.upsert(frame(spark, [(f"k{n}", "a", n) for n in range(20)]))
    table.patch(spark.createDataFrame([("k1", "patched"), ("k2", None), ("absent", "x")], "id string, v string"), "v")
    assert [r[1] for r in held(table) if r[0] in ("k1", "k2")] == ["patched", "a"] and len(held(table)) == 20
    table.recreate(frame(spark, [("z", "only", 1)]))
    assert held(table) == [("z", "only", 1)] and len(held(table, 1)) == 20
    gone = table.vacuum(keep=1)
    assert "manifest/1.json" in gone and table.versions() == [3] and held(table) == [("z", "only", 1)]
    assert len({f.split("/")[1] for f in files(tmp_path)}) == 1


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    table = Table(spark, str(tmp_path), "id", "seq", 4)
    stale = table.manifest()
    table.upsert(frame(spark, [("a", "x", 1)]))
    with pytest.raises(Conflict):
        table._replace(stale, frame(spark, [("b", "y", 1)]).withColumn("__bucket", table._bucket()), {0, 1, 2, 3}, frame(spark, []).schema, None)
    assert held(table) == [("a", "x", 1)]


def test_an_empty_table(spark, tmp_path):
    table = Table(spark, str(tmp_path), "id", "seq", 4)
    for asked in (table.read, lambda: table.lookup("a"), lambda: table.patch(frame(spark, []), "v")):
        with pytest.raises(ValueError, match="no table"):
            asked()
    table.upsert(frame(spark, []))
    assert held(table) == [] and table.lookup("a").count() == 0


def test_archives_past_their_time_are_deleted(spark, tmp_path):
    for name in ("2024-01-01", "2024-01-04", "2024-02-01", "latest"):
        frame(spark, [("a", name, 1)]).write.parquet(f"{tmp_path}/archive/{name}")
    assert sinks.delete_expired(spark, str(tmp_path), date(2024, 2, 1)) == ["2024-01-01"]
    assert sorted(p.name for p in (tmp_path / "archive").iterdir()) == ["2024-01-04", "2024-02-01", "latest"]
    assert sinks.delete_expired(spark, str(tmp_path / "none"), date(2024, 2, 1)) == []


# --- the loop on a stream ---------------------------------------------------

ARRIVING = "url string, type string, year int, text string"


def parsed(text):
    if text == "bad":
        raise ValueError("it can't be read")
    return [{"id": w, "v": text, "seq": len(text)} for w in text.split()]


def looped(spark, path, **how):
    return loop.Loop(Table(spark, f"{path}/table", "id", "seq", 4), f"{path}/run", parsed, "id string, v string, seq long", **how)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, ARRIVING).coalesce(1).write.mode("append").json(f"{path}/in")


def arrived(spark, path):
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", 1).json(f"{path}/in")


def test_a_run_cut_off_between_sink_and_log_changes_nothing(spark, tmp_path, monkeypatch):
    arrive(spark, tmp_path, [("u1", "a", 2001, "x y"), ("u2", "a", 2001, "bad"), ("u3", "b", 2001, "left out"), ("u4", "a", 1990, "left out")])
    run = looped(spark, tmp_path, types=["a"], years=[2001])
    real, calls = Table.upsert, []

    def cut_off(self, rows, batch=None):
        made = real(self, rows, batch)
        calls.append(batch)
        if len(calls) == 1:
            raise OSError("cut off")
        return made

    monkeypatch.setattr(Table, "upsert", cut_off)
    with pytest.raises(Exception, match="cut off"):
        run.start(arrived(spark, tmp_path)).awaitTermination(120)
    assert held(run.table) == [("x", "x y", 3), ("y", "x y", 3)] and run.log().count() == 0
    run.start(arrived(spark, tmp_path)).awaitTermination(120)
    assert held(run.table) == [("x", "x y", 3), ("y", "x y", 3)] and run.table.versions() == [1]
    assert sorted((r.url, r.status, r.error) for r in run.log().collect()) == [("u1", "success", None), ("u2", "failure", "ValueError: it can't be read")]
    # what has been done is skipped, what failed is tried again
    arrive(spark, tmp_path, [("u1", "a", 2001, "other"), ("u2", "a", 2001, "good now"), ("u5", "a", 2001, "x")])
    run.start(arrived(spark, tmp_path)).awaitTermination(120)
    assert held(run.table) == [("good", "good now", 8), ("now", "good now", 8), ("x", "x y", 3), ("y", "x y", 3)]
    assert sorted(r.url for r in run.log().where("status = 'success'").collect()) == ["u1", "u2", "u5"]


def test_the_limit_counts_over_batches(spark, tmp_path):
    for n in range(3):
        arrive(spark, tmp_path, [(f"u{n}{k}", "a", 2001, f"w{n}{k}") for k in range(2)])
    run = looped(spark, tmp_path, limit=3)
    run.start(arrived(spark, tmp_path)).awaitTermination(120)
    assert run.log().count() == 3 and len(held(run.table)) == 3


# --- state that goes --------------------------------------------------------


def test_state_of_closed_windows_goes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime(2024, 1, 1)
    for n in range(4):  # forty keys an hour, each seen in its hour alone, and one that is always there
        at = start + timedelta(hours=n)
        rows = [(f"k{n}-{k}", at + timedelta(seconds=k)) for k in range(40)] + [("always", at), ("always", at + timedelta(seconds=30))]
        spark.createDataFrame(rows, "who string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    hits = spark.readStream.schema("who string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = ratelimit.stream_counts(hits, "who", "at", 60, late="10 seconds")
    query = stream.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = spark.table("timed").groupBy("key").agg(F.sum("hits").alias("n")).collect()
    assert {r.key: r.n for r in got}["always"] == 4 * (1 + 2) and len(got) == 161
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # a window is its value and its timers: three hours of forty keys have gone
    assert max(rows) < 3 * 2 * 42 and rows[-1] <= 4 * 42


# --- sketches and progress --------------------------------------------------


def test_sketches_merge_and_keep_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 20_011).alias("key"))
    parts = [audit.sketches(rows.where("key < 9000"), "day", "kind", "key"), audit.sketches(rows.where("key >= 6000"), "day", "kind", "key")]
    told = {r.collection: r.n for r in audit.estimated(audit.merged(*parts), "collection").collect()}
    exact = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count_distinct("key").alias("n")).collect()}
    assert told.keys() == exact.keys() and all(abs(told[k] - exact[k]) <= 4 * audit.SKETCH_ERROR * exact[k] for k in exact)
    again, once = ({(r.day, r.collection): r.n for r in audit.estimated(x, "day", "collection").collect()} for x in (audit.merged(parts[1], parts[1]), parts[1]))
    assert all(abs(again[k] - once[k]) <= 4 * audit.SKETCH_ERROR * once[k] for k in once)  # the same keys again are not counted again


def test_progress_is_measured_by_the_run(spark, tmp_path):
    clock = iter([0.0, 10.0, 14.0])
    watch = Watch("run", lambda: next(clock))
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "de")], "id long, text string")
    seen = watch.watched(rows, failed=F.col("text").isNull(), text="text")
    with watch.running():
        seen.write.parquet(str(tmp_path / "out"))
    told = watch.told(total=6)
    assert (told["rows"], told["failed"], told["letters"], told["seconds"]) == (3, 1, 5, 4.0)
    assert told["rows_a_second"] == 0.75 and told["seconds_left"] == 4.0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("Scan") == 1


# --- table functions --------------------------------------------------------


def test_table_functions_give_the_rows_of_the_shredders(spark):
    tables.register(spark)
    texts = [(n, CASE.format(body=body)) for n, (body, _) in enumerate(LAYOUTS.values())] + [(90, None), (91, ""), (92, "<broken")]
    spark.createDataFrame(texts, "doc long, text string").createOrReplaceTempView("cases")
    got = spark.sql("SELECT doc, s.* FROM cases, LATERAL judgment_sections(text) s").collect()
    want = [(n, r["id"], r["text"]) for n, x in texts[: len(LAYOUTS)] for r in judgment.sections(x)]
    assert sorted((r.doc, r.id, r.text) for r in got if r.error is None) == sorted(want)
    assert [(r.doc, r.id) for r in got if r.error is not None] == [(92, None)]
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM judgment_sections(3)")


def test_a_long_judgment_is_never_an_array_of_rows():
    """100,000 paragraphs: what is held is the document's tree, rows come one at a time."""
    text = CASE.format(body="<level>x</level>" + "".join(f"<paragraph>{n} words of a paragraph</paragraph>" for n in range(100_000)))
    rows = judgment.each_section(text)
    first = next(rows)
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert first["order"] == 1 and sum(1 for _ in rows) == 99_999
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - peak < 30_000  # KB


# --- early stops ------------------------------------------------------------


def test_later_folders_are_not_opened(spark, tmp_path):
    for n in range(10):
        spark.range(10).select(F.col("id"), (F.col("id") % 2 == 0).alias("ok")).write.parquet(f"{tmp_path}/part={n}")
    asked = []

    def read(folders):
        asked.extend(folders)
        return spark.read.schema("id long, ok boolean").parquet(*folders).where("ok")

    folders = [f"{tmp_path}/part={n}" for n in range(10)]
    rows, opened = ingest.first_valid(folders, read, 12)
    assert (rows.count(), opened) == (12, 3) and asked == folders[:3]
    assert all("part=9" not in f for f in rows.inputFiles())
    assert ingest.first_valid(folders, read, 1000)[0].count() == 50
    assert ingest.first_valid(folders, read, 0)[0].count() == 0
