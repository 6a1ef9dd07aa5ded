from pathlib import Path

from pyspark.sql import functions as F

from tidemark.session import durable, release
from tidemark.sources import landed
from tidemark.streaming import cooldown, incremental


def test_json_with_schema_and_fallback(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"companies": [{"id": "a", "links": {"x": "https://x.com/a", "web": ""}}, {"id": "b", "links": null}]}')
    schema = "companies array<struct<id: string, links: map<string, string>>>"
    rows = landed.unnest(landed.read_json(spark, f"{tmp_path}/a.json", schema), "companies")
    assert [(r.ordinal, r.id) for r in rows.collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r) for r in landed.unpivot_links(rows, "id", "links").collect()] == [("a", "x", "https://x.com/a")]
    assert landed.read_json(spark, f"{tmp_path}/none.json", schema).count() == 0


def test_pages(spark):
    page = """<script type="application/ld+json">{"@graph": [{"name": "Acme", "url": "https://a.com", "founders": [{"name": "Jo", "url": "https://jo.me"}]}]}</script>
    <meta property="og:image" content="https://a.com/og.png"><img src="/logo.png"><img src="/pic.png"><a href="/companies/acme">Acme <b>Inc</b></a><a href="/other">x</a>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<script type='application/json'>{bad</script>")], "page_id long, html string")
    assert [(r.name, r.url) for r in landed.embedded_records(pages, "page_id").collect()] == [("Acme", "https://a.com"), ("Jo", "https://jo.me")]
    assert [(r.url, r.name) for r in landed.card_records(pages, "page_id", "^/companies/").collect()] == [("/companies/acme", "Acme Inc")]
    assert [r.image for r in landed.link_previews(pages, "page_id").orderBy("rank").collect()] == ["https://a.com/og.png", "/pic.png", "/logo.png"]
    feed = "<rss><item><title><![CDATA[One]]></title><link>https://a/1</link><pubDate>today</pubDate></item></rss><feed><entry><title>Two</title><link href=\"https://a/2\"/></entry></feed>"
    got = landed.feed_items(spark.createDataFrame([(1, feed)], "page_id long, html string")).collect()
    assert [(r.title, r.link) for r in got] == [("One", "https://a/1"), ("Two", "https://a/2")]


def test_incremental_is_batch(spark, tmp_path):
    schema = "id string, version long, text string"
    batches = [[("a", 1, "one"), ("b", 1, "x")], [("a", 3, "three"), ("a", 2, "two")], [("a", 3, "again"), ("c", 1, None)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    out = incremental.replay(spark, frames, lambda old, new: incremental.upsert(old, new, "id", "version"))
    want = [("a", 3, "again"), ("b", 1, "x"), ("c", 1, None)]
    assert sorted(map(tuple, out.collect())) == want
    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = incremental.write_upserts(stream, f"{tmp_path}/out", "id", "version", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, incremental.read_upserts(spark, f"{tmp_path}/out", out.schema, q.lastProgress["batchId"]).collect())) == want
    tasks = spark.createDataFrame([("t1",), ("t2",)], "task_key string")
    log = spark.createDataFrame([("t1", "done"), ("t2", "failed")], "task_key string, status string")
    assert [r.task_key for r in incremental.pending(tasks, log).collect()] == ["t2"] and incremental.pending(tasks, log, force=True).count() == 2


def test_streamed_windows(spark, tmp_path):
    rows = [("2026-01-01 10:00:00", "e", 1.0, 1), ("2026-01-01 12:00:00", "e", 2.0, 2), ("2026-01-02 01:00:00", "e", 4.0, 2)]
    spark.createDataFrame(rows, "t string, entity string, value double, id int").withColumn("at", F.to_timestamp("t")).coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    q = incremental.running_scores(stream, "at", "entity", "value").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.total, r.n) for r in spark.table("sums").collect()) == [(3.0, 2), (4.0, 1)]
    q = incremental.once_per_id(stream, "at", "id").writeStream.format("memory").queryName("ids").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("ids").collect()) == [1, 2]


def test_written_tables_are_released(spark):
    out = durable(spark.range(5), "five")
    assert out.count() == 5
    path = Path(out.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert path.exists()
    release(spark)
    assert not path.exists()


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    schema = "id long, version long, text string"
    batches = [[(k, 1, "a") for k in range(40)], [(3, 2, "b"), (5, 2, "b"), (3, 0, "old")], [(None, 1, "n")], [(3, 2, "c"), (None, 0, "m")]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = f"{tmp_path}/table"
    run = lambda cp: incremental.write_upserts(stream, path, "id", "version", f"{tmp_path}/{cp}", buckets=8).trigger(availableNow=True).start()
    run("cp").awaitTermination()
    read = lambda epoch: {(x.id, x.version, x.text) for x in incremental.read_upserts(spark, path, stream.schema, epoch).collect()}
    whole = {(k, 1, "a") for k in range(40)}
    want = [whole, whole - {(3, 1, "a"), (5, 1, "a")} | {(3, 2, "b"), (5, 2, "b")}]
    want += [want[1] | {(None, 1, "n")}, want[1] - {(3, 2, "b")} | {(3, 2, "c"), (None, 1, "n")}]
    assert [read(e) for e in range(4)] == want
    folders = [len(list(Path(f"{path}/data/v{e}").glob("bucket=*"))) for e in range(4)]
    assert folders[0] == 8 and all(1 <= n <= 2 for n in folders[1:])
    files = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    run("cp-lost").awaitTermination()  # every epoch is replayed
    assert {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")} == files and read(3) == want[3]


def test_streamed_cooldowns_are_those_of_the_batch(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    r, start = random.Random(4), datetime(2026, 1, 1)
    rows = [(r.choice(["x", "github", None]), start + timedelta(minutes=r.randint(0, 6000)), r.random() < 0.4) for _ in range(400)]
    rows.sort(key=lambda x: x[1])
    for k in range(4):
        part = rows[100 * k : 100 * k + 100]
        r.shuffle(part)
        spark.createDataFrame(part, "platform string, at timestamp, refused boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([("end", start + timedelta(days=99), False)], "platform string, at timestamp, refused boolean").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema("platform string, at timestamp, refused boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = cooldown.write_cooldowns(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    batch = [tuple(x) for x in cooldown.intervals(spark.createDataFrame(rows, "platform string, at timestamp, refused boolean")).collect()]
    plain = []
    for p in {x[0] for x in rows}:
        for at in sorted(x[1] for x in rows if x[0] == p and x[2]):
            if plain and plain[-1][0] == p and at <= plain[-1][2]:
                plain[-1] = (p, plain[-1][1], at + timedelta(minutes=30))
            else:
                plain.append((p, at, at + timedelta(minutes=30)))
    assert sorted(got, key=repr) == sorted(batch, key=repr) == sorted(plain, key=repr) and len(plain) > 40
