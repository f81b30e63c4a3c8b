"""Landed payloads and streaming forms on small files of our own."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sentimill.operators import alerts
from sentimill.sources import feeds
from sentimill.streaming import tone


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<rss><channel><item><title>Acme soars - The Post</title><link>https://r.example/?url=https%3A%2F%2Fx.example%2Fa&amp;c=1</link>
        <pubDate>Tue, 01 Oct 2024 12:30:00 GMT</pubDate><source>The Post</source></item><item><title> </title></item>
        <item><title>No outlet</title><link>https://y.example/b</link><pubDate>not a date</pubDate></item></channel></rss>"""
    )
    got = {r["title"]: r for r in feeds.rss(spark, str(tmp_path), "wire").collect()}
    assert set(got) == {"Acme soars", "No outlet"} and got["Acme soars"]["url"] == "https://x.example/a"
    assert got["Acme soars"]["ts"] == dt.datetime(2024, 10, 1, 12, 30) and got["No outlet"]["ts"] is None


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"uuid": "1", "title": "A", "providerPublishTime": 0, "relatedTickers": ["X"]}, {"uuid": "2", "title": "B", "relatedTickers": ["Y"]}, {"uuid": "3", "title": "C"}]))
    assert sorted(r["title"] for r in feeds.keyed_news(spark, str(tmp_path / "n.json"), "k", "X").collect()) == ["A", "C"]
    (tmp_path / "h.json").write_text(json.dumps({"hits": [{"title": "T", "points": 3, "num_comments": None, "created_at_i": 60, "author": "me"}]}))
    r = feeds.discussion(spark, str(tmp_path / "h.json"), "d").first()
    assert (r["engagement"], r["author"], r["ts"]) == (3, "me", dt.datetime(1970, 1, 1, 0, 1))
    (tmp_path / "b.csv").write_text("Datetime,Open,High,Low,Close,Adj Close,Volume\n2024-01-02 00:00:00,1,2,0.5,1.5,1.5,10\n2024-01-03 00:00:00,1,2,1,,,\n")
    assert [tuple(r)[1:] for r in feeds.bars(spark, str(tmp_path / "b.csv")).collect()] == [(1.0, 2.0, 0.5, 1.5, 10.0)]
    (tmp_path / "t.json").write_text(json.dumps({"timeline": [{"series": "tone", "data": [{"date": "20240101T000000Z", "value": 1.0}, {"date": "20240101T120000Z", "value": 3.0}]}]}))
    assert [tuple(r) for r in feeds.tone_timeline(spark, str(tmp_path / "t.json")).collect()] == [(dt.date(2024, 1, 1), "tone", 2.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("X", "=1+1", 2.0), ("Y", "plain", None)], "ticker string, note string, v double")
    feeds.export_csv(df, str(tmp_path / "c"))
    assert sorted(r["note"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["'=1+1", "plain"]
    feeds.write_snapshots(df, str(tmp_path / "s"))
    feeds.write_snapshots(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("ticker = 'X'").count() == 2
    feeds.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def readings(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=37 * i), float((i * 37 + ord(k)) % 100), i) for k in "ab" for i in range(120)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double, i long")
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), tone.landed(spark, str(tmp_path / "in"), df.schema)


def test_streamed_windows_match_batch(spark, tmp_path):
    batch, stream = readings(spark, tmp_path)
    scored = lambda d: d.withColumns({"score": F.col("v") / 100, "weight": F.lit(1.0)})
    got = {(r["k"], r["bucket"]): (round(r["tone"], 9), r["n"]) for r in drained(tone.tone_windows(scored(stream), "k"), "tones")}
    want = {(r["k"], r["w"]["start"]): (round(r["t"], 9), r["n"]) for r in scored(batch).groupBy("k", F.window("ts", "6 hours").alias("w")).agg(F.avg("score").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 2  # the last window stays open


def test_streamed_alerts_match_batch(spark, tmp_path):
    batch, stream = readings(spark, tmp_path)
    got = sorted((r["k"], r["s"]) for r in drained(tone.crossings(stream, "k", "v", 70.0), "fired"))
    want = sorted((r["k"], r["s"]) for r in alerts.crossings(batch.withColumn("s", F.unix_seconds("ts")), "k", "s", "i", "v", 70.0).collect())
    assert got == want and want


def test_streamed_items_once(spark, tmp_path):
    _, stream = readings(spark, tmp_path)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert len(drained(tone.once_each(twice, ["k", "i"]), "once")) == 240


def test_late_answers_supersede_in_any_order(spark, tmp_path):
    """Answers in shuffled files: the last version of every run is a batch recompute over each source's newest answer; versions only rise where something changes."""
    import random

    t0 = dt.datetime(2024, 1, 1)
    r = random.Random(5)
    rows = [(f"k{r.randrange(3)}", r.randrange(2), f"s{r.randrange(4)}", t0 + dt.timedelta(seconds=r.randrange(900)), r.randrange(9) / 4 - 1, r.choice([0.5, 1.0, 0.0, None])) for _ in range(80)]
    rows += rows[:15]
    schema = "k string, run long, source string, ts timestamp, score double, weight double"
    best = {}
    for k, run, source, ts, x, w in rows:
        if w:
            best[k, run, source] = max(best.get((k, run, source), (ts, x, w)), (ts, x, w))
    want = {}
    for (k, run, _), (_, x, w) in best.items():
        a, b, n = want.get((k, run), (0.0, 0.0, 0))
        want[k, run] = (a + x * w, b + w, n + 1)
    for turn in range(2):
        folder = str(tmp_path / f"late{turn}")
        r.shuffle(rows)
        for i in range(0, len(rows), 32):
            spark.createDataFrame(rows[i : i + 32], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = tone.landed(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
        out = drained(tone.superseding(stream, "k", "run", "source"), f"late{turn}", "update")
        last = {}
        for x in sorted(out, key=lambda x: x["version"]):
            last[x["k"], x["run"]] = (round(x["tone"], 9), x["sources"])
        assert last == {key: (round(a / b, 9), n) for key, (a, b, n) in want.items()}
        versions = sorted((x["k"], x["run"], x["version"]) for x in out)
        assert len(versions) == len(set(versions))
