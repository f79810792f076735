from pyspark.sql import functions as F

from civisphere.functions import stats as S
from civisphere.functions import url as U
from civisphere.operators import ledgers as L
from civisphere.sources import feeds, roadworks
from civisphere.streaming.history import presence_stream

RSS = """<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>https://X.example/a?utm_source=z&amp;k=1#f</link>
<pubDate>Tue, 06 Oct 2026 10:00:00 GMT</pubDate></item><item><title></title></item>
<entry><title>C</title><link href="https://y.example/c"/><updated>2026-10-06T10:00:00</updated></entry></channel></rss>"""


def test_feeds(spark):
    rows = feeds.parse_feeds(spark.createDataFrame([("s", RSS), ("t", None), ("u", "")], "source string, body string")).orderBy("position").collect()
    assert [(r.title, r.url) for r in rows] == [("A & B", "https://X.example/a?utm_source=z&k=1#f"), ("C", "https://y.example/c")]
    assert str(rows[0].published_at) == "2026-10-06 10:00:00"
    assert rows[1].published_at is None  # no offset


def test_canonical_url(spark):
    urls = [("HTTPS://A.example:443/p?utm_x=1&b=2&fbclid=3#z", "https://a.example/p?b=2"), ("http://a.example:80", "http://a.example/"), ("mailto:x", None), ("https://a.example/?&a", "https://a.example/?&a")]
    df = spark.createDataFrame(urls, "u string, want string")
    assert df.where(~U.canonical_url(F.col("u")).eqNullSafe(F.col("want"))).count() == 0


def test_roadworks_rejects(spark):
    f = lambda i, c: f'{{"id":{i},"geometry":{{"type":"Point","coordinates":{c}}},"properties":{{"event_status":"active","road_names":["R"]}}}}'
    body = '{"features":[' + ",".join([f('"a"', "[-71.2,46.8]"), f('"a"', "[-71.2,46.8]"), f('""', "[-71.2,46.8]"), f('"b"', "[0,0]"), f('"c"', "[]")]) + "]}"
    got = roadworks.is_active(roadworks.parse_roadworks(spark.createDataFrame([(body,), (None,)], "body string")), "2026-01-01").orderBy("position").collect()
    assert [r.reject for r in got] == ["malformed", None, "duplicate", "missing_id", "outside", "geometry"]
    assert all(r.active for r in got[1:])


def test_presence_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1), ("a", 2), ("b", 2), ("a", 4), ("b", 2), ("c", 4)]
    for no in (1, 2, 4, 2):  # the last is a replay
        spark.createDataFrame([r for r in rows if r[1] == no], "k string, no long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, no long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = presence_stream(stream, "k", "no").writeStream.outputMode("update").format("memory").queryName("presence").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.first_no, r.last_no, r.seen) for r in spark.sql("select k, first_no, max(last_no) last_no, max(seen) seen from presence group by 1, 2").collect()}
    eds = spark.createDataFrame([(1, 1), (2, 2), (4, 4)], "no long, e long").select(F.col("e").alias("ed"), "no")
    batch = L.presence_history(spark.createDataFrame(rows, "k string, ed long"), eds, "k", "ed")
    assert got == {(r.k, r.first_no, r.last_no, r.seen) for r in batch.collect()}


def test_nulls_and_empty(spark):
    none = spark.createDataFrame([], "k string, n long")
    assert L.concentration(none, "k").count() == 0
    assert spark.range(1).select(S.recency(F.lit(None).cast("long")).alias("x")).first().x == 0.0
    assert spark.range(1).select(S.wilson(F.lit(0), F.lit(0)).alias("x")).first().x == 0.0
