"""Rules on nulls, ties and empty tables."""

from pyspark.sql import functions as F

from civisphere.operators import content as C
from civisphere.operators import rules as P


def test_robots_longest_rule_wins_and_ties_allow(spark):
    p = spark.createDataFrame([("/a/b",), ("/a/c.html",), ("/x",), (None,)], "path string")
    rules = [("/a", False), ("/a/b", True), ("/a/b", False), ("*.html$", True)]
    assert [r[0] for r in p.select(P.robots_allowed(p, "path", rules)).collect()] == [True, True, True, True]
    assert [r[0] for r in p.select(P.robots_allowed(p, "path", [("/a", False)])).collect()] == [False, False, True, True]
    assert [r[0] for r in p.select(P.robots_allowed(p, "path", [])).collect()] == [True] * 4


def test_gates_keep_what_has_no_date(spark):
    t = spark.createDataFrame([("active", None), ("over", None), (None, None)], "s string, e timestamp")
    assert [r[0] for r in t.select(P.active(F.col("s"), F.col("e"), F.lit("2020-01-01").cast("timestamp"))).collect()] == [True, False, False]
    assert all(r[0] for r in t.select(P.fresh(F.col("e"), F.lit("2020-01-01").cast("timestamp"), 1, 1)).collect())


def test_blocking_pairs_against_brute_force(spark):
    rows = [(i, i % 4, (i * 37 % 50) * 40000) for i in range(60)] + [(99, None, 0), (98, 1, None)]
    got = C.blocking_pairs(spark.createDataFrame(rows, "id int, key int, t long"), len(rows))
    full = [r for r in rows if r[1] is not None and r[2] is not None]
    want = {(a[0], b[0]) for a in full for b in full if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 7 * 86400}
    assert {(r["a_id"], r["b_id"]) for r in got.collect()} == want


def test_near_duplicates_look_at_whole_texts(spark):
    words = [f"w{i}" for i in range(300)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:150] + [f"x{i}" for i in range(150)])), (3, " ".join(words) + " end"), (4, None), (5, "")]
    got = C.near_duplicate_pairs(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert [(r["a_id"], r["b_id"]) for r in got] == [(1, 3)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id int, g string, at timestamp, bad boolean")
    assert P.keep_recent(e, "g", "at", 1).isEmpty()
    assert P.newest_outcome(e, "g", "at", F.col("bad"), "id").isEmpty()
    assert P.retry_state(e, "g", "at", F.col("bad"), 5, 1).isEmpty()
    assert P.related(e, "id", "g").isEmpty()
