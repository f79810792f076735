"""Hand examples and brute force of what has no SQL, or whose SQL could share a mistake."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from civisphere.functions import stats, text, url
from civisphere.operators import editions, extract, grouping, matching, tables
from civisphere.sources import roadworks


def one(spark, make, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values)))).select(make(*(F.col(f"v{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("HTTPS://Example.ORG:443?utm_source=a&b=2#top", "https://example.org/?b=2"),
    ("http://example.org:80/Path/?ref=x&cmpid=1", "http://example.org/Path/?ref=x&cmpid=1"),
    ("https://example.org/a?DCLID=1&msclkid=2&q=%20&&z=", "https://example.org/a?q=%20&&z="),
    ("https://example.org/a?%75tm_medium=x&FBclid=1", "https://example.org/a"),
    ("https://example.org/a/?sig=AbC%2F", "https://example.org/a/?sig=AbC%2F"),
    ("ftp://example.org/a", None), ("javascript:alert(1)", None), ("https://user:pw@example.org/", None),
    ("http://localhost/", None), ("http://10.0.0.1/", None), ("http://example.org:8080/", None), ("http://2130706433/", None),
    ("http://a\\\\b.org/", None), ("", None), (None, None),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, url.canonical_url, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("wo<b>rd</b> <i>one</i>", "word one"), ("<p>a</p><p>b</p>", "a b"), ("a<br>b<br/>c<li>d", "a b c d"),
    ("x<script>var a = '<p>';</script>y<style>p{}</style>z", "xyz"), ("a &amp;lt; b &eacute;&nbsp;c", "a &lt; b é c"), ("<div class='k'>a</div>b<!-- no -->c", "a bc"),
])
def test_plain_text(spark, raw, want):
    assert one(spark, text.plain_text, raw) == want


def test_capped_and_wilson(spark):
    assert one(spark, lambda x: text.capped(x, 3), "abcd") == "abc…" and one(spark, lambda x: text.capped(x, 4), "abcd") == "abcd"
    row = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (33, 34)], "k long, n long")
    got = row.select(stats.wilson(F.col("k"), F.col("n")).alias("lo"), stats.wilson(F.col("k"), F.col("n"), True).alias("hi")).collect()
    assert (got[0].lo, got[0].hi) == (0, 1) and got[1].lo == 0 and got[2].hi == pytest.approx(1)
    assert round(got[3].lo, 3) == 0.851 and round(got[3].hi, 3) == 0.995


def test_mentions(spark):
    assert one(spark, extract.cents, "$1,250.50 and $ 7 or $1 000 000") == [125050, 700, 100000000]
    assert one(spark, extract.basis_points, "up 2.5 % or 3%, 0,25 %") == [250, 300, 25]
    assert one(spark, extract.shown, "a\u202eb\u200b  c\x07") == "ab c"
    assert one(spark, extract.street_key, "Boul. St-Joseph E") == "boulevard-saint-joseph-est"
    assert one(spark, lambda x: extract.terms(x, ["new", "new road", "road"]), "The New road, a road; new roads") == ["new road", "road", "new"]
    day = lambda m, d, a: extract.nearest_day(m, d, F.to_date(a))
    assert str(one(spark, day, "12", "30", "2025-01-05")) == "2024-12-30" and one(spark, day, "2", "30", "2025-01-05") is None


def test_components(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(60), rng.randrange(70)) for _ in range(90)] + [(100 + k, 1000) for k in range(50)] + [(200 + k, 2000 + k + j) for k in range(30) for j in (0, 1)]
    at = {i: i for i, _ in rows}
    moved = True
    while moved:
        moved = False
        for k in {k for _, k in rows}:
            own = [i for i, x in rows if x == k]
            low = min(at[i] for i in own)
            moved |= any(at[i] != low for i in own)
            at.update(dict.fromkeys(own, low))
    got = grouping.components_by_key(spark.createDataFrame(rows, "id long, key long")).collect()
    assert {r.id: r.component for r in got} == at and len(got) == len(at)
    assert grouping.components_by_key(spark.createDataFrame([], "id long, key long")).count() == 0


def brute_attach(items, score, threshold):
    members = {}
    for i, _, e in items:
        if e is not None:
            members.setdefault(e, []).append(i)
    for i, _, e in sorted(items, key=lambda r: (r[1], r[0])):
        if e is None:
            found = []
            for name, own in members.items():
                s = [score.get(frozenset((i, m)), 0.0) for m in own]
                if max(s) >= threshold and sum(s) / len(s) >= threshold:
                    found.append((-sum(s) / len(s), -sum(x >= threshold for x in s), name))
            members.setdefault(min(found)[2] if found else i, []).append(i)
    return {m: e for e, own in members.items() for m in own}


def test_attach(spark):
    rng = random.Random(3)
    items = [(i, rng.randrange(20), i if i % 9 == 0 else None) for i in range(80)]
    pairs = {frozenset(p): rng.randrange(100) / 100 for p in rng.sample(list(combinations(range(80), 2)), 160)}
    links = spark.createDataFrame([(*sorted(k), s) for k, s in pairs.items()], "a long, b long, score double")
    out = grouping.attach(spark.createDataFrame(items, "id long, at long, event long"), links).collect()
    assert {r.id: r.event for r in out} == brute_attach(items, pairs, 0.5) and len(out) == len(items)
    with pytest.raises(ValueError):
        grouping.linkage("other", 0.5)


def test_complete_link_and_average_link(spark):
    words = [(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "e"]), (3, ["c", "e", "f", "g"]), (4, ["x", "y", "z"]), (5, ["a", "b", "c", "d"])]
    out = grouping.complete_link(spark.createDataFrame(words, "id long, words array<string>")).collect()
    assert {r.id: r.bucket for r in out} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    ids = spark.createDataFrame([(k,) for k in range(5)], "id long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.1), (3, 4, 0.4)], "a long, b long, score double")
    assert {r.id: r.cluster for r in grouping.average_link(ids, pairs, 0.5).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("shared, jaccard, wide", [(2, 0.4, 100), (1, 0.3, 100), (3, 0.55, 4)])
def test_complete_link_by_brute_force(spark, monkeypatch, shared, jaccard, wide):
    monkeypatch.setattr(grouping, "WIDE", wide)
    rng = random.Random(5)
    items = [(i, rng.sample("abcdefghijkl", rng.randrange(8)) * rng.randrange(1, 3)) for i in range(150)]
    groups = []
    for i, w in items:
        like = lambda x, w=set(w): len(w & x) >= shared and len(w & x) >= jaccard * len(w | x)
        home = next((g for g in groups if all(like(x) for _, x in g)), None)
        if home is None:
            groups.append(home := [])
        home.append((i, set(w)))
    out = grouping.complete_link(spark.createDataFrame(items, "id long, words array<string>"), shared, jaccard).collect()
    assert sorted((r.id, r.bucket) for r in out) == sorted((i, g[0][0]) for g in groups for i, _ in g)


def test_complete_link_of_many_items_with_one_word(spark):
    # every item meets every bucket if they are tried one by one: 200 million trials
    n = 20_000
    words = F.array(F.lit("all"), F.concat(F.lit("x"), F.col("id")), F.concat(F.lit("y"), F.floor(F.col("id") / 2)))
    began = time.monotonic()
    out = grouping.complete_link(spark.range(n).select("id", words.alias("words")), 2, 0.4)
    assert out.where("bucket <> id - id % 2").count() == 0 and out.count() == n
    assert time.monotonic() - began < 60


def test_continue_ids(spark):
    before = spark.createDataFrame([("x", i) for i in range(5)] + [("y", i) for i in range(5, 9)], "group string, item long")
    after = spark.createDataFrame([("p", i) for i in (0, 1, 2, 5, 6)] + [("q", i) for i in (3, 4, 7, 8)] + [("r", 50)], "group string, item long")
    assert {r.group: r.kept for r in grouping.continue_ids(before, after).collect()} == {"p": "x", "q": "y", "r": None}


def test_takedowns(spark):
    rules = spark.createDataFrame([(1, "host", "bad.org", "active"), (2, "url", "https://ok.org/a?utm_x=1", "active"), (3, "source", "s9", "lifted"), (4, "image", "https://img.org/1.png", "active"), (4, "image", "https://img.org/2.png", "active"), (5, "what", "x", "active")], "id long, kind string, value string, status string")
    items = spark.createDataFrame([(1, "s1", "https://sub.bad.org/x", None), (2, "s1", "https://OK.org/a", None), (3, "s9", "https://ok.org/b", None), (4, "s1", "https://notbad.org/", "https://img.org/1.png"), (5, "s1", "https://notbad.org/", "https://img.org/2.png")], "id long, source string, url string, image string")
    left = editions.apply_takedowns(items, rules, {"host": "url", "url": "url", "source": "source", "image": "image"})
    assert sorted(r.id for r in left.collect()) == [3, 5]


def test_roadworks_any_point_and_accepted_first(spark):
    f = lambda i, *points: f'{{"id": "{i}", "geometry": {{"type": "LineString", "coordinates": {[list(p) for p in points]}}}, "properties": {{"event_status": "active"}}}}'
    inside, far = (-71.2, 46.8), (0.0, 0.0)
    body = f'{{"features": [{f("a", far)}, {f("a", far, inside)}, {f("a", inside)}, {f("", inside)}]}}'
    rows = spark.createDataFrame([("s1", body), ("s2", f'{{"features": [{f("a", inside)}]}}'), ("s3", "not json")], "source string, body string")
    got = sorted((r.source, r.position if r.position is not None else -1, r.reject) for r in roadworks.parse_roadworks(rows, source="source").collect())
    assert got == [("s1", 0, "outside"), ("s1", 1, None), ("s1", 2, "duplicate"), ("s1", 3, "missing_id"), ("s2", 0, None), ("s3", -1, "malformed")]


def test_publish(spark, tmp_path):
    tables.publish(spark.range(3), str(tmp_path), "t")
    tables.publish(spark.range(5), str(tmp_path), "t")
    assert tables.current(spark, str(tmp_path), "t").count() == 5


def test_gram_likeness_equals_posting_joins(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("ab 1") for _ in range(rng.choice((0, 3, 4, 60, 60, 60, 60, 60))))) for i in range(40)] + [(41, None), (5, "abab again")]
    texts = spark.createDataFrame(texts, "id long, text string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(41)] + [(7, 8)], "a long, b long")
    found = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit("(?=(.{4}))."), F.lit(1))).alias("key"))
    keys = found.groupBy("id", F.lit("chars").alias("kind"), "key").agg(F.count(F.lit(1)).alias("n"))
    items = texts.select("id", F.lit(None).cast("long").alias("at"), F.lit("en").alias("lang")).distinct()
    got, want = (sorted((r.a, r.b, round(r.chars, 9)) for r in out.collect()) for out in (
        matching.features(pairs, items, keys.limit(0), 42, matching.gram_likeness(pairs, texts, 42)), matching.features(pairs, items, keys, 42)))
    assert got == want and sum(x[2] > 0 for x in got) > 5
