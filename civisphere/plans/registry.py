"""All registered queries and their SQL. Each query applies an operator to the
whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civisphere.functions import stats as S
from civisphere.functions import text as T
from civisphere.functions import url as U
from civisphere.operators import content as C
from civisphere.operators import evaluation as V
from civisphere.operators import ledgers as L
from civisphere.operators import ranking as R
from civisphere.plans.rules import TOPIC_RULES

FLAGSHIP = "near_duplicate_pairs"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_FOLD = f"translate(lower({{}}), '{T.MARKED}', '{T.PLAIN}')"
AS_OF = "2001-09-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tok(expr: str) -> str:
    return f"regexp_extract_all({_FOLD.format(expr)}, '[a-z0-9]+')"


def _shingle_sql(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_distinct(list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i : i + {n} - 1], ' '))) ELSE [] END"


@query(f"""
WITH w AS (SELECT doc_id, {_tok("text")} AS w FROM documents),
s AS (SELECT doc_id, list_sort({_shingle_sql("w", 3)}) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id FROM s WHERE len(s) >= 6 GROUP BY s),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a_id, b_id, shared::BIGINT AS shared, (na + nb - shared)::BIGINT AS total FROM p WHERE 5 * shared >= 3 * (na + nb - shared)""")
def near_duplicate_pairs(spark, d):
    return C.near_duplicate_pairs(_t(spark, d, "documents"))


@query(f"""
SELECT trim({_FOLD.format("string_split(text, chr(10))[1]")}) AS headline, count(*) AS n, min(doc_id) AS first_id
FROM documents GROUP BY 1 HAVING count(*) > 1 AND headline <> ''""")
def repeated_headlines(spark, d):
    return C.repeated_headlines(_t(spark, d, "documents"))


@query(f"""
WITH b AS (SELECT item_id, {_tok("text")} AS w FROM benchmark), g AS (SELECT item_id, unnest({_shingle_sql("w", 4)}) AS g FROM b),
x AS (SELECT doc_id, {_tok("text")} AS w FROM documents), o AS (SELECT doc_id, unnest({_shingle_sql("w", 4)}) AS g FROM x)
SELECT doc_id, count(DISTINCT o.g) AS grams, count(DISTINCT item_id) AS items FROM o JOIN g ON o.g = g.g GROUP BY doc_id""")
def leak_scan(spark, d):
    return C.leak_scan(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


_TOKENS = f"""x AS (SELECT doc_id, unnest({_tok("text")}) AS t FROM documents),
k AS (SELECT doc_id, CASE WHEN length(t) >= 5 AND regexp_matches(t, '[sx]$') THEN substr(t, 1, length(t) - 1) ELSE t END AS token, count(*) AS n FROM x WHERE length(t) >= 3 GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM k GROUP BY token), m AS (SELECT count(*) AS m FROM documents)"""


@query(f"WITH {_TOKENS} SELECT token, df, round(ln((m + 1.0::DOUBLE) / (df + 1)) + 1, 6) AS idf FROM f, m")
def idf_table(spark, d):
    docs = _t(spark, d, "documents")
    return C.idf(C.stemmed_tokens(docs), docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {_TOKENS}, i AS (SELECT token, ln((m + 1.0::DOUBLE) / (df + 1)) + 1 AS idf FROM f, m)
SELECT doc_id, count(*) AS terms, round(sqrt(sum(pow((1 + ln(n::DOUBLE)) * idf, 2))), 6) AS norm FROM k JOIN i USING (token) GROUP BY doc_id""")
def tfidf_norm(spark, d):
    docs = _t(spark, d, "documents")
    return C.tfidf_norm(C.stemmed_tokens(docs), docs.count())


@query("""
WITH f AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) BETWEEN 2 AND greatest(30, (SELECT ceil(count(*) * 4 / 100.0) FROM orders))), r AS (SELECT o_orderkey AS id, o_custkey, epoch(o_orderdate) AS t FROM orders JOIN f USING (o_custkey))
SELECT a.id AS a_id, b.id AS b_id, count(*) AS keys FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.id < b.id AND abs(a.t - b.t) <= 604800 GROUP BY ALL""")
def blocking_pairs(spark, d):
    o = _t(spark, d, "orders")
    return C.blocking_pairs(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.unix_timestamp("o_orderdate").alias("t")), o.count())


def _read_sql(expr: str) -> str:
    for name, char in T.REFERENCES:
        expr = f"replace({expr}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)</?(p|br|div|li)(\s[^>]*|/)?>', ' ', 'g'), '(?s)</?[A-Za-z][^>]*>|<![^>]*>', '', 'g') AS t FROM a),
e AS (SELECT page_id, trim(regexp_replace({_read_sql("t")}, '[ \t\r\n]+', ' ', 'g')) AS t FROM b)
SELECT page_id, length(t)::INT AS n_chars, md5(t) AS digest, CASE WHEN length(t) > 140 THEN substr(t, 1, 140) || '…' ELSE t END AS excerpt FROM e""")
def html_plain_text(spark, d):
    t = T.plain_text(F.col("html"))
    return _t(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"), T.capped(F.col("t"), 140).alias("excerpt"))


_WHOLE = f"'{U._WHOLE}'"
_CANON = rf"""
u AS (SELECT page_id, url, trim(url) AS o FROM pages),
p AS (SELECT *, lower(regexp_extract(o, {_WHOLE}, 1)) AS s, lower(regexp_extract(o, {_WHOLE}, 2)) AS a, regexp_extract(o, {_WHOLE}, 3) AS p, substr(regexp_extract(o, {_WHOLE}, 4), 2) AS q FROM u),
n AS (SELECT *, regexp_replace(regexp_replace(a, ':[0-9]*$', ''), '\.$', '') AS n, regexp_extract(o, '^[A-Za-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1) AS port,
  array_to_string(list_filter(string_split(q, '&'), lambda x: NOT (starts_with(lower(url_decode(regexp_extract(x, '^([^=]*)', 1))), 'utm_') OR lower(url_decode(regexp_extract(x, '^([^=]*)', 1))) IN ({", ".join(f"'{t}'" for t in U.TRACKERS)}))), '&') AS k FROM p),
g AS (SELECT *, s IN ('http', 'https') AND n <> '' AND NOT contains(a, '@') AND NOT regexp_matches(url, '[\x00-\x1f\\]') AND port IN ('', '80', '443')
  AND NOT regexp_matches(n, '{U._LOCAL}') AND NOT (regexp_matches(n, '{U._NUMERIC}') AND NOT regexp_matches(n, '{U._DOTTED}')) AS safe FROM n),
c AS (SELECT page_id, url, safe, CASE WHEN safe THEN s || '://' || CASE WHEN s = 'https' THEN regexp_replace(a, ':443$', '') ELSE regexp_replace(a, ':80$', '') END || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN k <> '' THEN '?' || k ELSE '' END END AS canonical FROM g)"""


@query(f"WITH {_CANON} SELECT page_id, url, canonical, substr(sha256(coalesce(canonical, '|')), 1, 24) AS item_id, CASE WHEN row_number() OVER (PARTITION BY canonical ORDER BY page_id) = 1 THEN 'kept' ELSE 'duplicate_url' END AS reason FROM c")
def canonical_url_dedupe(spark, d):
    return C.dedupe_urls(_t(spark, d, "pages"))


_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':[0-9]+$', ''), '\.$', ''), '^www\.', '')"


@query(f"WITH {_CANON} SELECT {_HOST} AS host, count(*) AS pages, count(DISTINCT url) AS urls, sum(safe::INT)::BIGINT AS safe FROM c GROUP BY 1")
def host_rollup(spark, d):
    p = _t(spark, d, "pages").withColumn("host", U.host(F.col("url")))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"), F.count(U.safe_url(F.col("url"))).alias("safe"))


@query(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), r AS (SELECT min(host) AS rule FROM h UNION SELECT max(host) FROM h) SELECT page_id, host FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE host = rule OR ends_with(host, '.' || rule))")
def host_takedown(spark, d):
    p = _t(spark, d, "pages")
    h = p.select(U.host(F.col("url")).alias("rule"))
    rules = h.agg(F.min("rule").alias("rule")).union(h.agg(F.max("rule"))).distinct()
    return C.takedown(p, rules).select("page_id", "host")


_TOPIC_LIST = ", ".join(f"CASE WHEN regexp_matches({_FOLD.format('text')}, '{p}') THEN '{n}' END" for n, p in TOPIC_RULES)
_TOPICS = f"f AS (SELECT doc_id, source, list_filter([{_TOPIC_LIST}], lambda x: x IS NOT NULL) AS l FROM documents), t AS (SELECT doc_id, source, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['other'] END) AS topic FROM f)"


@query(f"WITH {_TOPICS} SELECT topic, count(*) AS n, count(DISTINCT source) AS sources FROM t GROUP BY topic")
def topic_labels(spark, d):
    return C.topics(_t(spark, d, "documents"), TOPIC_RULES).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query(f"WITH {_TOPICS}, c AS (SELECT source, topic, count(*) AS n FROM t WHERE topic <> 'other' GROUP BY ALL) SELECT source, topic, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, topic) = 1")
def topic_mode(spark, d):
    each = C.topics(_t(spark, d, "documents"), TOPIC_RULES).where("topic <> 'other'").groupBy("source", "topic").agg(F.count(F.lit(1)).alias("n"))
    return R.top_per_group(each, "source", [F.desc("n"), F.asc("topic")], 1).select("source", "topic", "n")


@query("WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]{1,3}(?:[ ,][0-9]{3})+|[0-9]+'), lambda x: regexp_replace(x, '[ ,]', '', 'g')) AS l FROM documents) SELECT doc_id, len(list_distinct(l))::INT AS n, l[1] AS first FROM r WHERE len(l) > 0")
def number_extraction(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.numbers(F.col("text")).alias("l")).where(F.size("l") > 0).select("doc_id", F.size("l").alias("n"), F.get("l", 0).alias("first"))


@query("SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.lang = l.lang AND strlen(d.text) > 20000)")
def silence_map(spark, d):
    docs = _t(spark, d, "documents")
    roster = docs.select("source").distinct().crossJoin(docs.select("lang").distinct())
    return roster.join(docs.where(F.octet_length("text") > 20000).select("source", "lang"), ["source", "lang"], "left_anti")


@query("SELECT n_regionkey, min(n_nationkey) AS best_rank, max(CASE WHEN n_name LIKE '%A%' THEN 1 ELSE 0 END)::INT AS official, array_to_string(list_sort(list_distinct(list(n_nationkey::VARCHAR))), ',') AS feeds FROM nation GROUP BY n_regionkey")
def collapse_dimension(spark, d):
    return L.collapse(_t(spark, d, "nation"), "n_regionkey", "n_nationkey", F.col("n_name").contains("A").cast("int"), "n_nationkey")


_SNAP = "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spend FROM orders WHERE year(o_orderdate) = {} GROUP BY o_custkey"


@query(f"""WITH a AS ({_SNAP.format(1996)}), b AS ({_SNAP.format(1997)}), j AS (SELECT a.o_custkey AS ka, b.o_custkey AS kb, concat_ws(',', CASE WHEN a.orders IS DISTINCT FROM b.orders THEN 'orders' END, CASE WHEN a.spend IS DISTINCT FROM b.spend THEN 'spend' END) AS f FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)
SELECT coalesce(ka, kb) AS o_custkey, CASE WHEN ka IS NULL THEN 'new' WHEN kb IS NULL THEN 'removed' WHEN f <> '' THEN 'changed' ELSE 'same' END AS state, CASE WHEN ka IS NULL OR kb IS NULL THEN '' ELSE f END AS fields FROM j""")
def snapshot_diff(spark, d):
    o = _t(spark, d, "orders")
    snap = lambda y: o.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return L.snapshot_diff(snap(1996), snap(1997), "o_custkey", ["orders", "spend"])


_MONTH = "(year({0}) * 12 + month({0}))::INT"


@query(f"""WITH r AS (SELECT o_custkey, {_MONTH.format("o_orderdate")} AS edition, count(*) AS items FROM orders GROUP BY ALL),
l AS (SELECT *, lag(items) OVER w AS p, lag(edition) OVER w AS pe FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY edition))
SELECT o_custkey, edition, items, CASE WHEN pe IS NULL OR pe <> edition - 1 THEN 'new' WHEN items > p THEN 'developed' ELSE 'quiet' END AS state, CASE WHEN pe = edition - 1 AND items > p THEN items - p END AS growth FROM l""")
def edition_ledger(spark, d):
    rows = _t(spark, d, "orders").groupBy("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("edition")).agg(F.count(F.lit(1)).alias("items"))
    return L.edition_ledger(rows, "o_custkey", "edition", "items")


_DAYS = "e AS (SELECT day, row_number() OVER (ORDER BY day)::INT AS no FROM (SELECT DISTINCT ts::DATE AS day FROM events)), m AS (SELECT max(no) AS m FROM e)"


def _days(ev: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    # one row for each day: the only unpartitioned window, over a calendar
    return ev.select("day").distinct().withColumn("no", F.row_number().over(W.orderBy("day")))


@query(f"WITH {_DAYS}, s AS (SELECT DISTINCT user_id, no FROM events JOIN e ON ts::DATE = day) SELECT user_id, min(no) AS first_no, max(no) AS last_no, count(*) AS seen, m - min(no) + 1 - count(*) AS missed, m - max(no) AS absent_streak FROM s, m GROUP BY user_id, m")
def presence_history(spark, d):
    ev = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return L.presence_history(ev, _days(ev), "user_id", "day")


@query("""WITH r AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
a AS (SELECT user_id, count(*) AS runs, sum(bad::INT)::BIGINT AS failures, coalesce(min(CASE WHEN NOT bad THEN rn END) - 1, count(*))::BIGINT AS streak FROM r WHERE rn <= 10 GROUP BY user_id)
SELECT *, CASE WHEN streak >= 3 THEN 'failing' WHEN failures > 0 THEN 'flaky' ELSE 'ok' END AS status FROM a""")
def feed_health(spark, d):
    return L.health(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(f"""WITH c AS (SELECT {_MONTH.format("o_orderdate")} AS edition, o_custkey, count(*) AS n FROM orders GROUP BY ALL),
b AS (SELECT edition, o_custkey FROM c QUALIFY row_number() OVER (PARTITION BY edition ORDER BY n DESC, o_custkey) <= 30),
p AS (SELECT edition + 1 AS edition, o_custkey FROM b)
SELECT edition, count(*) AS size, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p WHERE p.edition = b.edition AND p.o_custkey = b.o_custkey)) AS entered,
(SELECT count(*) FROM p WHERE p.edition = b.edition AND NOT EXISTS (SELECT 1 FROM b x WHERE x.edition = p.edition AND x.o_custkey = p.o_custkey)) AS left FROM b GROUP BY edition""")
def churn_top30(spark, d):
    c = _t(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("edition"), "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return L.churn(c, "edition", "o_custkey", "n")


@query("WITH a AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type AS display, n, sum(n) OVER w::BIGINT AS rows, count(*) OVER w AS variants FROM a WINDOW w AS (PARTITION BY p_brand) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def display_variant(spark, d):
    return L.display_variant(_t(spark, d, "part"), "p_brand", "p_type")


@query("""WITH b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= '2001-01-01' GROUP BY 1 HAVING count(*) >= 3),
p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT k, n FROM c WHERE n >= 8 AND n >= 4 * (SELECT median(n) FROM c)),
u AS (SELECT 1 AS rank, 'burst' AS rule, * FROM b UNION ALL SELECT 2, 'postponed', * FROM p UNION ALL SELECT 3, 'concentration', * FROM x)
SELECT rank, rule, k::VARCHAR AS key, n FROM u ORDER BY rank, n DESC, k::VARCHAR LIMIT 6""")
def anomaly_verdict(spark, d):
    o = _t(spark, d, "orders")
    count = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    burst, postponed = count(o.where("o_orderdate >= '2001-01-01'")).where("n >= 3"), count(o.where("o_orderstatus = 'P'")).where("n >= 2")
    return L.verdict([(1, "burst", burst), (2, "postponed", postponed), (3, "concentration", L.concentration(o, "o_custkey"))], "o_custkey")


@query(f"""WITH r AS (SELECT o_orderkey, CASE n_regionkey WHEN 0 THEN 1.0 WHEN 1 THEN 0.55 WHEN 2 THEN 0.25 ELSE 0.10 END AS near, epoch('{AS_OF}'::TIMESTAMP) - epoch(o_orderdate) AS age FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT o_orderkey, round(0.60::DOUBLE * near + 0.40::DOUBLE * CASE WHEN age < -300 THEN 0 ELSE pow(0.5::DOUBLE, greatest(age, 0) / 129600.0) END, 6) AS score FROM r""")
def recency_geo_rank(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    tier = F.when(F.col("n_regionkey") == 0, "city").when(F.col("n_regionkey") == 1, "region").when(F.col("n_regionkey") == 2, "country").otherwise("elsewhere")
    age = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("o_orderdate")
    return rows.select("o_orderkey", S.rank_score(tier, age).alias("score"))


@query("WITH p AS (SELECT c_custkey, c_acctbal, rank() OVER (ORDER BY c_acctbal) - 1 AS below, count(*) OVER (PARTITION BY c_acctbal) AS eq, count(*) OVER () AS n FROM customer) SELECT c_custkey, c_acctbal, least(3, floor(4 * (2 * below + eq) / (2.0 * n)))::INT AS band FROM p")
def midrank_band(spark, d):
    return R.midrank_band(_t(spark, d, "customer"), "c_custkey", "c_acctbal")


@query("WITH p AS (SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal) - 1 AS below, count(*) OVER (PARTITION BY s_acctbal) - 1 AS tied, count(*) OVER () AS known FROM supplier) SELECT s_suppkey, below, tied, known, floor(100 * below / known)::BIGINT AS percent_below FROM p")
def standing(spark, d):
    return R.standing(_t(spark, d, "supplier"), "s_suppkey", "s_acctbal")


_ACT = "a AS (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS orders, count(DISTINCT o_orderstatus) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


def _activity(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment", "c_custkey").agg(F.count("o_orderkey").alias("orders"), F.countDistinct("o_orderstatus").alias("kinds"))


@query(f"WITH {_ACT} SELECT c_mktsegment, c_custkey, kinds, orders, row_number() OVER w::INT AS rank, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN lag(kinds) OVER w <> kinds THEN 'kinds' WHEN lag(orders) OVER w <> orders THEN 'orders' ELSE 'id' END AS decided_by FROM a WINDOW w AS (PARTITION BY c_mktsegment ORDER BY kinds DESC, orders DESC, c_custkey)")
def multi_criteria_rank(spark, d):
    return R.decided_by(_activity(spark, d), "c_mktsegment", ["kinds", "orders"], "c_custkey")


@query(f"""WITH {_ACT}, p AS (SELECT c_mktsegment, c_custkey, orders, row_number() OVER w::INT AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM a WINDOW w AS (PARTITION BY c_mktsegment ORDER BY orders DESC, c_custkey)),
m AS (SELECT c_mktsegment, orders AS mid FROM p WHERE pos = (n - 1) // 2 + 1)
SELECT c_mktsegment, c_custkey, orders, pos, CASE WHEN orders < mid THEN 'below_median' WHEN pos > 12 THEN 'over_cap' ELSE 'shown' END AS state FROM p JOIN m USING (c_mktsegment)""")
def median_cut(spark, d):
    return R.median_cut(_activity(spark, d), "c_mktsegment", "orders", "c_custkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_per_group(spark, d):
    return R.top_per_group(_t(spark, d, "lineitem"), "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), n AS (SELECT user_id, s, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 259200 FOLLOWING) AS n FROM s)
SELECT user_id, s AS start_s, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1""")
def densest_window(spark, d):
    return R.densest_window(_t(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("s")), "user_id", "s")


@query("""WITH a AS (SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT AS s, epoch(o_orderdate)::BIGINT + 7776000 AS e FROM orders), b AS (SELECT l_orderkey AS k, l_linenumber AS n, epoch(l_shipdate)::BIGINT AS s, epoch(l_shipdate)::BIGINT + 864000 AS e FROM lineitem)
SELECT a.k AS o_orderkey, n AS l_linenumber FROM a JOIN b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e""")
def interval_overlap(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.unix_timestamp("o_orderdate").alias("start")).withColumn("end", F.col("start") + 7776000)
    i = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.unix_timestamp("l_shipdate").alias("start")).withColumn("end", F.col("start") + 864000)
    return R.overlapping(o, i, "k", 30 * 86400).select(F.col("x.k").alias("o_orderkey"), F.col("y.l_linenumber").alias("l_linenumber"))


@query("""WITH e AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL), x AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT x.event_id, e.value AS latest FROM x ASOF LEFT JOIN e ON x.user_id = e.user_id AND x.ts >= e.ts""")
def asof_clock(spark, d):
    ev = _t(spark, d, "events")
    right = ev.where("event_type <> 'error'").groupBy("user_id", "ts").agg(F.max("value").alias("latest"))
    return R.asof(ev.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "latest").select("event_id", "latest")


@query("SELECT l_partkey, l_returnflag, count(DISTINCT l_discount) AS values, count(DISTINCT l_orderkey) AS items, count(DISTINCT l_discount) >= 2 AND count(DISTINCT l_orderkey) >= 2 AS divergent FROM lineitem GROUP BY ALL")
def fact_slots(spark, d):
    return L.fact_slots(_t(spark, d, "lineitem"), ["l_partkey", "l_returnflag"], "l_discount", "l_orderkey")


@query("""WITH v AS (SELECT c_mktsegment AS event, n_regionkey AS area, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT event, area, count(*) AS area_votes FROM v GROUP BY ALL), a AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY event ORDER BY area_votes DESC, area) = 1),
p AS (SELECT event, area, place, count(*) AS place_votes FROM v GROUP BY ALL)
SELECT event, area, area_votes, place, place_votes FROM p JOIN a USING (event, area) QUALIFY row_number() OVER (PARTITION BY event ORDER BY place_votes DESC, place) = 1""")
def two_level_plurality(spark, d):
    v = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("event"), F.col("n_regionkey").alias("area"), F.col("n_name").alias("place"))
    return L.two_level_plurality(v, "event", "area", "place")


@query("SELECT lang, count(DISTINCT source) AS owners, count(*) AS n, count(DISTINCT source) >= 2 AS wire FROM documents GROUP BY lang")
def credit_measurement(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("owners"), F.count(F.lit(1)).alias("n")).withColumn("wire", F.col("owners") >= 2)


_SCORED = "s AS (SELECT d.doc_id, d.lang, n_chars AS score, toxic AS label, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("doc_id", "lang", F.col("n_chars").alias("score"), F.col("toxic").alias("label"), "quality")


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (score >= 2000 AND label = 1) AS tp, count(*) FILTER (score >= 2000 AND label = 0) AS fp, count(*) FILTER (score < 2000 AND label = 1) AS fn, count(*) FILTER (score < 2000 AND label = 0) AS tn FROM s)
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_prf(spark, d):
    return V.confusion(_scored(spark, d), F.col("score") >= 2000, F.col("label") == 1)


@query(f"""WITH {_SCORED}, g AS (SELECT score, count(*) AS n, sum(label)::BIGINT AS p FROM s GROUP BY score), c AS (SELECT score, sum(n) OVER w AS m, sum(p) OVER w AS tp, sum(p) OVER () AS total FROM g WINDOW w AS (ORDER BY score DESC))
SELECT score, tp::BIGINT AS tp, (m - tp)::BIGINT AS fp, round(tp / m::DOUBLE, 6) AS precision, round(tp / total::DOUBLE, 6) AS recall FROM c""")
def pr_curve(spark, d):
    return R.pr_curve(_scored(spark, d), "score", "label")


def _wilson_sql(k: str, n: str, sign: str) -> str:
    z = S.Z
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({k} / {n}::DOUBLE + {z * z}::DOUBLE / (2 * {n}) {sign} {z}::DOUBLE * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {z * z}::DOUBLE / (4.0::DOUBLE * {n} * {n}))) / (1 + {z * z}::DOUBLE / {n}))), 6)"


@query(f"WITH {_SCORED} SELECT lang, sum(label)::BIGINT AS k, count(*) AS n, {_wilson_sql('sum(label)', 'count(*)', '-')} AS lo, {_wilson_sql('sum(label)', 'count(*)', '+')} AS hi FROM s GROUP BY lang")
def wilson_interval(spark, d):
    g = _scored(spark, d).groupBy("lang").agg(F.sum("label").cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("lo", F.round(S.wilson(F.col("k"), F.col("n")), 6)).withColumn("hi", F.round(S.wilson(F.col("k"), F.col("n"), True), 6))


@query(f"WITH {_SCORED} SELECT coalesce(lang, 'all') AS lang, coalesce(quality::VARCHAR, 'all') AS quality, count(*) AS n, sum(label)::BIGINT AS positive FROM s GROUP BY GROUPING SETS ((lang, quality), (lang), (quality), ())")
def tier_table(spark, d):
    s = _scored(spark, d).withColumn("quality", F.col("quality").cast("string"))
    out = s.cube("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positive"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("quality", F.lit("all")).alias("quality"), "n", "positive")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agree, sum(quality)::BIGINT AS a, sum(toxic)::BIGINT AS b FROM labels), p AS (SELECT n, agree, agree / n::DOUBLE AS po, (a / n::DOUBLE) * (b / n::DOUBLE) + (1 - a / n::DOUBLE) * (1 - b / n::DOUBLE) AS pe FROM c)
SELECT n, agree, round((po - pe) / (1 - pe), 6) AS kappa FROM p""")
def kappa(spark, d):
    return V.kappa(_t(spark, d, "labels"), "quality", "toxic")


@query("""WITH e AS (SELECT vec_id, label, (embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT AS cluster FROM embeddings), c AS (SELECT label, cluster, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS nc, sum(n) OVER (PARTITION BY label) AS nl FROM c)
SELECT round(sum(n * n / nc::DOUBLE) / sum(n), 6) AS precision, round(sum(n * n / nl::DOUBLE) / sum(n), 6) AS recall FROM t""")
def bcubed(spark, d):
    e = _t(spark, d, "embeddings")
    sign = lambda i: (F.col("embedding")[i] > 0).cast("int")
    return V.bcubed(e.select("label", (sign(0) * 2 + sign(1)).alias("cluster")), "cluster", "label")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR || '|7'), doc_id) <= 5")
def stratified_sample(spark, d):
    rows = _t(spark, d, "documents").select("lang", "doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|7")), 256).alias("h"))
    return R.top_per_group(rows, "lang", [F.asc("h"), F.asc("doc_id")], 5).select("lang", "doc_id")


@query(f"""WITH RECURSIVE m AS (SELECT {_MONTH.format("o_orderdate")} AS edition, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders GROUP BY 1),
l AS (SELECT edition AS no, sha256('{{"edition":' || edition || ',"n":' || n || ',"s":' || s || '}}') AS leaf, row_number() OVER (ORDER BY edition) AS i FROM m),
c AS (SELECT no, leaf, sha256(leaf) AS root, i FROM l WHERE i = 1 UNION ALL SELECT l.no, l.leaf, sha256(c.root || l.leaf), l.i FROM c JOIN l ON l.i = c.i + 1)
SELECT no, leaf, root FROM c""")
def hash_chain(spark, d):
    m = _t(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("edition")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))
    return L.hash_chain(m, "edition", F.to_json(F.struct("edition", "n", "s")))


@query(f"WITH {_DAYS}, v AS (SELECT DISTINCT user_id FROM events), o AS (SELECT user_id, count(DISTINCT no) AS spoke, max(no) AS last_no FROM events JOIN e ON ts::DATE = day WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, coalesce(spoke, 0) AS spoke, last_no, coalesce(m - last_no, m) AS gap FROM v LEFT JOIN o USING (user_id), m")
def voice_register(spark, d):
    ev = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = _days(ev)
    return L.voice_register(ev.where("event_type = 'error'").join(days, "day"), ev.select("user_id").distinct(), days, "user_id")


@query("SELECT (props->>'$.k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    return _t(spark, d, "events").groupBy(F.get_json_object("props", "$.k").try_cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT isoyear(ts)::INT AS iso_year, weekofyear(ts)::INT AS iso_week, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') * 10 >= count(*) AS attention FROM events GROUP BY 1, 2")
def iso_week_watchdog(spark, d):
    ev = _t(spark, d, "events").withColumn("err", (F.col("event_type") == "error").cast("long"))
    g = ev.groupBy(F.expr("extract(YEAROFWEEK FROM ts)").cast("int").alias("iso_year"), F.weekofyear("ts").alias("iso_week")).agg(F.count(F.lit(1)).alias("n"), F.sum("err").alias("errors"), F.countDistinct("user_id").alias("users"))
    return g.withColumn("attention", F.col("errors") * 10 >= F.col("n"))


@query("""WITH j AS (SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate, epoch(l_shipdate) - epoch(o_orderdate) AS ahead FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN ahead > 21600 THEN 'suspect' WHEN ahead > 900 THEN 'future' ELSE 'valid' END AS status, count(*) AS n FROM j GROUP BY 1""")
def date_status(spark, d):
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(S.date_status(F.col("l_shipdate"), F.col("o_orderdate")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE p AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - 1 END AS merged_into FROM nation),
r AS (SELECT id, id AS root, merged_into FROM p UNION ALL SELECT r.id, p.id, p.merged_into FROM r JOIN p ON p.id = r.merged_into)
SELECT id, root FROM r WHERE merged_into IS NULL""")
def lineage_roots(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") - 1).alias("merged_into"))
    return V.lineage_roots(n, "id", "merged_into")


@query("SELECT l_suppkey, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL")
def source_class_tally(spark, d):
    return _t(spark, d, "lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
