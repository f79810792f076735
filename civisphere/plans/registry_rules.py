"""Registered queries of the rules in ``operators/rules.py``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from civisphere.operators import ledgers as L
from civisphere.operators import ranking as R
from civisphere.operators import rules as P
from civisphere.plans.registry import AS_OF, _MONTH, _scored, _SCORED, _t, query

#: (bucket, pattern) in order of precedence. Fixed values.
BUCKETS = [("legal", "[Ll]icense"), ("contact", "@"), ("figures", "[0-9]{4}")]
#: type: (pattern, weight, veto). Fixed values.
TYPES = {"figure": ("[0-9]+", 2, "@"), "question": ("[?]", 3, "!"), "stop": ("[.]", 1, "[?]")}
ROBOTS = [("/", True), ("/*p=", False), ("/a", False), ("/ar", True), ("*.html$", True)]
WEIGHTS = {"c_acctbal": 0.001, "c_nationkey": -0.05}


@query(f"""SELECT CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in BUCKETS)} ELSE 'other' END AS bucket, count(*) AS n FROM documents GROUP BY 1""")
def first_rule_buckets(spark, d):
    return _t(spark, d, "documents").groupBy(P.first_rule(F.col("text"), BUCKETS, "other").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{v}') THEN 0 ELSE {w} * len(regexp_extract_all(text, '{p}')) END AS {k}" for k, (p, w, v) in TYPES.items())


@query(f"""WITH s AS (SELECT conv_id, turn, {_HITS} FROM conversations), m AS (SELECT *, greatest(figure, question, stop, 0) AS top FROM s)
SELECT conv_id, turn, CASE WHEN top < 2 THEN NULL WHEN figure = top THEN 'figure' WHEN question = top THEN 'question' ELSE 'stop' END AS type FROM m""")
def type_scores(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", P.best_type(P.score_types(F.col("text"), TYPES), 2).alias("type"))


@query(f"SELECT count(*) AS n, count(*) FILTER (epoch(o_orderdate) - epoch('{AS_OF}'::TIMESTAMP) BETWEEN -604800 AND 21600 OR o_orderdate IS NULL) AS kept FROM orders")
def freshness_gate(spark, d):
    keep = P.fresh(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp"), 604800, 21600)
    return _t(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(keep, 1)).alias("kept"))


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND (l_shipdate IS NULL OR l_shipdate >= '{AS_OF}'::TIMESTAMP)")
def active_rows(spark, d):
    return _t(spark, d, "lineitem").where(P.active(F.col("l_returnflag"), F.col("l_shipdate"), F.lit(AS_OF).cast("timestamp"), "N")).select("l_orderkey", "l_linenumber")


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS voices, count(*) FILTER (c_acctbal < 0) AS local_rows FROM customer GROUP BY 1 HAVING voices >= 2 AND local_rows >= 1")
def nest_gate(spark, d):
    return P.nest_gate(_t(spark, d, "customer"), "c_nationkey", "c_mktsegment", F.col("c_acctbal") < 0)


@query("SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m, max(floor(epoch(ts))) OVER () AS e FROM events) WHERE floor(epoch(ts)) >= e - 604800 OR ts = m")
def retention(spark, d):
    return P.keep_recent(_t(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 604800).select("event_id", "user_id")


@query("SELECT user_id, ts AS at, event_id, event_type = 'error' AS failed FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'error', event_id DESC) = 1")
def newest_outcome(spark, d):
    return P.newest_outcome(_t(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", "event_id")


@query("SELECT user_id, count(*) AS attempts, count(*) >= 5 AS permanent, CASE WHEN count(*) < 5 THEN max(floor(epoch(ts)))::BIGINT + 86400 END AS retry_after FROM events WHERE event_type = 'error' GROUP BY 1")
def retry_state(spark, d):
    return P.retry_state(_t(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 5, 86400)


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^.*\.html$') THEN true WHEN regexp_matches(path, '^/.*p=') THEN false WHEN starts_with(path, '/ar') THEN true WHEN starts_with(path, '/a') THEN false ELSE true END AS allowed FROM p""")
def robots(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*(/[^#]*)", 1).alias("path"))
    return p.select("page_id", P.robots_allowed(p, "path", ROBOTS).alias("allowed"))


_PARTS = " UNION ALL ".join(f"SELECT c_custkey AS id, '{f}' AS feature, round({f}::DOUBLE * {w}::DOUBLE, 6) + 0.0::DOUBLE AS part FROM customer" for f, w in WEIGHTS.items())


@query(f"SELECT id, feature, part, row_number() OVER (PARTITION BY id ORDER BY part DESC, feature)::INT AS place FROM ({_PARTS})")
def contributions(spark, d):
    return P.contributions(_t(spark, d, "customer").withColumnRenamed("c_custkey", "id"), "id", WEIGHTS)


@query("SELECT a.p_partkey, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) <= 5")
def related_items(spark, d):
    return P.related(_t(spark, d, "part"), "p_partkey", "p_brand")


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS shared, any_value(l) AS left_size, any_value(r) AS right_size
FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS l, count(*) OVER (PARTITION BY c_nationkey) AS r FROM customer) GROUP BY ALL""")
def group_overlap(spark, d):
    c = _t(spark, d, "customer")
    return P.overlap(c.select("c_custkey", "c_mktsegment"), c.select("c_custkey", "c_nationkey"), "c_custkey", "c_mktsegment", "c_nationkey")


@query(f"""WITH {_SCORED}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score), c AS (SELECT score, sum(n) OVER w AS m, sum(p) OVER w AS tp, sum(p) OVER () AS total FROM g WINDOW w AS (ORDER BY score DESC))
SELECT score AS threshold, round(2 * tp / (m + total)::DOUBLE, 6) AS f1 FROM c ORDER BY f1 DESC, score DESC LIMIT 1""")
def threshold_choice(spark, d):
    s = _scored(spark, d)
    total = s.agg(F.sum("label").alias("positives"))  # one row
    return P.best_threshold(R.pr_curve(s, "score", "label").join(F.broadcast(total)))


@query("""WITH e AS (SELECT toxic AS p, r AS round, ('0x' || substr(sha256(doc_id || '|' || r || '|7'), 1, 6))::BIGINT AS u FROM labels, range(20) t(r)),
t AS (SELECT round, p, CASE WHEN u < 6171992 THEN 0 WHEN u < 12343985 THEN 1 WHEN u < 15429981 THEN 2 ELSE 3 END AS k FROM e)
SELECT round::INT AS round, sum(k)::BIGINT AS n, sum(k * p)::BIGINT AS positive FROM t GROUP BY 1""")
def bootstrap(spark, d):
    return P.bootstrap_counts(_t(spark, d, "labels"), F.col("doc_id"), F.col("toxic") == 1, 20, 7)


@query("SELECT o_custkey AS k, 'both' AS side FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O' UNION ALL (SELECT o_custkey, 'closed' FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'closed' FROM orders WHERE o_orderstatus = 'O')")
def id_sets(spark, d):
    o = _t(spark, d, "orders")
    closed, opened = (o.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FO")
    return closed.intersect(opened).withColumn("side", F.lit("both")).union(closed.subtract(opened).withColumn("side", F.lit("closed")))


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_days(spark, d):
    g = _t(spark, d, "events").groupBy("user_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.unix_timestamp("window.start").alias("start_s"), "n", "total")


@query("""WITH m AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM m)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, no""")
def sessions(spark, d):
    g = _t(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_timestamp("session_window.start").alias("start_s"), "n")


@query("SELECT event_type, count(*) AS n, (10000 * count(*)) // sum(count(*)) OVER ()::BIGINT AS basis_points, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def distributions(spark, d):
    ev = _t(spark, d, "events")
    total = F.broadcast(ev.agg(F.count(F.lit(1)).alias("all")))  # one row
    g = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.join(total).select("event_type", "n", F.expr("10000 * n div all").alias("basis_points"), "lo", "hi")


@query("SELECT source, count(*) AS n, count(*) FILTER (text IS NULL) AS undated, min(n_chars) AS lo, max(n_chars) AS hi, (count(text) - count(DISTINCT text))::BIGINT AS repeats FROM documents GROUP BY 1")
def evidence_metadata(spark, d):
    each = _t(spark, d, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    null = F.col("h").isNull()
    return each.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("undated"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.when(null, 0).otherwise(F.col("n") - 1)).alias("repeats"))


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o FROM lineitem GROUP BY 1")
def class_pivot(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return g.select("l_returnflag", F.coalesce("F", F.lit(0)).cast("long").alias("f"), F.coalesce("O", F.lit(0)).cast("long").alias("o"))


@query(f"SELECT DISTINCT {_MONTH.format('o_orderdate')} AS no, CASE WHEN no = (SELECT max({_MONTH.format('o_orderdate')}) FROM orders) THEN 'leaf' END AS problem FROM orders")
def chain_check(spark, d):
    """A chain whose last payload was changed after it was sealed."""
    m = _t(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("no")).agg(F.count(F.lit(1)).alias("n"))
    payload = F.to_json(F.struct("no", "n"))
    last = F.broadcast(m.agg(F.max("no").alias("last")))  # one row
    changed = m.join(last).select("no", F.when(F.col("no") == F.col("last"), F.concat(payload, F.lit(" "))).otherwise(payload).alias("payload"))
    return P.check_chain(L.hash_chain(m, "no", payload).join(changed, "no"))
