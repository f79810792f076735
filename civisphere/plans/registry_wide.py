"""Registered queries of mentions, labels, edition records, orders and groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from civisphere.functions import stats as S
from civisphere.functions import text as T
from civisphere.functions import url as U
from civisphere.operators import editions as E
from civisphere.operators import evaluation as V
from civisphere.operators import extract as X
from civisphere.operators import grouping as G
from civisphere.operators import matching as M
from civisphere.plans.registry import _CANON, _FOLD, _HOST, _t, _tok, _wilson_sql, query

SURFACES = ["the", "of the", "in the", "und", "der", "les", "de la", "los", "el"]
GEO_RULES = [("capital", "named", "paris|berlin|madrid|london"), ("region", "number", "[0-9]{4}"), ("linked", "address", "https?:")]
UNIT_RULES = [("count", "([0-9]+ [a-z]+)"), ("mail", "([a-z]+@[a-z]+)"), ("year", "((?:19|20)[0-9]{2})")]
PLACE_MASKS = ["the the", "new road"]
PLACE_RULES = [("c", 3, "der", None), ("a", 1, "und ", "[0-9]"), ("b", 2, "the ", None), ("d", 4, "los", "el ")]
STATUSES, CODES = ["F", "O"], ["1-URGENT", "2-HIGH", "3-MEDIUM"]
AREAS = {"purchase": 3, "error": 5, "click": 1}
PAID = "'paid $' || l_extendedprice::DECIMAL(18,2) || ' at ' || (l_discount * 100)::INT || ' %'"


def _sql_list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {PAID} AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, (replace(regexp_extract(t, '{X.MONEY}', 1), ',', '')::DECIMAL(18,2) * 100)::BIGINT AS cents, (regexp_extract(t, '{X.PERCENT}', 1)::DECIMAL(18,4) * 100)::BIGINT AS bp FROM t""")
def money_mentions(spark, d):
    rows = _t(spark, d, "lineitem")
    text = F.concat(F.lit("paid $"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" at "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" %"))
    return rows.select("l_orderkey", "l_linenumber", F.get(X.cents(text), 0).alias("cents"), F.get(X.basis_points(text), 0).alias("bp"))


@query(rf"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{X.UNSEEN}', '', 'g'), '[ \t]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t)::INT AS n, md5(t) AS digest, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM s""")
def shown_titles(spark, d):
    s = _t(spark, d, "documents").select("doc_id", X.shown(F.col("text")).alias("t"))
    return s.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"), T.capped(F.col("t"), 60).alias("title"))


@query(f"SELECT name, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{X.NAME}', 1))) AS name FROM documents) GROUP BY name")
def name_counts(spark, d):
    return _t(spark, d, "documents").select(F.explode(X.names(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("docs"))


@query("""WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS anchor, (o_orderkey % 12 + 1) AS m, (o_orderkey % 31 + 1) AS dd FROM orders),
c AS (SELECT o_orderkey, anchor, unnest([try_strptime((year(anchor) + k) || '-' || m || '-' || dd, '%Y-%m-%d')::DATE FOR k IN [-1, 0, 1]]) AS x FROM r),
b AS (SELECT o_orderkey, arg_min(x, abs(x - anchor) * 100000 + (x - DATE '1970-01-01')) AS resolved FROM c WHERE x IS NOT NULL AND abs(x - anchor) <= 183 GROUP BY 1)
SELECT r.o_orderkey, resolved FROM r LEFT JOIN b USING (o_orderkey)""")
def nearest_days(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("anchor"))
    return o.select("o_orderkey", X.nearest_day((F.col("o_orderkey") % 12 + 1).cast("string"), (F.col("o_orderkey") % 31 + 1).cast("string"), F.col("anchor")).alias("resolved"))


_TERM = "|".join(" " + s.replace(" ", "  ") + " " for s in sorted(SURFACES, key=lambda s: (-len(s), s)))


@query(f"WITH t AS (SELECT unnest(list_transform(regexp_extract_all(' ' || array_to_string({_tok('text')}, '  ') || ' ', '{_TERM}'), lambda x: replace(trim(x), '  ', ' '))) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term")
def term_counts(spark, d):
    return _t(spark, d, "documents").select(F.explode(X.terms(F.col("text"), SURFACES)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_STREET = "CASE c_custkey % 3 WHEN 0 THEN 'Boul. ' WHEN 1 THEN 'Ave ' ELSE 'Ch. ' END || c_mktsegment || '-St. ' || (c_custkey % 40) || ' N'"


@query(f"WITH k AS (SELECT array_to_string(list_transform({_tok(_STREET)}, lambda w: CASE {' '.join(f"WHEN w = '{a}' THEN '{b}'" for a, b in X.STREET_WORDS.items())} ELSE w END), '-') AS street FROM customer) SELECT street, count(*) AS n FROM k GROUP BY street")
def street_keys(spark, d):
    k = F.col("c_custkey") % 3
    name = F.concat(F.when(k == 0, "Boul. ").when(k == 1, "Ave ").otherwise("Ch. "), F.col("c_mktsegment"), F.lit("-St. "), (F.col("c_custkey") % 40).cast("string"), F.lit(" N"))
    return _t(spark, d, "customer").select(X.street_key(name).alias("street")).groupBy("street").agg(F.count(F.lit(1)).alias("n"))


_LOW = _FOLD.format("text")


@query(f"SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches({_LOW}, '{p}') THEN '{a}'" for a, _, p in GEO_RULES)} ELSE 'none' END AS label, CASE {' '.join(f"WHEN regexp_matches({_LOW}, '{p}') THEN '{r}'" for _, r, p in GEO_RULES)} ELSE 'default' END AS reason, CASE {' '.join(f"WHEN regexp_matches({_LOW}, '{p}') THEN regexp_extract({_LOW}, '({p})', 1)" for _, _, p in GEO_RULES)} ELSE '' END AS evidence FROM documents")
def geo_proposal(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.first_match(F.col("text"), GEO_RULES, "none").alias("g")).select("doc_id", "g.*")


_UNITS = " UNION ALL ".join(f"SELECT doc_id, {k} AS r, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS value, unnest(range(1, 1 + len(regexp_extract_all(text, '{p}', 1)))) AS pos FROM documents" for k, (kind, p) in enumerate(UNIT_RULES))


@query(f"WITH u AS ({_UNITS}), f AS (SELECT doc_id, kind, value, min(r * 1000000 + pos) AS o FROM u GROUP BY ALL) SELECT doc_id, kind, value, (row_number() OVER (PARTITION BY doc_id ORDER BY o))::INT AS rank FROM f QUALIFY rank <= 5")
def impact_units(spark, d):
    return X.units(_t(spark, d, "documents"), UNIT_RULES)


_MASKED = f"regexp_replace(regexp_replace({_LOW}, '{PLACE_MASKS[0]}', ' ', 'g'), '{PLACE_MASKS[1]}', ' ', 'g')"
_PLACES = ", ".join(f"CASE WHEN regexp_matches(m, '{p}'){f" AND regexp_matches(m, '{c}')" if c else ''} THEN '{code}' END" for code, _, p, c in sorted(PLACE_RULES, key=lambda r: r[1]))


@query(f"WITH m AS (SELECT doc_id, {_MASKED} AS m FROM documents) SELECT doc_id, array_to_string(list_filter([{_PLACES}], lambda x: x IS NOT NULL), ',') AS places FROM m")
def place_codes(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.places(F.col("text"), PLACE_MASKS, PLACE_RULES), ",").alias("places"))


@query(f"""WITH b AS (SELECT doc_id, source, text, regexp_extract(text, '^([A-Z][a-z]+(?: [a-z]+)?)[,. ]', 1) AS byline FROM documents),
s AS (SELECT byline FROM b WHERE byline <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 2), o AS (SELECT min(source) AS o FROM documents)
SELECT doc_id, CASE WHEN source = (SELECT o FROM o) THEN 'official' WHEN regexp_matches({_LOW}, '@|https?:') THEN 'wire' WHEN byline IN (SELECT byline FROM s) THEN 'relay' WHEN byline <> '' THEN 'named' ELSE 'unknown' END AS origin FROM b""")
def origin_class(spark, d):
    docs = _t(spark, d, "documents")
    return X.origins(docs, [docs.agg(F.min("source")).first()[0]], "@|https?:")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority LIKE '%LOW%' THEN 'slow' ELSE '' END AS codes FROM orders")
def credit_alias_codes(spark, d):
    aliases = spark.createDataFrame([("urgent", "fast"), ("high", "fast"), ("low", "slow")], "alias string, code string")
    out = X.credit_codes(_t(spark, d, "orders"), "o_orderkey", "o_orderpriority", F.broadcast(aliases))
    return out.select("o_orderkey", F.array_join("codes", ",").alias("codes"))


@query(f"""WITH p AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS phrase FROM (SELECT {_tok('text')} AS w FROM benchmark) WHERE len(w) >= 3),
d AS (SELECT doc_id, {_tok('text')} AS w FROM documents), r AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS phrase FROM d WHERE len(w) >= 3)
SELECT doc_id, phrase FROM r JOIN p USING (phrase)""")
def phrase_containment(spark, d):
    w = _t(spark, d, "benchmark").select(T.tokens(F.col("text")).alias("w")).where(F.size("w") >= 3)
    return X.phrase_hits(_t(spark, d, "documents"), w.select(F.array_join(F.slice("w", 1, 3), " ").alias("phrase")), 3)


@query(r"""WITH q AS (SELECT d.doc_id, d.text, substr(CASE WHEN d.doc_id % 3 = 0 THEN b.text ELSE d.text END, 5, 30) AS quote FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)
SELECT doc_id, contains(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), trim(regexp_replace(quote, '[ \t\r\n]+', ' ', 'g'))) AS found FROM q""")
def quote_provenance(spark, d):
    b = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("other"))
    q = _t(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40).join(b, "item_id")
    quote = F.substring(F.when(F.col("doc_id") % 3 == 0, F.col("other")).otherwise(F.col("text")), 5, 30)
    return q.select("doc_id", X.literal_span(F.col("text"), quote).alias("found"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN NOT coalesce(event_type IN ('click', 'purchase'), false) THEN 'type' END, CASE WHEN NOT coalesce(value >= 20, false) THEN 'value' END, CASE WHEN NOT coalesce(user_id % 7 <> 0, false) THEN 'user' END], lambda x: x IS NOT NULL), ',') AS problems FROM events""")
def store_problems(spark, d):
    checks = [("type", F.col("event_type").isin("click", "purchase")), ("value", F.col("value") >= 20), ("user", F.col("user_id") % 7 != 0)]
    return E.problems(_t(spark, d, "events"), checks).select("event_id", "problems")


def _half(spark, d, late: bool):
    e = _t(spark, d, "events").withColumn("late", F.col("event_id") % 2 == 1)
    return e.where("late" if late else "not late").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))


@query("""WITH h AS (SELECT user_id, event_id % 2 = 1 AS late, arg_max(event_type, epoch_us(ts) * 1000000::HUGEINT + event_id) AS last FROM events GROUP BY ALL), a AS (SELECT * FROM h WHERE NOT late), b AS (SELECT * FROM h WHERE late)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'gone' WHEN a.last <> b.last THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id""")
def since_left_delta(spark, d):
    return E.delta(_half(spark, d, False), _half(spark, d, True), "user_id")


@query("SELECT event_id, sha256(props) AS digest, coalesce(lag(sha256(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) = sha256(props), false) AS not_modified FROM events")
def run_log(spark, d):
    runs = _t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return E.run_log(runs, "user_id", "at", "props").select("event_id", "digest", "not_modified")


@query("""WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last_ok FROM events GROUP BY 1)
SELECT e.user_id, any_value(l.last_ok) AS last_ok, count(*) FILTER (event_type = 'error' AND (l.last_ok IS NULL OR ts > l.last_ok)) AS failed FROM events e JOIN l ON e.user_id = l.user_id GROUP BY 1""")
def failures_since_ok(spark, d):
    return E.failures_since_ok(_t(spark, d, "events"), "user_id", F.col("ts"), F.col("event_type") != "error")


def _rules(spark, d):
    p = _t(spark, d, "pages")
    rule = lambda i, kind, value, status="active": p.agg(F.lit(i).alias("id"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(status).alias("status"))
    host = U.host(F.col("url"))
    out = rule(1, "host", F.min(host)).union(rule(2, "url", F.max("url"))).union(rule(3, "source", F.max(F.col("page_id") % 5).cast("string")))
    return out.union(rule(4, "host", F.max(host), "lifted")).union(rule(5, "page", F.max("url"))).union(rule(5, "url", F.min("url"))).union(rule(6, "url", F.lit(" "))).union(rule(7, "host", F.min(host), "open"))


_RULES = f"""{_CANON}, h AS (SELECT *, {_HOST} AS host, (page_id % 5)::VARCHAR AS source FROM c),
r AS (SELECT 1 AS id, 'host' AS kind, min(host) AS value, 'active' AS status FROM h UNION ALL SELECT 2, 'url', max(url), 'active' FROM h UNION ALL SELECT 3, 'source', max(source), 'active' FROM h
 UNION ALL SELECT 4, 'host', max(host), 'lifted' FROM h UNION ALL SELECT 5, 'page', max(url), 'active' FROM h UNION ALL SELECT 5, 'url', min(url), 'active' FROM h UNION ALL SELECT 6, 'url', ' ', 'active' UNION ALL SELECT 7, 'host', min(host), 'open' FROM h),
x AS (SELECT *, CASE WHEN kind NOT IN ('source', 'host', 'url', 'image') THEN 'kind' WHEN trim(value) = '' THEN 'value' WHEN status NOT IN ('active', 'lifted') THEN 'status' WHEN row_number() OVER (PARTITION BY id ORDER BY kind, value) > 1 THEN 'repeated' END AS error FROM r)"""


@query(f"WITH {_RULES} SELECT id, kind, error FROM x")
def takedown_errors(spark, d):
    return E.rule_errors(_rules(spark, d)).select("id", "kind", "error")


@query(f"""WITH {_RULES}, l AS (SELECT * FROM x WHERE error IS NULL AND status = 'active'), gone AS (SELECT canonical FROM h WHERE url IN (SELECT value FROM l WHERE kind = 'url'))
SELECT page_id FROM h WHERE NOT EXISTS (SELECT 1 FROM l WHERE kind = 'host' AND (host = value OR ends_with(host, '.' || value))) AND NOT EXISTS (SELECT 1 FROM l WHERE kind = 'source' AND source = value) AND (canonical IS NULL OR canonical NOT IN (SELECT canonical FROM gone WHERE canonical IS NOT NULL))""")
def takedown_replay(spark, d):
    pages = _t(spark, d, "pages").withColumn("source", (F.col("page_id") % 5).cast("string"))
    return E.apply_takedowns(pages, _rules(spark, d), {"host": "url", "url": "url", "source": "source"}).select("page_id")


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, o_orderpriority FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1)
SELECT p.o_custkey, p.o_orderpriority, w.weakest, w.newest FROM p JOIN (SELECT o_custkey, max(left(o_orderpriority, 1)) AS weakest, max(o_orderdate) AS newest FROM orders GROUP BY 1) w ON p.o_custkey = w.o_custkey""")
def event_geo_tier(spark, d):
    o = _t(spark, d, "orders")
    w = o.groupBy("o_custkey").agg(F.max(F.substring("o_orderpriority", 1, 1)).alias("weakest"), F.max("o_orderdate").alias("newest"))
    return E.plurality(o, "o_custkey", "o_orderpriority").join(w, "o_custkey")


@query(f"WITH c AS (SELECT {_HOST} AS host, CASE WHEN length(html) < 400 THEN 'short' WHEN contains(html, '<script') THEN 'script' ELSE 'ok' END AS reason FROM pages), n AS (SELECT host, reason, count(*) AS n FROM c GROUP BY ALL) SELECT host, sum(n)::BIGINT AS pages, sum(CASE WHEN reason <> 'ok' THEN n ELSE 0 END)::BIGINT AS missing, arg_min(reason, (-n)::VARCHAR || reason) AS any_reason FROM (SELECT host, reason, n FROM n) GROUP BY host HAVING any_reason IS NOT NULL".replace("arg_min(reason, (-n)::VARCHAR || reason) AS any_reason", "min(reason) AS first_reason").replace(" HAVING any_reason IS NOT NULL", ""))
def media_health(spark, d):
    reason = F.when(F.length("html") < 400, "short").when(F.contains("html", F.lit("<script")), "script").otherwise("ok")
    n = _t(spark, d, "pages").select(U.host(F.col("url")).alias("host"), reason.alias("reason")).groupBy("host", "reason").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("host").agg(F.sum("n").alias("pages"), F.sum(F.when(F.col("reason") != "ok", F.col("n")).otherwise(0)).alias("missing"), F.min("reason").alias("first_reason"))


@query(f"SELECT o_orderdate::DATE AS day, count(*) AS items, array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderpriority IN ({_sql_list(CODES)})))), ',') AS codes, sum((o_orderpriority NOT IN ({_sql_list(CODES)}))::INT)::BIGINT AS dropped, min(o_orderkey) AS first_item, max(o_orderkey) AS last_item FROM orders GROUP BY 1".replace("array_to_string(list_sort", "coalesce(array_to_string(list_sort").replace(")))), ',') AS codes", ")))), ','), '') AS codes"))
def edition_records(spark, d):
    return E.record(_t(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "o_orderkey", "o_orderpriority", CODES)


@query("SELECT count(*) AS total, count(*) FILTER (m >= e - INTERVAL 7 DAY) AS ok, count(*) FILTER (m < e - INTERVAL 7 DAY) AS stale, count(*) FILTER (bad > 0) AS partial FROM (SELECT user_id, max(ts) AS m, count(*) FILTER (event_type = 'error') AS bad, max(max(ts)) OVER () AS e FROM events GROUP BY 1)")
def collection_status(spark, d):
    e = _t(spark, d, "events")
    end = F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 7 DAY")
    each = e.groupBy("user_id").agg(F.max("ts").alias("m"), F.sum((F.col("event_type") == "error").cast("long")).alias("bad"))
    one = lambda c: F.sum(c.cast("long"))
    return each.agg(F.count(F.lit(1)).alias("total"), one(F.col("m") >= end).alias("ok"), one(F.col("m") < end).alias("stale"), one(F.col("bad") > 0).alias("partial"))


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, (o_totalprice > 150000) DESC, o_orderdate DESC, o_orderkey))::INT AS place FROM orders) WHERE place <= 5")
def impact_first(spark, d):
    return E.impact_first(_t(spark, d, "orders"), "o_custkey", F.col("o_totalprice") > 150000, [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "P", 5).select("o_custkey", "o_orderkey", "place")


@query(f"WITH s AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, sum(CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in AREAS.items())} ELSE 0 END)::BIGINT AS score FROM events GROUP BY ALL) SELECT user_id, day, score, (row_number() OVER (PARTITION BY day ORDER BY score DESC, user_id))::INT AS place FROM s QUALIFY place <= 10")
def facet_order(spark, d):
    facets = F.broadcast(spark.createDataFrame(list(AREAS.items()), "event_type string, weight long"))
    return E.facet_order(_t(spark, d, "events").withColumn("day", F.to_date("ts")), facets, "user_id", "event_type", "day", 10)


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS first_official FROM events GROUP BY 1)
SELECT e.user_id, any_value(first_official) AS first_official, count(*) FILTER (first_official IS NOT NULL AND ts >= first_official) AS measured, count(*) FILTER (first_official IS NULL OR ts < first_official) AS run FROM events e JOIN f ON e.user_id = f.user_id GROUP BY 1""")
def promise_line(spark, d):
    return E.promise(_t(spark, d, "events"), "user_id", "ts", F.col("event_type") == "purchase")


@query("""WITH c AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), k AS (SELECT * FROM c WHERE was IS NULL OR was <> event_type)
SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS revision FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40""")
def timeline_revisions(spark, d):
    e = _t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return E.revisions(e, "user_id", "at", "event_type", 40).select("user_id", F.col("at.event_id").alias("event_id"), "event_type", "revision")


@query("""WITH n AS (SELECT k, sum(s) AS s FROM (SELECT o_custkey AS k, 1 AS s FROM orders UNION ALL SELECT c_custkey, -1 FROM customer) GROUP BY k)
SELECT coalesce(sum(greatest(s, 0)), 0)::BIGINT AS missing, coalesce(sum(greatest(-s, 0)), 0)::BIGINT AS extra FROM n""")
def multiset_identity(spark, d):
    return E.same_multiset(_t(spark, d, "orders").select(F.col("o_custkey").alias("k")), _t(spark, d, "customer").select(F.col("c_custkey").alias("k")))


_HITS = "sum((toxic = 1)::INT)"


@query(f"WITH s AS (SELECT source, toxic FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, {_HITS}::BIGINT AS k, count(*) AS n, {_wilson_sql(_HITS, 'count(*)', '-')} AS lo FROM s GROUP BY 1) SELECT *, CASE WHEN lo >= 0.05 THEN 'measured' ELSE 'estimated' END AS chip FROM c")
def quality_chips(spark, d):
    return E.chips(_t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id"), "source", F.col("toxic") == 1, 0.05)


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id, abs(floor(epoch(a.ts)) - floor(epoch(b.ts)))::BIGINT AS apart FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 259200""")
def outage_anchors(spark, d):
    e = _t(spark, d, "events").withColumnRenamed("event_id", "id")
    return E.near_in_time(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), "user_id", "ts", 259200)


@query("""WITH m AS (SELECT doc_id, lang, md5(coalesce(text, '')) AS k FROM documents), g AS (SELECT doc_id // 10 AS event, doc_id, lang FROM documents WHERE lang IN ('fr', 'en'))
SELECT a.event, a.doc_id AS fr, b.doc_id AS en FROM g a JOIN g b ON a.event = b.event AND a.lang = 'fr' AND b.lang = 'en'""")
def language_pairs(spark, d):
    g = _t(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("event"), "doc_id", "lang")
    return g.where("lang = 'fr'").select("event", F.col("doc_id").alias("fr")).join(g.where("lang = 'en'").select("event", F.col("doc_id").alias("en")), "event")


_AP = "WITH s AS (SELECT n_chars AS score, toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT score, count(*) AS n, sum(label)::BIGINT AS p FROM s GROUP BY 1), c AS (SELECT p, sum(n) OVER w AS m, sum(p) OVER w AS tp FROM g WINDOW w AS (ORDER BY score DESC))"


@query(f"{_AP} SELECT round(sum(p * (tp / m::DOUBLE)) / sum(p), 6) AS ap FROM c")
def average_precision(spark, d):
    s = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("toxic").alias("label"))
    return V.average_precision(s, "score", "label")


@query("""WITH c AS (SELECT lang AS g, source AS c, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), b AS (SELECT sum(n * (n - 1) / 2) AS shared FROM c), o AS (SELECT sum(n * (n - 1) / 2) AS own FROM (SELECT sum(n) AS n FROM c GROUP BY c)), a AS (SELECT sum(n * (n - 1) / 2) AS whole FROM (SELECT sum(n) AS n FROM c GROUP BY g))
SELECT round(shared / own, 6) AS precision, round(shared / whole, 6) AS recall, round(2 * shared / (own + whole), 6) AS f1 FROM b, o, a""")
def induced_pairs(spark, d):
    return V.induced_pairs(_t(spark, d, "documents"), "source", "lang")


@query("""WITH p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents), t AS (SELECT a, b, CASE WHEN x.lang = y.lang THEN 'same' ELSE 'cross' END AS tier, x.source = y.source AS kept FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b)
SELECT tier, count(*) AS pairs, count(*) FILTER (kept) AS kept, round(count(*) FILTER (kept) / count(*)::DOUBLE, 6) AS recall FROM t GROUP BY tier""")
def blocking_recall(spark, d):
    docs = _t(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("a_id"), F.col("lang").alias("x"), F.col("source").alias("sx"))
    both = a.withColumn("b_id", F.col("a_id") + 1).join(docs.select(F.col("doc_id").alias("b_id"), F.col("lang").alias("y"), F.col("source").alias("sy")), "b_id")
    pairs = both.withColumn("tier", F.when(F.col("x") == F.col("y"), "same").otherwise("cross"))
    return V.blocking_recall(pairs.select("a_id", "b_id", "tier"), pairs.where("sx = sy"), "tier")


@query("""WITH h AS (SELECT user_id, event_id % 2 = 1 AS late, arg_max(event_type, epoch_us(ts) * 1000000::HUGEINT + event_id) AS owner FROM events GROUP BY ALL), a AS (SELECT * FROM h WHERE NOT late), b AS (SELECT * FROM h WHERE late)
SELECT count(*) AS items, count(*) FILTER (b.owner <> a.owner) AS moved, count(*) FILTER (b.owner IS NULL) AS lost FROM a LEFT JOIN b USING (user_id)""")
def id_stability(spark, d):
    return V.moved(*(_half(spark, d, k).select(F.col("user_id").alias("id"), F.col("last").alias("owner")) for k in (False, True)))


_EDGES = "SELECT DISTINCT l_suppkey AS id, l_orderkey AS key FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R' AND l_discount < 0.02"


def _members(spark, d):
    rows = _t(spark, d, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R' and l_discount < 0.02")
    return rows.select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("key"))


_PARTS = f"m AS ({_EDGES}), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM m a JOIN m b ON a.key = b.key), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a), k AS (SELECT a AS id, min(b) AS component FROM w GROUP BY a)"


@query(f"WITH RECURSIVE {_PARTS} SELECT id, component FROM k")
def independence_components(spark, d):
    return G.components_by_key(_members(spark, d))


@query(f"WITH RECURSIVE {_PARTS} SELECT id, component, CASE WHEN ('0x' || substr(sha256(component::VARCHAR), 1, 8))::BIGINT % 100 < 30 THEN 'test' ELSE 'dev' END AS split FROM k")
def component_split(spark, d):
    return G.components_by_key(_members(spark, d)).withColumn("split", G.split_of(F.col("component"), 30))


_PAIR = "SELECT doc_id AS a, doc_id + 3 AS b, (doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM documents"


def _pairs(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 3).alias("b"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("score"))


@query(f"WITH p AS ({_PAIR}), j AS (SELECT least(p.a // 5, p.b // 5) AS ea, greatest(p.a // 5, p.b // 5) AS eb, score FROM p JOIN documents x ON x.doc_id = p.b) SELECT ea, eb, max(score) AS score FROM j WHERE ea <> eb GROUP BY ALL")
def event_neighbours(spark, d):
    owner = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).alias("event"))
    return G.neighbours(_pairs(spark, d), owner)


@query()
def sticky_attach(spark, d):
    items = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 17).alias("at"), F.when(F.col("doc_id") % 10 == 0, F.col("doc_id")).alias("event"))
    pairs = _pairs(spark, d).where("score >= 0.4").join(items.select(F.col("id").alias("b")), "b").select("a", "b", "score")
    return G.attach(items, pairs)


@query()
def average_link(spark, d):
    ids = _t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return G.average_link(ids, _pairs(spark, d).where("score >= 0.4").join(ids.select(F.col("id").alias("b")), "b").select("a", "b", "score"), 0.5)


@query()
def complete_link_buckets(spark, d):
    items = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.concat_ws("-", F.to_date("o_orderdate").cast("string"), "o_orderpriority")).alias("words"))
    return G.complete_link(items, 2, 0.4)


@query()
def dossier_continuity(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("item"), F.to_date("ts").alias("day"), (F.col("event_id") % 2).alias("half"))
    side = lambda k: e.where(F.col("half") == k).select(F.dayofyear("day").alias("group"), "item").distinct()
    return G.continue_ids(side(0), side(1))


EVENT_TERMS = ["of the", "in the", "de la"]
PAIR_WEIGHTS = {"bias": -2.0, "time": 1.0, "far": -1.0, "numbers": 1.5, "dates": 0.5, "names": 2.0, "place": 0.7, "conflict": -0.8, "event_conflict": -0.5, "terms": 1.0, "event": 0.4, "tokens": 4.0, "title": 1.0, "chars": 3.0, "cross": -0.3, "cross_tokens": 1.0, "cross_chars": 1.0}
BARS = {"certain": 0.8, "probable": 0.6, "possible": 0.3}


def match_keys(docs):
    """``id, kind, key, n``: the keys by which documents are matched, but for grams."""
    title = F.array_join(F.slice(F.split("text", " "), 1, 12), " ")
    low, found = T.fold(F.col("text")), X.terms(F.col("text"), SURFACES)
    events = F.array(*map(F.lit, EVENT_TERMS))
    dates = F.transform(F.regexp_extract_all("text", F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1)), lambda x: F.concat(F.lit("d:"), x))
    kinds = {
        "numbers": T.numbers(F.col("text")), "dates": F.concat(dates, F.regexp_extract_all(low, F.lit("(monday|lundi|montag|lunes)"), F.lit(1))), "names": X.names(F.col("text")),
        "place": X.places(F.col("text"), PLACE_MASKS, PLACE_RULES), "head_place": X.places(F.col("title"), PLACE_MASKS, PLACE_RULES), "terms": found, "event": F.array_intersect(found, events),
        "title_event": F.array_intersect(X.terms(F.col("title"), SURFACES), events), "tokens": T.tokens(F.col("text")), "title": T.tokens(F.col("title")),
    }
    rows = docs.select(F.col("doc_id").alias("id"), "text", title.alias("title"))
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("key"))
    every = F.flatten(F.array(*(F.coalesce(F.transform(c, named(k)), F.array()) for k, c in kinds.items())))
    out = rows.select("id", F.explode(every).alias("x")).select("id", "x.kind", "x.key")
    return out.groupBy("id", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def _matched(spark, d):
    docs = _t(spark, d, "documents")
    pairs = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(docs.select(F.col("doc_id").alias("b")), "b").select("a", "b")
    items = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 7 * 36000).alias("at"), "lang")
    total = docs.count()
    texts = docs.select(F.col("doc_id").alias("id"), F.array_join(T.tokens(F.col("text")), " ").alias("text"))
    return M.features(pairs, items, match_keys(docs), total, M.gram_likeness(pairs, texts, total))


_MASK = lambda low: f"regexp_replace(regexp_replace({low}, '{PLACE_MASKS[0]}', ' ', 'g'), '{PLACE_MASKS[1]}', ' ', 'g')"
_PL = lambda m: f"list_filter([{_PLACES.replace('regexp_matches(m,', f'regexp_matches({m},')}], lambda x: x IS NOT NULL)"
_TM = lambda t: f"list_transform(regexp_extract_all(' ' || array_to_string({_tok(t)}, '  ') || ' ', '{_TERM}'), lambda x: replace(trim(x), '  ', ' '))"
_EV = f"[{_sql_list(EVENT_TERMS)}]"
_KINDS = {
    "numbers": "list_transform(regexp_extract_all(text, '[0-9]{1,3}(?:[ ,][0-9]{3})+|[0-9]+'), lambda x: regexp_replace(x, '[ ,]', '', 'g'))",
    "dates": f"list_concat(list_transform(regexp_extract_all(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), lambda x: 'd:' || x), regexp_extract_all({_LOW}, '(monday|lundi|montag|lunes)', 1))",
    "names": f"regexp_extract_all(text, '{X.NAME}', 1)", "place": _PL(_MASK(_LOW)), "head_place": _PL(_MASK(_FOLD.format("title"))), "terms": _TM("text"),
    "event": f"list_filter({_TM('text')}, lambda x: list_contains({_EV}, x))", "title_event": f"list_filter({_TM('title')}, lambda x: list_contains({_EV}, x))",
    "tokens": _tok("text"), "title": _tok("title"), "chars": "list_transform(range(1, length(j) - 2), lambda i: substr(j, i, 4))",
}
_ONCE = ("numbers", "names", "event", "title_event")
_MATCH = f"""d AS MATERIALIZED (SELECT doc_id AS id, text, array_to_string(string_split(text, ' ')[1:12], ' ') AS title, array_to_string({_tok('text')}, ' ') AS j, lang, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 7 * 36000 END AS at FROM documents),
k0 AS ({' UNION ALL '.join(f"SELECT id, '{k}' AS kind, unnest({'list_distinct(' + e + ')' if k in _ONCE else e}) AS key FROM d" for k, e in _KINDS.items())}),
k AS MATERIALIZED (SELECT id, kind, key, count(*) AS n FROM k0 GROUP BY ALL),
w0 AS (SELECT kind, key, ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS w FROM k WHERE kind IN ('numbers', 'names', 'terms', 'tokens', 'chars') GROUP BY ALL),
w1 AS (SELECT id, k.kind, k.key, coalesce(w, 1.0::DOUBLE) * CASE WHEN k.kind = 'chars' THEN ln(n) + 1 ELSE 1 END AS w FROM k LEFT JOIN w0 ON w0.key = k.key AND w0.kind = CASE WHEN k.kind = 'title' THEN 'tokens' ELSE k.kind END),
w AS MATERIALIZED (SELECT id, kind, key, w / CASE WHEN kind = 'chars' THEN sqrt(sum(w * w) OVER (PARTITION BY id, kind)) ELSE 1 END AS w FROM w1),
p AS (SELECT x.id AS a, y.id AS b, x.at AS xa, y.at AS ya, x.lang AS xl, y.lang AS yl FROM d x JOIN d y ON y.id = x.id + 1),
s AS MATERIALIZED (SELECT a, b, l.kind, sum(CASE WHEN l.kind = 'chars' THEN l.w * r.w ELSE l.w END) AS w, bool_or(starts_with(l.key, 'd:')) AS day FROM p JOIN w l ON l.id = a JOIN w r ON r.id = b AND r.kind = l.kind AND r.key = l.key GROUP BY ALL),
e AS (SELECT DISTINCT a, b FROM p JOIN w l ON l.id = a JOIN w r ON r.id = b AND r.key = l.key WHERE (l.kind = 'title_event' AND r.kind = 'terms') OR (l.kind = 'terms' AND r.kind = 'title_event')),
t AS MATERIALIZED (SELECT id, kind, sum(w) AS w FROM w GROUP BY ALL),
g AS (SELECT a, b, {', '.join(f"max(w) FILTER (kind = '{k}') AS s_{k}" for k in ('numbers', 'dates', 'names', 'place', 'terms', 'event', 'tokens', 'title', 'chars'))}, bool_or(day) FILTER (kind = 'dates') AS day FROM s GROUP BY ALL),
o AS (SELECT id, {', '.join(f"max(w) FILTER (kind = '{k}') AS t_{k}" for k in ('numbers', 'names', 'terms', 'tokens', 'title', 'head_place', 'title_event'))} FROM t GROUP BY id),
f AS (SELECT p.a, p.b, abs(xa - ya) / 3600.0::DOUBLE AS h, coalesce(xl <> yl, false) AS x, g.* EXCLUDE (a, b), {', '.join(f"coalesce(m.t_{k}, 0) AS a_{k}, coalesce(q.t_{k}, 0) AS b_{k}" for k in ('numbers', 'names', 'terms', 'tokens', 'title', 'head_place', 'title_event'))}, e.a IS NOT NULL AS ev FROM p LEFT JOIN g ON g.a = p.a AND g.b = p.b LEFT JOIN o m ON m.id = p.a LEFT JOIN o q ON q.id = p.b LEFT JOIN e ON e.a = p.a AND e.b = p.b),
y AS (SELECT a, b, CASE WHEN h IS NULL THEN 0.5 ELSE exp(-h / 12) END AS time, (coalesce(h > 72, false))::INT::DOUBLE AS far,
 {', '.join(f"CASE WHEN s_{k} IS NULL THEN 0 ELSE 2 * s_{k} / (a_{k} + b_{k}) END AS {k}" for k in ('numbers', 'names', 'terms'))},
 CASE WHEN day THEN 1.0 WHEN s_dates IS NOT NULL THEN 0.5 ELSE 0.0 END AS dates, (s_place IS NOT NULL)::INT::DOUBLE AS place, (a_head_place > 0 AND b_head_place > 0 AND s_place IS NULL)::INT::DOUBLE AS conflict,
 (a_title_event > 0 AND b_title_event > 0 AND NOT ev)::INT::DOUBLE AS event_conflict, (s_event IS NOT NULL)::INT::DOUBLE AS event, CASE WHEN s_tokens IS NULL THEN 0 ELSE s_tokens / (a_tokens + b_tokens - s_tokens) END AS tokens,
 CASE WHEN s_title IS NULL THEN 0 ELSE s_title / least(a_title, b_title) END AS title, coalesce(s_chars, 0) AS chars, x::INT::DOUBLE AS "cross" FROM f),
z AS (SELECT *, "cross" * tokens AS cross_tokens, "cross" * chars AS cross_chars FROM y),
c AS (SELECT *, 1 / (1 + exp(-({' + '.join([str(PAIR_WEIGHTS['bias'])] + [f'"{k}" * {v}' for k, v in PAIR_WEIGHTS.items() if k != 'bias'])}))) AS score FROM z)"""
_R6 = ", ".join(f'round("{k}"::DOUBLE, 6) AS "{k}"' for k in M.FEATURES)


@query(f"WITH {_MATCH} SELECT a, b, {_R6} FROM z")
def pair_features(spark, d):
    return _matched(spark, d).select("a", "b", *(F.round(k, 6).alias(k) for k in M.FEATURES))


@query(f"""WITH {_MATCH} SELECT a, b, round(score, 5) AS score, CASE WHEN score >= 0.8 AND g THEN 'certain' WHEN score >= 0.6 AND g THEN 'probable' WHEN score >= 0.3 THEN 'possible' END AS tier FROM (SELECT *, "cross" = 0 OR names > 0 OR place > 0 OR numbers > 0 AS g FROM c)""")
def pair_tiers(spark, d):
    return M.scored(_matched(spark, d), PAIR_WEIGHTS, BARS).select("a", "b", F.round("score", 5).alias("score"), "tier")


@query("WITH n AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL) SELECT a, b, n, round(n / (sum(n) OVER (PARTITION BY a))::DOUBLE, 6) AS share FROM n")
def label_matrix(spark, d):
    return V.matrix(_t(spark, d, "labels"), "quality", "toxic").withColumnsRenamed({"quality": "a", "toxic": "b"})


@query("SELECT l_orderkey, l_linenumber, place FROM (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate DESC, l_linenumber))::INT AS place FROM lineitem) WHERE place <= 6")
def severity_order(spark, d):
    severity = {"R": 0, "A": 1}
    return E.severity_order(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", severity, "l_shipdate", "l_linenumber", 6).select("l_orderkey", "l_linenumber", "place")


@query("""WITH e AS (SELECT *, max(ts) OVER () AS now FROM events), g AS (SELECT user_id, event_id, CASE WHEN now - ts <= INTERVAL 24 HOUR THEN 'today' WHEN now - ts <= INTERVAL 7 DAY THEN 'week' ELSE 'older' END AS fresh, ts FROM e WHERE event_type = 'purchase' AND now - ts <= INTERVAL 30 DAY)
SELECT user_id, event_id, fresh, (row_number() OVER (PARTITION BY user_id, fresh ORDER BY ts DESC, event_id))::INT AS place FROM g""")
def official_freshness(spark, d):
    e = _t(spark, d, "events")
    return E.fresh_groups(e.where("event_type = 'purchase'"), e.agg(F.max("ts").alias("now")), "user_id", "ts", "event_id", 30).select("user_id", "event_id", "fresh", "place")


@query("""WITH a AS (SELECT c_nationkey, unnest(CASE WHEN c_acctbal < 0 THEN ['debt', c_mktsegment] WHEN c_acctbal > 8000 THEN ['rich', c_mktsegment] ELSE [c_mktsegment] END) AS area FROM customer), n AS (SELECT c_nationkey, area, count(*) AS n FROM a GROUP BY ALL)
SELECT c_nationkey, area, n, (row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, area))::INT AS place FROM n QUALIFY place <= 3""")
def area_blocks(spark, d):
    own = F.array("c_mktsegment")
    areas = F.when(F.col("c_acctbal") < 0, F.concat(F.array(F.lit("debt")), own)).when(F.col("c_acctbal") > 8000, F.concat(F.array(F.lit("rich")), own)).otherwise(own)
    return E.blocks(_t(spark, d, "customer"), "c_nationkey", areas, 3)


IMPACTS = {"click": ["reach"], "purchase": ["money", "reach"], "error": ["service"]}


@query(f"SELECT user_id, array_to_string(list_sort(list_distinct(flatten(list(CASE event_type {' '.join(f"WHEN '{k}' THEN [{_sql_list(v)}]" for k, v in IMPACTS.items())} ELSE [] END)))), ',') AS impacts FROM events GROUP BY user_id")
def impact_labels(spark, d):
    g = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("topics"))
    return g.select("user_id", F.array_join(F.array_sort(X.impacts(F.col("topics"), IMPACTS)), ",").alias("impacts"))


@query(rf"""WITH o AS (SELECT * FROM (VALUES ('A', 'public', 'https://a.example/x', '2025-01-31'), ('N', 'private', 'http://a.example', '2025-01-31'), ('R', 'coop', 'https://b.example', '2025-13-01')) t(flag, owner, ref, day))
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(ref, '^https://[^/]+') AND try_strptime(day, '%Y-%m-%d') IS NOT NULL THEN owner ELSE 'undeclared' END AS owner FROM lineitem LEFT JOIN o ON flag = l_returnflag""")
def ownership_class(spark, d):
    table = spark.createDataFrame([("A", "public", "https://a.example/x", "2025-01-31"), ("N", "private", "http://a.example", "2025-01-31"), ("R", "coop", "https://b.example", "2025-13-01")], "flag string, owner string, ref string, day string")
    return X.ownership(_t(spark, d, "lineitem"), "l_returnflag", table).select("l_orderkey", "l_linenumber", "owner")


@query("""WITH t AS (SELECT o_orderkey, o_orderdate + INTERVAL 30 YEAR AS ts, year(o_orderdate) + 30 AS y FROM orders), b AS (SELECT *, make_date(y, 3, 1) AS m, make_date(y, 11, 1) AS n FROM t),
s AS (SELECT *, (m + ((7 - dayofweek(m)) % 7 + 7)::INT)::TIMESTAMP + INTERVAL 7 HOUR AS b0, (n + ((7 - dayofweek(n)) % 7)::INT)::TIMESTAMP + INTERVAL 6 HOUR AS b1 FROM b)
SELECT o_orderkey, ts - CASE WHEN ts >= b0 AND ts < b1 THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS "local" FROM s""")
def eastern_time(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.eastern(F.expr("o_orderdate + INTERVAL 30 YEAR").cast("timestamp")).cast("timestamp_ntz").alias("local"))


@query("""WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, list_sort(list(event_type) FILTER (n >= 20)) AS kept, list_sort(list(event_type) FILTER (n < 20)) AS gone FROM r GROUP BY 1)
SELECT user_id, coalesce(array_to_string(kept, ','), '') AS stated_by, coalesce(len(gone), 0)::INT AS reduced FROM g""")
def reduced_facts(spark, d):
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return E.reduced(n, "user_id", "event_type", F.col("n") >= 20)
