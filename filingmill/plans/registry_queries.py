"""Registry, cache, merging and feed operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, merge, registry
from ..sources import announcements
from . import views
from .catalog import query
from .views import CACHE, REGISTRY

AS_OF = "1997-06-01 00:00:00"


@query(f"WITH {REGISTRY} SELECT id, stock_code, market, report_type, report_year FROM registry WHERE is_available AND market = 'CN' AND report_type = 'annual' ORDER BY download_time DESC, id LIMIT 50")
def flt1_top1_registry_search(spark, sf_dir):
    return registry.search(views.registry(spark, sf_dir), market="CN", report_type="annual", limit=50).select("id", "stock_code", "market", "report_type", "report_year")


@query(f"WITH {REGISTRY} SELECT id, report_year, file_size FROM registry WHERE is_available AND report_year = 1996 ORDER BY report_year, id LIMIT 30")
def flt1_top1_by_year_ascending(spark, sf_dir):
    return registry.search(views.registry(spark, sf_dir), report_type="all", year=1996, limit=30, sort_by="report_year", descending=False).select("id", "report_year", "file_size")


@query(f"WITH {REGISTRY} SELECT id, market, file_size FROM registry WHERE is_available AND stock_code = '000007' ORDER BY download_time DESC, id LIMIT 100")
def top7_of_stock(spark, sf_dir):
    return registry.of_stock(views.registry(spark, sf_dir), "000007").select("id", "market", "file_size")


@query(f"WITH {REGISTRY} SELECT id, strftime(download_time, '%Y-%m-%dT%H:%M:%S') AS download_time FROM registry")
def prj1_iso_times(spark, sf_dir):
    return registry.as_text(views.registry(spark, sf_dir).select("id", "download_time"), "download_time")


@query(
    f"WITH {REGISTRY} SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (market = '{m}') AS market_{m}" for m in ("CN", "HK", "US"))
    + ", "
    + ", ".join(f"count(*) FILTER (report_type = '{t}') AS report_type_{t}" for t in ("annual", "semi_annual", "quarterly"))
    + " FROM registry WHERE is_available"
)
def agg1_domain_counts(spark, sf_dir):
    return registry.stats(views.registry(spark, sf_dir))


@query(
    """WITH t AS (SELECT count(*) AS a, count(*) FILTER (l_returnflag = 'R') AS d, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS b FROM lineitem)
SELECT 'total' AS dimension, 'all' AS key, a AS n FROM t UNION ALL SELECT 'total', 'downloaded', d FROM t UNION ALL SELECT 'total', 'bytes', b FROM t
UNION ALL SELECT 'total', 'megabytes_x100', CAST(floor(b * 100.0::DOUBLE / 1048576 + 0.5) AS BIGINT) FROM t
UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2"""
)
def agg2_collection_stats(spark, sf_dir):
    log = views.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("size"))
    return registry.collection_stats(log, F.col("l_returnflag") == "R", ["l_returnflag", "l_linestatus"], "size")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def top3_most_recent(spark, sf_dir):
    return registry.most_recent(views.table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    f"""WITH {CACHE} SELECT count(*) AS entries, CAST(floor(sum(strlen(payload)) * 100.0::DOUBLE / 1024 + 0.5) AS BIGINT) AS kilobytes_x100,
CAST(floor(sum(extraction_ms) FILTER (extraction_ms <> 0) * 1.0::DOUBLE / count(*) FILTER (extraction_ms <> 0) + 0.5) AS BIGINT) AS mean_ms,
CAST(floor(sum(field_count) * 10.0::DOUBLE / count(field_count) + 0.5) AS BIGINT) AS mean_fields_x10, strftime(min(created_at), '%Y-%m-%d %H') AS first, strftime(max(created_at), '%Y-%m-%d %H') AS last FROM cache"""
)
def agg3_set3_cache_stats(spark, sf_dir):
    c = views.cache(spark, sf_dir)
    s = cache.stats(c.where("schema_version = 'v1'"), c.where("schema_version = 'v2'"))
    return s.withColumns({x: F.date_format(x, "yyyy-MM-dd HH") for x in ("first", "last")})


@query(f"WITH {CACHE} SELECT schema_version, extractor_version, count(*) AS entries FROM cache GROUP BY 1, 2")
def agg3_cache_by_version(spark, sf_dir):
    return cache.by_version(views.cache(spark, sf_dir))


@query("SELECT count(*) AS processed, count(*) FILTER (doc_id % 4 <> 0) AS ok, count(*) FILTER (doc_id % 4 = 0) AS failed, CAST(sum(n_chars) FILTER (doc_id % 4 <> 0) AS BIGINT) AS fields, CAST(floor(sum(n_chars) FILTER (doc_id % 4 <> 0) / count(*) FILTER (doc_id % 4 <> 0)) AS BIGINT) AS mean_fields FROM documents")
def agg10_warm_up_totals(spark, sf_dir):
    return cache.warm_up_totals(views.table(spark, sf_dir, "documents").select((F.col("doc_id") % 4 != 0).alias("success"), F.col("n_chars").alias("fields")))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'none') AS none FROM events")
def agg11_run_counters(spark, sf_dir):
    return merge.run_counters(views.table(spark, sf_dir, "events"), "event_type", ["click", "view", "none"])


@query(
    f"""WITH {REGISTRY}, incoming AS (SELECT o_orderkey AS seq, sha256(CAST(o_orderkey % 7000 AS VARCHAR)) AS file_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'quarterly' END AS report_type, 'US' AS market, 'n/' || o_orderkey AS file_path FROM orders WHERE o_orderpriority = '1-URGENT'),
last AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY seq DESC) = 1),
kept AS (SELECT r.id, coalesce(l.market, r.market) AS market, coalesce(l.report_type, r.report_type) AS report_type, CASE WHEN l.file_hash IS NOT NULL THEN l.file_path ELSE r.file_path END AS file_path, r.file_hash, l.file_hash IS NOT NULL OR r.is_available AS is_available,
  CASE WHEN l.file_hash IS NOT NULL THEN TIMESTAMP '1997-06-01' ELSE r.download_time END AS download_time FROM registry r LEFT JOIN last l ON r.file_hash = l.file_hash),
fresh AS (SELECT (SELECT max(id) FROM registry) + row_number() OVER (ORDER BY seq) AS id, market, report_type, file_path, file_hash, true AS is_available, TIMESTAMP '1997-06-01' AS download_time FROM last WHERE file_hash NOT IN (SELECT file_hash FROM registry WHERE file_hash IS NOT NULL))
SELECT id, market, report_type, file_path, file_hash, is_available, strftime(download_time, '%Y-%m-%d') AS day FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh)"""
)
def snk1_upsert_by_hash(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    incoming = o.select(
        F.col("o_orderkey").alias("seq"), F.sha2((F.col("o_orderkey") % 7000).cast("string"), 256).alias("file_hash"), F.when(F.col("o_orderkey") % 2 == 0, "quarterly").alias("report_type"), F.lit("US").alias("market"),
        F.concat(F.lit("n/"), F.col("o_orderkey").cast("string")).alias("file_path"), F.lit(None).cast("string").alias("stock_code"), F.lit(None).cast("int").alias("report_year"), F.lit(None).cast("bigint").alias("file_size"),
    )
    known = views.registry(spark, sf_dir).withColumn("last_accessed", F.lit(None).cast("timestamp_ntz"))
    return registry.add(known, incoming, AS_OF).select("id", "market", "report_type", "file_path", "file_hash", "is_available", F.date_format("download_time", "yyyy-MM-dd").alias("day"))


@query(f"WITH {CACHE}, i AS (SELECT * FROM cache WHERE extraction_ms > 25 QUALIFY row_number() OVER (PARTITION BY file_hash, schema_version ORDER BY seq DESC) = 1) SELECT file_hash, schema_version, field_count, seq FROM cache c WHERE extraction_ms <= 25 AND NOT EXISTS (SELECT 1 FROM i WHERE i.file_hash = c.file_hash AND i.schema_version = c.schema_version) UNION ALL SELECT file_hash, schema_version, field_count, seq FROM i")
def snk2_cache_upsert(spark, sf_dir):
    c = views.cache(spark, sf_dir)
    return cache.save(c.where("extraction_ms <= 25"), c.where("extraction_ms > 25")).select("file_hash", "schema_version", "field_count", "seq")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def snk3_insert_or_replace(spark, sf_dir):
    return merge.keep_latest(views.table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 80) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def snk4_insert_ignore(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return merge.insert_ignore(e.where("event_type = 'click' and value > 80"), e.where("event_type <> 'click'"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'done' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def snk6_status_update(spark, sf_dir):
    keys = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return registry.set_status(views.table(spark, sf_dir, "customer"), keys, "c_custkey", "c_mktsegment", F.lit("done")).select("c_custkey", "c_mktsegment")


@query(f"WITH {REGISTRY} SELECT id, is_available AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS is_available FROM registry")
def snk7_soft_delete(spark, sf_dir):
    ids = views.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return registry.mark_unavailable(views.registry(spark, sf_dir), ids)[0].select("id", "is_available")


@query(f"WITH {REGISTRY} SELECT count(*) AS changed FROM registry WHERE is_available AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def snk7_soft_delete_count(spark, sf_dir):
    ids = views.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return registry.mark_unavailable(views.registry(spark, sf_dir), ids)[1]


@query(f"WITH {REGISTRY} SELECT id, is_available AND NOT (download_time < TIMESTAMP '1997-06-01' - INTERVAL 90 DAY) AS is_available FROM registry")
def snk8_age_out(spark, sf_dir):
    return registry.age_out(views.registry(spark, sf_dir), AS_OF, 90).select("id", "is_available")


@query("SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15' - INTERVAL 5 DAY)")
def snk9_purge(spark, sf_dir):
    return registry.purge(views.table(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00", 5).select("event_id")


@query(f"WITH {CACHE} SELECT seq, file_hash FROM cache WHERE NOT (schema_version = 'v2' AND file_hash IN (SELECT sha256(text) FROM documents WHERE lang = 'de'))")
def snk10_invalidate(spark, sf_dir):
    gone = views.table(spark, sf_dir, "documents").where("lang = 'de'").select(F.sha2("text", 256).alias("file_hash"))
    return cache.invalidate(views.cache(spark, sf_dir), gone, "v2").select("seq", "file_hash")


_GC = f"""WITH {CACHE}, live AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0),
m AS (SELECT *, extractor_version <> '1' OR created_at < TIMESTAMP '2023-12-01' - INTERVAL 10 DAY AS stale FROM cache), g AS (SELECT *, NOT stale AND file_hash NOT IN (SELECT h FROM live) AS orphan FROM m)"""


def _gc(spark, sf_dir):
    live = views.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("file_hash"), (F.col("doc_id") % 2 == 0).alias("is_available"))
    return cache.collect_garbage(views.cache(spark, sf_dir), live, "1", "2023-12-01 00:00:00", 10)


@query(_GC + " SELECT seq, file_hash FROM g WHERE NOT stale AND NOT orphan")
def snk11_jon2_garbage_collection(spark, sf_dir):
    return _gc(spark, sf_dir)[0].select("seq", "file_hash")


@query(_GC + " SELECT count(*) FILTER (stale) AS stale, count(*) FILTER (orphan) AS orphans FROM g")
def snk11_garbage_counts(spark, sf_dir):
    return _gc(spark, sf_dir)[1]


_UNCACHED = f"WITH {REGISTRY}, done AS (SELECT DISTINCT sha256(CAST(doc_id % 5000 AS VARCHAR)) AS h FROM documents)"


def _uncached(spark, sf_dir, parity):
    done = views.table(spark, sf_dir, "documents").select(F.sha2((F.col("doc_id") % 5000).cast("string"), 256).alias("file_hash"), F.lit("v2").alias("schema_version"))
    return registry.uncached(views.registry(spark, sf_dir), done, 100, parity=parity).select("id", "file_hash")


@query(_UNCACHED + " SELECT id, file_hash FROM registry WHERE is_available AND file_hash IS NOT NULL AND file_hash NOT IN (SELECT h FROM done) ORDER BY download_time DESC, id LIMIT 100")
def jon1_uncached(spark, sf_dir):
    return _uncached(spark, sf_dir, False)


@query(_UNCACHED + ", n AS (SELECT * FROM registry WHERE is_available AND file_hash IS NOT NULL ORDER BY download_time DESC, id LIMIT 200) SELECT id, file_hash FROM n WHERE file_hash NOT IN (SELECT h FROM done) ORDER BY download_time DESC, id LIMIT 100")
def jon1_uncached_parity(spark, sf_dir):
    return _uncached(spark, sf_dir, True)


@query(f"WITH {REGISTRY} SELECT id, file_path FROM registry WHERE is_available AND file_path NOT IN (SELECT 'f/' || l_orderkey || '.pdf' FROM lineitem WHERE l_linenumber = 4)")
def jon3_missing_files(spark, sf_dir):
    files = views.table(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.concat(F.lit("f/"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("path"))
    return registry.missing_files(views.registry(spark, sf_dir), files).select("id", "file_path")


@query(f"WITH {CACHE}, c AS (SELECT DISTINCT file_hash, schema_version, field_count, seq FROM cache WHERE extractor_version = '1') SELECT d.doc_id, c.seq, c.seq IS NOT NULL AS hit FROM documents d LEFT JOIN c ON sha256(d.text) = c.file_hash AND c.schema_version = 'v2'")
def jon4_cache_lookup(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.lit("v2").alias("schema_version"))
    c = views.cache(spark, sf_dir)
    found = cache.lookup(wanted, c.withColumn("payload", F.struct("seq")), "1")
    return found.select("doc_id", F.col("payload.seq").alias("seq"), "hit")


@query("SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders) AS INTEGER) AS found FROM customer")
def flt4_existence_probe(spark, sf_dir):
    log = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return registry.existing(log, views.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(
    """WITH l AS (SELECT user_id, max(event_id) AS event_id, min(event_id) AS first_seen FROM events GROUP BY 1)
SELECT e.user_id, e.event_id, e.event_type, l.first_seen FROM l JOIN events e USING (event_id) ORDER BY e.ts DESC, l.first_seen LIMIT 50"""
)
def set2_top2_last_wins(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    rows = merge.last_wins(e, F.col("user_id"), "event_id")
    return merge.newest(rows, "ts", "first_seen", 50).select("user_id", "event_id", "event_type", "first_seen")


@query(
    """WITH u AS (SELECT coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id END, ''), event_type) AS id, event_id + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1099511627776 ELSE 2199023255552 END AS seq, event_id, epoch_ms(ts) // 1000 AS publish_timestamp FROM events WHERE event_type IN ('click', 'view', 'purchase')),
l AS (SELECT id, max(seq) AS seq, min(seq) AS first_seen FROM u GROUP BY 1) SELECT u.id, u.event_id, CAST(u.publish_timestamp AS BIGINT) AS publish_timestamp FROM l JOIN u USING (id, seq) ORDER BY u.publish_timestamp DESC, l.first_seen LIMIT 25"""
)
def set1_top2_latest_reports(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("web_path"), F.col("event_type").alias("title"), F.col("event_id").alias("seq"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("publish_timestamp"))
    identity = F.coalesce(F.nullif("web_path", F.lit("")), "title")
    found = merge.latest_reports([e.where(F.col("title") == k) for k in ("click", "view", "purchase")], identity, 25)
    return found.select(identity.alias("id"), "event_id", "publish_timestamp")


@query("SELECT lang, doc_id FROM documents WHERE n_chars > 200 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10")
def top5_per_language(spark, sf_dir):
    return merge.top_per_group(views.table(spark, sf_dir, "documents"), "lang", "doc_id", 10, F.col("n_chars") > 200).select("lang", "doc_id")


@query("SELECT p_partkey, CASE WHEN n > 0 THEN p_type || '_[' || n || ']' ELSE p_type END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n FROM part)")
def win11_collision_suffix(spark, sf_dir):
    return merge.collision_suffix(views.table(spark, sf_dir, "part"), "p_type", "p_partkey").select("p_partkey", "name")


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 1000 + 1 AS INTEGER) AS bucket FROM orders")
def snk13_folder_buckets(spark, sf_dir):
    return merge.buckets_of(views.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey").select("o_orderkey", "bucket")


@query(
    """WITH s AS (SELECT l_partkey AS symbol, l_returnflag AS statement_type, min(l_orderkey * 10 + l_linenumber) AS source_seq, min(l_linestatus) AS source FROM lineitem GROUP BY 1, 2)
SELECT symbol, statement_type, source_seq, source, (SELECT string_agg(x.source, ',' ORDER BY x.source_seq, x.source) FROM (SELECT DISTINCT symbol, source_seq, source FROM s) x WHERE x.symbol = s.symbol) AS sources FROM s"""
)
def jon12_first_source(spark, sf_dir):
    by = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), F.col("l_returnflag").alias("statement_type"))
    s = by.agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_seq"), F.min("l_linestatus").alias("source"))
    return merge.first_source(s).withColumn("sources", F.array_join("sources", ","))


@query(
    """WITH w AS (SELECT CAST(n AS INTEGER) AS window_no, greatest(DATE '1996-01-01', DATE '1998-01-01' - CAST((n + 1) * 120 AS INTEGER)) AS s, DATE '1998-01-01' - CAST(n * 120 AS INTEGER) AS e FROM range(0, 7) r(n))
SELECT window_no, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date, count(o_orderkey) AS n FROM w LEFT JOIN orders ON CAST(o_orderdate AS DATE) > s AND CAST(o_orderdate AS DATE) <= e GROUP BY 1, 2, 3"""
)
def src5_stm3_backward_windows(spark, sf_dir):
    w = announcements.backward_windows(spark, "1998-01-01", 120, 2)
    # each order has one window: its number follows from its day
    day = F.col("o_orderdate").cast("date")
    o = views.table(spark, sf_dir, "orders").select(F.floor(F.datediff(F.lit("1998-01-01").cast("date"), day) / 120).cast("int").alias("window_no"), day.alias("day"))
    n = o.join(F.broadcast(w), "window_no").where("day > start_date and day <= end_date").groupBy("window_no").agg(F.count("*").alias("n"))
    return w.join(n, "window_no", "left").select("window_no", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(DISTINCT event_id) AS BIGINT) AS events FROM (SELECT d, event_id FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN events ON CAST(ts AS DATE) >= d AND CAST(ts AS DATE) <= d + 1)")
def src15_daily_requests(spark, sf_dir):
    """Overlapping days deliver rows twice; the distinct key counts them once."""
    days = announcements.daily_requests(spark, 2024)
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    # a day's request delivers the events of that day and the next, so an event comes once for each of these that is asked for; a request without any is one row
    asked = F.broadcast(days.select(F.explode(F.array("day", "until")).alias("day")).groupBy("day").agg(F.count("*").alias("times")))
    found = e.join(asked, "day")
    per_day = F.broadcast(found.groupBy("day").agg(F.sum("times").alias("n")))
    empty = days.join(per_day.select("day"), "day", "left_anti").join(per_day.select(F.date_sub("day", 1).alias("day")), "day", "left_anti").agg(F.count("*").alias("n"))
    requests = per_day.select("n").unionByName(empty).agg(F.sum("n").alias("requests"))
    return requests.crossJoin(found.select("event_id").distinct().agg(F.count("event_id").alias("events")))


@query(f"WITH {REGISTRY} SELECT id, CAST(c_nationkey AS INTEGER) AS internal_id FROM registry LEFT JOIN customer ON stock_code = lpad(CAST(c_custkey AS VARCHAR), 6, '0') AND c_custkey % 3 = 0")
def src10_jon5_internal_ids(spark, sf_dir):
    dim = views.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), F.col("c_nationkey").alias("internal_id"))
    return announcements.internal_ids(views.registry(spark, sf_dir), dim).select("id", "internal_id")
