"""Text, date, array and validation functions over the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arrays, dates, numbers, text, validators
from ..operators import candidates, context
from ..sources import announcements, html_rows
from ..staging import shared_folder
from ..streaming import ingest
from . import views
from .catalog import query
from .views import TITLES_SQL

_RAW = "CASE l_orderkey % 6 WHEN 0 THEN '(' || k || ')' WHEN 1 THEN k || '%' WHEN 2 THEN '－' || k WHEN 3 THEN ' 1,' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ' ' WHEN 4 THEN k || '，000.5' ELSE 'N/A' END"
_RAWS = f"WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw FROM (SELECT *, CAST(l_quantity AS BIGINT) AS k FROM lineitem))"


def _raw(spark, sf_dir):
    k = F.col("l_quantity").cast("bigint").cast("string")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kinds = [say("(", k, ")"), say(k, "%"), say("－", k), say(" 1,", F.lpad((F.col("l_quantity").cast("bigint") % 1000).cast("string"), 3, "0"), " "), say(k, "，000.5"), F.lit("N/A")]
    raw = F.coalesce(*(F.when(F.col("l_orderkey") % 6 == n, kind) for n, kind in enumerate(kinds)))
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))


@query(_RAWS + " SELECT l_orderkey, l_linenumber, raw, CASE l_orderkey % 6 WHEN 2 THEN -CAST(substr(raw, 2) AS DOUBLE) WHEN 3 THEN CAST(replace(trim(raw), ',', '') AS DOUBLE) WHEN 4 THEN CAST(replace(raw, '，', '') AS DOUBLE) END AS value FROM r")
def str1_parse_number(spark, sf_dir):
    return _raw(spark, sf_dir).withColumn("value", numbers.parse_number(F.col("raw")))


@query(_RAWS + " SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 = 1 THEN CAST(replace(raw, '%', '') AS DOUBLE) WHEN l_orderkey % 6 = 3 THEN CAST(replace(trim(raw), ',', '') AS DOUBLE) END AS num, CASE WHEN l_orderkey % 6 NOT IN (1, 3) THEN raw END AS raw FROM r")
def str2_lenient_number(spark, sf_dir):
    return _raw(spark, sf_dir).select("l_orderkey", "l_linenumber", numbers.lenient_number(F.col("raw")).alias("x")).select("l_orderkey", "l_linenumber", "x.num", "x.raw")


@query("SELECT p_partkey, replace(replace(replace(replace(lower(trim(regexp_replace(p_name || '  （' || p_type || '） – x', '\\s+', ' ', 'g'))), '（', '('), '）', ')'), '–', '-'), '—', '-') AS label FROM part")
def str3_normalized_label(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.normalized_label(F.concat("p_name", F.lit("  （"), "p_type", F.lit("） – x"))).alias("label"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '[<>;&|$`\n\r\t]', '', 'g')), 1, 200) AS clean FROM documents")
def str19_sanitized(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.sanitized(F.col("text")).alias("clean"))


@query(f"WITH {TITLES_SQL} SELECT id, CASE WHEN substr(code, 1, 3) IN ('000', '001', '002', '003') THEN 'sz' WHEN substr(code, 1, 3) = '300' THEN 'szcy' WHEN substr(code, 1, 3) IN ('600', '601', '603', '605') THEN 'sh' WHEN substr(code, 1, 3) = '688' THEN 'shkcp' WHEN substr(code, 1, 3) IN ('430', '831', '832', '833', '834', '835', '836', '837', '838', '839') THEN 'bj' ELSE 'unknown' END AS exchange FROM titles")
def str18_exchange(spark, sf_dir):
    return views.titles(spark, sf_dir).select("id", text.exchange(F.col("code")).alias("exchange"))


def _kind(annual_first: bool) -> str:
    half, year = "WHEN title LIKE '%半年度报告%' THEN 'semi_annual'", "WHEN title LIKE '%年度报告%' OR title LIKE '%年报%' THEN 'annual'"
    a, b = (year, half) if annual_first else (half, year)
    return f"WITH {TITLES_SQL} SELECT id, CASE {a} {b} WHEN title LIKE '%第一季度报告%' THEN 'quarterly_1' WHEN title LIKE '%第三季度报告%' THEN 'quarterly_3' ELSE 'other' END AS kind FROM titles"


@query(_kind(False))
def str13_filing_kind(spark, sf_dir):
    return views.titles(spark, sf_dir).select("id", text.filing_kind(F.col("title")).alias("kind"))


@query(_kind(True))
def str13_filing_kind_parity(spark, sf_dir):
    return views.titles(spark, sf_dir).select("id", text.filing_kind(F.col("title"), parity=True).alias("kind"))


@query(f"WITH {TITLES_SQL} SELECT id, coalesce(regexp_extract(title, '20[0-9]{{2}}'), '') || '_' || CASE WHEN title LIKE '%半年度报告%' THEN '半年度报告' WHEN title LIKE '%年度报告摘要%' THEN '年度报告摘要' WHEN title LIKE '%第三季度报告%' THEN '第三季度报告' WHEN title LIKE '%第一季度报告%' THEN '第一季度报告' ELSE '其他公告' END || '.pdf' AS name FROM titles WHERE regexp_matches(title, '20[0-9]{{2}}')")
def str14_file_name(spark, sf_dir):
    t = views.titles(spark, sf_dir).withColumn("year", dates.title_year(F.col("title"))).where("year is not null")
    return t.select("id", text.file_name(F.col("title"), F.col("year"), "20240101").alias("name"))


@query(f"WITH {TITLES_SQL} SELECT id, title LIKE '%摘要%' AS summary, NOT title LIKE '%board meeting%' AND NOT (lower(title) LIKE '%interim%' OR lower(title) LIKE '%six months%' OR title LIKE '%半年%') AND (lower(title) LIKE '%annual report%' OR lower(title) LIKE '%annual results%') AS annual, NOT title LIKE '%board meeting%' AND regexp_matches(lower(title), 'q[34] |quarterly results|nine months|第[一三]季度') AS quarterly FROM titles")
def flt5_flt6_title_filters(spark, sf_dir):
    title = F.col("title")
    return views.titles(spark, sf_dir).select("id", text.is_summary(title).alias("summary"), text.matches_type(title, "annual").alias("annual"), text.matches_type(title, "quarterly").alias("quarterly"))


@query(f"WITH {TITLES_SQL} SELECT id, CAST(CASE WHEN title LIKE '%第一季度%' THEN 1 WHEN title LIKE 'Q3%' OR title LIKE '%第三季度%' THEN 3 WHEN title LIKE 'Q4%' THEN 4 END AS INTEGER) AS quarter FROM titles")
def str9_quarter_number(spark, sf_dir):
    return views.titles(spark, sf_dir).select("id", text.quarter_number(F.col("title")).alias("quarter"))


@query(
    f"""WITH {TITLES_SQL}, i AS (SELECT id, CASE WHEN lower(title) LIKE '%interim report%' OR lower(title) LIKE '%six months%' OR title LIKE '%半年度报告%' THEN 's' WHEN title LIKE 'Q4%' THEN 'f' WHEN title LIKE 'Q3%' OR title LIKE '%季度%' OR title LIKE 'Quarterly%' THEN 'q'
  WHEN lower(title) LIKE '%annual report%' OR title LIKE '%年度报告%' THEN 'a' WHEN lower(title) LIKE '%annual results%' THEN 'r' END AS k FROM titles)
SELECT id, CASE k WHEN 's' THEN 'semi_annual' WHEN 'f' THEN 'quarterly' WHEN 'q' THEN 'quarterly' WHEN 'a' THEN 'annual' WHEN 'r' THEN 'annual' END AS report_type, CASE k WHEN 's' THEN 'interim_report' WHEN 'f' THEN 'results_announcement' WHEN 'q' THEN 'quarterly_report' WHEN 'a' THEN 'annual_report' WHEN 'r' THEN 'results_announcement' END AS doc_type,
CASE k WHEN 's' THEN 'semi_annual' WHEN 'f' THEN 'full_year_in_quarterly_announcement' WHEN 'q' THEN 'quarter' WHEN 'a' THEN 'annual' WHEN 'r' THEN 'annual' END AS period_type FROM i"""
)
def str10_report_identity(spark, sf_dir):
    return views.titles(spark, sf_dir).select("id", text.report_identity(F.col("title")).alias("i")).select("id", "i.*")


@query(f"WITH {TITLES_SQL} SELECT id, CASE WHEN title LIKE 'Q4%' THEN '2023_q4_fy' WHEN title LIKE 'Q3%' THEN '2024_q3' WHEN title LIKE '2022年第一%' THEN '2022_q1' WHEN title LIKE '2022年第三%' THEN '2022_q3' ELSE nullif(regexp_extract(title, '20[0-9]{{2}}'), '') END AS hint FROM titles")
def str15_period_hint(spark, sf_dir):
    return views.titles(spark, sf_dir).select("id", text.period_hint(F.col("title"), F.lit("quarterly"), dates.title_year(F.col("title"))).alias("hint"))


@query(f"WITH {TITLES_SQL} SELECT id, CASE WHEN regexp_matches(title, '[年报告]') OR path LIKE '%\\_c.%' ESCAPE '\\' THEN 'zh' ELSE 'en' END AS language, CASE WHEN path LIKE '%\\_c.pdf' ESCAPE '\\' THEN replace(path, '_c.pdf', '.pdf') END AS english, CASE WHEN path NOT LIKE '%\\_c.%' ESCAPE '\\' THEN replace(path, '.pdf', '_c.pdf') END AS chinese, CASE WHEN id % 5 = 0 AND length(CAST(id AS VARCHAR)) < 5 THEN lpad(CAST(id AS VARCHAR), 5, '0') ELSE CAST(id AS VARCHAR) END AS padded FROM titles")
def str16_str17_str21_languages(spark, sf_dir):
    path, code = F.col("path"), F.col("id").cast("string")
    return views.titles(spark, sf_dir).select("id", text.title_language(F.col("title"), path).alias("language"), text.english_url(path).alias("english"), text.chinese_url(path).alias("chinese"), F.when(F.col("id") % 5 == 0, text.padded_code(code)).otherwise(code).alias("padded"))


@query(f"WITH {TITLES_SQL} SELECT id, CASE WHEN title LIKE '%naudited%' THEN false WHEN title LIKE '%audited%' THEN true END AS audited, CASE WHEN title LIKE '%HK$%' THEN 'HKD' WHEN title LIKE '%USD%' THEN 'USD' END AS currency, CASE WHEN title LIKE '%HK$''000%' OR title LIKE '%million%' THEN 'million' ELSE 'none' END AS unit FROM titles")
def str22_dat9_metadata(spark, sf_dir):
    title = F.col("title")
    return views.titles(spark, sf_dir).select("id", text.audited(title).alias("audited"), text.currency_of(title).alias("currency"), text.amount_unit(title).alias("unit"))


@query(f"WITH {TITLES_SQL} SELECT id, CAST(coalesce(nullif(regexp_extract(title, '20[0-9]{{2}}'), ''), regexp_extract(path, '/(20[0-9]{{2}}|19[0-9]{{2}})/', 1)) AS INTEGER) AS year FROM titles WHERE path LIKE '/sehk/20%' OR regexp_matches(title, '20[0-9]{{2}}')")
def dat5_title_year(spark, sf_dir):
    t = views.titles(spark, sf_dir).withColumn("year", dates.title_year(F.col("title"), F.col("path"), F.col("release")))
    return t.where(F.col("path").startswith("/sehk/20") | F.col("title").rlike("20[0-9]{2}")).select("id", "year")


@query(f"WITH {TITLES_SQL} SELECT id, CAST(CASE WHEN title LIKE '2024 %' THEN '2024' WHEN title LIKE 'Q4%' THEN '2023' WHEN title LIKE '%March 2021%' THEN '2021' ELSE nullif(regexp_extract('f_' || id || '_2019.pdf', '20[0-9]{{2}}'), '') END AS INTEGER) AS fiscal_year FROM titles")
def dat2_fiscal_year(spark, sf_dir):
    name = F.concat(F.lit("f_"), F.col("id").cast("string"), F.lit("_2019.pdf"))
    return views.titles(spark, sf_dir).select("id", dates.fiscal_year(F.col("title"), F.lit(None).cast("string"), name).alias("fiscal_year"))


@query(f"WITH {TITLES_SQL} SELECT id, CASE id % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS publish_time, CAST(CASE id % 3 WHEN 0 THEN epoch_ms(date_trunc('minute', o_orderdate)) // 1000 WHEN 1 THEN epoch_ms(date_trunc('day', o_orderdate)) // 1000 ELSE 0 END AS BIGINT) AS publish_timestamp FROM titles JOIN orders ON id = o_orderkey")
def dat3_prj10_publish_time(spark, sf_dir):
    t = views.titles(spark, sf_dir).withColumnRenamed("release", "release_time")
    return announcements.with_publish_time(t, "HK").select("id", "publish_time", "publish_timestamp")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS t FROM orders")
def dat4_cn_time(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    millis = F.when(F.col("o_orderkey") % 4 != 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise("n/a")
    when = dates.cn_time(millis, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.date_format(when, "yyyy-MM-dd")).otherwise(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")).alias("t"))


@query("SELECT o_orderkey, CAST(make_date(CAST(year(o_orderdate) AS BIGINT), CAST((quarter(o_orderdate) - 1) * 3 + 1 AS BIGINT), 1) AS VARCHAR) AS start, CAST(last_day(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(quarter(o_orderdate) * 3 AS BIGINT), 1)) AS VARCHAR) AS end FROM orders")
def dat1_period_days(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    days = dates.period_days(F.year("o_orderdate"), F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string")))
    return o.select("o_orderkey", days.alias("d")).select("o_orderkey", F.col("d.start").cast("string").alias("start"), F.col("d.end").cast("string").alias("end"))


_EN, _FR = ["the", "and", "with", "that"], ["les", "des", "une", "que"]


@query(
    "SELECT doc_id, CASE WHEN "
    + " + ".join(f"CAST(contains(text, ' {w} ') AS INTEGER)" for w in _EN)
    + " > "
    + " + ".join(f"CAST(contains(text, ' {w} ') AS INTEGER)" for w in _FR)
    + " THEN 'en' ELSE 'zh' END AS vote FROM documents"
)
def agg5_language_vote(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.language_vote(F.col("text"), F.lit("x.pdf"), [f" {w} " for w in _EN], [f" {w} " for w in _FR]).alias("vote"))


_SPECS = ["1-3,5", "2,2,1", "7-", "0", "5-2", "-3", "4", "1-2,x"]


@query(
    "WITH s AS (SELECT doc_id, "
    + "([" + ", ".join(f"'{s}'" for s in _SPECS) + f"])[CAST(doc_id % {len(_SPECS)} AS INTEGER) + 1] AS spec, CAST(n_chars % 9 AS INTEGER) AS total FROM documents), "
    + "p AS (SELECT *, CASE spec WHEN '1-3,5' THEN [1, 2, 3, 5] WHEN '2,2,1' THEN [1, 2] WHEN '7-' THEN list_transform(range(7, 10008), lambda x: CAST(x AS INTEGER)) WHEN '4' THEN [4] END AS pages FROM s) "
    + "SELECT doc_id, spec, CAST(len(pages) AS INTEGER) AS n, array_to_string(list_filter(pages, lambda x: x <= total), ',') AS valid, CAST(len(list_filter(pages, lambda x: x > total)) AS INTEGER) AS n_missing FROM p"
)
def arr1_set6_page_ranges(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.element_at(F.array(*map(F.lit, _SPECS)), (F.col("doc_id") % len(_SPECS) + 1).cast("int")).alias("spec"), (F.col("n_chars") % 9).cast("int").alias("total"))
    d = d.withColumn("pages", arrays.page_ranges(F.col("spec")))
    parts = arrays.split_pages(F.col("pages"), F.col("total"))
    return d.select("doc_id", "spec", F.when(F.col("pages").isNotNull(), F.size("pages")).alias("n"), F.array_join(F.transform(parts["valid"], lambda x: x.cast("string")), ",").alias("valid"), F.when(F.col("pages").isNotNull(), F.size(parts["missing"])).alias("n_missing"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events")
def arr3_json_props(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.map_values("m")[0].alias("first_value"), F.size("m").alias("n_keys"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_links, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def src7_page_links(spark, sf_dir):
    p = html_rows.links(views.table(spark, sf_dir, "pages"))
    return p.select("page_id", F.size("links").alias("n_links"), F.array_join("links", " ").alias("links"))


@query(
    f"""WITH {TITLES_SQL} SELECT CAST(id AS VARCHAR) AS announcement_id, title AS announcement_title, code AS stock_code, strftime(make_timestamp(millis * 1000), '%Y-%m-%d') AS announcement_date, 'http://files.example.com/' || path AS pdf_url,
CAST(id % 1000 AS BIGINT) AS file_size, CASE WHEN title LIKE '%半年度报告%' THEN 'semi_annual' WHEN title LIKE '%第一季度报告%' THEN 'quarterly_1' WHEN title LIKE '%第三季度报告%' THEN 'quarterly_3' ELSE 'other' END AS report_type FROM titles WHERE title NOT LIKE '%摘要%' AND id % 13 <> 0"""
)
def src12_cn_announcements(spark, sf_dir):
    t = views.titles(spark, sf_dir)
    item = F.struct(
        F.col("id").cast("string").alias("announcementId"), F.col("code").alias("secCode"), F.lit("x").alias("secName"), F.col("title").alias("announcementTitle"),
        F.when(F.col("id") % 13 == 0, "2024-01-01").otherwise(F.col("millis").cast("string")).alias("announcementTime"), F.col("path").alias("adjunctUrl"), (F.col("id") % 1000).cast("string").alias("adjunctSize"),
    )
    found = announcements.cn_announcements(t.select(F.array(item).alias("announcements")), "http://files.example.com")
    return found.select("announcement_id", "announcement_title", "stock_code", "announcement_date", "pdf_url", "file_size", "report_type")


@query(
    f"""WITH {TITLES_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 'symbol_missing' WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN 'symbol_format_hk' ELSE 'market_unknown' END AS symbol, CASE WHEN id % 3 = 0 THEN 'keyword_missing' WHEN title LIKE '%$%' AND length(title) > 50 THEN 'keyword_too_long,keyword_unsafe' WHEN length(title) > 50 THEN 'keyword_too_long' END AS keyword FROM titles"""
)
def flt13_validators(spark, sf_dir):
    t = views.titles(spark, sf_dir)
    symbol, market = F.when(F.col("id") % 4 != 0, F.col("code")), F.element_at(F.array(*map(F.lit, ["CN", "CN", "hk", "XX"])), (F.col("id") % 4 + 1).cast("int"))
    keyword = F.when(F.col("id") % 3 == 0, "  ").otherwise(F.col("title"))
    show = lambda e: F.nullif(F.array_join(e, ","), F.lit(""))
    return t.select("id", show(validators.symbol_errors(symbol, market)).alias("symbol"), show(validators.keyword_errors(keyword)).alias("keyword"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'start_after_end' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-01') > 3650 THEN 'range_too_long' END AS errors, CASE WHEN year(o_orderdate) > 1996 THEN 'year_too_late' END AS year_errors FROM orders WHERE CAST(o_orderdate AS DATE) <> DATE '1997-01-01'")
def flt13_date_ranges(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date") != F.lit("1997-01-01").cast("date"))
    show = lambda e: F.nullif(F.array_join(e, ","), F.lit(""))
    return o.select("o_orderkey", show(validators.date_range_errors(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1997-01-01"))).alias("errors"), show(validators.year_errors(F.year("o_orderdate"), 1995)).alias("year_errors"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'v1' ELSE 'v2' END AS version, CASE event_type WHEN 'click' THEN 'annual' WHEN 'view' THEN 'annual,semi_annual,quarterly' ELSE 'annual,semi_annual,quarterly' END AS types FROM events")
def str25_str26_negotiation(spark, sf_dir):
    click = F.col("event_type") == "click"
    version = text.schema_version(F.when(click, "v1"), F.lit("zz"), F.lit("text/html"))
    types = text.report_types(F.when(click, F.array(F.lit("annual"), F.lit(""))).when(F.col("event_type") == "view", F.array(F.lit("annual"), F.lit("all"))))
    return views.table(spark, sf_dir, "events").select("event_id", version.alias("version"), F.array_join(types, ",").alias("types"))


@query("SELECT p_partkey, regexp_replace(regexp_replace('<em>' || p_name || '</em>', '<[^>]+>', '', 'g'), '\\s+', '', 'g') AS clean, 'http://search.example.com/?q=' || replace(p_name, ' ', '+') AS url FROM part")
def str14_str20_str27_names(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.clean_name(F.concat(F.lit("<em>"), "p_name", F.lit("</em>"))).alias("clean"), text.search_url("http://search.example.com/?q=", F.col("p_name")).alias("url"))


@query("SELECT event_id FROM events")
def stm2_stream_dedup(spark, sf_dir):
    """The events delivered twice, as a stream: each comes out once. The stream appends to a table of files, which is read again."""
    schema = views.table(spark, sf_dir, "events").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    twice = feed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", F.col("ts").cast("timestamp"))
    at = f"{shared_folder(spark)}/stream-dedup-{uuid.uuid4().hex}"
    once = ingest.deduplicated(twice, "event_id", "at").select("event_id")
    run = once.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{at}/rows")


@query(f"WITH {TITLES_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'given' WHEN title LIKE '%Annual Report%' THEN '2024_fy' WHEN title LIKE 'Q3%' THEN '2024_fy' ELSE coalesce(nullif(regexp_extract(title, '20[0-9]{{2}}'), '') || '_fy', NULL) END AS hint, path AS web_path FROM titles")
def prj9_hk_metadata(spark, sf_dir):
    t = views.titles(spark, sf_dir).select("id", "title", F.col("release").alias("release_time"), F.col("path").alias("web_path"), F.when(F.col("id") % 5 == 0, "given").alias("period_hint"), F.lit("annual").alias("report_type"), dates.title_year(F.col("title")).alias("year"))
    done = context.hk_metadata(t)
    return done.select("id", F.get_json_object("metadata_json", "$.period_hint").alias("hint"), F.get_json_object("metadata_json", "$.web_path").alias("web_path"))


@query(f"WITH {TITLES_SQL} SELECT id, regexp_replace('<em>' || title || '</em>', '<[^>]+>', '', 'g') AS title, strftime(make_timestamp(millis * 1000), '%Y-%m-%d %H:%M:%S') AS time, regexp_replace(code || '_x_' || title, '[<>:\"/\\\\|?*]', '', 'g') AS file_stem FROM titles")
def prj6_keyword_records(spark, sf_dir):
    t = views.titles(spark, sf_dir)
    found = t.select("id", F.concat(F.lit("<em>"), "title", F.lit("</em>")).alias("announcementTitle"), F.col("millis").cast("string").alias("announcementTime"), F.col("code").alias("secCode"), F.lit("x").alias("secName"))
    return announcements.keyword_records(found).select("id", "title", "time", "file_stem")


@query("SELECT o_orderkey, CAST(greatest(a, b) AS DOUBLE) AS value, CAST(2 + CASE WHEN greatest(a, b) >= 1000 THEN 1 ELSE 0 END AS INTEGER) AS score FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS a, o_orderkey % 3000 + 1 AS b FROM orders)")
def win1_str6_flt8_best_candidate(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    body = F.concat(F.lit("In HKD million\nTotal revenue "), F.floor(F.col("o_totalprice") / 100).cast("string"), F.lit("\nRevenue "), (F.col("o_orderkey") % 3000 + 1).cast("string"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text"), F.lit("en").alias("lang"))
    return candidates.best(docs).where("field = 'revenue'").select(F.col("doc_id").alias("o_orderkey"), "value", "score")


#: A name for each of the 42 fields, by language, as filings print it.
_EN_NAMES = {
    "revenue": "Total revenue", "operating_cost": "Cost of sales", "gross_profit": "Gross profit", "operating_profit": "Profit from operations", "total_profit": "Profit before tax", "net_profit": "Net income",
    "net_profit_attributable_to_parent": "Profit attributable to owners", "net_profit_deducted": "Net profit excluding non-recurring items", "interest_expense": "Finance costs", "rd_expense": "R&D expense", "gross_margin": "Gross profit margin",
    "net_margin": "Net margin", "total_assets": "Total assets", "current_assets": "Total current assets", "cash_and_equivalents": "Cash and  cash equivalents", "accounts_receivable": "Trade receivables", "inventory": "Inventories",
    "fixed_assets": "Property, plant and equipment", "goodwill": "GOODWILL", "intangible_assets": "Intangible assets", "total_liabilities": "Total liabilities", "current_liabilities": "Total current liabilities",
    "short_term_debt": "Short-term borrowings", "long_term_debt": "Long-term borrowings", "bonds_payable": "Bonds payable", "total_equity": "Total equity", "equity_attributable_to_parent": "Equity attributable to owners of the parent",
    "operating_cash_flow": "Net cash from operating activities", "investing_cash_flow": "Net cash used in investing activities", "financing_cash_flow": "Net cash used in financing activities", "capital_expenditure": "Capital expenditure",
    "free_cash_flow": "Free cash flow", "eps": "Basic earnings per share", "eps_diluted": "Diluted earnings per share", "bps": "Net assets per share", "dividend_per_share": "Dividend per share", "roe": "Return on equity", "roa": "Return on assets",
    "debt_ratio": "Gearing ratio", "current_ratio": "Current ratio", "quick_ratio": "Quick ratio", "total_shares": "Issued shares",
}
_ZH_NAMES = {
    "revenue": "营业总收入", "operating_cost": "营业成本", "gross_profit": "毛利", "operating_profit": "营业利润", "total_profit": "利润总额", "net_profit": "净利润", "net_profit_attributable_to_parent": "归属于母公司股东的净利润",
    "net_profit_deducted": "扣非净利润", "interest_expense": "利息支出", "rd_expense": "研发费用", "gross_margin": "毛利率", "net_margin": "净利率", "total_assets": "资产总计", "current_assets": "流动资产合计", "cash_and_equivalents": "货币资金",
    "accounts_receivable": "应收账款", "inventory": "存货", "fixed_assets": "固定资产", "goodwill": "商誉", "intangible_assets": "无形资产", "total_liabilities": "负债合计", "current_liabilities": "流动负债合计", "short_term_debt": "短期借款",
    "long_term_debt": "长期借款", "bonds_payable": "应付债券", "total_equity": "股东权益合计", "equity_attributable_to_parent": "归属于母公司所有者的权益", "operating_cash_flow": "经营活动产生的现金流量净额",
    "investing_cash_flow": "投资活动产生的现金流量净额", "financing_cash_flow": "筹资活动产生的现金流量净额", "capital_expenditure": "购建固定资产支付的现金", "free_cash_flow": "自由现金流量", "eps": "基本每股收益", "eps_diluted": "稀释每股收益",
    "bps": "每股净资产", "dividend_per_share": "每股股利", "roe": "加权平均净资产收益率", "roa": "总资产收益率", "debt_ratio": "资产负债率", "current_ratio": "流动比率", "quick_ratio": "速动比率", "total_shares": "总股本",
}


def _fields_sql(names: dict) -> str:
    of = ", ".join(f"({k}, '{m}')" for k, m in enumerate(names))
    return f"SELECT p_partkey, metric AS field, CAST(p_size % 40 + 1 AS DOUBLE) + k AS value FROM part, (VALUES {of}) AS f(k, metric)"


def _fields(spark, sf_dir, names: dict, lang: str):
    """A filing's text that names every field once, in its own line; each field's best candidate is its own amount."""
    p = views.table(spark, sf_dir, "part")
    lines = [F.concat(F.lit(f"{name}: "), (F.col("p_size") % 40 + 1 + k).cast("string")) for k, name in enumerate(names.values())]
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"), F.lit(lang).alias("lang"))
    return candidates.best(docs).select(F.col("doc_id").alias("p_partkey"), "field", "value")


@query(_fields_sql(_EN_NAMES))
def str7_english_fields(spark, sf_dir):
    return _fields(spark, sf_dir, _EN_NAMES, "en")


@query(_fields_sql(_ZH_NAMES))
def str7_chinese_fields(spark, sf_dir):
    return _fields(spark, sf_dir, _ZH_NAMES, "zh")


@query(
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'revenue' ELSE 'net_profit' END AS field, CASE o_orderkey % 3 WHEN 2 THEN (o_custkey % 50 + 1) * 1000.0 ELSE CAST(5000000 + o_custkey AS DOUBLE) END AS value FROM orders"
)
def str7_amounts_past_notes_and_ahead(spark, sf_dir):
    """A note's number between name and amount, with and without the name in two languages; an amount in words' units ahead of the name."""
    o = views.table(spark, sf_dir, "orders")
    big = F.format_number(F.col("o_custkey") + 5000000, 0)
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Profit for the year 年內溢利 12 "), big)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Net profit 7 "), big)).otherwise(F.concat(F.lit("It had $"), (F.col("o_custkey") % 50 + 1).cast("string"), F.lit(" billion of revenue, as planned.")))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text"), F.lit("en").alias("lang"))
    return candidates.best(docs).select(F.col("doc_id").alias("o_orderkey"), "field", "value")


@query("SELECT o_orderkey, 'k: ' || o_custkey AS line, CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1000.0 WHEN 2 THEN 0.001 ELSE 1.0 END::DOUBLE AS multiplier FROM orders")
def str4_str5_lines_and_units(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    head = F.lit("head\n")
    body = F.concat(head, F.lit("k: "), F.col("o_custkey").cast("string"), F.lit("\ntail"))
    near = F.element_at(F.array(*map(F.lit, ["RMB'000", "US$ billion", "in thousand", "RMB million"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", text.line_of(body, F.lit(6), F.lit(8)).alias("line"), numbers.unit_multiplier(F.lit("x"), near).alias("multiplier"))


@query("SELECT o_orderkey, CAST(o_custkey * 1000 + 500 AS DOUBLE) AS total_sales, CASE WHEN o_orderkey % 2 = 0 THEN 7.0 END::DOUBLE AS total_payables FROM orders")
def agg13_related_totals(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    body = F.concat(F.lit("向关联方销售商品金额："), F.col("o_custkey").cast("string"), F.lit(",500 "), F.when(F.col("o_orderkey") % 2 == 0, "应付关联方款项：7").otherwise(""))
    return context.related_totals(o.select("o_orderkey", body.alias("text"))).select("o_orderkey", "total_sales", "total_payables")
