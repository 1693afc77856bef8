"""Facts, tables, periods and analysis over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import numbers
from ..operators import analysis, context, facts, merge, periods, shape, tables
from ..sources import documents
from ..staging import dealt, staged
from . import views
from .catalog import query
from .views import QUARTERS, STATEMENTS, TITLES_SQL


def _records(spark, sf_dir):
    s = views.statements(spark, sf_dir).withColumn("doc_id", F.concat_ws("-", F.col("company").cast("string"), F.col("fiscal_year").cast("string")))
    for m in vocab.STATEMENT_OF:
        if m not in s.columns:
            s = s.withColumn(m, F.lit(None).cast("double"))
    return s


_DERIVED = f"""WITH {STATEMENTS}, d AS (SELECT *, company || '-' || fiscal_year AS doc_id, revenue - operating_cost AS gross_profit, operating_cash_flow - capital_expenditure AS free_cash_flow FROM statements)"""
_MARGIN, _NET = "floor(gross_profit / revenue * 100 * 100 + 0.5) / 100", "floor(net_profit / revenue * 100 * 100 + 0.5) / 100"


@query(
    _DERIVED
    + "".join(
        (", f AS (" if k == 0 else " UNION ALL ") + f"SELECT doc_id, '{m}' AS metric, CAST({e} AS DOUBLE) AS value, {d} AS is_derived, fiscal_year FROM d" + (f" WHERE {w}" if w else "")
        for k, (m, e, d, w) in enumerate(
            [("revenue", "revenue", "false", ""), ("operating_cost", "operating_cost", "false", ""), ("gross_profit", "gross_profit", "true", "revenue <> 0 AND operating_cost <> 0"), ("net_profit", "net_profit", "false", ""),
             ("gross_margin", _MARGIN, "true", "gross_profit <> 0 AND revenue <> 0"), ("net_margin", _NET, "true", "net_profit <> 0 AND revenue <> 0"), ("operating_cash_flow", "operating_cash_flow", "false", ""),
             ("capital_expenditure", "capital_expenditure", "false", ""), ("free_cash_flow", "free_cash_flow", "true", "")]
        )
    )
    + ") SELECT doc_id, metric, fiscal_year || 'FY' AS period_id, value, is_derived, CASE WHEN is_derived THEN 'derived' ELSE 'text_regex' END AS source_method, CASE WHEN is_derived THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM f"
)
def prj8_mth1_facts(spark, sf_dir):
    """Wide yearly records to derived facts with method and confidence; without tables, so without evidence."""
    both = staged(_records(spark, sf_dir).select("doc_id", "fiscal_year", *vocab.STATEMENT_OF))
    records = facts.derive(both.drop("fiscal_year"))
    spans = periods.periods(both.select("doc_id", "fiscal_year", F.lit("annual").alias("kind")))
    v = facts.metric_values(records, spans)
    method = F.when(F.col("is_derived"), "derived").otherwise("text_regex")
    return v.select("doc_id", "metric", "period_id", "value", "is_derived", method.alias("source_method"), F.when(F.col("is_derived"), 1.0).otherwise(0.75).alias("confidence"))


@query(_DERIVED + ", m AS (SELECT doc_id, fiscal_year, CASE WHEN abs(operating_cash_flow - capital_expenditure - operating_cash_flow * 0.5) / greatest(abs(operating_cash_flow * 0.5), 1.0) > 0.1 THEN 1 ELSE 0 END AS bad FROM d) SELECT doc_id, fiscal_year || 'FY' AS period_id, 'free_cash_flow' AS \"check\" FROM m WHERE bad = 1")
def mth2_cross_checks(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("free_cash_flow", F.col("operating_cash_flow") * 0.5)
    long = r.unpivot(["doc_id", "fiscal_year"], ["operating_cash_flow", "capital_expenditure", "free_cash_flow"], "metric", "value").withColumn("period_id", F.concat(F.col("fiscal_year").cast("string"), F.lit("FY")))
    return facts.cross_checks(long)


@query(_DERIVED + " SELECT doc_id, CASE WHEN company % 3 = 0 THEN 'partial' ELSE 'ok' END AS status, CAST(CASE WHEN company % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_issues FROM d")
def agg8_quality_status(spark, sf_dir):
    r = _records(spark, sf_dir).select("doc_id", "company")
    issue = F.struct(F.lit("unit_inferred").alias("type"), F.lit("warning").alias("severity"), F.lit("m").alias("message"), F.array(F.lit("x")).alias("affected_facts"))
    q = facts.quality(r, r.where("company % 3 = 0").select("doc_id", F.lit(1).alias("issue_seq"), issue.alias("issue")))
    return q.select("doc_id", "status", F.size("issues").alias("n_issues"))


_FLT7 = "WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber * 100000 + l_partkey AS fact_seq, l_discount * 10 AS confidence FROM lineitem)"


def _confidence(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    f = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("fact_seq"), F.lit("s").alias("statement"), F.col("l_partkey").cast("string").alias("metric"), F.lit("p").alias("period_id"), (F.col("l_discount") * 10).alias("confidence"))
    q = li.select(F.col("l_orderkey").alias("doc_id")).distinct().withColumns({"status": F.lit("ok"), "issues": F.array().cast(f"array<{facts.ISSUE}>")})
    return facts.confident(f, q, 0.35)


@query(_FLT7 + " SELECT doc_id, CASE WHEN count(*) FILTER (NOT confidence >= 0.35) > 0 THEN 'partial' ELSE 'ok' END AS status, CAST(count(*) FILTER (NOT confidence >= 0.35) AS INTEGER) AS n_removed FROM f GROUP BY 1")
def flt7_confidence_filter(spark, sf_dir):
    q = _confidence(spark, sf_dir)[1]
    return q.select("doc_id", "status", F.when(F.size("issues") > 0, F.size(F.get("issues", F.lit(0))["affected_facts"])).otherwise(0).alias("n_removed"))


@query(_FLT7 + " SELECT doc_id, fact_seq FROM f WHERE confidence >= 0.35")
def flt7_confident_facts(spark, sf_dir):
    return _confidence(spark, sf_dir)[0].select("doc_id", "fact_seq")


_KINDS = ["semi_annual", "q4_full_year", "q1", "q2", "q3", "q4", "annual", "none"]


def _rule_values() -> str:
    spans = [(k, n, s, shift, scope) for n, (k, s, shift, scope, *_) in enumerate(vocab.PERIOD_RULES)]
    instants = [(k, 100 + n, "BS_" + day, shift, "point_in_time") for n, (k, day, shift, *_) in enumerate(vocab.INSTANT_RULES)]
    return ", ".join(f"('{k}', {n}, '{s}', {shift}, '{scope}')" for k, n, s, shift, scope in spans + instants)


@query(
    "WITH f AS (SELECT o_orderkey AS doc_id, ([" + ", ".join(f"'{k}'" for k in _KINDS) + f"])[CAST(o_orderkey % {len(_KINDS)} AS INTEGER) + 1] AS kind, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate) END AS y FROM orders), r(kind, seq, suffix, shift, scope) AS (VALUES {_rule_values()}) "
    "SELECT doc_id, seq, CASE WHEN scope = 'point_in_time' THEN 'BS_' || (y + shift) || '-' || substr(suffix, 4) ELSE (y + shift) || suffix END AS period_id, scope FROM f JOIN r USING (kind) WHERE y IS NOT NULL"
)
def prj11_periods(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS) + 1).cast("int"))
    filings = o.select(F.col("o_orderkey").alias("doc_id"), kind.alias("kind"), F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate")).alias("fiscal_year"))
    return periods.periods(filings).select("doc_id", "seq", "period_id", "scope")


@query(
    "WITH f AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 2 = 0 AS a FROM orders) SELECT doc_id, CASE WHEN a THEN y || 'FY' ELSE y || 'Q3_YTD' END AS primary_id, CASE WHEN a THEN 'BS_' || y || '-12-31' ELSE 'BS_' || y || '-09-30' END AS balance_id, CASE WHEN a THEN (y - 1) || 'FY' END AS comparison_id, CASE WHEN NOT a THEN y || 'Q3_SINGLE' END AS single_id, CASE WHEN a THEN 'full_year,unknown' ELSE 'ytd,unknown' END AS roles FROM f"
)
def prj12_flt12_period_keys(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    filings = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "annual").otherwise("q3").alias("kind"), F.year("o_orderdate").alias("fiscal_year"))
    roles = F.array_join(periods.allowed_roles(F.col("primary_scope"), F.lit(vocab.INCOME)), ",")
    return periods.period_keys(periods.periods(filings)).select("doc_id", "primary_id", "balance_id", "comparison_id", "single_id", roles.alias("roles"))


_OBS = """WITH o AS (SELECT l_partkey AS doc_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS obs_seq, floor(l_extendedprice) AS value, CASE l_linestatus WHEN 'O' THEN 'full_year' ELSE 'unknown' END AS role, l_returnflag = 'R' AS cmp FROM lineitem),
s AS (SELECT *, role = 'full_year' AS strict, bool_or(role = 'full_year') OVER (PARTITION BY doc_id) AS has FROM o), c AS (SELECT * FROM s WHERE CASE WHEN has THEN strict OR cmp ELSE true END),
m AS (SELECT *, bool_or(NOT cmp) OVER (PARTITION BY doc_id) AS main FROM c)"""


def _observed(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")).cast("long")
    o = dealt(views.table(spark, sf_dir, "lineitem"), "l_partkey").select(
        F.col("l_partkey").alias("doc_id"), seq.alias("obs_seq"), F.lit(vocab.INCOME).alias("statement"), F.lit("revenue").alias("metric"), F.lit(1).alias("page"), F.lit(1).alias("table_index"), seq.cast("string").alias("row_label"),
        F.lit("h").alias("column_header"), F.when(F.col("l_linestatus") == "O", "full_year").otherwise("unknown").alias("column_role"), F.lit(None).cast("int").alias("column_year"), (F.col("l_returnflag") == "R").alias("is_comparison"),
        F.lit("v").alias("raw_value"), F.floor("l_extendedprice").cast("double").alias("value"), F.lit("s").alias("snippet"),
    )
    v = o.select("doc_id", "statement", "metric").distinct().withColumns({"value": F.lit(20000.0), "allowed": F.array(F.lit("full_year"), F.lit("unknown"))})
    return v, o


@query(_OBS + " SELECT doc_id, obs_seq, value FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN NOT cmp OR NOT main THEN 0 ELSE 1 END, CASE WHEN has THEN -value ELSE abs(value - 20000) END, CASE WHEN has AND NOT strict THEN 1 ELSE 0 END, obs_seq) = 1")
def win2_primary_observation(spark, sf_dir):
    return facts.primary_observations(*_observed(spark, sf_dir)).select("doc_id", "o.obs_seq", "o.value")


@query(
    _OBS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN NOT cmp OR NOT main THEN 0 ELSE 1 END, CASE WHEN has THEN -value ELSE abs(value - 20000) END, CASE WHEN has AND NOT strict THEN 1 ELSE 0 END, obs_seq) AS rank, bool_or(cmp) OVER (PARTITION BY doc_id) AS marked FROM m),
p AS (SELECT doc_id, value AS pv FROM r WHERE rank = 1), t AS (SELECT r.*, pv, CASE WHEN cmp THEN 2 WHEN rank > 1 AND abs(value - pv) > 1e-9 AND (NOT cmp OR NOT main) AND NOT marked THEN 3 END AS tier FROM r JOIN p USING (doc_id))
SELECT doc_id, obs_seq, value FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, CASE WHEN tier < 3 THEN abs(value - pv) ELSE rank END, obs_seq) = 1"""
)
def win3_comparison_observation(spark, sf_dir):
    return facts.chosen_observations(*_observed(spark, sf_dir)).where("place = 'comparison'").select("doc_id", "obs_seq", "value")


_CELLS = "cells AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id AS INTEGER) AS col_no, CASE WHEN event_id % 3 = 0 THEN event_type || ' ' || (2020 + event_id % 5) WHEN event_id % 3 = 1 THEN '' END AS cell FROM events WHERE event_id > 0)"


@query(f"WITH {_CELLS} SELECT doc_id, col_no, h AS column_header, CAST(nullif(regexp_extract(coalesce(h, ''), '20[0-9]{{2}}'), '') AS INTEGER) AS column_year, coalesce(CAST(nullif(regexp_extract(coalesce(h, ''), '20[0-9]{{2}}'), '') AS INTEGER) < 2023, false) AS is_comparison FROM (SELECT *, last_value(nullif(cell, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY col_no ROWS UNBOUNDED PRECEDING) AS h FROM cells)")
def win4_header_forward_fill(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").where("event_id > 0")
    cell = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" "), (2020 + F.col("event_id") % 5).cast("string"))).when(F.col("event_id") % 3 == 1, "")
    cells = e.select(F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_index"), F.lit(0).alias("row_no"), F.col("event_id").cast("int").alias("col_no"), cell.alias("cell"))
    docs = cells.select("doc_id").distinct().withColumn("fiscal_year", F.lit(2023))
    return tables.column_profiles(cells, docs).select("doc_id", "col_no", "column_header", "column_year", "is_comparison")


_ROW = "v AS (SELECT l_orderkey, list(CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END ORDER BY l_linenumber, l_partkey, l_quantity) AS a FROM lineitem GROUP BY 1)"


@query(f"WITH {_ROW} SELECT l_orderkey, list_filter(a, lambda x: x > 30)[1] AS first_above, coalesce(a[3], a[4], a[5], a[2]) AS near FROM v WHERE len(a) > 2 UNION ALL SELECT l_orderkey, list_filter(a, lambda x: x > 30)[1], NULL FROM v WHERE len(a) <= 2")
def win5_win7_row_values(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_linenumber") % 3 != 1, F.col("l_quantity").cast("double")).alias("v")).alias("x"))
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("a"))
    return rows.select("l_orderkey", tables.first_above(F.col("a"), F.lit(30.0)).alias("first_above"), tables.value_near(F.col("a"), F.lit(2)).alias("near"))


@query("WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS col_no, CAST(1990 + l_suppkey % 30 AS INTEGER) AS y, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem), u AS (SELECT * FROM c WHERE k = 1 AND y >= 2000), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY col_no DESC) <= 2) SELECT doc_id, CAST(col_no AS INTEGER) AS year_end_col FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, col_no) = 1")
def win6_year_end_column(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_extendedprice")
    li = views.table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1")
    cells = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_index"), F.lit(0).alias("row_no"), F.col("l_linenumber").alias("col_no"), F.concat(F.lit("31/12/"), (1990 + F.col("l_suppkey") % 30).cast("string")).alias("cell"))
    return tables.year_end_columns(cells).select("doc_id", "year_end_col")


@query("WITH v AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, floor(l_extendedprice) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS value FROM lineitem), u AS (SELECT l_partkey, seq, max(value) AS value FROM v GROUP BY 1, 2) SELECT l_partkey, arg_max(value, row(abs(value), seq)) AS largest, arg_min(value, seq) AS first FROM u GROUP BY 1")
def agg6_agg7_row_picks(spark, sf_dir):
    li = dealt(views.table(spark, sf_dir, "lineitem"), "l_partkey")
    v = li.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.floor("l_extendedprice") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).cast("double").alias("value"))
    u = v.groupBy("l_partkey", "seq").agg(F.max("value").alias("value"))
    both = u.withColumn("metric", F.explode(F.array(F.lit("revenue"), F.lit("eps"))))
    offered = both.select(F.col("l_partkey").alias("doc_id"), "metric", "seq", "value", F.lit("en").alias("lang"))
    records = li.select(F.col("l_partkey").alias("doc_id")).distinct().select("doc_id", *(F.lit(None).cast("double").alias(m) for m in vocab.STATEMENT_OF))
    return tables.table_pass(records, offered).select(F.col("doc_id").alias("l_partkey"), F.col("revenue").alias("largest"), F.col("eps").alias("first"))


_LABELS = [(m, w) for m, ws in vocab.LABELS["en"].items() for w in ws]
_NOT = [(m, w) for m, ws in vocab.NOT_LABELS.items() for w in ws]
_LABEL = "(['Total ', 'Other ', 'Net ', '', 'noncontrolling '])[CAST(p_partkey % 5 AS INTEGER) + 1] || (['Revenues', 'revenue', 'profit for the year', 'Gross Profit', 'total assets', 'Earnings per share', 'prerevenue', 'income before tax'])[CAST(p_partkey % 8 AS INTEGER) + 1] || ' (' || p_size || ')'"


def _values(rows) -> str:
    return ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in rows)


@query(
    f"WITH l AS (SELECT p_partkey, {_LABEL} AS label FROM part), k(metric, word) AS (VALUES {_values(_LABELS)}), b(metric, token) AS (VALUES {_values(_NOT)}) "
    "SELECT DISTINCT p_partkey, k.metric FROM l JOIN k ON regexp_matches(lower(label), '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)') WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.metric = k.metric AND contains(lower(label), token))"
)
def jon7_flt9_label_metrics(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % n + 1).cast("int"))
    label = F.concat(at(["Total ", "Other ", "Net ", "", "noncontrolling "], 5), at(["Revenues", "revenue", "profit for the year", "Gross Profit", "total assets", "Earnings per share", "prerevenue", "income before tax"], 8), F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    labels = p.select("p_partkey", F.lit("en").alias("lang"), label.alias("label"))
    return labels.join(tables.label_metrics(labels), ["lang", "label"]).select("p_partkey", "metric").distinct()


@query("SELECT l_orderkey, CASE WHEN h LIKE '%cash flow%' THEN 'cash_flow_statement' WHEN h LIKE '%balance sheet%' THEN 'balance_sheet' WHEN h LIKE '%profit or loss%' THEN 'income_statement' ELSE 'unknown' END AS statement, CASE WHEN h LIKE '%as at%' THEN 'point_in_time' WHEN h LIKE '%three months%' THEN 'single_q' ELSE 'unknown' END AS role FROM (SELECT l_orderkey, l_linenumber, l_partkey, lower((['Cash Flow of AIR', 'Balance Sheet as at', 'Profit or Loss three months', 'Notes'])[CAST(l_partkey % 4 AS INTEGER) + 1]) AS h FROM lineitem)")
def str11_str12_headers(spark, sf_dir):
    names = F.array(*map(F.lit, ["Cash Flow of AIR", "Balance Sheet as at", "Profit or Loss three months", "Notes"]))
    h = F.lower(F.element_at(names, (F.col("l_partkey") % 4 + 1).cast("int")))
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", tables.statement_of(h).alias("statement"), tables.role_of(h).alias("role"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(max(l_linenumber) AS INTEGER) AS n_rows, count(*) FILTER (l_linenumber = 1) AS n_cols FROM lineitem GROUP BY 1")
def src2_table_sizes(spark, sf_dir):
    cells = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_index"), (F.col("l_linenumber") - 1).alias("row_no"), F.lit(0).alias("col_no"), F.lit("x").alias("cell"))
    return documents.table_sizes(cells).select("doc_id", "n_rows", "n_cols")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg(text, '\n\n' ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY 1")
def src3_src20_full_texts(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("f").alias("file_name"), F.col("turn").cast("int").alias("page_no"), "text")
    return documents.full_texts(pages, "\n\n").select("doc_id", "text")


@query("SELECT doc_id, lang AS statement FROM (SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 2 END AS tier FROM documents) WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY source)")
def set7_fallback_tiers(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.col("lang"))
    profiles = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.lit(1).alias("table_index"), F.when(F.col("lang") == "en", vocab.CASH).when(F.col("lang") == "fr", "unknown").otherwise(vocab.INCOME).alias("statement"), "lang")
    return tables.tables_for(profiles, vocab.CASH).select(F.col("page").alias("doc_id"), F.col("lang").alias("statement"))


@query("SELECT o_orderkey, 'ev_' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), 4, '0') AS evidence_id FROM orders")
def win9_evidence_ids(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("ev_%04d", n).alias("evidence_id"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS ids FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def set4_ordered_union(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    names = F.transform("x", lambda x: x["o_orderpriority"])
    half = F.ceil(F.size("x") / 2).cast("int")
    from ..functions.arrays import ordered_union

    return o.select("o_custkey", F.array_join(ordered_union(F.slice(names, F.lit(1), half), F.slice(names, half + 1, F.size("x"))), ",").alias("ids"))


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 END, 999), o_orderkey) = 1")
def win12_canonical(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumn("rank", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 4))
    return analysis.canonical(o, ["o_custkey", "o_orderstatus"], "rank", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query(f"WITH {QUARTERS}, y AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY company, fiscal_year ORDER BY quarter) AS BIGINT) AS ytd FROM quarters) SELECT company, fiscal_year, quarter, CASE WHEN quarter = 1 THEN ytd WHEN lag(quarter) OVER w = quarter - 1 THEN ytd - lag(ytd) OVER w END AS single FROM y WINDOW w AS (PARTITION BY company, fiscal_year ORDER BY quarter)")
def win13_single_quarters(spark, sf_dir):
    from pyspark.sql import Window

    q = views.quarters(spark, sf_dir).withColumn("ytd", F.sum("amount").over(Window.partitionBy("company", "fiscal_year").orderBy("quarter")))
    return analysis.single_quarters(q, ["company"], "fiscal_year", "quarter", "ytd").select("company", "fiscal_year", "quarter", "single")


@query(f"WITH {QUARTERS} SELECT company, q_no, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(amount) OVER w AS BIGINT) END AS ttm FROM quarters WINDOW w AS (PARTITION BY company ORDER BY q_no RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)")
def agg14_ttm(spark, sf_dir):
    return analysis.trailing(views.quarters(spark, sf_dir), ["company"], "q_no", "amount").select("company", "q_no", "ttm")


@query(f"WITH {QUARTERS} SELECT a.company, a.q_no, (a.amount - b.amount) / CAST(abs(b.amount) AS DOUBLE) AS qoq, (a.amount - c.amount) / CAST(abs(c.amount) AS DOUBLE) AS yoy FROM quarters a LEFT JOIN quarters b ON a.company = b.company AND a.q_no = b.q_no + 1 LEFT JOIN quarters c ON a.company = c.company AND a.q_no = c.q_no + 4")
def win14_growth(spark, sf_dir):
    return analysis.growth(views.quarters(spark, sf_dir), ["company"], "q_no", "amount").select("company", "q_no", "qoq", "yoy")


@query(f"WITH {TITLES_SQL} SELECT id, CAST(id AS DOUBLE) * CASE id % 4 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 WHEN 2 THEN 1e3 ELSE 1.0 END AS amount, CASE WHEN id % 10 > 9 THEN 'merge' WHEN id % 10 = 8 OR id % 10 = 9 THEN 'review' ELSE 'keep_apart' END AS band FROM titles")
def mth4_mth5_units_and_bands(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["billion", "million", "thousand", "none"])), (F.col("id") % 4 + 1).cast("int"))
    return views.titles(spark, sf_dir).select("id", numbers.to_currency_units(F.col("id").cast("double"), unit).alias("amount"), numbers.similarity_band((F.col("id") % 10) / 10.0).alias("band"))


@query(_DERIVED + " SELECT doc_id, CAST(0 AS BIGINT) AS errors, count(*) AS warnings, 'review' AS gate FROM d WHERE company % 3 = 0 GROUP BY 1")
def agg15_validation_report(spark, sf_dir):
    r = _records(spark, sf_dir).where("company % 3 = 0")
    return analysis.validation_report(r.select("doc_id", F.struct(F.lit("warning").alias("severity")).alias("issue")))


@query("SELECT doc_id, issue FROM (SELECT l_orderkey AS doc_id, l_returnflag AS issue, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2)")
def win10_issue_dedup(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("issue"), "l_linenumber")
    return merge.insert_ignore(li.limit(0), li, ["doc_id", "issue"], "l_linenumber").select("doc_id", "issue")


@query(_DERIVED + " SELECT doc_id, CAST(9 AS INTEGER) - CASE WHEN company % 2 = 0 THEN 1 ELSE 0 END AS n FROM d")
def agg4_filled_fields(spark, sf_dir):
    from ..functions.arrays import filled_fields

    r = _records(spark, sf_dir).withColumn("revenue", F.when(F.col("company") % 2 != 0, F.col("revenue")))
    return r.select("doc_id", filled_fields([F.col(m) for m in vocab.STATEMENT_OF], [F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))]).alias("n"))


@query("SELECT o_orderkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS stock_code, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE c_name END AS stock_name, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'US' END, c_mktsegment) AS market FROM orders JOIN customer ON o_custkey = c_custkey")
def prj3_jon13_identity_context(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    docs = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("file_hash"), F.lit("?").alias("stock_code"), F.when(F.col("o_orderkey") % 3 == 0, "own").alias("stock_name"), F.when(F.col("o_orderkey") % 2 == 0, "US").alias("market"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file_hash"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code"), F.col("c_name").alias("stock_name"), F.col("c_mktsegment").alias("market"))
    return context.with_identity(docs, c).select("o_orderkey", "stock_code", "stock_name", "market")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 5 <> 0")
def jon6_files_by_url(spark, sf_dir):
    files = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("url"))
    reports = views.table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("url"), "o_custkey")
    return context.downloaded_with_metadata(files, reports).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 2 THEN 'USD' END AS currency, CASE p_partkey % 4 WHEN 0 THEN 'million' WHEN 1 THEN 'percent' WHEN 2 THEN 'per_share' ELSE 'shares' END AS unit FROM part")
def prj13_units(spark, sf_dir):
    metric = F.element_at(F.array(*map(F.lit, ["revenue", "roe", "eps", "total_shares"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = views.table(spark, sf_dir, "part").select("p_partkey", context.unit_of(metric, F.lit("million"), F.lit("USD")).alias("u"))
    return p.select("p_partkey", "u.*")


@query("SELECT n_nationkey, 'N' || n_nationkey AS report_date, CAST(n_nationkey * 1000 AS DOUBLE) AS total_assets, CASE WHEN n_regionkey = 1 THEN 'n/a' END AS raw_cash FROM nation")
def prj5_str2_standard_columns(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("fiscalDateEnding"), F.concat(F.lit("$"), F.col("n_nationkey").cast("string"), F.lit(",000")).alias("totalAssets"), F.when(F.col("n_regionkey") == 1, "n/a").otherwise("5").alias("cash"))
    s = shape.statements(rows, "balance_sheet", "X", "s")
    return s.select(F.substring("report_date", 2, 9).cast("int").alias("n_nationkey"), "report_date", F.col("total_assets.num").alias("total_assets"), F.col("cash_and_equivalents.raw").alias("raw_cash"))


@query("SELECT l_orderkey AS doc_id, CAST(count(*) AS INTEGER) AS n_facts, string_agg(l_partkey, ',' ORDER BY k) AS metrics FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) GROUP BY 1")
def arr4_arr3_payloads(spark, sf_dir):
    """Assembled to JSON, and read back."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    f = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), k.alias("fact_seq"), F.col("l_partkey").cast("string").alias("metric"))
    d = f.select("doc_id").distinct()
    empty = lambda order: d.withColumn(order, F.lit("1")).limit(0)
    q = d.withColumns({"status": F.lit("ok"), "issues": F.array().cast(f"array<{facts.ISSUE}>")})
    p = context.payloads(f, empty("evidence_id"), empty("seq"), q)
    back = context.read_payloads(p, "facts array<struct<fact_seq:int,metric:string>>")
    return back.select("doc_id", F.size("parsed.facts").alias("n_facts"), F.array_join(F.transform("parsed.facts", lambda x: x["metric"]), ",").alias("metrics"))


@query("SELECT CAST(event_id AS VARCHAR) AS \"announcementId\", CAST(user_id AS VARCHAR) AS \"secCode\", '' AS \"adjunctUrl\" FROM events")
def snk14_control_sheet(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("announcementId"), F.col("user_id").alias("secCode"))
    return context.control_sheet(e).select("announcementId", "secCode", "adjunctUrl")


@query(
    f"""WITH {STATEMENTS} SELECT company || '-' || fiscal_year AS doc_id, 'gross_profit' AS metric, 'ev_0001,ev_0002' AS ids FROM statements WHERE company % 2 = 0 AND revenue <> 0 AND operating_cost <> 0
UNION ALL SELECT company || '-' || fiscal_year, m, i FROM statements, (VALUES ('revenue', 'ev_0001'), ('operating_cost', 'ev_0002')) x(m, i) WHERE company % 2 = 0"""
)
def jon10_win9_evidence(spark, sf_dir):
    """Facts with evidence from one table each; the derived one inherits. parity: only from facts before it."""
    r = facts.derive(_records(spark, sf_dir).where("company % 2 = 0").select("doc_id", *(m if m in ("revenue", "operating_cost") else F.lit(None).cast("double").alias(m) for m in vocab.STATEMENT_OF)))
    spans = periods.periods(_records(spark, sf_dir).select("doc_id", "fiscal_year", F.lit("annual").alias("kind")))
    both = r.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("obs_seq"), F.lit(m).alias("metric"), F.col(m).alias("value")) for k, m in enumerate(("revenue", "operating_cost"))))).alias("o")).select("doc_id", "o.*")
    seen = both.select(
        "doc_id", "obs_seq", F.lit(vocab.INCOME).alias("statement"), "metric", F.lit(1).alias("page"), F.lit(1).alias("table_index"), F.col("metric").alias("row_label"), F.lit("h").alias("column_header"), F.lit("full_year").alias("column_role"),
        F.lit(None).cast("int").alias("column_year"), F.lit(False).alias("is_comparison"), F.col("value").cast("string").alias("raw_value"), "value", F.lit("s").alias("snippet"),
    )
    docs = r.select("doc_id", F.lit("USD").alias("currency"), F.lit("million").alias("amount_unit"))
    found = facts.build_facts(r, spans, seen, docs, parity=True)[0]
    return found.where(F.col("metric").isin("revenue", "operating_cost", "gross_profit")).select("doc_id", "metric", F.array_join("evidence_ids", ",").alias("ids"))


#: What a filing of the graph's queries gives, as SQL that both engines read; what isn't here is derived, where its formula allows. debt_ratio is always computed anew.
_GIVEN = {
    "revenue": "revenue", "operating_cost": "CASE WHEN company % 3 <> 1 THEN operating_cost END", "gross_profit": "CASE WHEN company % 3 <> 0 THEN revenue - operating_cost END", "net_profit": "net_profit",
    "total_assets": "revenue * 2", "current_assets": "revenue", "inventory": "CASE WHEN company % 5 <> 0 THEN net_profit END", "total_liabilities": "revenue", "current_liabilities": "operating_cash_flow", "total_equity": "revenue",
    "operating_cash_flow": "operating_cash_flow", "capital_expenditure": "capital_expenditure", "eps": "2.0", "debt_ratio": "50.0", "total_shares": "CASE WHEN company % 2 = 0 THEN net_profit / 2 END",
}
_DERIVED_HERE = {"operating_cost": "company % 3 = 1", "gross_profit": "company % 3 = 0", "total_shares": "company % 2 = 1"} | dict.fromkeys(["gross_margin", "net_margin", "debt_ratio", "current_ratio", "quick_ratio", "roa", "roe", "free_cash_flow", "bps"], "true")
_SEQ = {m: k for k, _, m in vocab.SPECS}
_SOUND = "revenue > operating_cost AND operating_cost > 0 AND net_profit > 0 AND operating_cash_flow > 0 AND capital_expenditure > 0"
_GRAPH = (
    f"WITH RECURSIVE {STATEMENTS}, g AS (SELECT company || '-' || fiscal_year AS doc_id, * FROM statements WHERE {_SOUND}), seen AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, {_SEQ[m]} AS seq FROM g WHERE {e} IS NOT NULL" for m, e in _GIVEN.items())
    + "), ev AS (SELECT doc_id, metric, 'ev_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS VARCHAR), 4, '0') AS id FROM seen), derived AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric FROM g WHERE {w}" for m, w in _DERIVED_HERE.items())
    + "), facts AS (SELECT doc_id, metric FROM seen UNION SELECT doc_id, metric FROM derived), deps(metric, k, dep) AS (VALUES "
    + ", ".join(f"('{m}', {k}, '{d}')" for m, (_, ds) in vocab.FORMULAS.items() for k, d in enumerate(ds))
    + "), paths AS (SELECT doc_id, metric AS root, metric AS node, []::INT[] AS path FROM facts UNION ALL SELECT p.doc_id, root, d.dep, list_append(path, d.k) FROM paths p JOIN derived x ON x.doc_id = p.doc_id AND x.metric = p.node JOIN deps d ON d.metric = p.node"
    + " JOIN facts f ON f.doc_id = p.doc_id AND f.metric = d.dep), firsts AS (SELECT p.doc_id, root, id, min(path) AS path FROM paths p JOIN ev ON ev.doc_id = p.doc_id AND ev.metric = p.node GROUP BY 1, 2, 3)"
    + " SELECT f.doc_id, f.metric, x.metric IS NOT NULL AS is_derived, coalesce(string_agg(id, ',' ORDER BY path), '') AS ids FROM facts f LEFT JOIN derived x USING (doc_id, metric) LEFT JOIN firsts t ON t.doc_id = f.doc_id AND t.root = f.metric GROUP BY 1, 2, 3"
)


@query(_GRAPH)
def jon10_evidence_through_derivations(spark, sf_dir):
    """Filings whose table has a row for each figure given; all twelve derived metrics, each with the evidence of whatever it comes from."""
    s = staged(views.statements(spark, sf_dir).where(_SOUND).withColumn("doc_id", F.concat_ws("-", F.col("company").cast("string"), F.col("fiscal_year").cast("string"))))
    given = s.select("doc_id", *(F.expr(_GIVEN.get(m, "CAST(NULL AS DOUBLE)")).cast("double").alias(m) for m in vocab.STATEMENT_OF))
    long = given.select("doc_id", F.explode(F.array(*(F.struct(F.lit(_SEQ[m]).cast("long").alias("obs_seq"), F.lit(vocab.STATEMENT_OF[m]).alias("statement"), F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _GIVEN))).alias("o")).select("doc_id", "o.*").where("value is not null")
    role = F.when(F.col("statement") == vocab.BALANCE, "point_in_time").otherwise("full_year")
    seen = long.select(
        "doc_id", "obs_seq", "statement", "metric", F.lit(1).alias("page"), F.lit(1).alias("table_index"), F.col("metric").alias("row_label"), F.lit("h").alias("column_header"), role.alias("column_role"),
        F.lit(None).cast("int").alias("column_year"), F.lit(False).alias("is_comparison"), F.col("value").cast("string").alias("raw_value"), "value", F.lit("s").alias("snippet"),
    )
    spans = periods.periods(s.select("doc_id", "fiscal_year", F.lit("annual").alias("kind")))
    docs = s.select("doc_id", F.lit("USD").alias("currency"), F.lit("million").alias("amount_unit"))
    found = facts.build_facts(facts.derive(given), spans, seen, docs)[0]
    return found.where(F.col("period_id").endswith("FY") | F.col("period_id").startswith("BS_")).select("doc_id", "metric", "is_derived", F.array_join("evidence_ids", ",").alias("ids"))
