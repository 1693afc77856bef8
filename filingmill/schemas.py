"""The tables of the library, as DDL."""

from __future__ import annotations

from .vocab import FIELDS

REGISTRY = (
    "id bigint, stock_code string, stock_name string, market string, report_type string, report_year int, report_quarter int, announcement_date timestamp_ntz, original_title string, "
    "file_path string, file_name string, file_size bigint, file_hash string, source_url string, source_name string, metadata_json string, is_available boolean, download_time timestamp_ntz, last_accessed timestamp_ntz"
)
CACHE = ("file_hash string, schema_version string, extractor_version string, payload string, extraction_ms bigint, field_count int, created_at timestamp_ntz")
CN_FEED = (
    "announcements array<struct<announcementId:string,secCode:string,secName:string,announcementTitle:string,announcementTime:string,adjunctUrl:string,adjunctSize:string>>, totalRecordNum int, totalpages int, hasMore boolean"
)
HK_ITEM = "struct<newsId:string,title:string,webPath:string,relTime:string,size:string,market:string,stock:array<struct<sc:string,sn:string>>>"
PAGES = ("doc_id string, file_name string, page_no int, text string")
CELLS = ("doc_id string, page int, table_index int, row_no int, col_no int, cell string")
PERIODS = ("doc_id string, seq int, period_id string, scope string, fiscal_quarter int, ytd_through_quarter int, start_date string, end_date string, as_of_date string, is_primary boolean, is_comparison boolean")
OBSERVATIONS = (
    "doc_id string, obs_seq bigint, statement string, metric string, page int, table_index int, row_label string, column_header string, column_role string, column_year int, is_comparison boolean, raw_value string, value double, snippet string"
)
RECORD = "doc_id string, " + ", ".join(f"{m} double" for ms in FIELDS.values() for m in ms)

# The shapes of answers to searches, listings and extractions.
REPORT_INFO = "title string, url string, publish_date string, report_type string, file_size string"
SEARCH_ANSWER = f"reports array<struct<{REPORT_INFO}>>, count int, stock_code string, market string, report_type string, source string"
FILE_INFO = "id bigint, stock_code string, stock_name string, market string, report_type string, report_year int, file_path string, file_name string, file_size bigint, download_time string"
EXTRACTION = (
    "income_statement struct<revenue:double,operating_cost:double,gross_profit:double,operating_profit:double,net_profit:double,net_profit_deducted:double,rd_expense:double,gross_margin:double,net_margin:double>, "
    "balance_sheet struct<total_assets:double,total_liabilities:double,total_equity:double,current_assets:double,current_liabilities:double,cash_and_equivalents:double,accounts_receivable:double,inventory:double>, "
    "cash_flow_statement struct<operating_cash_flow:double,investing_cash_flow:double,financing_cash_flow:double,free_cash_flow:double>, "
    "financial_metrics struct<eps:double,bps:double,roe:double,roa:double,debt_ratio:double>"
)
