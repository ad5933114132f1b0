from .extract import (
    RAW_COLUMNS, RAW_SCHEMA, clean_query_text, conform_extract, load_extract_jdbc,
    load_extract_parquet, load_extract_sql, read_sql_file,
)
from .dictionary import data_dictionary, dictionary_values
from .fixture import customer_dimension, raw_extract
from .sinks import write_chart_frame, write_report, write_reports
from .store import ATTEMPTS_SCHEMA, read_attempts, write_attempts

__all__ = [
    "ATTEMPTS_SCHEMA", "data_dictionary", "dictionary_values", "read_attempts", "write_attempts", "write_chart_frame",
    "write_report", "write_reports",
    "RAW_COLUMNS", "RAW_SCHEMA", "clean_query_text", "conform_extract", "customer_dimension",
    "load_extract_jdbc", "load_extract_parquet", "load_extract_sql", "raw_extract",
    "read_sql_file",
]
