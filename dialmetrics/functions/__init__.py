from .codes import CLEAN_CODES, CODE_CATEGORY, clean_code, code_category
from .semantics import (
    if_else_na, lookup, parse_date, parse_dmy, parse_timestamp, paste_na, r_n_distinct, r_sum,
    r_week, ratio, round_k, to_int,
)

__all__ = [
    "CLEAN_CODES", "CODE_CATEGORY", "clean_code", "code_category", "if_else_na", "lookup",
    "parse_date", "parse_dmy", "parse_timestamp", "paste_na", "r_n_distinct", "r_sum", "r_week",
    "ratio", "round_k", "to_int",
]
