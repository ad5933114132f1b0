from .oracle import oracle_sql
from .registry import REPORTS, load_attempts, queries, run_report

__all__ = ["REPORTS", "load_attempts", "oracle_sql", "queries", "run_report"]
